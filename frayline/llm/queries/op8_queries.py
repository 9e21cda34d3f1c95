from pyspark.sql import DataFrame, SparkSession

from frayline.llm.jaccard_join import near_classes


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy class and number of links of every document: five words, similarity 0.8."""
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_jaccard_join": op8_jaccard_join}
SQL = {
    "op8_jaccard_join": """
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g
  FROM words, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE k / (x.n + y.n - k) >= 0.8),
reach AS (SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least_ids AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM documents JOIN least_ids i ON i.a = doc_id LEFT JOIN counts c ON c.a = doc_id
"""
}
