from pyspark.sql import DataFrame, SparkSession

from frayline.llm.substring_dedup import removal_counts


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that stand in a repeated window of 35 words."""
    return removal_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
SQL = {
    "op2_substring_dedup": """
WITH words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
wins AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS win FROM words, unnest(range(1, len(w) - 33)) AS u(i) WHERE len(w) >= 35),
often AS (SELECT win FROM wins GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + k AS i FROM wins JOIN often USING (win), unnest(range(35)) AS u(k)),
cells AS (SELECT r, i, w[i] AS word FROM words, unnest(range(1, len(w) + 1)) AS u(i)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM cells ANTI JOIN gone USING (r, i) GROUP BY r),
sizes AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN sizes USING (r) LEFT JOIN kept USING (r)
"""
}
