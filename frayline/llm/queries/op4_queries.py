from pyspark.sql import DataFrame, SparkSession

from frayline.llm.tree_search import top_k


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest rows of every row whose id is divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows.filter("vec_id % 50 = 0"), rows)


QUERIES = {"op4_topk_search": op4_topk_search}
SQL = {
    "op4_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5
"""
}
