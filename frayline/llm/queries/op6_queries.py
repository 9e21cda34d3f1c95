from pyspark.sql import DataFrame, SparkSession

from frayline.llm.warc import archived


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back through the capture index."""
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("payload", "url")


QUERIES = {"op6_warc": op6_warc}
SQL = {
    "op6_warc": """
WITH rows AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
firsts AS (SELECT html, min(page_id) AS first_id FROM rows GROUP BY html),
digests AS (SELECT html, first_id, sha1(html) AS hex FROM firsts)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM rows JOIN digests USING (html)
"""
}
