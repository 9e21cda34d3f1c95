from pyspark.sql import DataFrame, SparkSession

from frayline.llm.sharding import placed

SHARDS = 8


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal weight, and where they would be with a ninth."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return placed(documents, dict.fromkeys(range(SHARDS), 1.0), dict.fromkeys(range(SHARDS + 1), 1.0))


QUERIES = {"op11_sharding": op11_sharding}
# with equal weights the largest draw wins; the checksum is computed byte by byte from its polynomial
SQL = {
    "op11_sharding": f"""
WITH RECURSIVE steps AS (
  SELECT b, b AS c, 0 AS k FROM range(256) AS r(b)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, coalesce(octet_length(encode(doc_id::VARCHAR))::VARCHAR || ':' || doc_id, '-') AS key FROM documents),
drawn AS (
  SELECT doc_id, len(h) // 2 + 1 AS size,
    xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32,
    list_transform(range({SHARDS + 1}), lambda s: ('0x' || md5(key || '|' || s)[1:13])::BIGINT) AS d
  FROM docs, tab),
placed AS (
  SELECT doc_id, size, text_crc32, 'key' AS law, (list_position(d, list_max(d[1:{SHARDS}])) - 1)::INT AS shard, (list_position(d, list_max(d)) - 1)::INT AS grown_shard
  FROM drawn)
SELECT *, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot FROM placed
"""
}
