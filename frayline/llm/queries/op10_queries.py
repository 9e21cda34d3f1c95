from pyspark.sql import DataFrame, SparkSession
import public_tokenizers

from frayline.llm.chat_format import digests, format_conversations

# a conversation whose texts hold another template's control strings
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
COLUMNS = ["conv_id", "turn", "role", "text"]


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*COLUMNS)
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return digests(format_conversations(rows.unionByName(probe), public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {"op10_chat_format": op10_chat_format}
SQL = {
    "op10_chat_format": """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|') AS shown,
    replace(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'), chr(10), chr(92) || 'n') AS head
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(8 + length(head) + 1 + length(shown) + 7)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
}
