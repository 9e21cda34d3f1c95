from pyspark.sql import DataFrame, SparkSession
import public_tokenizers

from frayline.llm.token_counts import count_tokens


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op7_token_counts": op7_token_counts}
