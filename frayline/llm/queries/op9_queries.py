from pyspark.sql import DataFrame, SparkSession
import public_tokenizers

from frayline.llm.packing import pack


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2,048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
