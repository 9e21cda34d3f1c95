from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frayline.llm.whitening import whitened


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on their eight leading components; a deviation beyond a long is an error."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {"op13_whitening": op13_whitening}
