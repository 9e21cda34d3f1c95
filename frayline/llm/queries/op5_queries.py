from pyspark.sql import DataFrame, SparkSession

from frayline.llm.licences import licence_families


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families declared in every document."""
    return licence_families(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_licence_scan": op5_licence_scan}
