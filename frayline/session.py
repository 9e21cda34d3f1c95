"""Session helpers shared by every job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "frayline", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every operator here assumes.

    UTC is the only one results depend on; the rest lets AQE choose partition
    counts, split skewed joins and pick broadcast sides from measured sizes.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names, if any."""
    return spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in shared storage: the checkpoint folder, else the streaming checkpoint location, else the warehouse."""
    settings = (checkpoint_dir(spark), spark.conf.get("spark.sql.streaming.checkpointLocation", None), spark.conf.get("spark.sql.warehouse.dir", None))
    base = next((s for s in settings if s), None)
    if base is None:
        raise ValueError("set spark.checkpoint.dir, spark.sql.streaming.checkpointLocation or spark.sql.warehouse.dir to shared storage")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Stage:
    """Results written once into a folder of shared storage and read back, for plans that use them several times.

    Spark writes a shared subplan out again for every use and only merges what turns out equal at run time. A staged result
    is one scan of a narrow table instead, and survives lost executors. The folder is removed when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder = spark, work_folder(spark, name)
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def __call__(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).select(*df.columns)
