"""Tables that micro-batches leave in a shared folder, merged from time to time.

``since=M/batch_id=N`` holds what batch N left after the merge up to M, ``merged/upto=M`` all batches up to M as one, and
``marks`` one row per finished merge. A batch owns its folder, so a replayed one rewrites itself; one that has been merged
already is not written again. A reader lists the newest merged folder and the batches after it only, so what it opens does
not grow with the number of batches that ever ran.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NEVER = -1


class BatchStore:
    """``merge`` makes one row set of several; rows of ``schema`` may be laid out by a ``part`` expression."""

    def __init__(
        self, spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame] = lambda rows: rows,
        part: Column | None = None, options: dict[str, str] | None = None,
    ) -> None:
        self.spark, self.path, self.schema, self.merge, self.part, self.options = spark, path.rstrip("/"), schema, merge, part, options or {}
        self.columns = spark.createDataFrame([], schema).columns

    def _append(self, path: str, schema: str, rows: DataFrame, by: list[str]) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**self.options).partitionBy(*by).parquet(path)

    def _ready(self, path: str, schema: str, by: list[str]) -> None:
        self.spark.createDataFrame([], schema).write.mode("append").partitionBy(*by).parquet(path)

    def mark(self) -> int:
        """The newest batch that has been merged."""
        self._ready(f"{self.path}/marks", "done BOOLEAN, upto BIGINT", ["upto"])
        found = self.spark.read.schema("done BOOLEAN, upto BIGINT").parquet(f"{self.path}/marks").agg(F.max("upto")).first()[0]
        return NEVER if found is None else found

    def _layout(self) -> tuple[str, list[str]]:
        return (f"{self.schema}, part STRING", ["part"]) if self.part is not None else (self.schema, [])

    def _laid(self, rows: DataFrame) -> DataFrame:
        rows = rows.select(*self.columns)
        return rows if self.part is None else rows.withColumn("part", self.part).repartition("part")

    def put(self, rows: DataFrame, batch_id: int) -> None:
        mark = self.mark()
        if batch_id > mark:
            self._append(f"{self.path}/since={mark}", self.schema, self._laid(rows).withColumn("batch_id", F.lit(batch_id).cast("bigint")), ["batch_id", *self._layout()[1]])

    def stored(self, parts: Iterable[str] | None = None, before: int | None = None) -> DataFrame:
        """Unmerged rows: those of ``parts`` only, and of batches below ``before`` only, if given."""
        mark, (schema, by) = self.mark(), self._layout()
        tail_schema = f"{schema}, batch_id BIGINT"
        self._ready(f"{self.path}/since={mark}", tail_schema, ["batch_id", *by])
        tail = self.spark.read.schema(tail_schema).parquet(f"{self.path}/since={mark}")
        if before is not None:
            tail = tail.filter(F.col("batch_id") < before)
        tables = [tail.drop("batch_id")]
        if mark != NEVER:
            base = f"{self.path}/merged/upto={mark}"
            tables.append(self.spark.read.schema(schema).parquet(base))
        if parts is not None and by:
            tables = [t.filter(F.col("part").isin(list(parts))) for t in tables]
        rows = tables[0]
        for t in tables[1:]:
            rows = rows.unionByName(t)
        return rows.select(*self.columns)

    def rows(self, parts: Iterable[str] | None = None) -> DataFrame:
        return self.merge(self.stored(parts)).select(*self.columns)

    def compact(self, upto: int) -> None:
        """Merge everything there is; ``upto`` is the newest batch that has ended. Safe to repeat."""
        if upto <= self.mark():
            return
        base, (_, by) = f"{self.path}/merged/upto={upto}", self._layout()
        rows = self._laid(self.rows())
        (rows.write.partitionBy(*by) if by else rows.write).mode("overwrite").options(**self.options).parquet(base)
        marks = self.spark.createDataFrame([(True, upto)], "done BOOLEAN, upto BIGINT")
        self._append(f"{self.path}/marks", "", marks, ["upto"])
