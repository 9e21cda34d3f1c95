"""Streaming forms of the windowed, stateful and polling operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from frayline.operators.rollups import sum_where
from frayline.session import work_folder  # noqa: F401  (streams keep their files there)
from frayline.streaming import stacks
from frayline.streaming.store import BatchStore


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table read as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def live_timeline(events: DataFrame, event_time: str = "ts", window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Tumbling sums per fight with a watermark; later rows are dropped and counted by the query's progress."""
    is_ = lambda kind: F.col("event_type") == kind
    rows = events.withWatermark(event_time, delay).groupBy("fight_id", F.window(event_time, window).alias("w")).agg(
        F.count(F.lit(1)).alias("event_count"),
        sum_where(is_("DAMAGE"), "damage").alias("total_damage"),
        sum_where(is_("HEALING"), "healing").alias("total_healing"),
        sum_where(is_("BUFF_REMOVAL"), "buff_removal").alias("total_buff_removal"),
    )
    return rows.select("fight_id", F.col("w.start").alias("window_start"), "event_count", "total_damage", "total_healing", "total_buff_removal")


def late_rows(query) -> int:
    """Rows the watermark dropped so far."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def late_ledger(path: str, event_time: str = "ts", window: str = "1 hour", delay_ms: int = 600_000) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: per (fight, window) the rows that come after the watermark of their batch has passed the window.

    The watermark of a batch is the newest event time of the batches before it less the delay. Each batch stores its newest
    time, so counts are kept for good, survive restarts and are the same when a batch is replayed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        clock = BatchStore(spark, f"{path}/clock", "newest_ms BIGINT", lambda rows: rows.agg(F.max("newest_ms").alias("newest_ms")))
        newest = clock.stored(before=batch_id).agg(F.max("newest_ms")).first()[0]
        late = batch.groupBy("fight_id", F.window(event_time, window).alias("w")).agg(F.count(F.lit(1)).alias("late_rows"))
        late = late.filter(F.lit(False) if newest is None else F.unix_millis("w.end") <= newest - delay_ms)
        BatchStore(spark, f"{path}/late", LATE_DDL, merged_late).put(late.select("fight_id", F.col("w.start").alias("window_start"), "late_rows"), batch_id)
        clock.put(batch.agg(F.max(F.unix_millis(event_time)).alias("newest_ms")), batch_id)

    return write


LATE_DDL = "fight_id STRING, window_start TIMESTAMP, late_rows BIGINT"


def merged_late(rows: DataFrame) -> DataFrame:
    return rows.groupBy("fight_id", "window_start").agg(F.sum("late_rows").alias("late_rows"))


def late_windows(spark: SparkSession, path: str) -> DataFrame:
    """What the ledger has counted so far."""
    return BatchStore(spark, f"{path}/late", LATE_DDL, merged_late).rows()


def first_uploads(uploads: DataFrame, time: str = "uploaded_at", delay: str = "7 days") -> DataFrame:
    """One row per content hash within the watermark; the sink's anti-join covers older ones."""
    return uploads.withWatermark(time, delay).dropDuplicatesWithinWatermark(["sha256"])


def batch_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches below ``path``, which is made when it is not there yet."""
    spark.createDataFrame([], f"{schema}, batch_id BIGINT").write.mode("append").partitionBy("batch_id").parquet(path)
    return spark.read.schema(f"{schema}, batch_id BIGINT").parquet(path)


def own_folder(rows: DataFrame, path: str, batch_id: int) -> None:
    """Each batch owns a folder, so a replayed batch rewrites itself."""
    rows.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("batch_id").parquet(path)


def batch_sink(path: str, step: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: ``step`` of every batch, kept once however often the batch is replayed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        own_folder(step(batch), path, batch_id)

    return write


PREFIX_DIGITS = 2


def hash_store(spark: SparkSession, path: str) -> BatchStore:
    """Content hashes by their first digits, with Bloom filters for look-ups of single ones."""
    options = {"parquet.bloom.filter.enabled#sha256": "true"}
    return BatchStore(spark, path, "sha256 STRING", DataFrame.distinct, F.substring("sha256", 1, PREFIX_DIGITS), options)


def ingest_batch(path: str, compact_every: int = 16) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: append hashes that no other batch has stored.

    Only the folders of the prefixes a batch brings are read, and every ``compact_every`` batches they are merged, so what a
    batch opens depends on the batch and not on the store. There are at most 256 prefixes of hexadecimal hashes.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store = hash_store(batch.sparkSession, path)
        if batch_id and batch_id % compact_every == 0:
            store.compact(batch_id - 1)
        prefixes = [r[0] for r in batch.select(F.substring("sha256", 1, PREFIX_DIGITS)).distinct().collect()]
        stored = store.stored(prefixes, before=batch_id)
        store.put(batch.select("sha256").distinct().join(stored, "sha256", "left_anti"), batch_id)

    return write


def merged_summaries(spark: SparkSession, path: str, keys: list[str], totals: list[str]) -> DataFrame:
    """Summaries from the partial sums each batch has left: a fight may arrive in any number of batches."""
    parts = batch_table(spark, path, ", ".join([f"{k} STRING" for k in keys] + [f"{t} BIGINT" for t in totals]))
    return parts.groupBy(*keys).agg(*[F.sum(t).alias(t) for t in totals])


def newest_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows an updating stream has left per key, those of the last batch."""
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_last"))
    return last.select(*keys, "_last.*")


def _day_of(fight_id: str) -> int:
    return int(pd.Timestamp(fight_id).value // 1_000_000)


def live_stack_history(events: DataFrame, event_time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Stack history where a fight is the calendar day its id names."""
    return stacks.stack_history(events, _day_of, event_time, delay)


CLOSING_ID = -1


def closing_rows(last: DataFrame, schema, event_time: str, after: str) -> DataFrame:
    """The row that closes a drained stream, for a table of events in ``schema``.

    ``last`` holds the newest event time and its fight. The row is an apply on no agent, later than all by ``after``, which
    must exceed the watermark's delay; the watermark then passes every event, and the row itself never comes out.
    """
    own = {
        event_time: F.col(event_time) + F.expr(f"INTERVAL {after}"), "fight_id": F.col("fight_id"), "event_type": F.lit("BOON_APPLY"), "kind": F.lit("apply"),
        "target_agent_id": F.lit(CLOSING_ID), "skill_id": F.lit(CLOSING_ID), "seq": F.lit(CLOSING_ID), "time_ms": F.lit(2**40), "stacks": F.lit(0),
    }
    return last.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, on disk and checkpointed by changes; the setting is put back."""
    before = spark.conf.get(PROVIDER_KEY, None)
    spark.conf.set(PROVIDER_KEY, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER_KEY)
        else:
            spark.conf.set(PROVIDER_KEY, before)


def started(stream: DataFrame, folder: str, sink: Callable[[DataFrame, int], None] | None = None, mode: str = "append", **trigger) -> StreamingQuery:
    """The running query: into parquet under ``folder``/rows, or through a batch sink."""
    writer = stream.writeStream.trigger(**(trigger or {"availableNow": True})).option("checkpointLocation", f"{folder}/progress")
    with rocks_state(stream.sparkSession):
        if sink is None:
            return writer.outputMode("append").format("parquet").option("path", f"{folder}/rows").start()
        return writer.outputMode(mode).foreachBatch(sink).start()


def drain(stream: DataFrame, folder: str, sink: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> StreamingQuery:
    """Process what is available now; the ended query tells its progress."""
    query = started(stream, folder, sink, mode)
    query.awaitTermination()
    return query
