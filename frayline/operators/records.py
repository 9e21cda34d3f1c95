"""Small per-fight facts derived from events: time base, duration, awareness, initial buffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000
SENTINEL = 9223372036854775807  # agent clocks at or above this are 'no time'


def normalise_time(events: DataFrame, time: str = "time_ms") -> DataFrame:
    """Rebase absolute clocks per fight; sentinels become 0.

    The base is the smallest positive, non-sentinel time and is only subtracted
    when it is at least a day, i.e. when the clock is clearly not fight-relative.
    """
    valid = (F.col(time) > 0) & (F.col(time) < SENTINEL)
    base = events.groupBy("fight_id").agg(F.min(F.when(valid, F.col(time))).alias("_base"))
    shifted = (
        F.when(F.col(time) >= SENTINEL, F.lit(0))
        .when(F.col("_base") >= DAY_MS, F.greatest(F.col(time) - F.col("_base"), F.lit(0)))
        .otherwise(F.col(time))
    )
    return events.join(base, "fight_id").withColumn(time, shifted.cast("bigint")).drop("_base")


def fight_durations(events: DataFrame) -> DataFrame:
    """``duration_s`` per fight by stream order: first to last hit or heal, else the latest time."""
    hit = (F.coalesce(F.col("damage"), F.lit(0)) > 0) | (F.coalesce(F.col("healing"), F.lit(0)) > 0)
    t = F.col("time_ms")
    bounds = events.groupBy("fight_id").agg(
        F.max(t).alias("max_ms"),
        F.min_by(t, F.when(hit & (t != 0), F.col("seq"))).alias("first_ms"),
        F.max_by(t, F.when(hit, F.col("seq"))).alias("last_ms"),
    )
    first = F.coalesce(F.col("first_ms"), F.lit(0))
    last = F.coalesce(F.col("last_ms"), F.lit(0))
    seconds = F.when(last > first, (last - first) / 1000.0).otherwise(F.col("max_ms") / 1000.0)
    return bounds.select("fight_id", seconds.alias("duration_s"))


def event_spans(events: DataFrame) -> DataFrame:
    """``duration_s`` per fight as the span of all its events (the summary definition)."""
    return events.groupBy("fight_id").agg(
        ((F.max("time_ms") - F.min("time_ms")) / 1000.0).alias("duration_s")
    )


def initial_buffs(events: DataFrame, start: Column | int = 0, buff_ids: list[int] | None = None) -> DataFrame:
    """Buff snapshots (not mid-fight applies), relative to ``start``."""
    rows = events.filter(F.col("event_type") == "BUFF_APPLY")
    if buff_ids is not None:
        rows = rows.filter(F.col("skill_id").isin(buff_ids))
    start = F.lit(start) if isinstance(start, int) else start
    return rows.select(
        "fight_id",
        "seq",
        F.greatest(F.col("time_ms") - start, F.lit(0)).alias("time_ms"),
        F.col("target_agent_id").alias("agent_id"),
        F.col("skill_id").alias("buff_id"),
        "stacks",
        "duration_ms",
    )
