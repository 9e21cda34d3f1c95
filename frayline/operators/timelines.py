"""Tumbling windows and timelines.

Zero-fill is built from one row per series (its last bucket), exploded in two
steps of bounded or short arrays, joined with the already aggregated buckets.
Events themselves are only ever aggregated. Long fights are filled like others;
``oversized`` reports those above the documented bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frayline.operators.rollups import sum_where
from frayline.operators.scan import Running, running

FIGHT = "fight_id"
MAX_BUCKETS = 50_000
STRETCH = 1_000
SERIES = {"DAMAGE": "damage", "HEALING": "healing", "BUFF_REMOVAL": "buff_removal"}
TOTALS = ["total_damage", "total_healing", "total_buff_removal"]


def _series() -> list[Column]:
    return [
        sum_where(F.col("event_type") == kind, value).alias(name)
        for name, (kind, value) in zip(TOTALS, SERIES.items())
    ]


def _bucket(window_s: int) -> Column:
    if window_s < 1:
        raise ValueError(f"window_s must be at least 1, got {window_s}")
    return F.floor(F.col("time_ms") / (window_s * 1000))


def _frame(last_bucket: DataFrame) -> DataFrame:
    """All buckets from 0 on: first the stretches of ``STRETCH`` buckets, then the buckets of each."""
    start = F.col("_stretch") * STRETCH
    stretches = last_bucket.withColumn("_stretch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("last_bucket") / STRETCH))))
    return stretches.withColumn("bucket", F.explode(F.sequence(start, F.least(F.col("last_bucket"), start + STRETCH - 1)))).drop("last_bucket", "_stretch")


def oversized(events: DataFrame, window_s: int = 5, bound: int = MAX_BUCKETS) -> DataFrame:
    """Fights with more than ``bound`` buckets, as a wrong clock makes them: buckets needed."""
    last = events.groupBy(FIGHT).agg((F.max(_bucket(window_s)) + 1).alias("buckets"))
    return last.filter(F.col("buckets") > bound)


def _filled(frame: DataFrame, buckets: DataFrame, keys: list[str], values: list[str], window_s: int) -> DataFrame:
    rows = frame.join(buckets, [*keys, "bucket"], "left").fillna(0, values)
    return rows.withColumns(
        {
            "start_ms": F.col("bucket") * window_s * 1000,
            "end_ms": (F.col("bucket") + 1) * window_s * 1000,
        }
    )


def event_windows(events: DataFrame, window_s: int = 5) -> DataFrame:
    """Half-open windows per fight from 0 to the last event of any kind, zero-filled."""
    buckets = events.groupBy(FIGHT, _bucket(window_s).alias("bucket")).agg(
        F.count(F.lit(1)).alias("event_count"), *_series()
    )
    last = buckets.groupBy(FIGHT).agg(F.max("bucket").alias("last_bucket"))
    return _filled(_frame(last), buckets, [FIGHT], ["event_count", *TOTALS], window_s)


def fight_timeline(events: DataFrame, window_s: int = 5) -> DataFrame:
    """The three value series only; other kinds neither count nor extend the timeline."""
    acting = events.filter(F.col("event_type").isin(list(SERIES)))
    return event_windows(acting, window_s).drop("event_count")


def player_timelines(events: DataFrame, players: DataFrame, window_s: int = 5) -> DataFrame:
    """One series per account, all padded to the fight's last bucket with player activity.

    Any event of a known player extends the timeline even when it adds nothing.
    """
    who = players.select(FIGHT, F.col("agent_id").alias("source_agent_id"), "account_name")
    per_agent = events.groupBy(FIGHT, "source_agent_id", _bucket(window_s).alias("bucket")).agg(*_series())
    buckets = (
        per_agent.join(who, [FIGHT, "source_agent_id"])
        .groupBy(FIGHT, "account_name", "bucket")
        .agg(*[F.sum(c).alias(c) for c in TOTALS])
    )
    accounts = buckets.groupBy(FIGHT, "account_name").agg(
        F.sum("total_damage").alias("account_damage"), F.max("bucket").alias("account_last")
    )
    last = accounts.groupBy(FIGHT).agg(F.max("account_last").alias("last_bucket"))
    frame = _frame(accounts.drop("account_last").join(last, FIGHT))
    return _filled(frame, buckets, [FIGHT, "account_name"], TOTALS, window_s)


# -- calendar time ---------------------------------------------------------------
def _local_midnight(day: Column, tz: Column) -> Column:
    return F.to_utc_timestamp(day.cast("timestamp"), tz)


def account_points(contributions: DataFrame, fights: DataFrame) -> DataFrame:
    """One point per (account, fight)."""
    rows = contributions.join(fights.select(FIGHT, "started_at"), FIGHT)
    return rows.select("account_name", FIGHT, "started_at", "name", *TOTALS)


def day_points(points: DataFrame, tz: str = "UTC") -> DataFrame:
    """Sums per local calendar day; the representative fight is the day's newest one."""
    zone = F.lit(tz)
    day = F.to_date(F.from_utc_timestamp("started_at", zone))
    rows = points.groupBy("account_name", day.alias("local_day")).agg(
        F.max_by(F.col(FIGHT), F.struct("started_at", FIGHT)).alias(FIGHT),
        *[F.sum(c).alias(c) for c in TOTALS],
    )
    return rows.withColumn("started_at", _local_midnight(F.col("local_day"), zone))


def compare_accounts(
    points: DataFrame, requested: DataFrame, minimum: int = 2, maximum: int = 4
) -> DataFrame:
    """Series of the requested accounts (columns ``position, account_name``); absent ones stay, empty.

    The request itself is a handful of rows typed by a user, so its size is
    checked where it is built (:func:`requested_accounts`).
    """
    newest = points.groupBy("account_name").agg(
        F.max_by("name", F.struct("started_at", FIGHT)).alias("display_name"),
        F.count(F.lit(1)).alias("point_count"),
    )
    rows = requested.join(newest, "account_name", "left").join(points.drop("name"), "account_name", "left")
    return rows.withColumn("point_count", F.coalesce("point_count", F.lit(0)))


def requested_accounts(spark, accounts: list[str], minimum: int = 2, maximum: int = 4) -> DataFrame:
    """Order-preserving, duplicate-free request; colons stripped; 2 to 4 distinct accounts."""
    bare = list(dict.fromkeys(a.lstrip(":") for a in accounts))
    if not minimum <= len(bare) <= maximum:
        raise ValueError(f"between {minimum} and {maximum} distinct accounts are needed, got {len(bare)}")
    return spark.createDataFrame(list(enumerate(bare)), "position INT, account_name STRING")


def aligned_days(series: DataFrame, requested: DataFrame, value: str = "total_damage") -> DataFrame:
    """The requested accounts (2 to 4, see :func:`requested_accounts`) on the union of their days: one value or null.

    A day meets the request's accounts, never the accounts of the corpus.
    """
    own = series.join(requested.select("account_name"), "account_name", "left_semi").select("account_name", "local_day", value)
    names = requested.agg(F.collect_set("account_name").alias("_names")).withColumn("_all", F.lit(1))
    frame = own.select("local_day").distinct().withColumn("_all", F.lit(1)).join(names, "_all").select("local_day", F.explode("_names").alias("account_name"))
    return frame.join(own, ["account_name", "local_day"], "left").select("account_name", "local_day", value)


def day_runs(series: DataFrame, value: str = "total_damage") -> DataFrame:
    """Runs of days without a missing one, per account, on the calendar of all accounts' days.

    Days of one run have the same difference of calendar rank and own rank, so no account-by-day grid is made. The
    calendar is a table of distinct days; own ranks are running counts.
    """
    calendar = series.select("local_day").distinct().withColumn("_all", F.lit(1)).withColumn("_time", F.unix_date("local_day").cast("bigint"))
    ranks = running(calendar, ["_all"], [Running("day_rank", "sum", F.lit(1))], ("_time",), 1_000).select("local_day", "day_rank", "_time")
    rows = series.filter(F.col(value).isNotNull()).select("account_name", "local_day").join(ranks, "local_day")
    rows = running(rows, ["account_name"], [Running("own_rank", "sum", F.lit(1))], ("_time",), 1_000)
    return rows.groupBy("account_name", (F.col("day_rank") - F.col("own_rank")).alias("run")).agg(
        F.min("local_day").alias("run_start"), F.max("local_day").alias("run_end"), F.count(F.lit(1)).alias("points")
    )


# -- series reshaping -------------------------------------------------------------
def rebucket(series: DataFrame, keys: list[str], values: list[str], limit: int = 200) -> DataFrame:
    """At most ``limit`` points: consecutive groups of equal size, summed.

    Buckets are numbered 0..n-1 by construction, so the group needs no ranking.
    """
    sizes = series.groupBy(*keys).agg((F.max("bucket") + 1).alias("n"))
    width = F.greatest(F.ceil(F.col("n") / limit), F.lit(1))
    grouped = series.join(sizes, keys).withColumn("point", F.floor(F.col("bucket") / width))
    return grouped.groupBy(*keys, "point").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), *[F.sum(v).alias(v) for v in values]
    )


def activity_gaps(series: DataFrame, keys: list[str], min_gap_ms: int = 30_000) -> DataFrame:
    """Stretches longer than ``min_gap_ms`` between active buckets, with their midpoints."""
    active = series.filter(" + ".join(TOTALS) + " > 0")
    rows = running(active, keys, [Running("gap_start_ms", "prev", F.col("end_ms"))], ("start_ms",), 3_600_000)
    rows = rows.withColumn("gap_ms", F.col("start_ms") - F.col("gap_start_ms"))
    return rows.filter(F.col("gap_ms") > min_gap_ms).select(
        *keys, "gap_start_ms", F.col("start_ms").alias("gap_end_ms"), "gap_ms",
        F.expr("(gap_start_ms + start_ms) div 2").alias("midpoint_ms"),
    )


def trim_inactive(series: DataFrame, keys: list[str]) -> DataFrame:
    """Drop leading and trailing inactive buckets but one on each side; the index is kept."""
    active = series.groupBy(*keys).agg(
        F.min(F.when(F.expr(" + ".join(TOTALS) + " > 0"), F.col("bucket"))).alias("first_active"),
        F.max(F.when(F.expr(" + ".join(TOTALS) + " > 0"), F.col("bucket"))).alias("last_active"),
    )
    rows = series.join(active, keys)
    inside = F.col("bucket").between(F.col("first_active") - 1, F.col("last_active") + 1)
    return rows.filter(inside).drop("first_active", "last_active")


def log_scaled(series: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """log10(v + 1) over the largest log value of all series of the key."""
    top = series.groupBy(*keys).agg(F.max(F.greatest(*[F.col(v) for v in values])).alias("_top"))
    scale = F.log10(F.greatest(F.col("_top"), F.lit(1)) + 1)
    rows = series.join(top, keys)
    return rows.withColumns({f"{v}_scaled": F.log10(F.col(v) + 1) / scale for v in values}).drop("_top")

