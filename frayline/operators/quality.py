"""Invariants as queries that return violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frayline.operators.scan import Running, running

FIGHT = "fight_id"


def failing(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows breaking any check, with the names of the broken ones."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return rows.withColumn("broken", broken).filter(F.size("broken") > 0)


def roster_checks(roster: DataFrame, subgroups: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Counts against each other and against the fight's skill catalogue (``catalogue``: fight_id, skill_id)."""
    members = subgroups.groupBy(FIGHT).agg(F.sum("player_count").alias("members"))
    skills = catalogue.groupBy(FIGHT).agg(F.countDistinct("skill_id").alias("skills"))
    rows = roster.join(members, FIGHT, "left").join(skills, FIGHT, "left").fillna(0, ["members", "skills"])
    return failing(
        rows,
        {
            "players + npcs = agents": F.col("player_count") + F.col("npc_count") == F.col("agent_count"),
            "subgroups add up": F.col("members") == F.col("player_count"),
            "skills = catalogue": F.col("skills") == F.col("skill_count"),
        },
    )


def attendance_checks(attendance: DataFrame, played: DataFrame) -> DataFrame:
    """Attendance within the number of fights, and equal to the account's fights (``played``: account_name, fight_id)."""
    own = played.groupBy("account_name").agg(F.countDistinct(FIGHT).alias("own"))
    total = played.agg(F.countDistinct(FIGHT).alias("n")).first()["n"]
    rows = attendance.join(own, "account_name", "left").fillna(0, ["own"])
    return failing(rows, {"attendance within fights": F.col("fights_attended") <= total, "attendance = own fights": F.col("fights_attended") == F.col("own")})


def out_of_order(rows: DataFrame, keys: list[str], position: str, value: str, descending: bool = False, chunk: int = 1_000_000) -> DataFrame:
    """Rows whose value does not come after the previous one of the key (equal values are out of order too)."""
    rows = running(rows, keys, [Running("_before", "prev", F.col(value))], (position,), chunk)
    ordered = F.col("_before") > F.col(value) if descending else F.col("_before") < F.col(value)
    return rows.filter(~ordered).drop("_before")


def sums_preserved(parts: DataFrame, whole: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys at which the roll-up's sums differ from the input's."""
    left = parts.groupBy(*keys).agg(*[F.sum(v).alias(f"part_{v}") for v in values])
    right = whole.groupBy(*keys).agg(*[F.sum(v).alias(f"whole_{v}") for v in values])
    rows = left.join(right, keys, "full")
    same = reduce(lambda a, b: a & b, [F.coalesce(f"part_{v}", F.lit(0)) == F.coalesce(f"whole_{v}", F.lit(0)) for v in values])
    return rows.filter(~same)


def order_violations(rows: DataFrame, partition: list[str], position: str, metric: str, key: str, chunk: int = 1_000) -> DataFrame:
    """Neighbours out of (metric desc, key asc) order in a presented list."""
    rows = running(rows, partition, [Running("_before", "prev", F.struct(F.col(metric).alias("m"), F.col(key).alias("k")))], (position,), chunk)
    before_m, before_k = F.col("_before.m"), F.col("_before.k")
    bad = (before_m < F.col(metric)) | ((before_m == F.col(metric)) & (before_k >= F.col(key)))
    return rows.filter(bad).drop("_before")


def bucket_gaps(buckets: DataFrame, keys: list[str]) -> DataFrame:
    """Series whose buckets are not exactly 0..n-1 once each (an aggregate; no ordering needed)."""
    rows = buckets.groupBy(*keys).agg(
        F.min("bucket").alias("low"), F.max("bucket").alias("high"), F.count(F.lit(1)).alias("n"), F.countDistinct("bucket").alias("distinct_n")
    )
    return rows.filter((F.col("low") != 0) | (F.col("n") != F.col("high") + 1) | (F.col("distinct_n") != F.col("n")))


def unequal_series(series: DataFrame, group: list[str], member: str) -> DataFrame:
    """Groups whose members' series differ in length."""
    lengths = series.groupBy(*group, member).agg(F.count(F.lit(1)).alias("length"))
    return lengths.groupBy(*group).agg(F.min("length").alias("shortest"), F.max("length").alias("longest")).filter("shortest <> longest")


def bad_history(history: DataFrame, keys: list[str], chunk: int = 1_000_000) -> DataFrame:
    """Entries with a negative time or level, or earlier than the entry before them."""
    rows = running(history, keys, [Running("_before", "prev", F.col("time_ms"))], ("seq",), chunk)
    return rows.filter("stacks < 0 or time_ms < 0 or time_ms < _before").drop("_before")


def domain_violations(rows: DataFrame, non_negative: list[str] = (), domains: dict[str, list] = {}, ranges: dict[str, tuple] = {}) -> DataFrame:
    checks = {f"{c} >= 0": F.col(c) >= 0 for c in non_negative}
    checks |= {f"{c} domain": F.col(c).isin(values) for c, values in domains.items()}
    checks |= {f"{c} range": F.col(c).isNull() | F.col(c).between(*bounds) for c, bounds in ranges.items()}
    return failing(rows, checks)


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
