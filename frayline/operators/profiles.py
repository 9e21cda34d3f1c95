"""Cross-fight player profiles, ranking, paging, guild joins and drift."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frayline.operators.timelines import TOTALS

FIGHT = "fight_id"


def profiles(contributions: DataFrame) -> DataFrame:
    """Attendance, sums, first-seen profession and elite, last-seen name, per account.

    The attended fight ids of an account grow without bound, so they come as
    rows from :func:`attended_fights` instead of an array in one row.
    """
    order = F.struct(FIGHT, "seq")
    per_fight = contributions.groupBy("account_name", FIGHT).agg(
        *[F.sum(c).alias(c) for c in TOTALS],
        F.min_by(F.struct("profession", "elite"), order).alias("first_spec"),
        F.max_by("name", order).alias("last_name"),
    )
    return per_fight.groupBy("account_name").agg(
        F.count(F.lit(1)).alias("fights_attended"),
        *[F.sum(c).alias(c) for c in TOTALS],
        F.min_by("first_spec.profession", FIGHT).alias("profession"),
        F.min_by("first_spec.elite", FIGHT).alias("elite"),
        F.max_by("last_name", FIGHT).alias("name"),
    )


def attended_fights(contributions: DataFrame) -> DataFrame:
    return contributions.select("account_name", FIGHT).distinct()


def modal_value(rows: DataFrame, key: str, attribute: str) -> DataFrame:
    """Most frequent value per key, smallest on ties.

    The count is a partial aggregation over (key, value); the pick is an
    aggregate too, so no window ever ranks a whole key.
    """
    counts = rows.groupBy(key, attribute).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(key).agg(F.min_by(attribute, F.struct(-F.col("_n"), F.col(attribute))).alias(attribute))


def modal_profiles(summaries: DataFrame, profession: int | None = None) -> DataFrame:
    """Profiles with the modal profession, largest name and elite."""
    modal = modal_value(summaries, "account_name", "profession")
    if profession is not None:
        modal = modal.filter(F.col("profession") == profession)
    sums = summaries.groupBy("account_name").agg(
        F.max("name").alias("name"),
        F.max("elite").alias("elite"),
        F.count(FIGHT).alias("fights_attended"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOTALS],
    )
    return sums.join(modal, "account_name")


def account_totals(points: DataFrame) -> DataFrame:
    """Totals with the newest name and profession of each account."""
    newest = F.struct("started_at", FIGHT)
    return points.groupBy("account_name").agg(
        F.count(F.lit(1)).alias("fights"),
        *[F.sum(c).alias(c) for c in TOTALS],
        F.max_by("name", newest).alias("name"),
        F.max_by("profession", newest).alias("profession"),
    )


# -- order, limit, paging ------------------------------------------------------------
def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0, largest: int = 500) -> DataFrame:
    """Offset page under a total order. The limit is the feature and is range-checked."""
    if not 1 <= limit <= largest or offset < 0:
        raise ValueError(f"limit must be 1..{largest} and offset >= 0")
    return rows.orderBy(*order).offset(offset).limit(limit)


def encode_cursor(total: int, account: str) -> str:
    return base64.urlsafe_b64encode(json.dumps({"t": total, "a": account}).encode()).decode()


def decode_cursor(cursor: str | None) -> tuple[int, str] | None:
    """Position a cursor names; anything unreadable means the first page."""
    try:
        data = json.loads(base64.urlsafe_b64decode((cursor or "").encode()))
        return int(data["t"]), str(data["a"])
    except (ValueError, KeyError, TypeError):
        return None


def cursor_column(total: Column, account: Column) -> Column:
    """The same opaque cursor, computed per row."""
    text = F.concat(F.lit('{"t": '), total.cast("string"), F.lit(', "a": '), F.to_json(F.array(account)))
    body = F.concat(F.regexp_replace(text, r"\[(.*)\]$", "$1"), F.lit("}"))
    return F.translate(F.base64(F.encode(body, "utf-8")), "+/", "-_")


def keyset_page(rows: DataFrame, limit: int, cursor: str | None = None) -> DataFrame:
    """Page after ``cursor`` in (total_damage desc, account asc); one extra row tells if more follow.

    Sorting and limit fuse into a bounded per-task top-k (TakeOrderedAndProject).
    """
    position = decode_cursor(cursor)
    if position is not None:
        total, account = position
        after = (F.col("total_damage") < total) | (
            (F.col("total_damage") == total) & (F.col("account_name") > account)
        )
        rows = rows.filter(after)
    rows = rows.orderBy(F.col("total_damage").desc(), F.col("account_name").asc()).limit(limit + 1)
    return rows.withColumn("next_cursor", cursor_column(F.col("total_damage"), F.col("account_name")))


def top_per_key(rows: DataFrame, keys: list[str], metric: str, tie: str, n: int) -> DataFrame:
    """The n best rows per key.

    Spark pushes the rank bound below the shuffle (WindowGroupLimit), so each
    input partition forwards at most n rows per key.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(metric).desc_nulls_last(), F.col(tie).asc())
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_per_metric(rows: DataFrame, keys: list[str], tie: str, metrics: list[str], n: int = 3) -> DataFrame:
    """Top n of every metric, long form."""
    long = rows.unpivot([*keys, tie], metrics, "metric", "value").filter(F.col("value") > 0)
    return top_per_key(long, [*keys, "metric"], "value", tie, n)


def role_counts(readout: DataFrame) -> DataFrame:
    return readout.select(FIGHT, F.explode("roles").alias("role")).groupBy(FIGHT, "role").agg(
        F.count(F.lit(1)).alias("players")
    )


# -- sets ------------------------------------------------------------------------------
def union_of_targets(*rollups: DataFrame) -> DataFrame:
    out = rollups[0].select(FIGHT, "target_agent_id")
    for other in rollups[1:]:
        out = out.union(other.select(FIGHT, "target_agent_id"))
    return out.distinct()


def merge_page(held: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Held rows plus the fresh ones whose key is not held yet."""
    return held.unionByName(fresh.join(held.select(*keys), keys, "left_anti"))


# -- summaries against fights -------------------------------------------------------------
def fights_without_summary(fights: DataFrame, summaries: DataFrame) -> DataFrame:
    return fights.join(summaries.select(FIGHT), FIGHT, "left_anti")


def merged_contributions(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Stored summaries, plus recomputed rows for the fights that have none at all."""
    return stored.unionByName(recomputed.join(stored.select(FIGHT).distinct(), FIGHT, "left_anti"))


def summary_drift(fights: DataFrame, summaries: DataFrame) -> DataFrame:
    total = fights.agg(F.count(F.lit(1)).alias("total_fights"))
    covered = summaries.agg(F.countDistinct(FIGHT).alias("fights_with_summaries"))
    rows = total.join(covered)  # two one-row aggregates
    missing = F.col("total_fights") - F.col("fights_with_summaries")
    share = F.when(F.col("total_fights") > 0, F.bround(missing / F.col("total_fights") * 100, 2)).otherwise(0.0)
    return rows.withColumns(
        {
            "drift_count": missing,
            "drift_pct": share,
            "status": F.when(missing == 0, "ok").otherwise("drift"),
        }
    )


def drift_gate(before: DataFrame, after: DataFrame, limit: int = 2) -> DataFrame:
    """Growth of the drift between two snapshots against a limit (both are one row)."""
    rows = before.select(F.col("drift_count").alias("before")).join(after.select(F.col("drift_count").alias("after")))
    delta = F.col("after") - F.col("before")
    return rows.withColumns({"delta": delta, "passed": delta <= limit})


def guilds_of_accounts(members: DataFrame, guilds: DataFrame) -> DataFrame:
    pairs = members.select("account_name", "guild_id").distinct()
    return pairs.join(guilds.select(F.col("id").alias("guild_id"), F.col("name").alias("guild_name"), "tag"), "guild_id")
