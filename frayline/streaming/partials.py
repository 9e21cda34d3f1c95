"""Summaries of fights that arrive in pieces: per batch a mergeable partial state, per read one merge.

Sums add up, spans are least and greatest times, distinct targets are keyed rows, and presence is a bit set per (fight,
agent, word of 64 buckets). Merging is associative, and every batch is kept once, so pieces may come in any number of batches,
in any order, and batches may be replayed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frayline.functions import lookups as L
from frayline.functions.combat import is_condition_buff
from frayline.operators.rollups import FIGHT, count_where, sum_where
from frayline.streaming.store import BatchStore

PRESENCE_MS = 5000
WORD_BITS = 64
SUMS = ["total_damage", "condi_damage", "total_healing", "total_buff_removal", "boon_removals", "condition_cleanses", "cc_applied", "cleanses", "strips", "cc", "downtime_ms"]
SPANS = ["least_ms", "most_ms", "first_seq", "first_ms", "last_seq", "last_ms"]
KEYS = f"{FIGHT} STRING, agent_id BIGINT"


# the partial tables and what each reads of an event
TABLES = {
    "sums": [FIGHT, "event_type", "source_agent_id", "target_agent_id", "skill_id", "kind", "buff_id", "damage", "healing", "buff_removal", "stacks", "downtime_ms"],
    "targets": [FIGHT, "event_type", "source_agent_id", "target_agent_id"],
    "spans": [FIGHT, "seq", "time_ms", "damage", "healing"],
    "presence": [FIGHT, "time_ms", "source_agent_id", "target_agent_id"],
}


class LiveSummaries:
    """The partial states below a folder: all four, or those named in ``kept`` when no reading needs the others."""

    def __init__(self, spark: SparkSession, path: str, kept: Sequence[str] = tuple(TABLES)) -> None:
        def summed(rows: DataFrame) -> DataFrame:
            return rows.groupBy(FIGHT, "agent_id").agg(*[F.sum(c).alias(c) for c in [*SUMS, "acted", "counted"]])

        def spans(rows: DataFrame) -> DataFrame:
            ends = [F.min_by("first_ms", "first_seq").alias("first_ms"), F.min("first_seq").alias("first_seq"), F.max_by("last_ms", "last_seq").alias("last_ms"), F.max("last_seq").alias("last_seq")]
            return rows.groupBy(FIGHT).agg(F.min("least_ms").alias("least_ms"), F.max("most_ms").alias("most_ms"), *ends)

        def presence(rows: DataFrame) -> DataFrame:
            return rows.groupBy(FIGHT, "agent_id", "part_no").agg(F.bit_or("bits").alias("bits"))

        sums = ", ".join(f"{c} BIGINT" for c in [*SUMS, "acted", "counted"])
        self.sums = BatchStore(spark, f"{path}/sums", f"{KEYS}, {sums}", summed)
        self.targets = BatchStore(spark, f"{path}/targets", f"{KEYS}, target_id BIGINT", DataFrame.distinct)
        self.spans = BatchStore(spark, f"{path}/spans", f"{FIGHT} STRING, {', '.join(f'{c} BIGINT' for c in SPANS)}", spans)
        self.presence = BatchStore(spark, f"{path}/presence", f"{KEYS}, part_no BIGINT, bits BIGINT", presence)
        self.tables = {name: getattr(self, name) for name in kept}

    def put(self, events: DataFrame, skills: DataFrame, batch_id: int) -> None:
        """The partial state of one batch of events; every kept table reads the batch once."""
        partial = {"sums": lambda: partial_sums(events, skills), "targets": lambda: partial_targets(events), "spans": lambda: partial_spans(events), "presence": lambda: partial_presence(events)}
        for name, table in self.tables.items():
            table.put(partial[name](), batch_id)

    def columns(self) -> list[str]:
        """What the kept tables read: a stream hands its batches on as rows, so columns are left out before it or not at all."""
        return sorted({c for name in self.tables for c in TABLES[name]})

    def compact(self, upto: int) -> None:
        for table in self.tables.values():
            table.compact(upto)

    def durations(self) -> DataFrame:
        """First to last hit or heal in stream order, else the latest time."""
        first, last = F.coalesce("first_ms", F.lit(0)), F.coalesce("last_ms", F.lit(0))
        seconds = F.when(last > first, (last - first) / 1000.0).otherwise(F.col("most_ms") / 1000.0)
        return self.spans.rows().select(FIGHT, seconds.alias("duration_s"))

    def event_spans(self) -> DataFrame:
        """First to last event."""
        return self.spans.rows().select(FIGHT, ((F.col("most_ms") - F.col("least_ms")) / 1000.0).alias("duration_s"))

    def counters(self) -> DataFrame:
        """Cleanses, strips, CC, distinct cleave targets and down time per agent."""
        targets = self.targets.rows().groupBy(FIGHT, "agent_id").agg(F.count(F.lit(1)).alias("cleave_targets"))
        rows = self.sums.rows().filter("counted > 0").select(FIGHT, "agent_id", "cleanses", "strips", "cc", "downtime_ms")
        return rows.join(targets, [FIGHT, "agent_id"], "left").fillna(0, ["cleave_targets"])

    def presence_pct(self, players: DataFrame) -> DataFrame:
        """Share of 5-second buckets in which a player acts or is acted on, capped at 100."""
        seen = self.presence.rows().groupBy(FIGHT, "agent_id").agg(F.coalesce(F.sum(F.bit_count("bits").cast("bigint")), F.lit(0)).alias("active_buckets"))
        rows = seen.join(players.select(FIGHT, "agent_id"), [FIGHT, "agent_id"], "left_semi").join(self.durations(), FIGHT)
        buckets = F.greatest(F.ceil(F.floor(F.col("duration_s") * 1000) / PRESENCE_MS), F.lit(1))
        return rows.select(FIGHT, "agent_id", "active_buckets", F.least(F.col("active_buckets") / buckets * 100.0, F.lit(100.0)).alias("presence_pct"))

    def account_buckets(self, players: DataFrame) -> DataFrame:
        """The plain columns of the summary row per (fight, account)."""
        rows = self.sums.rows().filter("acted > 0").join(players, [FIGHT, "agent_id"])
        out = rows.groupBy(FIGHT, "account_name").agg(
            *[F.min_by(c, "agent_id").alias(c) for c in ("name", "profession", "elite")],
            *[F.sum(c).alias(c) for c in ("total_damage", "condi_damage", "total_healing", "total_buff_removal", "boon_removals", "condition_cleanses", "cc_applied")],
        )
        return out.withColumns(
            {"power_damage": F.col("total_damage") - F.col("condi_damage"), "boon_strips": F.col("boon_removals") + F.col("total_buff_removal")}
        ).drop("boon_removals")


def partial_sums(events: DataFrame, skills: DataFrame) -> DataFrame:
    """Sums per (fight, agent). ``acted`` counts what makes a summary member, ``counted`` what makes a counter row.

    Receiving a buff makes a member too. Reduced per (agent, skill) before the skill's name decides what is a condition.
    """
    is_ = lambda *kinds: F.col("event_type").isin(*kinds)
    side = lambda who, acts: F.struct(F.col(who).cast("bigint").alias("agent_id"), F.lit(acts).alias("acts"))
    gets = is_("BOON_APPLY", "BUFF_APPLY") & (F.col("source_agent_id") != F.col("target_agent_id"))
    sides = F.when(gets, F.array(side("source_agent_id", True), side("target_agent_id", False))).otherwise(F.array(side("source_agent_id", True)))
    rows = events.select("*", F.inline(sides))
    acts = F.col("acts")
    removal, tracked = acts & is_("BOON_APPLY") & (F.col("kind") != "apply"), F.col("skill_id").isin(list(L.TRACKED_BOONS.values()))
    condition = is_condition_buff(F.col("buff_id"))
    per_skill = rows.groupBy(FIGHT, "agent_id", "skill_id").agg(
        sum_where(acts & is_("DAMAGE"), "damage").alias("total_damage"), sum_where(acts & is_("HEALING"), "healing").alias("total_healing"),
        sum_where(acts & is_("BUFF_REMOVAL"), "buff_removal").alias("total_buff_removal"), sum_where(removal & tracked, "stacks").alias("boon_removals"),
        sum_where(removal & ~tracked, "stacks").alias("condition_cleanses"), count_where(acts & is_("CC")).alias("cc_applied"),
        count_where(acts & is_("BUFF_REMOVAL") & condition).alias("cleanses"), count_where(acts & is_("BUFF_REMOVAL") & ~condition).alias("strips"),
        sum_where(acts & is_("DOWN") & (F.col("downtime_ms") > 0), "downtime_ms").alias("downtime_ms"),
        F.count(F.lit(1)).alias("acted"), count_where(acts & is_("BUFF_REMOVAL", "CC", "DAMAGE", "DOWN")).alias("counted"),
    ).withColumn("cc", F.col("cc_applied"))
    condi = skills.filter(F.col("skill_name").isin(L.CONDITION_SKILL_NAMES)).select("skill_id", F.lit(True).alias("_condi"))
    named = per_skill.join(condi, "skill_id", "left").withColumn("condi_damage", F.when(F.col("_condi"), F.col("total_damage")).otherwise(0))
    return named.groupBy(FIGHT, "agent_id").agg(*[F.sum(c).alias(c) for c in [*SUMS, "acted", "counted"]])


def partial_targets(events: DataFrame) -> DataFrame:
    return events.filter("event_type = 'DAMAGE'").select(FIGHT, F.col("source_agent_id").cast("bigint").alias("agent_id"), F.col("target_agent_id").cast("bigint").alias("target_id")).distinct()


def partial_spans(events: DataFrame) -> DataFrame:
    """Least and greatest time, and the first and last hit or heal by their place in the stream."""
    hit = (F.coalesce(F.col("damage"), F.lit(0)) > 0) | (F.coalesce(F.col("healing"), F.lit(0)) > 0)
    first, last = F.when(hit & (F.col("time_ms") != 0), F.col("seq")), F.when(hit, F.col("seq"))
    return events.groupBy(FIGHT).agg(
        F.min("time_ms").alias("least_ms"), F.max("time_ms").alias("most_ms"), F.min(first).alias("first_seq"), F.min_by("time_ms", first).alias("first_ms"),
        F.max(last).alias("last_seq"), F.max_by("time_ms", last).alias("last_ms"),
    )


def partial_presence(events: DataFrame) -> DataFrame:
    """The 5-second buckets an agent is seen in, as bits of one word per stretch of 64 buckets.

    A word is a number, so rows are reduced before they are shuffled, and an agent seen for a moment leaves one word only.
    """
    seen = events.select(FIGHT, F.explode(F.array(*[F.col(c).cast("bigint") for c in ("source_agent_id", "target_agent_id")])).alias("agent_id"), F.floor(F.col("time_ms") / PRESENCE_MS).alias("bucket"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("bucket", F.lit(WORD_BITS)).cast("int"))
    return seen.groupBy(FIGHT, "agent_id", F.floor(F.col("bucket") / WORD_BITS).alias("part_no")).agg(F.bit_or(bit).alias("bits"))
