"""Per-(fight, account) summaries and the per-player readout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frayline.functions import lookups as L
from frayline.functions.roles import additive_roles, with_role
from frayline.operators.rollups import ACTION_KINDS, count_where, sum_where
from frayline.operators.timelines import TOTALS

FIGHT = "fight_id"


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


def contributions(events: DataFrame, players: DataFrame) -> DataFrame:
    """Damage, healing and removal totals of every acting account (``seq`` = its first agent)."""
    per_agent = (
        events.filter(F.col("event_type").isin(ACTION_KINDS))
        .groupBy(FIGHT, F.col("source_agent_id").alias("agent_id"))
        .agg(
            sum_where(_is("DAMAGE"), "damage").alias("total_damage"),
            sum_where(_is("HEALING"), "healing").alias("total_healing"),
            sum_where(_is("BUFF_REMOVAL"), "buff_removal").alias("total_buff_removal"),
        )
    )
    rows = per_agent.join(players, [FIGHT, "agent_id"])
    return rows.groupBy(FIGHT, "account_name").agg(
        F.min("agent_id").alias("seq"),
        F.min_by("name", "agent_id").alias("name"),
        F.min_by("profession", "agent_id").alias("profession"),
        F.min_by("elite", "agent_id").alias("elite"),
        *[F.sum(t).alias(t) for t in TOTALS],
    )


SUMS = ["total_damage", "condi_damage", "total_healing", "total_buff_removal", "boon_removals", "condition_cleanses", "cc_applied"]
UPTIMES = [f"{n}_uptime" for n in L.TRACKED_BOONS]
OUTGOING = [f"outgoing_{n}" for n in L.TRACKED_BOONS]


def agent_buckets(events: DataFrame, skills: DataFrame) -> DataFrame:
    """Raw sums and outgoing boons of every (fight, agent) that acts, or gives or receives a buff.

    Reduced per (agent, skill) before the skill join.
    """
    buffs = F.col("event_type").isin("BOON_APPLY", "BUFF_APPLY")
    sides = F.when(
        buffs & (F.col("source_agent_id") != F.col("target_agent_id")),
        F.array(
            F.struct(F.col("source_agent_id").alias("agent_id"), F.lit(True).alias("acts")),
            F.struct(F.col("target_agent_id").alias("agent_id"), F.lit(False).alias("acts")),
        ),
    ).otherwise(F.array(F.struct(F.col("source_agent_id").alias("agent_id"), F.lit(True).alias("acts"))))
    rows = events.withColumn("side", F.explode(sides)).withColumns(
        {"agent_id": F.col("side.agent_id"), "acts": F.col("side.acts")}
    )
    acts = F.col("acts")
    removal = acts & _is("BOON_APPLY") & (F.col("kind") != "apply")
    tracked = F.col("skill_id").isin(list(L.TRACKED_BOONS.values()))
    given = acts & _is("BOON_APPLY") & (F.col("kind") == "apply") & (F.col("source_agent_id") != F.col("target_agent_id")) & tracked
    per_skill = rows.groupBy(FIGHT, "agent_id", "skill_id").agg(
        sum_where(acts & _is("DAMAGE"), "damage").alias("total_damage"),
        sum_where(acts & _is("HEALING"), "healing").alias("total_healing"),
        sum_where(acts & _is("BUFF_REMOVAL"), "buff_removal").alias("total_buff_removal"),
        sum_where(removal & tracked, "stacks").alias("boon_removals"),
        sum_where(removal & ~tracked, "stacks").alias("condition_cleanses"),
        count_where(acts & _is("CC")).alias("cc_applied"),
        F.sum(F.when(given, F.col("duration_ms") * F.col("stacks"))).alias("_outgoing"),
    )
    condi = skills.filter(F.col("skill_name").isin(L.CONDITION_SKILL_NAMES)).select("skill_id", F.lit(True).alias("_condi"))
    per_skill = per_skill.join(condi, "skill_id", "left").withColumn(
        "condi_damage", F.when(F.col("_condi"), F.col("total_damage")).otherwise(0)
    )
    return per_skill.groupBy(FIGHT, "agent_id").agg(
        *[F.sum(c).alias(c) for c in SUMS],
        *[F.sum(F.when(F.col("skill_id") == i, F.col("_outgoing"))).alias(f"outgoing_{n}") for n, i in L.TRACKED_BOONS.items()],
    )


def _per_account(rows: DataFrame, *further: Column) -> DataFrame:
    """Sums per (fight, account) over its agents; those without any (``total_damage`` is null) lend it no name."""
    agent = F.when(F.col("total_damage").isNotNull(), F.col("agent_id"))
    out = rows.groupBy(FIGHT, "account_name").agg(
        *[F.min_by(c, agent).alias(c) for c in ("name", "profession", "elite")], *[F.sum(c).alias(c) for c in SUMS], *further
    )
    return out.withColumns(
        {
            "power_damage": F.col("total_damage") - F.col("condi_damage"),
            "boon_strips": F.col("boon_removals") + F.col("total_buff_removal"),
        }
    ).drop("boon_removals")


def account_buckets(events: DataFrame, players: DataFrame, skills: DataFrame) -> DataFrame:
    """Raw sums per (fight, account): what the summary row is built from.

    An account appears when one of its agents acts, or gives or receives a buff.
    """
    return _per_account(agent_buckets(events, skills).drop(*OUTGOING).join(players, [FIGHT, "agent_id"]))


def _merged() -> list[Column]:
    """Uptimes averaged over all agents of an account, outgoing boons summed."""
    return [(F.sum(u) / F.count(F.lit(1))).alias(u) for u in UPTIMES] + [F.sum(o).alias(o) for o in OUTGOING]


def merged_boons(agents: DataFrame, outgoing: DataFrame) -> DataFrame:
    """28 columns per account: ``agents`` (fight_id, agent_id, account_name, uptimes), ``outgoing(fight_id, agent_id, boon, outgoing)``."""
    given = outgoing.groupBy(FIGHT, "agent_id").agg(
        *[F.sum(F.when(F.col("boon") == n, F.col("outgoing"))).alias(f"outgoing_{n}") for n in L.TRACKED_BOONS]
    )
    return agents.join(given, [FIGHT, "agent_id"], "left").groupBy(FIGHT, "account_name").agg(*_merged())


def account_summaries(agents: DataFrame, buckets: DataFrame) -> DataFrame:
    """Sums and boons of every account one of whose agents has sums, in one shuffle by account.

    ``agents``: the players with their uptimes, ``buckets``: :func:`agent_buckets`.
    """
    rows = agents.join(buckets, [FIGHT, "agent_id"], "left")
    return _per_account(rows, *_merged()).filter("total_damage is not null")


def long_boons(summaries: DataFrame) -> DataFrame:
    """The normalised boon table from the 28 wide columns; a row stays if either value is set."""
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("boon_name"),
                F.col(f"{name}_uptime").alias("uptime"),
                F.col(f"outgoing_{name}").alias("outgoing"),
            )
            for name in L.TRACKED_BOONS
        ]
    )
    rows = summaries.select(FIGHT, "account_name", F.inline(entries))
    return rows.filter(F.col("uptime").isNotNull() | F.col("outgoing").isNotNull())


def fight_player_summaries(accounts: DataFrame, durations: DataFrame) -> DataFrame:
    """The materialised row per (fight, account): totals, boons, detected role, additive roles.

    ``accounts``: :func:`account_summaries`. The squad's healing is added up from all their columns (a hash stands for the
    others), so both readers of the accounts need the same ones and Spark reuses their shuffle.
    """
    whole = F.max(F.xxhash64(*accounts.columns)).alias("_whole")
    squad = accounts.groupBy(FIGHT).agg(F.sum("total_healing").alias("_squad_healing"), whole).filter("_whole is not null")
    fights = squad.drop("_whole").join(durations.select(FIGHT, "duration_s"), FIGHT, "left")
    rows = accounts.join(fights, FIGHT)
    rows = with_role(rows, power="power_damage", condi="condi_damage", outgoing_prefix="outgoing_")
    total_out = sum((F.coalesce(F.col(f"outgoing_{n}"), F.lit(0)) for n in L.TRACKED_BOONS), F.lit(0))
    share = F.when(F.col("_squad_healing") > 0, F.col("total_healing") / F.col("_squad_healing")).otherwise(0.0)
    seconds = F.greatest(F.coalesce(F.col("duration_s"), F.lit(0.0)), F.lit(1.0))
    rows = rows.withColumn("_boon_rate", total_out / seconds).withColumn("_share", share)
    roles = additive_roles(
        F.col("_share"), F.col("_boon_rate"), F.col("boon_strips"), F.col("condition_cleanses"), F.col("cc_applied")
    )
    return rows.withColumn("roles", roles).drop("_squad_healing", "_share", "_boon_rate", "duration_s")


def readout_details(readout: DataFrame, parts: list[DataFrame], counts: list[str]) -> DataFrame:
    """Readout rows with the columns of further per-agent tables; absent counts and rates are 0, absent text ''.

    Every part has one row per (fight, agent), so the rows never multiply.
    """
    for part in parts:
        readout = readout.join(part, [FIGHT, "agent_id"], "left")
    return readout.fillna(0, counts)
