"""Per-fight roll-ups.

Each is one conditional-aggregation pass: Spark combines map-side, so a fight,
target or skill holding a large share of the rows sends one partial row per
input partition. Dimension and duration joins happen after the aggregation and
are left to AQE, which broadcasts them only when their measured size allows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frayline.functions import lookups as L
from frayline.functions.combat import condition_part, is_condition_buff, safe_rate

FIGHT = "fight_id"


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def sum_where(condition: Column, value: str | Column) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("bigint")


def with_names(rows: DataFrame, agents: DataFrame, key: str) -> DataFrame:
    """Left join of display names; agents without one keep a null name."""
    names = agents.select(FIGHT, F.col("agent_id").alias(key), "name")
    return rows.join(names, [FIGHT, key], "left")


def with_duration(rows: DataFrame, durations: DataFrame) -> DataFrame:
    return rows.join(durations.select(FIGHT, "duration_s"), FIGHT, "left")


def ordered(rows: DataFrame, metric: str, *keys: str) -> DataFrame:
    """The display order of every roll-up: metric descending, keys ascending."""
    return rows.orderBy(F.col(metric).desc(), *[F.col(k).asc() for k in keys])


# -- rosters --------------------------------------------------------------------
def _has_account() -> Column:
    return F.col("is_player") & (F.coalesce(F.length("account_name"), F.lit(0)) > 0)


def fight_roster(agents: DataFrame, skills: DataFrame) -> DataFrame:
    """Agent, player, NPC and skill counts; players without an account count as NPCs."""
    counts = agents.groupBy(FIGHT).agg(
        F.count(F.lit(1)).alias("agent_count"), count_where(_has_account()).alias("player_count")
    )
    skill_counts = skills.groupBy(FIGHT).agg(F.count(F.lit(1)).alias("skill_count"))
    return counts.join(skill_counts, FIGHT, "left").select(
        FIGHT,
        "agent_count",
        "player_count",
        (F.col("agent_count") - F.col("player_count")).alias("npc_count"),
        F.coalesce("skill_count", F.lit(0)).alias("skill_count"),
    )


def subgroup_members(agents: DataFrame) -> DataFrame:
    """Player count per subgroup and its first and last account in name order."""
    players = agents.filter(_has_account()).withColumn("subgroup", F.coalesce("subgroup", F.lit("")))
    return players.groupBy(FIGHT, "subgroup").agg(
        F.count(F.lit(1)).alias("player_count"),
        F.min("account_name").alias("first_account"),
        F.max("account_name").alias("last_account"),
    )


def subgroup_accounts(agents: DataFrame) -> DataFrame:
    """The sorted member list of every subgroup, one row per member with its place: lists have no bound."""
    players = agents.filter(_has_account()).withColumn("subgroup", F.coalesce("subgroup", F.lit("")))
    names = players.groupBy(FIGHT, "subgroup", "account_name").agg(F.count(F.lit(1)).alias("characters"))
    place = Window.partitionBy(FIGHT, "subgroup").orderBy("account_name")
    return names.withColumn("position", F.row_number().over(place))


def combatants(agents: DataFrame) -> DataFrame:
    """Players of a fight in (account, name) order, one row each."""
    return agents.filter(_has_account()).select(
        FIGHT, "agent_id", "account_name", "name", F.coalesce("subgroup", F.lit("")).alias("subgroup"),
        "profession", "elite",
    )


def attendance(agents: DataFrame, fights: DataFrame) -> DataFrame:
    """Per-account attendance over many fights.

    Duplicate fight rows are ignored and fights without players drop out.
    Profession and elite are those of the first fight seen, the name that of the last.
    """
    fights = fights.select(FIGHT, "started_at").dropDuplicates([FIGHT])
    rows = agents.filter(_has_account()).join(fights, FIGHT)
    # one row per (account, fight) first: the hot accounts are already reduced when they meet
    per_fight = rows.groupBy("account_name", FIGHT).agg(
        F.min("started_at").alias("started_at"),
        F.min_by(F.struct("profession", "elite"), "agent_id").alias("first_spec"),
        F.max_by("name", "agent_id").alias("last_name"),
    )
    order = F.struct("started_at", FIGHT)
    return per_fight.groupBy("account_name").agg(
        F.count(F.lit(1)).alias("fights_attended"),
        F.min_by("first_spec.profession", order).alias("profession"),
        F.min_by("first_spec.elite", order).alias("elite"),
        F.max_by("last_name", order).alias("name"),
    )


# -- targets ----------------------------------------------------------------------
def _per_agent(
    events: DataFrame, kind: str, value: str, key: str, total: str, count: str, rate: str,
    durations: DataFrame, agents: DataFrame | None,
) -> DataFrame:
    rows = events.filter(_is(kind)).groupBy(FIGHT, key).agg(
        F.sum(value).alias(total), F.count(F.lit(1)).alias(count)
    )
    rows = with_duration(rows, durations)
    rows = rows.withColumn(rate, safe_rate(F.col(total), F.col("duration_s"))).drop("duration_s")
    return with_names(rows, agents, key) if agents is not None else rows.withColumn("name", F.lit(None).cast("string"))


def target_damage(events: DataFrame, durations: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    return _per_agent(events, "DAMAGE", "damage", "target_agent_id", "total_damage", "hit_count", "dps", durations, agents)


def target_healing(events: DataFrame, durations: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    return _per_agent(events, "HEALING", "healing", "target_agent_id", "total_healing", "heal_count", "hps", durations, agents)


def target_buff_removal(events: DataFrame, durations: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    return _per_agent(
        events, "BUFF_REMOVAL", "buff_removal", "target_agent_id", "total_removed", "removal_count", "bps", durations, agents
    )


# -- players ----------------------------------------------------------------------
def player_damage(
    events: DataFrame, durations: DataFrame, agents: DataFrame | None = None,
    condition: Column | None = None,
) -> DataFrame:
    """Damage per source; ``condition`` is the condition part of one hit."""
    condition = F.lit(0) if condition is None else condition
    rows = events.filter(_is("DAMAGE")).groupBy(FIGHT, "source_agent_id").agg(
        F.sum("damage").alias("total_damage"),
        F.count(F.lit(1)).alias("hit_count"),
        F.sum(condition).cast("bigint").alias("condi_damage"),
    )
    return _damage_rates(rows, durations, agents)


def _damage_rates(rows: DataFrame, durations: DataFrame, agents: DataFrame | None) -> DataFrame:
    rows = with_duration(rows, durations).withColumn("power_damage", F.col("total_damage") - F.col("condi_damage"))
    for total, rate in (("total_damage", "dps"), ("power_damage", "power_dps"), ("condi_damage", "condi_dps")):
        rows = rows.withColumn(rate, safe_rate(F.col(total), F.col("duration_s")))
    rows = rows.drop("duration_s")
    return with_names(rows, agents, "source_agent_id") if agents is not None else rows


def condition_split(events: DataFrame, fights: DataFrame, skills: DataFrame) -> DataFrame:
    """Damage, hits and condition damage per (fight, source, skill).

    Whether the build carries the condition part in the hit or leaves it to the
    skill's name is a property of (fight, skill), so both candidates are summed
    first and the dimensions join reduced rows.
    """
    carried = F.least(F.col("damage"), F.greatest(F.col("buff_dmg"), F.lit(0)))
    rows = events.filter(_is("DAMAGE")).groupBy(FIGHT, "source_agent_id", "skill_id").agg(
        F.sum("damage").alias("damage"), F.count(F.lit(1)).alias("hits"), F.sum(carried).alias("carried")
    )
    rows = rows.join(fights.select(FIGHT, "build_version"), FIGHT, "left").join(skills.select("skill_id", "skill_name"), "skill_id", "left")
    part = condition_part(F.col("build_version"), F.col("skill_name"), F.col("carried"))
    return rows.withColumn("condi", part).drop("carried", "build_version", "skill_name")


def player_damage_split(split: DataFrame, durations: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """Player damage from :func:`condition_split` rows."""
    rows = split.groupBy(FIGHT, "source_agent_id").agg(
        F.sum("damage").alias("total_damage"), F.sum("hits").alias("hit_count"), F.sum("condi").cast("bigint").alias("condi_damage")
    )
    return _damage_rates(rows, durations, agents)


def player_healing(
    events: DataFrame, durations: DataFrame, agents: DataFrame | None = None, barrier: Column | None = None
) -> DataFrame:
    """Healing per source; a source with only stun breaks appears with a heal count of 1."""
    barrier = F.lit(0) if barrier is None else barrier
    rows = events.filter(F.col("event_type").isin("HEALING", "STUN_BREAK")).groupBy(FIGHT, "source_agent_id").agg(
        sum_where(_is("HEALING"), "healing").alias("total_healing"),
        F.greatest(count_where(_is("HEALING")), F.lit(1)).alias("heal_count"),
        sum_where(_is("HEALING"), barrier).alias("barrier_total"),
        count_where(_is("STUN_BREAK")).alias("stun_breaks"),
    )
    rows = with_duration(rows, durations)
    rows = rows.withColumn("hps", safe_rate(F.col("total_healing"), F.col("duration_s")))
    rows = rows.withColumn("barrier_ps", safe_rate(F.col("barrier_total"), F.col("duration_s"))).drop("duration_s")
    return with_names(rows, agents, "source_agent_id") if agents is not None else rows


def player_boons(
    events: DataFrame, durations: DataFrame, columns: Mapping[str, int] = L.READOUT_BOONS
) -> DataFrame:
    """Applications given and received per agent, fixed boon columns, strips received.

    An event counts once for its source and once for its target, so rows are
    doubled before a partial aggregation rather than joined from two roll-ups.
    """
    apply_ = _is("BOON_APPLY") & (F.col("kind") == "apply")
    strip = _is("BUFF_REMOVAL") & (F.col("target_agent_id") > 0)
    sides = F.when(
        apply_,
        F.array(
            F.struct(F.col("source_agent_id").alias("agent_id"), F.lit("out").alias("side")),
            F.struct(F.col("target_agent_id").alias("agent_id"), F.lit("in").alias("side")),
        ),
    ).when(strip, F.array(F.struct(F.col("target_agent_id").alias("agent_id"), F.lit("strip").alias("side"))))
    rows = events.filter(apply_ | strip).select(FIGHT, "skill_id", F.explode(sides).alias("s"))
    rows = rows.select(FIGHT, "skill_id", "s.agent_id", "s.side")
    given = F.col("side") == "out"
    out = rows.groupBy(FIGHT, "agent_id").agg(
        count_where(given).alias("boons_out"),
        count_where(F.col("side") == "in").alias("boons_in"),
        *[count_where(given & (F.col("skill_id") == i)).alias(f"{n}_out") for n, i in columns.items()],
        count_where(F.col("side") == "strip").alias("strips_received_in"),
    )
    out = with_duration(out, durations)
    for side in ("out", "in"):
        out = out.withColumn(f"boons_{side}_rate", safe_rate(F.col(f"boons_{side}"), F.col("duration_s")))
    return out.drop("duration_s")


def other_boons(events: DataFrame, names: DataFrame, columns: Mapping[str, int] = L.READOUT_BOONS) -> DataFrame:
    """Applications of every other boon as one map per agent, keyed by name or ``Unknown (id)``.

    Counts are aggregated per (fight, agent, boon) first, so a map is built from
    one entry per distinct boon, never from events.
    """
    rows = events.filter(
        _is("BOON_APPLY") & (F.col("kind") == "apply") & ~F.col("skill_id").isin(list(columns.values()))
    )
    counts = rows.groupBy(FIGHT, F.col("source_agent_id").alias("agent_id"), "skill_id").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.join(names.select("skill_id", "skill_name"), "skill_id", "left")
    label = F.coalesce("skill_name", F.concat(F.lit("Unknown ("), F.col("skill_id").cast("string"), F.lit(")")))
    counts = counts.groupBy(FIGHT, "agent_id", label.alias("boon")).agg(F.sum("n").alias("n"))
    return counts.groupBy(FIGHT, "agent_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("boon", "n")))).alias("other_boons_out")
    )


def player_defense(events: DataFrame, barrier: Column | None = None) -> DataFrame:
    """Damage and CC taken (by target), deaths, dodges, blocks and interrupts (by actor)."""
    barrier = F.lit(0) if barrier is None else barrier
    taken = F.col("event_type").isin("DAMAGE", "CC")
    actor = F.col("event_type").isin("DEATH", "DODGE", "BLOCK", "INTERRUPT")
    rows = events.filter(taken | actor)
    agent = F.when(taken, F.col("target_agent_id")).otherwise(F.col("source_agent_id"))
    return rows.groupBy(FIGHT, agent.alias("agent_id")).agg(
        sum_where(_is("DAMAGE"), "damage").alias("damage_taken"),
        sum_where(_is("DAMAGE"), barrier).alias("barrier_absorbed"),
        sum_where(_is("CC"), "cc_value").alias("cc_taken"),
        count_where(_is("DEATH")).alias("deaths"),
        count_where(_is("DODGE")).alias("dodges"),
        count_where(_is("BLOCK")).alias("blocks"),
        count_where(_is("INTERRUPT")).alias("interrupts"),
    )


# -- squads and skills ----------------------------------------------------------------
ACTION_KINDS = ["DAMAGE", "HEALING", "BUFF_REMOVAL"]


def _action_totals() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("hit_count"),
        sum_where(_is("DAMAGE"), "damage").alias("total_damage"),
        sum_where(_is("HEALING"), "healing").alias("total_healing"),
        sum_where(_is("BUFF_REMOVAL"), "buff_removal").alias("total_buff_removal"),
    ]


def squad_rollup(events: DataFrame, agents: DataFrame, durations: DataFrame) -> DataFrame:
    """Totals per subgroup; sources without one fall into ''.

    Reduced per source before the subgroup join: the join then meets one row per
    (fight, agent), whatever the number of events.
    """
    per_source = (
        events.filter(F.col("event_type").isin(ACTION_KINDS)).groupBy(FIGHT, "source_agent_id").agg(*_action_totals())
    )
    groups = agents.select(FIGHT, F.col("agent_id").alias("source_agent_id"), "subgroup")
    totals = ["hit_count", "total_damage", "total_healing", "total_buff_removal"]
    rows = (
        per_source.join(groups, [FIGHT, "source_agent_id"], "left")
        .groupBy(FIGHT, F.coalesce("subgroup", F.lit("")).alias("subgroup"))
        .agg(*[F.sum(c).alias(c) for c in totals])
    )
    rows = with_duration(rows, durations)
    for total, rate in (("total_damage", "dps"), ("total_healing", "hps"), ("total_buff_removal", "bps")):
        rows = rows.withColumn(rate, safe_rate(F.col(total), F.col("duration_s")))
    return rows.drop("duration_s")


def skill_usage(events: DataFrame, skills: DataFrame, source: Column | None = None) -> DataFrame:
    """Hits and totals per skill; ``source`` narrows to chosen actors before the aggregation."""
    rows = events.filter(F.col("event_type").isin(ACTION_KINDS))
    keys = [FIGHT, "skill_id"]
    if source is not None:
        rows = rows.filter(source)
    rows = rows.groupBy(*keys).agg(*_action_totals())
    return rows.join(skills.select("skill_id", "skill_name"), "skill_id", "left").withColumn(
        "skill_name", F.coalesce("skill_name", F.lit(""))
    )


def player_skill_usage(events: DataFrame, players: DataFrame, skills: DataFrame) -> DataFrame:
    """Skill usage of every player account (all its agents together)."""
    per_agent = (
        events.filter(F.col("event_type").isin(ACTION_KINDS))
        .groupBy(FIGHT, "source_agent_id", "skill_id")
        .agg(*_action_totals())
    )
    who = players.select(FIGHT, F.col("agent_id").alias("source_agent_id"), "account_name")
    totals = ["hit_count", "total_damage", "total_healing", "total_buff_removal"]
    rows = per_agent.join(who, [FIGHT, "source_agent_id"]).groupBy(FIGHT, "account_name", "skill_id").agg(
        *[F.sum(c).alias(c) for c in totals]
    )
    return rows.join(skills.select("skill_id", "skill_name"), "skill_id", "left").withColumn(
        "skill_name", F.coalesce("skill_name", F.lit(""))
    )


# -- counters ----------------------------------------------------------------------
def combat_counters(events: DataFrame) -> DataFrame:
    """Cleanses, strips, CC and distinct cleave targets per source, positive down time per actor."""
    rows = events.filter(F.col("event_type").isin("BUFF_REMOVAL", "CC", "DAMAGE", "DOWN"))
    # first level keyed by target too: the distinct count becomes a count of rows
    per_target = rows.groupBy(FIGHT, "source_agent_id", F.when(_is("DAMAGE"), F.col("target_agent_id")).alias("hit")).agg(
        count_where(_is("BUFF_REMOVAL") & is_condition_buff(F.col("buff_id"))).alias("cleanses"),
        count_where(_is("BUFF_REMOVAL") & ~is_condition_buff(F.col("buff_id"))).alias("strips"),
        count_where(_is("CC")).alias("cc"),
        sum_where(_is("DOWN") & (F.col("downtime_ms") > 0), "downtime_ms").alias("downtime_ms"),
    )
    return per_target.groupBy(FIGHT, F.col("source_agent_id").alias("agent_id")).agg(
        F.sum("cleanses").alias("cleanses"),
        F.sum("strips").alias("strips"),
        F.sum("cc").alias("cc"),
        F.count("hit").alias("cleave_targets"),
        F.sum("downtime_ms").alias("downtime_ms"),
    )


def cleave_targets_estimate(events: DataFrame, rsd: float = 0.01) -> DataFrame:
    """HyperLogLog variant for dashboards that accept a relative error of ``rsd``."""
    return events.filter(_is("DAMAGE")).groupBy(FIGHT, F.col("source_agent_id").alias("agent_id")).agg(
        F.approx_count_distinct("target_agent_id", rsd).alias("cleave_targets")
    )


def kill_participation(events: DataFrame) -> DataFrame:
    """Each death credits every distinct source that ever damaged the victim in that fight.

    Both sides are reduced to (fight, victim[, source]) before they meet, so the
    join emits one row per distinct pair and deaths enter as a count.
    """
    deaths = events.filter(_is("DEATH")).groupBy(FIGHT, F.col("source_agent_id").alias("victim")).agg(F.count(F.lit(1)).alias("n"))
    hits = events.filter(_is("DAMAGE")).select(FIGHT, F.col("target_agent_id").alias("victim"), F.col("source_agent_id").alias("agent_id")).distinct()
    return hits.join(deaths, [FIGHT, "victim"]).groupBy(FIGHT, "agent_id").agg(F.sum("n").alias("kill_participation"))


def presence(events: DataFrame, players: DataFrame, durations: DataFrame, bucket_ms: int = 5000) -> DataFrame:
    """Share of 5-second buckets in which the agent acts or is acted on, capped at 100."""
    seen = events.select(
        FIGHT,
        F.explode(F.array("source_agent_id", "target_agent_id")).alias("agent_id"),
        F.floor(F.col("time_ms") / bucket_ms).alias("bucket"),
    ).distinct()
    counts = seen.groupBy(FIGHT, "agent_id").agg(F.count(F.lit(1)).alias("active_buckets"))
    rows = with_duration(counts.join(players.select(FIGHT, "agent_id"), [FIGHT, "agent_id"], "left_semi"), durations)
    total_ms = F.floor(F.col("duration_s") * 1000)
    buckets = F.greatest(F.ceil(total_ms / bucket_ms), F.lit(1))
    share = F.least(F.col("active_buckets") / buckets * 100.0, F.lit(100.0))
    return rows.select(FIGHT, "agent_id", "active_buckets", share.alias("presence_pct"))


def squad_totals(readout: DataFrame) -> DataFrame:
    """Totals bar over readout rows."""
    return readout.groupBy(FIGHT).agg(
        F.sum("dps").alias("dps"),
        F.sum("hps").alias("hps"),
        F.sum("strips").alias("strips"),
        F.sum("cleanses").alias("cleanses"),
        F.sum("cc").alias("cc"),
        count_where(F.array_contains("roles", "Heal")).alias("healers"),
        count_where(F.array_contains("roles", "Support")).alias("supports"),
    )


