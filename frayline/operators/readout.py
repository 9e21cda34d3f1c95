"""The per-player readout from one pass over the events.

Every event becomes narrow tally rows (fight, agent, metric, key) with two amounts; one shuffle adds them up. The key is
the skill, the stretch of time or the other agent where a metric counts distinct ones or is looked up by them, so distinct
counts are counts of rows, or of bits. A second, reduced shuffle turns the tallies of an agent into columns.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frayline.functions import lookups as L
from frayline.functions.combat import is_condition_buff, safe_rate
from frayline.functions.roles import readout_roles, with_role
from frayline.operators.rollups import FIGHT

BUCKET_MS = 5000
# metrics by what makes a member of the readout: being down, seen or hit by someone alone does not
ACTS = ["damage", "heal", "stun_break", "boon", "boon_in", "strip_in", "taken", "cc_taken", "death", "dodge", "block", "interrupt", "cleanse", "strip", "cc"]


def _is(*kinds: str) -> Column:
    return F.col("event_type").isin(*kinds)


def tallies(events: DataFrame) -> DataFrame:
    """(fight, agent, metric, k) with count ``n``, sums ``a`` and ``b`` and ``bits``: the only pass over the events.

    Buckets of time an agent is seen in are the bits of one row per 64 buckets, so a busy agent has few rows however many events name it.
    """
    source, target, zero = F.col("source_agent_id"), F.col("target_agent_id"), F.lit(0)
    long = lambda c: F.coalesce(c, zero).cast("bigint")
    row = lambda metric, agent, k=zero, a=zero, b=zero, bits=F.lit(None): F.struct(
        agent.cast("bigint").alias("agent_id"), F.lit(metric).alias("metric"), long(k).alias("k"), long(a).alias("a"), long(b).alias("b"), bits.cast("bigint").alias("bits"),
    )
    bucket = F.floor(F.col("time_ms") / BUCKET_MS)
    seen = lambda agent: row("seen", agent, F.floor(bucket / 64), bits=F.expr("shiftleft(1L, cast(pmod(floor(time_ms / %d), 64) as int))" % BUCKET_MS))
    hit, removal, apply_ = _is("DAMAGE"), _is("BUFF_REMOVAL"), _is("BOON_APPLY") & (F.col("kind") == "apply")
    given = F.when(source != target, F.col("duration_ms") * F.col("stacks"))
    condition = is_condition_buff(F.col("buff_id"))
    named = lambda *kinds: [(_is(k.upper()), row(k, source)) for k in kinds]
    # an event is of one kind, so a place in the list is shared by all kinds: five plain places compile, fifteen with a filter over the list do not
    places = [
        [
            (hit, row("damage", source, F.col("skill_id"), F.col("damage"), F.least(F.col("damage"), F.greatest(F.col("buff_dmg"), zero)))),
            (_is("HEALING"), row("heal", source, a=F.col("healing"), b=F.col("barrier"))),
            (apply_, row("boon", source, F.col("skill_id"), a=given)),
            (removal & condition, row("cleanse", source)), (removal & ~condition, row("strip", source)),
            (_is("DOWN") & (F.col("downtime_ms") > 0), row("down", source, a=F.col("downtime_ms"))),
            *named("stun_break", "cc", "death", "dodge", "block", "interrupt"),
        ],
        [
            (hit, row("hit_by", target, source)),
            (apply_, row("boon_in", target)),
            (removal & (target > 0), row("strip_in", target)),
            (_is("CC"), row("cc_taken", target, a=F.col("cc_value"))),
        ],
        [(hit, row("taken", target, a=F.col("damage"), b=F.col("shield_damage")))],
    ]
    first = lambda rules: functools.reduce(lambda case, rule: case.when(*rule), rules[1:], F.when(*rules[0]))
    rows = [*map(first, places), seen(source), seen(target)]
    made = events.select(FIGHT, F.inline(F.array(*rows))).filter("metric is not null")
    return made.groupBy(FIGHT, "agent_id", "metric", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.bit_or("bits").alias("bits"))


def _of(metric: str, value: str | Column = "n", also: Column | None = None) -> Column:
    test = F.col("metric") == metric
    return F.coalesce(F.sum(F.when(test if also is None else test & also, F.col(value) if isinstance(value, str) else value)), F.lit(0))


def agent_columns(tallied: DataFrame, skills: DataFrame) -> DataFrame:
    """One row per (fight, agent): every count and total, both candidates of the condition damage, and membership."""
    named = skills.filter(F.col("skill_name").isin(L.CONDITION_SKILL_NAMES)).select(F.col("skill_id").cast("bigint").alias("_skill"), F.lit(True).alias("_condi"))
    # rows of other metrics get keys of their own that meet no skill, so they spread
    spread = -1 - F.shiftrightunsigned(F.xxhash64("agent_id", "metric", "k"), 2)
    rows = tallied.withColumn("_skill", F.when(F.col("metric") == "damage", F.col("k")).otherwise(spread)).join(named, "_skill", "left")
    # a victim's deaths reach all who hit it: those rows then belong to the one who hit
    died = F.sum(F.when(F.col("metric") == "death", F.col("n"))).over(Window.partitionBy(FIGHT, "agent_id"))
    pair = F.col("metric") == "hit_by"
    rows = rows.withColumn("_died", F.when(pair, died)).withColumn("agent_id", F.when(pair, F.col("k")).otherwise(F.col("agent_id")))
    boon = lambda ids, value: _of("boon", value, F.col("k") == ids)
    return rows.groupBy(FIGHT, "agent_id").agg(
        (F.count(F.when(F.col("metric").isin(ACTS) | (F.col("_died") > 0), 1)) > 0).alias("member"),
        _of("damage", "a").alias("total_damage"), _of("damage").alias("hit_count"), _of("damage", "b").alias("condi_carried"), _of("damage", "a", F.col("_condi")).alias("condi_named"),
        _of("heal", "a").alias("total_healing"), _of("heal", "b").alias("barrier_total"), _of("stun_break").alias("stun_breaks"),
        _of("boon").alias("boons_out"), _of("boon_in").alias("boons_in"), _of("strip_in").alias("strips_received_in"),
        _of("taken", "a").alias("damage_taken"), _of("taken", "b").alias("barrier_absorbed"), _of("cc_taken", "a").alias("cc_taken"),
        _of("death").alias("deaths"), _of("dodge").alias("dodges"), _of("block").alias("blocks"), _of("interrupt").alias("interrupts"),
        _of("cleanse").alias("cleanses"), _of("strip").alias("strips"), _of("cc").alias("cc"),
        _of("hit_by", F.lit(1)).cast("bigint").alias("cleave_targets"), _of("hit_by", "_died").cast("bigint").alias("kill_participation"),
        _of("down", "a").alias("downtime_ms"), _of("seen", F.bit_count("bits")).cast("bigint").alias("active_buckets"),
        *[boon(i, "n").alias(f"{b}_out") for b, i in L.READOUT_BOONS.items()],
        *[boon(i, "a").alias(f"outgoing_{b}") for b, i in L.TRACKED_BOONS.items()],
    )


def readout(events: DataFrame, players: DataFrame, durations: DataFrame, fights: DataFrame, skills: DataFrame) -> DataFrame:
    """One row per player found in any metric set, with rates, presence, boon columns, role and labels."""
    rows = agent_columns(tallies(events), skills).filter("member").drop("member").join(players, [FIGHT, "agent_id"])
    rows = rows.join(durations.select(FIGHT, "duration_s"), FIGHT, "left").join(fights.select(FIGHT, "build_version"), FIGHT, "left")
    build = F.when(F.col("build_version").rlike("^[0-9]+$"), F.col("build_version").try_cast("bigint"))
    condi = F.when(F.coalesce(build >= L.SPLIT_BUILD, F.lit(False)), F.col("condi_carried")).otherwise(F.col("condi_named"))
    rows = rows.withColumns({"condi_damage": condi, "power_damage": F.col("total_damage") - condi})
    seconds = F.col("duration_s")
    rates = {
        "dps": "total_damage", "power_dps": "power_damage", "condi_dps": "condi_damage", "hps": "total_healing", "barrier_ps": "barrier_total",
        "boons_out_rate": "boons_out", "boons_in_rate": "boons_in",
    }
    buckets = F.greatest(F.ceil(F.floor(seconds * 1000) / BUCKET_MS), F.lit(1))
    present = F.coalesce(F.least(F.col("active_buckets") / buckets * 100.0, F.lit(100.0)), F.lit(0.0))
    rows = rows.withColumns({rate: safe_rate(F.col(total), seconds) for rate, total in rates.items()} | {"presence_pct": present})
    rows = rows.drop("duration_s", "build_version", "condi_carried", "condi_named", "active_buckets")
    return readout_roles(with_role(rows, removal="strips", outgoing_prefix="outgoing_"))
