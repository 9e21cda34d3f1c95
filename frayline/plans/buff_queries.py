"""Buff history, generation and uptime queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frayline.operators import buffs, records, rollups, summaries
from frayline.functions import lookups as L
from frayline.plans.registry import query
from frayline.plans.rollup_queries import fight_seconds, rounded
from frayline.plans.stack_sql import INTENSITY, NAMES, TRACKED, area, level_ctes, stack_ctes
from frayline.sources.corpus import Corpus

HOUR_MS = 3_600_000
BUFF_KINDS = ["BOON_APPLY", "BUFF_APPLY", "BUFF_EXTENSION"]


def fight_ends(c: Corpus) -> DataFrame:
    """End of each fight: its last event; the length is the same as time starts at 0."""
    return c.clock().groupBy("fight_id").agg(F.max("time_ms").alias("end_ms")).withColumn("length_ms", F.col("end_ms"))


def segments(c: Corpus) -> DataFrame:
    return buffs.stack_segments(buffs.stack_events(c.events(BUFF_KINDS)), fight_ends(c), HOUR_MS)


def _list(values) -> str:
    return "(" + ", ".join(str(v) for v in values) + ")"


_TRACKED = _list(L.TRACKED_BOONS.values())
_NAMES = "CASE skill_id " + " ".join(f"WHEN {i} THEN '{n}'" for n, i in L.TRACKED_BOONS.items()) + " END"
_ENDS = "ends AS (SELECT fight_id, max(time_ms) AS end_ms FROM ev GROUP BY 1)"
# stack level by the epoch formula: prefix sum minus the lowest prefix (or 0) since the last remove-all
HISTORY = """h0 AS (SELECT fight_id, target_agent_id AS agent_id, skill_id AS buff_id, seq, time_ms, kind,
      CASE kind WHEN 'apply' THEN stacks WHEN 'remove_single' THEN -stacks ELSE 0 END AS d,
      count(*) FILTER (kind = 'remove_all') OVER (PARTITION BY fight_id, target_agent_id, skill_id ORDER BY time_ms, seq) AS era
      FROM ev WHERE event_type = 'BOON_APPLY' AND kind <> 'remove_manual'),
    h1 AS (SELECT *, sum(d) OVER (PARTITION BY fight_id, agent_id, buff_id, era ORDER BY time_ms, seq) AS p FROM h0),
    hist AS (SELECT fight_id, agent_id, buff_id, seq, time_ms,
      CAST(p - least(0, min(p) OVER (PARTITION BY fight_id, agent_id, buff_id, era ORDER BY time_ms, seq)) AS BIGINT) AS stacks FROM h1)"""


@query("F1 N4 F4 V9", f"WITH {HISTORY} SELECT * FROM hist")
def stack_history(c: Corpus) -> DataFrame:
    return buffs.stack_history(c.events(["BOON_APPLY"]), HOUR_MS)


@query("F2 F3 N5", f"""
    WITH {HISTORY}, {_ENDS}, st AS (SELECT hist.*, coalesce(lead(time_ms) OVER (PARTITION BY hist.fight_id, agent_id, buff_id ORDER BY time_ms, seq), end_ms) AS until, end_ms
      FROM hist JOIN ends ON hist.fight_id = ends.fight_id)
    SELECT fight_id, agent_id, buff_id, CAST(sum(stacks * (until - time_ms)) AS BIGINT) AS stack_ms,
      CAST(sum(CASE WHEN stacks > 0 THEN until - time_ms ELSE 0 END) AS BIGINT) AS present_ms, max(end_ms) AS end_ms,
      round(least(100.0, sum(CASE WHEN stacks > 0 THEN until - time_ms ELSE 0 END) / max(end_ms) * 100.0), 6) AS present_pct
    FROM st GROUP BY 1, 2, 3""")
def stack_time(c: Corpus) -> DataFrame:
    history = buffs.stack_history(c.events(["BOON_APPLY"]), HOUR_MS)
    rows = buffs.stack_time(history, fight_ends(c), HOUR_MS)
    pct = buffs.interval_percent(F.col("present_ms"), F.col("end_ms"))
    return rounded(rows.withColumn("present_pct", pct), "present_pct")


@query("F5", f"""
    SELECT fight_id, source_agent_id AS agent_id, {_NAMES} AS boon, CAST(sum(duration_ms * stacks) AS BIGINT) AS outgoing
    FROM ev WHERE kind = 'apply' AND source_agent_id <> target_agent_id AND skill_id IN {_TRACKED} GROUP BY 1, 2, 3""")
def outgoing_boons(c: Corpus) -> DataFrame:
    return buffs.outgoing_generation(c.events(["BOON_APPLY"]))


def _key_uptimes(c: Corpus, intensity: bool) -> DataFrame:
    """Uptime of every (fight, agent, buff) that any stack event names."""
    stacks = buffs.stack_events(c.events(BUFF_KINDS))
    ours = F.col("buff_id").isin(buffs.INTENSITY_IDS) == F.lit(intensity)
    times = segments(c).filter(ours).groupBy(*buffs.KEYS).agg(F.sum((F.col("end_ms") - F.col("start_ms")) * F.col("stacks")).alias("stack_ms"))
    rows = stacks.filter(ours).select(*buffs.KEYS).distinct().join(times, buffs.KEYS, "left").join(fight_ends(c), "fight_id")
    value = buffs.uptime_value(F.col("buff_id"), F.coalesce("stack_ms", F.lit(0)), F.col("length_ms"))
    return rounded(rows.withColumn("uptime", value), "uptime").select(*buffs.KEYS, "uptime")


_VALUE = "round(CASE WHEN buff_id IN {i} THEN {a} / {n} ELSE least(100.0, {a} / {n} * 100.0) END, 6)"


def _uptime(stack_ms: str, length: str) -> str:
    return _VALUE.format(i=INTENSITY, a=stack_ms, n=length)


def _key_sql(which: str) -> str:
    return f"""WITH RECURSIVE {stack_ctes()}
      SELECT sg.fight_id, agent_id, buff_id, {_uptime(f"sum({area()})", "any_value(end_ms)")} AS uptime
      FROM sg JOIN ends ON sg.fight_id = ends.fight_id WHERE {which} GROUP BY 1, 2, 3"""


@query("F6 F8 F9 F10", _key_sql("intensity"))
def plain_intensity_uptime(c: Corpus) -> DataFrame:
    """Average stacks of every intensity key."""
    return _key_uptimes(c, True)


@query("F7 F8 F9 F10", _key_sql("NOT intensity"))
def plain_queue_uptime(c: Corpus) -> DataFrame:
    """Uptime of every queue key."""
    return _key_uptimes(c, False)


def _agent_sql(clears: bool) -> str:
    boons = ", ".join(f"('{n}', {i})" for n, i in L.TRACKED_BOONS.items())
    return f"""WITH RECURSIVE {stack_ctes(clears)},
      tm AS (SELECT fight_id, agent_id, buff_id, sum({area()}) AS stack_ms FROM sg GROUP BY 1, 2, 3)
      SELECT a.fight_id, a.agent_id, boon, {_uptime("coalesce(stack_ms, 0)", "end_ms").replace("buff_id IN", "b.buff_id IN")} AS uptime
      FROM agents a JOIN ends ON a.fight_id = ends.fight_id CROSS JOIN (VALUES {boons}) AS b(boon, buff_id)
      LEFT JOIN tm ON tm.fight_id = a.fight_id AND tm.agent_id = a.agent_id AND tm.buff_id = b.buff_id"""


@query("F6 F7 F8 F9 F10", f"WITH RECURSIVE {stack_ctes()}, {level_ctes()} SELECT * FROM lv")
def stack_segments(c: Corpus) -> DataFrame:
    return buffs.merged_segments(segments(c), HOUR_MS)


@query("F12", _agent_sql(False))
def boon_uptimes(c: Corpus) -> DataFrame:
    return rounded(buffs.boon_uptimes(segments(c), c.agents(), fight_ends(c)), "uptime")


@query("F11", _agent_sql(True))
def uptimes_until_despawn(c: Corpus) -> DataFrame:
    despawns = c.events(["DESPAWN"]).select("fight_id", F.col("source_agent_id").alias("agent_id"), "seq", "time_ms")
    stacks = buffs.with_agent_ends(buffs.stack_events(c.events(BUFF_KINDS)), despawns)
    ends = fight_ends(c)
    return rounded(buffs.boon_uptimes(buffs.stack_segments(stacks, ends, HOUR_MS), c.agents(), ends), "uptime")


@query("F13", f"""
    WITH RECURSIVE {stack_ctes()}, aw AS (SELECT fight_id, agent_id, min(time_ms) AS first_ms, max(time_ms) AS last_ms FROM (
        SELECT fight_id, source_agent_id AS agent_id, time_ms FROM ev UNION ALL SELECT fight_id, target_agent_id, time_ms FROM ev) x GROUP BY 1, 2),
    wn AS (SELECT a.fight_id, a.agent_id, instance_id AS entity, end_ms // 2 - end_ms // 4 AS length, greatest(end_ms // 4, first_ms) AS lo, least(end_ms // 2, last_ms) AS hi
      FROM agents a JOIN ends ON a.fight_id = ends.fight_id JOIN aw ON aw.fight_id = a.fight_id AND aw.agent_id = a.agent_id),
    ar AS (SELECT sg.fight_id, entity, buff_id, length, {area("lo", "hi")} AS held FROM sg JOIN wn ON sg.fight_id = wn.fight_id AND sg.agent_id = wn.agent_id WHERE hi > lo)
    SELECT fight_id, entity, {NAMES} AS boon, {_uptime("sum(held)", "max(length)")} AS uptime FROM ar GROUP BY fight_id, entity, buff_id HAVING sum(held) > 0""")
def merged_instance_uptimes(c: Corpus) -> DataFrame:
    """Agents sharing an instance id taken as one entity over the second quarter of the fight."""
    ends = fight_ends(c)
    spans = (
        c.events()
        .select("fight_id", F.explode(F.array("source_agent_id", "target_agent_id")).alias("agent_id"), "time_ms")
        .groupBy("fight_id", "agent_id").agg(F.min("time_ms").alias("first_ms"), F.max("time_ms").alias("last_ms"))
    )
    groups = c.agents().join(ends, "fight_id").select(
        "fight_id", F.col("instance_id").alias("entity"), "agent_id",
        F.expr("end_ms div 4").alias("lo_ms"), F.expr("end_ms div 2").alias("hi_ms"),
    )
    return rounded(buffs.merged_uptimes(segments(c), groups, spans).filter("uptime > 0"), "uptime")


def account_boons(c: Corpus) -> DataFrame:
    """28 boon columns per account."""
    players = buffs.with_uptimes(c.players().select("fight_id", "agent_id", "account_name"), segments(c), fight_ends(c))
    return summaries.merged_boons(players, buffs.outgoing_generation(c.events(["BOON_APPLY"])))


_ACCOUNT_BOONS = f"""{stack_ctes()},
    tm AS (SELECT fight_id, agent_id, buff_id, sum({area()}) AS stack_ms FROM sg GROUP BY 1, 2, 3),
    og AS (SELECT fight_id, source_agent_id AS agent_id, skill_id AS buff_id, sum(duration_ms * stacks) AS outgoing
      FROM ev WHERE kind = 'apply' AND source_agent_id <> target_agent_id AND skill_id IN {TRACKED} GROUP BY 1, 2, 3),
    ab AS (SELECT p.fight_id, account_name, boon AS boon_name, CAST(sum(outgoing) AS BIGINT) AS outgoing,
        round(avg(CASE WHEN b.buff_id IN {INTENSITY} THEN coalesce(stack_ms, 0) / end_ms ELSE least(100.0, coalesce(stack_ms, 0) / end_ms * 100.0) END), 6) AS uptime
      FROM players p JOIN ends ON p.fight_id = ends.fight_id CROSS JOIN (VALUES {", ".join(f"('{n}', {i})" for n, i in L.TRACKED_BOONS.items())}) AS b(boon, buff_id)
      LEFT JOIN tm ON tm.fight_id = p.fight_id AND tm.agent_id = p.agent_id AND tm.buff_id = b.buff_id
      LEFT JOIN og ON og.fight_id = p.fight_id AND og.agent_id = p.agent_id AND og.buff_id = b.buff_id GROUP BY 1, 2, 3)"""


@query("A24", f"WITH RECURSIVE {_ACCOUNT_BOONS} SELECT * FROM ab")
def merged_account_boons(c: Corpus) -> DataFrame:
    return rounded(summaries.long_boons(account_boons(c)), "uptime")


def summary_rows(c: Corpus) -> DataFrame:
    players = c.players().select("fight_id", "agent_id", "account_name", "name", "profession", "elite")
    accounts = summaries.account_summaries(buffs.with_uptimes(players, segments(c), fight_ends(c)), summaries.agent_buckets(c.events(), c.skills()))
    return summaries.fight_player_summaries(accounts, records.event_spans(c.clock()))


@query("S8", f"WITH RECURSIVE {_ACCOUNT_BOONS} SELECT * FROM ab WHERE uptime IS NOT NULL OR outgoing IS NOT NULL")
def fight_player_boons(c: Corpus) -> DataFrame:
    """Long boon rows unpivoted back from the wide summary columns."""
    return rounded(summaries.long_boons(account_boons(c)), "uptime")


@query("A22", """
    WITH sd AS (SELECT e.*, s.skill_name FROM ev e LEFT JOIN skills s ON e.skill_id = s.skill_id),
    ag AS (SELECT fight_id, source_agent_id AS agent_id, true AS acts, sd.* EXCLUDE (fight_id) FROM sd
      UNION ALL SELECT fight_id, target_agent_id, false, sd.* EXCLUDE (fight_id) FROM sd
        WHERE event_type IN ('BOON_APPLY', 'BUFF_APPLY') AND source_agent_id <> target_agent_id)
    SELECT p.fight_id, account_name, min_by(name, p.agent_id) AS name, min_by(profession, p.agent_id) AS profession, min_by(elite, p.agent_id) AS elite,
      CAST(coalesce(sum(damage) FILTER (acts), 0) AS BIGINT) AS total_damage,
      CAST(coalesce(sum(damage) FILTER (acts AND skill_name IN ('Bleeding', 'Burning', 'Confusion', 'Poisoned', 'Torment')), 0) AS BIGINT) AS condi_damage,
      CAST(coalesce(sum(damage) FILTER (acts AND coalesce(skill_name, '') NOT IN ('Bleeding', 'Burning', 'Confusion', 'Poisoned', 'Torment')), 0) AS BIGINT) AS power_damage,
      CAST(coalesce(sum(healing) FILTER (acts), 0) AS BIGINT) AS total_healing,
      CAST(coalesce(sum(buff_removal) FILTER (acts), 0) AS BIGINT) AS total_buff_removal,
      CAST(coalesce(sum(stacks) FILTER (acts AND kind <> 'apply' AND ag.skill_id <> 50001), 0) + coalesce(sum(buff_removal) FILTER (acts), 0) AS BIGINT) AS boon_strips,
      CAST(coalesce(sum(stacks) FILTER (acts AND kind <> 'apply' AND ag.skill_id = 50001), 0) AS BIGINT) AS condition_cleanses,
      count(*) FILTER (acts AND event_type = 'CC') AS cc_applied
    FROM ag JOIN players p ON ag.fight_id = p.fight_id AND ag.agent_id = p.agent_id GROUP BY 1, 2""")
def summary_buckets(c: Corpus) -> DataFrame:
    return summaries.account_buckets(c.events(), c.players(), c.skills())
