"""Down contribution, identity, position and cast queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frayline.operators import classify, downs, identity, positions, rotation
from frayline.operators.scan import covered_by_any, near_any
from frayline.plans.registry import QUERIES, query
from frayline.plans.rollup_queries import fight_seconds, rounded
from frayline.session import Stage
from frayline.sources.corpus import BUFF_CHOICES, Corpus, StagedCorpus, pick

HOUR_MS = 3_600_000
DOWN_KINDS = ["DAMAGE", "CC", "DOWN", "UP", "DEATH", "HEALTH_UPDATE", "COMBAT_OUTCOME"]

_WINDOWS = """dn AS (SELECT DISTINCT fight_id, source_agent_id AS a, time_ms AS t FROM ev d WHERE event_type = 'DOWN' AND NOT (
        EXISTS (SELECT 1 FROM ev x WHERE x.event_type = 'DEATH' AND x.fight_id = d.fight_id AND x.source_agent_id = d.source_agent_id AND x.time_ms = d.time_ms)
        AND NOT EXISTS (SELECT 1 FROM ev x WHERE x.event_type = 'UP' AND x.fight_id = d.fight_id AND x.source_agent_id = d.source_agent_id AND x.time_ms = d.time_ms))),
    dr AS (SELECT dn.*, coalesce((SELECT max(time_ms) FROM ev u WHERE u.event_type = 'UP' AND u.fight_id = dn.fight_id AND u.source_agent_id = a AND u.time_ms < t), -1) AS r FROM dn),
    dh AS (SELECT dr.*, (SELECT max(time_ms) FROM ev h WHERE h.event_type = 'HEALTH_UPDATE' AND h.fight_id = dr.fight_id AND h.source_agent_id = a AND h.time_ms > r AND h.time_ms < t AND health_percent > 90) AS hi FROM dr),
    win AS (SELECT fight_id, a AS agent_id, CASE WHEN hi IS NULL THEN r + 1 ELSE (SELECT min(time_ms) FROM ev h WHERE h.event_type = 'HEALTH_UPDATE'
        AND h.fight_id = dh.fight_id AND h.source_agent_id = a AND h.time_ms > hi AND h.time_ms < t AND health_percent <= 90) END AS start_ms, t AS end_ms FROM dh)"""


@query("F14", f"WITH {_WINDOWS} SELECT * FROM win WHERE start_ms IS NOT NULL")
def pre_down_windows(c: Corpus) -> DataFrame:
    return downs.pre_down_windows(c.events(["DOWN", "UP", "DEATH", "HEALTH_UPDATE"]), HOUR_MS)


_OUTCOMES = """oc AS (SELECT fight_id, agent AS source_agent_id, count(*) FILTER (what = 'downed') AS downs, count(*) FILTER (what = 'killed') AS kills
      FROM (SELECT fight_id, source_agent_id AS agent, outcome AS what FROM ev WHERE event_type = 'COMBAT_OUTCOME'
            UNION ALL SELECT fight_id, killed_by_agent_id, 'killed' FROM ev WHERE killed_by_agent_id IS NOT NULL) x GROUP BY 1, 2)"""


@query("F15 F17 J13", f"""
    WITH {_WINDOWS}, {_OUTCOMES}, ac AS (SELECT *, EXISTS (SELECT 1 FROM win WHERE win.fight_id = ev.fight_id AND win.agent_id = ev.target_agent_id
        AND start_ms <= ev.time_ms AND ev.time_ms < end_ms) AS inw,
      event_type = 'DAMAGE' AND against_downed AND (CASE WHEN is_condition THEN connected WHEN connected THEN true WHEN buff_dmg > 0 THEN damage > 0 ELSE result IN (0, 1, 2, 8, 10) END) AS dh
      FROM ev WHERE event_type IN ('DAMAGE', 'CC')),
    st AS (SELECT fight_id, source_agent_id, sum(damage) FILTER (inw AND damage > 0) AS dcd, sum(damage) FILTER (dh) AS add_, count(*) FILTER (dh) AS adc,
      count(*) FILTER (inw AND event_type = 'CC') AS ccc, sum(cc_value) FILTER (inw) AS ccm FROM ac WHERE event_type = 'DAMAGE' OR inw GROUP BY 1, 2)
    SELECT coalesce(st.fight_id, oc.fight_id) AS fight_id, coalesce(st.source_agent_id, oc.source_agent_id) AS source_agent_id,
      CAST(coalesce(dcd, 0) AS BIGINT) AS down_contribution_damage, CAST(coalesce(add_, 0) AS BIGINT) AS against_downed_damage, coalesce(adc, 0) AS against_downed_count,
      coalesce(ccc, 0) AS down_contribution_cc_count, CAST(coalesce(ccm, 0) AS BIGINT) AS down_contribution_cc_ms, coalesce(downs, 0) AS downs, coalesce(kills, 0) AS kills,
      round(coalesce(dcd, 0) / duration_s, 6) AS down_contribution_dps
    FROM st FULL JOIN oc ON st.fight_id = oc.fight_id AND st.source_agent_id = oc.source_agent_id
    JOIN durations d ON d.fight_id = coalesce(st.fight_id, oc.fight_id)""")
def down_contribution(c: Corpus) -> DataFrame:
    rows = downs.down_contribution(c.events(DOWN_KINDS), fight_seconds(c), HOUR_MS)
    return rounded(rows, "down_contribution_dps")


@query("F16", f"""
    WITH {_OUTCOMES}, tl AS (SELECT fight_id, CASE WHEN event_type = 'DAMAGE' THEN target_agent_id ELSE source_agent_id END AS agent, source_agent_id, seq, time_ms, event_type, damage, skill_id,
        CASE event_type WHEN 'DAMAGE' THEN 0 WHEN 'DOWN' THEN 1 ELSE 2 END AS prio, CASE event_type WHEN 'DOWN' THEN 1 WHEN 'DEATH' THEN 0 WHEN 'UP' THEN 0 END AS state
        FROM ev WHERE event_type IN ('DAMAGE', 'DOWN', 'DEATH', 'UP')),
    dw AS (SELECT *, last_value(state IGNORE NULLS) OVER (PARTITION BY fight_id, agent ORDER BY time_ms, prio, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS down FROM tl),
    st AS (SELECT fight_id, source_agent_id, sum(damage) AS dcd FROM dw WHERE event_type = 'DAMAGE' AND down = 1
      AND skill_id NOT IN (740, 725, 717, 718, 719, 726, 743, 1122, 1187, 873, 5974, 30336, 13017, 26980) GROUP BY 1, 2)
    SELECT coalesce(st.fight_id, oc.fight_id) AS fight_id, coalesce(st.source_agent_id, oc.source_agent_id) AS source_agent_id,
      CAST(coalesce(dcd, 0) AS BIGINT) AS down_contribution_damage, coalesce(downs, 0) AS downs, coalesce(kills, 0) AS kills,
      round(coalesce(dcd, 0) / duration_s, 6) AS down_contribution_dps
    FROM st FULL JOIN oc ON st.fight_id = oc.fight_id AND st.source_agent_id = oc.source_agent_id
    JOIN durations d ON d.fight_id = coalesce(st.fight_id, oc.fight_id)""")
def legacy_down_contribution(c: Corpus) -> DataFrame:
    rows = downs.legacy_down_contribution(c.events(DOWN_KINDS), fight_seconds(c), chunk_ms=HOUR_MS)
    return rounded(rows, "down_contribution_dps")


# -- identity -------------------------------------------------------------------------
_INTERVALS = """orig AS (SELECT fight_id, min(time) AS origin, max(time) AS last FROM raw WHERE time > 0 GROUP BY 1),
    mk AS (SELECT r.fight_id, src AS agent_id, r.seq, time, statechange = 6 AS fresh, CASE WHEN statechange = 7 THEN 'gone' ELSE coalesce(CAST(m.master AS VARCHAR), 'none') END AS state,
      CASE WHEN statechange <> 7 THEN m.master END AS owner, src_inst FROM raw r LEFT JOIN mst m ON r.fight_id = m.fight_id AND r.seq = m.seq
      WHERE time > 0 AND src <> 0 AND (statechange IN (6, 7) OR src_master <> 0)),
    ch AS (SELECT * FROM (SELECT *, lag(state) OVER (PARTITION BY fight_id, agent_id ORDER BY time, seq) AS before FROM mk) x WHERE fresh OR before IS NULL OR before <> state),
    iv AS (SELECT n.fight_id, agent_id, owner AS owner_agent_id, src_inst AS instance_id, time - origin AS start_ms, coalesce(nx, last) - origin AS end_ms
      FROM (SELECT *, lead(time) OVER (PARTITION BY fight_id, agent_id ORDER BY time, seq) AS nx FROM ch) n JOIN orig ON n.fight_id = orig.fight_id
      WHERE state <> 'gone' AND coalesce(nx, last) > time)"""
_SPANS = """sp AS (SELECT a.fight_id, agent_id, min(time) - any_value(origin) AS first_ms, max(time) - any_value(origin) AS last_ms
    FROM (SELECT fight_id, time, src AS agent_id, statechange FROM raw UNION ALL SELECT fight_id, time, dst, statechange FROM raw WHERE statechange <> 19) a
    JOIN orig ON a.fight_id = orig.fight_id WHERE time > 0 AND agent_id <> 0 AND (a.fight_id, agent_id) IN (SELECT (fight_id, agent_id) FROM agents) AND statechange NOT IN (8, 27) GROUP BY 1, 2)"""


def intervals(c: Corpus) -> DataFrame:
    raw = c.raw_records()
    return identity.ownership_intervals(classify.resolve_masters(raw), raw, HOUR_MS)


def spans(c: Corpus) -> DataFrame:
    """Awareness of the known agents. Position records pack coordinates into dst and name no agent there, but one in src."""
    known = c.agents().select("fight_id", "agent_id")
    raw = c.raw_records().withColumn("dst", F.when(F.col("statechange") == 19, 0).otherwise(F.col("dst")))
    return classify.awareness(raw).join(known, ["fight_id", "agent_id"], "left_semi")


@query("C12", f"WITH {_INTERVALS} SELECT * FROM iv")
def ownership_intervals(c: Corpus) -> DataFrame:
    return intervals(c)


_PROBES = "pr AS (SELECT fight_id, seq, time_ms, user_id % 12 AS agent_id FROM ev0)"


def probes(c: Corpus) -> DataFrame:
    return c.base().select("fight_id", "seq", "time_ms", (F.col("user_id") % 12).alias("agent_id"))


@query("J7", f"""
    WITH {_INTERVALS}, {_PROBES} SELECT pr.fight_id, pr.seq, pr.time_ms, pr.agent_id, owner_agent_id FROM pr LEFT JOIN iv
      ON pr.fight_id = iv.fight_id AND pr.agent_id = iv.agent_id AND start_ms <= time_ms AND time_ms < end_ms""")
def owner_at_event(c: Corpus) -> DataFrame:
    return identity.owner_at(probes(c), intervals(c), HOUR_MS)


@query("J7", f"""
    WITH {_INTERVALS}, {_PROBES} SELECT pr.fight_id, pr.seq, pr.time_ms, pr.agent_id AS owner_agent_id, iv.agent_id AS owned_agent_id FROM pr JOIN iv
      ON pr.fight_id = iv.fight_id AND pr.agent_id = iv.owner_agent_id AND start_ms <= time_ms AND time_ms < end_ms""")
def owned_agents_at_event(c: Corpus) -> DataFrame:
    asked = probes(c).withColumnRenamed("agent_id", "owner_agent_id")
    return identity.owned_agents_at(asked, intervals(c), HOUR_MS)


@query("J8", f"""
    WITH {_INTERVALS}, {_SPANS}, {_PROBES}, sl AS (SELECT a.fight_id, a.agent_id, row_number() OVER (PARTITION BY a.fight_id, ltrim(account_name, ':') ORDER BY first_ms NULLS LAST, a.agent_id) - 1 AS slice_index
      FROM agents a LEFT JOIN sp ON a.fight_id = sp.fight_id AND a.agent_id = sp.agent_id WHERE account_name IS NOT NULL)
    SELECT pr.fight_id, pr.seq, pr.agent_id, iv.owner_agent_id, a.name, ltrim(a.account_name, ':') AS account, ltrim(o.account_name, ':') AS owner_account, slice_index
    FROM pr JOIN agents a ON pr.fight_id = a.fight_id AND pr.agent_id = a.agent_id
    LEFT JOIN iv ON pr.fight_id = iv.fight_id AND pr.agent_id = iv.agent_id AND start_ms <= time_ms AND time_ms < end_ms
    LEFT JOIN agents o ON o.fight_id = pr.fight_id AND o.agent_id = iv.owner_agent_id
    LEFT JOIN sl ON sl.fight_id = pr.fight_id AND sl.agent_id = pr.agent_id""")
def identity_at_event(c: Corpus) -> DataFrame:
    rows = identity.identity_at(probes(c), c.agents(), intervals(c), spans(c), HOUR_MS)
    return rows.select("fight_id", "seq", "agent_id", "owner_agent_id", "name", "account", "owner_account", "slice_index")




def slices(c: Corpus) -> DataFrame:
    """The later two thirds of each agent's awareness, on five shared instance ids."""
    return spans(c).select(
        "fight_id", "agent_id", (1 + F.col("agent_id") % 5).alias("instance_id"),
        F.expr("first_ms + (last_ms - first_ms) div 3").alias("lo_ms"), F.col("last_ms").alias("hi_ms"),
    )


def instance_spans(c: Corpus) -> DataFrame:
    return spans(c).withColumn("instance_id", 1 + F.col("agent_id") % 5)


_SL = """sl AS (SELECT fight_id, agent_id, 1 + agent_id % 5 AS instance_id, first_ms + (last_ms - first_ms) // 3 AS lo_ms, last_ms AS hi_ms FROM sp),
    si AS (SELECT *, 1 + agent_id % 5 AS instance_id FROM sp)"""


@query("J9", f"""
    WITH {_INTERVALS}, {_SPANS}, {_SL} SELECT sl.fight_id, sl.agent_id, lo_ms, hi_ms, ltrim(o.account_name, ':') AS owner_account FROM sl
    LEFT JOIN iv ON sl.fight_id = iv.fight_id AND sl.agent_id = iv.agent_id AND start_ms <= (lo_ms + hi_ms) // 2 AND (lo_ms + hi_ms) // 2 < end_ms
    LEFT JOIN agents o ON o.fight_id = sl.fight_id AND o.agent_id = iv.owner_agent_id""")
def slice_owner_accounts(c: Corpus) -> DataFrame:
    rows = identity.slice_owners(slices(c), intervals(c), c.agents(), HOUR_MS)
    return rows.select("fight_id", "agent_id", "lo_ms", "hi_ms", "owner_account")


@query("J10", f"""
    WITH {_INTERVALS}, {_SPANS}, {_PROBES} SELECT pr.fight_id, pr.seq, pr.time_ms, pr.agent_id, coalesce(time_ms BETWEEN first_ms AND last_ms, false) AS present
    FROM pr LEFT JOIN sp ON pr.fight_id = sp.fight_id AND pr.agent_id = sp.agent_id""")
def presence_at_event(c: Corpus) -> DataFrame:
    return identity.presence_at(probes(c), spans(c))


@query("J10", f"""
    WITH {_INTERVALS} SELECT fight_id, instance_id, count(DISTINCT agent_id) AS agents, min(start_ms) AS start_ms, max(end_ms) AS end_ms
    FROM iv WHERE instance_id <> 0 GROUP BY 1, 2""")
def instance_recycling(c: Corpus) -> DataFrame:
    return identity.instance_recycling(intervals(c))


@query("J11", f"""
    WITH {_INTERVALS}, {_SPANS}, {_SL}, en AS (SELECT fight_id, last - origin AS duration_ms FROM orig),
    cn AS (SELECT sl.*, (SELECT count(*) FROM si WHERE si.fight_id = sl.fight_id AND si.instance_id = sl.instance_id AND si.last_ms >= lo_ms AND si.first_ms <= hi_ms) AS overlapping FROM sl)
    SELECT cn.fight_id, cn.agent_id, instance_id, lo_ms, hi_ms, overlapping,
      CASE WHEN overlapping > 1 THEN hi_ms - lo_ms WHEN duration_ms - last_ms > 1000 THEN last_ms + 10 END AS active_ms
    FROM cn JOIN en ON cn.fight_id = en.fight_id JOIN sp ON sp.fight_id = cn.fight_id AND sp.agent_id = cn.agent_id""")
def active_slice_durations(c: Corpus) -> DataFrame:
    raw = c.raw_records().filter("time > 0")
    lengths = raw.groupBy("fight_id").agg((F.max("time") - F.min("time")).alias("duration_ms"))
    return identity.active_durations(slices(c), instance_spans(c), lengths, HOUR_MS)


@query("J18", f"""
    WITH {_INTERVALS}, {_SPANS}, {_SL} SELECT fight_id, agent_id, lo_ms, hi_ms, agent_id AS alias_id FROM sl
    UNION SELECT sl.fight_id, sl.agent_id, lo_ms, hi_ms, iv.agent_id FROM sl JOIN iv ON sl.fight_id = iv.fight_id AND sl.agent_id = iv.owner_agent_id
      AND start_ms <= (lo_ms + hi_ms) // 2 AND (lo_ms + hi_ms) // 2 < end_ms
    UNION SELECT sl.fight_id, sl.agent_id, lo_ms, hi_ms, si.agent_id FROM sl JOIN si ON sl.fight_id = si.fight_id AND sl.instance_id = si.instance_id
      AND si.last_ms >= lo_ms AND si.first_ms <= hi_ms""")
def entity_aliases(c: Corpus) -> DataFrame:
    return identity.alias_sets(slices(c), intervals(c), instance_spans(c), HOUR_MS)


_ENTRIES = """en AS (SELECT fight_id, agent_id AS entry_id, CASE WHEN agent_id % 4 = 3 THEN 'Non Squad Player ' || agent_id ELSE 'acct.' || (agent_id // 2) END AS account,
      CASE WHEN agent_id % 3 = 0 THEN 'Agent ' || (agent_id + 1) ELSE 'Agent ' || agent_id END AS name, (['Druid', 'Warrior', 'Firebrand', 'Scourge'])[agent_id % 4 + 1] AS profession_label,
      CAST((agent_id * 7) % 40 AS INTEGER) AS instance_id, 0 AS lo_ms, 60000000 AS hi_ms FROM agents)"""


def _entries(c: Corpus) -> DataFrame:
    a = F.col("agent_id")
    return c.agents().select(
        "fight_id", a.alias("entry_id"),
        F.when(a % 4 == 3, F.concat(F.lit("Non Squad Player "), a.cast("string"))).otherwise(F.concat(F.lit("acct."), F.expr("agent_id div 2").cast("string"))).alias("account"),
        F.concat(F.lit("Agent "), F.when(a % 3 == 0, a + 1).otherwise(a).cast("string")).alias("name"),
        pick(["Druid", "Warrior", "Firebrand", "Scourge"], a % 4).alias("profession_label"),
        ((a * 7) % 40).cast("int").alias("instance_id"), F.lit(0).cast("bigint").alias("lo_ms"), F.lit(60000000).cast("bigint").alias("hi_ms"),
    )


_LABEL = """CASE WHEN elite = 0 THEN CASE WHEN profession = 0 THEN 'Unknown' ELSE (['Guardian', 'Warrior', 'Engineer', 'Ranger', 'Thief', 'Elementalist', 'Mesmer', 'Necromancer', 'Revenant'])[profession] END
      WHEN elite = 62 THEN 'Firebrand' WHEN elite = 5 THEN 'Druid' WHEN elite = 60 THEN 'Scourge' ELSE 'other' END"""


@query("J17", f"""
    WITH {_INTERVALS}, {_SPANS}, {_ENTRIES}, wh AS (SELECT a.fight_id, a.agent_id, a.name AS a_name, ltrim(account_name, ':') AS a_account, {_LABEL} AS a_label, instance_id AS a_instance,
        coalesce(30000000 BETWEEN first_ms AND last_ms, false) AS pres FROM agents a LEFT JOIN sp ON a.fight_id = sp.fight_id AND a.agent_id = sp.agent_id),
    cd AS (SELECT en.fight_id, entry_id, agent_id, CASE WHEN pres AND a_name = name THEN 1 WHEN pres AND a_label = profession_label THEN 2 WHEN pres THEN 3
        WHEN a_name = name THEN 6 WHEN a_label = profession_label THEN 7 ELSE 8 END AS rank FROM en JOIN wh ON en.fight_id = wh.fight_id AND en.account = a_account
      UNION ALL SELECT en.fight_id, entry_id, agent_id, CASE WHEN account LIKE 'Non Squad Player%' AND a_account IS NULL AND pres THEN 0 WHEN pres THEN 4
        WHEN account LIKE 'Non Squad Player%' AND a_account IS NULL THEN 5 ELSE 9 END FROM en JOIN wh ON en.fight_id = wh.fight_id AND en.instance_id = a_instance)
    SELECT fight_id, entry_id, agent_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY fight_id, entry_id ORDER BY rank, CASE WHEN rank IN (8, 9) THEN -agent_id ELSE agent_id END) AS rn FROM cd) x WHERE rn = 1""")
def matched_entities(c: Corpus) -> DataFrame:
    return identity.match_entities(_entries(c), c.agents(), spans(c))


# -- proximity ------------------------------------------------------------------------
@query("J14", """
    SELECT d.fight_id, d.seq, EXISTS (SELECT 1 FROM ev h WHERE h.event_type = 'HEALING' AND h.fight_id = d.fight_id AND h.source_agent_id = d.source_agent_id
      AND abs(h.time_ms - d.time_ms) <= 1800000) AS near FROM ev d WHERE event_type = 'DAMAGE'""")
def hits_near_heals(c: Corpus) -> DataFrame:
    hits = c.events(["DAMAGE"]).select("fight_id", "seq", "time_ms", "source_agent_id")
    heals = c.events(["HEALING"]).select("fight_id", "time_ms", "source_agent_id")
    return near_any(hits, heals, ["fight_id", "source_agent_id"], 1_800_000, "near", HOUR_MS).select("fight_id", "seq", "near")


_GUARDS = """gs AS (SELECT fight_id, source_agent_id, skill_id, seq, time_ms, duration_ms, activation IN (1, 2) AS starts,
      lead(time_ms) OVER w AS nt, lead(activation IN (1, 2)) OVER w AS ns, lag(activation IN (1, 2)) OVER w AS ps
      FROM ev WHERE event_type = 'SKILL_ACTIVATION' WINDOW w AS (PARTITION BY fight_id, source_agent_id, skill_id ORDER BY time_ms, seq)),
    gw AS (SELECT fight_id, source_agent_id, skill_id AS guard_skill_id, CASE WHEN NOT starts THEN time_ms - duration_ms ELSE time_ms END - 10 AS start_ms,
      CASE WHEN starts AND NOT coalesce(ns, true) THEN nt ELSE time_ms END + 11 AS end_ms FROM gs
      WHERE (starts AND NOT coalesce(ns, true)) OR (starts AND nt IS NULL) OR (NOT starts AND NOT coalesce(ps, false)))"""


@query("J15", f"""
    WITH {_GUARDS} SELECT s.fight_id, s.seq, EXISTS (SELECT 1 FROM gw WHERE gw.fight_id = s.fight_id AND gw.source_agent_id = s.source_agent_id AND guard_skill_id = 100
      AND start_ms <= s.time_ms AND s.time_ms < end_ms) AS guarded FROM ev s WHERE event_type = 'WEAPON_SWAP'""")
def guarded_swaps(c: Corpus) -> DataFrame:
    guards = rotation.guard_windows(c.events(["SKILL_ACTIVATION"]), [100], chunk_ms=HOUR_MS)
    swaps = c.events(["WEAPON_SWAP"]).select("fight_id", "seq", "time_ms", "source_agent_id")
    return covered_by_any(swaps, guards, ["fight_id", "source_agent_id"], "guarded", HOUR_MS).select("fight_id", "seq", "guarded")


# -- casts -----------------------------------------------------------------------------
_FIGHT_ENDS = "fe AS (SELECT fight_id, max(time_ms) AS end_ms FROM ev GROUP BY 1)"
_CASTS = f"""{_FIGHT_ENDS}, ga AS (SELECT fight_id, source_agent_id, skill_id, seq, time_ms, duration_ms, expected_duration_ms, activation IN (1, 2) AS starts,
      lead(time_ms) OVER w AS nt, lead(activation IN (1, 2)) OVER w AS ns, lag(activation IN (1, 2)) OVER w AS ps
      FROM ev WHERE event_type = 'SKILL_ACTIVATION' WINDOW w AS (PARTITION BY fight_id, source_agent_id, skill_id ORDER BY time_ms, seq)),
    pc AS (SELECT ga.fight_id, source_agent_id, skill_id, CASE WHEN starts THEN time_ms ELSE time_ms - duration_ms END AS time_ms,
      CASE WHEN starts AND nt IS NULL THEN least(CASE WHEN skill_id = 101 THEN expected_duration_ms ELSE duration_ms END, greatest(end_ms - time_ms, 0))
           WHEN starts AND ns THEN least(expected_duration_ms, nt - time_ms + 10) WHEN starts AND nt - time_ms > 1 THEN nt - time_ms
           WHEN NOT starts AND NOT coalesce(ps, false) AND duration_ms > 1 THEN duration_ms END AS duration_ms
      FROM ga JOIN fe ON ga.fight_id = fe.fight_id)"""


def fight_ends(c: Corpus) -> DataFrame:
    return c.events().groupBy("fight_id").agg(F.max("time_ms").alias("end_ms"))


def casts(c: Corpus) -> DataFrame:
    return rotation.paired_casts(c.events(["SKILL_ACTIVATION"]), fight_ends(c), expected_when_open=[101], chunk_ms=HOUR_MS)


@query("F18", f"WITH {_CASTS} SELECT * FROM pc WHERE duration_ms IS NOT NULL")
def paired_casts(c: Corpus) -> DataFrame:
    return casts(c)


_RULES = f"""ru AS (SELECT trigger_kind, trigger_id, cast_skill_id, max(p_size) * 60000 AS cooldown_ms, CAST(max(gp) AS INTEGER) AS gate_profession
      FROM (SELECT p_size, (['damage', 'healing', 'missile', 'buff_gain', 'buff_give', 'buff_loss'])[p_partkey % 6 + 1] AS trigger_kind,
        CAST(CASE WHEN p_partkey % 6 > 2 THEN ([{", ".join(map(str, BUFF_CHOICES))}])[p_partkey // 6 % 6 + 1] ELSE p_partkey END AS VARCHAR) AS trigger_id,
        1000 + p_partkey % 7 AS cast_skill_id, CASE WHEN p_partkey % 7 = 3 THEN 4 END AS gp FROM part) x GROUP BY 1, 2, 3)"""


def rules(c: Corpus) -> DataFrame:
    """A cast rule per (trigger, cast) of the parts table."""
    key = F.col("p_partkey")
    kind = pick(["damage", "healing", "missile", "buff_gain", "buff_give", "buff_loss"], key % 6)
    trigger = F.when(key % 6 > 2, pick(BUFF_CHOICES, F.expr("p_partkey div 6 % 6"))).otherwise(key).cast("string")
    rows = c.table("part").select(
        kind.alias("trigger_kind"), trigger.alias("trigger_id"), (1000 + key % 7).alias("cast_skill_id"),
        "p_size", F.when(key % 7 == 3, 4).alias("gp"),
    )
    rows = rows.groupBy("trigger_kind", "trigger_id", "cast_skill_id").agg(
        (F.max("p_size") * 60000).alias("cooldown_ms"), F.max("gp").alias("gate_profession")
    )
    return rows.withColumns(
        {
            "gate_elite": F.lit(None).cast("int"), "before_swap": F.col("cast_skill_id") == 1001,
            "after_swap": F.col("cast_skill_id") == 1002, "self_only": F.lit(False), "guard_skill_id": F.lit(None).cast("bigint"),
        }
    )


_TRIGGERS = """tr AS (SELECT fight_id, seq, time_ms, 'buff_gain' AS trigger_kind, CAST(skill_id AS VARCHAR) AS trigger_id, target_agent_id AS agent FROM ev WHERE kind = 'apply'
      UNION ALL SELECT fight_id, seq, time_ms, 'buff_loss', CAST(skill_id AS VARCHAR), target_agent_id FROM ev WHERE kind = 'remove_all'
      UNION ALL SELECT fight_id, seq, time_ms, 'buff_give', CAST(skill_id AS VARCHAR), source_agent_id FROM ev WHERE kind = 'apply'
      UNION ALL SELECT fight_id, seq, time_ms, lower(event_type), CAST(skill_id AS VARCHAR), source_agent_id FROM ev WHERE event_type IN ('DAMAGE', 'HEALING', 'MISSILE'))"""


@query("F19 F20", f"""
    WITH {_RULES}, {_TRIGGERS}, hit AS (SELECT tr.fight_id, agent AS source_agent_id, cast_skill_id AS skill_id, seq, time_ms, cooldown_ms, tr.trigger_kind, tr.trigger_id
      FROM tr JOIN ru ON tr.trigger_kind = ru.trigger_kind AND tr.trigger_id = ru.trigger_id JOIN agents a ON a.fight_id = tr.fight_id AND a.agent_id = agent
      WHERE gate_profession IS NULL OR gate_profession = profession),
    lg AS (SELECT *, lag(time_ms) OVER (PARTITION BY fight_id, source_agent_id, skill_id ORDER BY time_ms, seq, trigger_kind, trigger_id) AS pv FROM hit)
    SELECT fight_id, source_agent_id, skill_id, count(*) AS casts, CAST(sum(time_ms) AS BIGINT) AS time_sum FROM lg
    WHERE pv IS NULL OR (time_ms - pv >= cooldown_ms AND time_ms <> pv) GROUP BY 1, 2, 3""")
def inferred_casts(c: Corpus) -> DataFrame:
    """Per (agent, cast) count and time sum of rule-inferred casts, before swap alignment.

    Rules of one cast that fire on the same record at once count as one trigger.
    """
    table = rules(c).withColumns({"before_swap": F.lit(False), "after_swap": F.lit(False)})
    kinds = ["DAMAGE", "HEALING", "MISSILE", "BOON_APPLY"]
    rows = rotation.inferred_casts(c.events(kinds), table, c.agents(), chunk_ms=HOUR_MS)
    return rows.groupBy("fight_id", "source_agent_id", "skill_id").agg(F.count(F.lit(1)).alias("casts"), F.sum("time_ms").alias("time_sum"))


@query("F21", """
    WITH sw AS (SELECT DISTINCT fight_id, source_agent_id, time_ms FROM ev WHERE event_type = 'WEAPON_SWAP'),
    ac AS (SELECT fight_id, source_agent_id, seq, time_ms, skill_id FROM ev WHERE event_type = 'SKILL_ACTIVATION'),
    nr AS (SELECT ac.*, (SELECT max(sw.time_ms) FROM sw WHERE sw.fight_id = ac.fight_id AND sw.source_agent_id = ac.source_agent_id AND sw.time_ms <= ac.time_ms AND ac.time_ms - sw.time_ms < 600000) AS b,
      (SELECT min(sw.time_ms) FROM sw WHERE sw.fight_id = ac.fight_id AND sw.source_agent_id = ac.source_agent_id AND sw.time_ms > ac.time_ms AND sw.time_ms - ac.time_ms < 600000) AS f FROM ac)
    SELECT fight_id, seq, CASE WHEN coalesce(b, f) IS NULL THEN time_ms WHEN skill_id % 2 = 0 THEN least(time_ms, coalesce(b, f) - 1) ELSE greatest(time_ms, coalesce(b, f) + 1) END AS time_ms FROM nr""")
def swap_aligned_activations(c: Corpus) -> DataFrame:
    rows = c.events(["SKILL_ACTIVATION"]).select(
        "fight_id", "source_agent_id", "seq", "time_ms", (F.col("skill_id") % 2 == 0).alias("before_swap"), (F.col("skill_id") % 2 == 1).alias("after_swap")
    )
    return rotation.align_to_swaps(rows, c.events(["WEAPON_SWAP"]), 600_000, HOUR_MS).select("fight_id", "seq", "time_ms")


@query("F22", """
    WITH sw AS (SELECT fight_id, source_agent_id, seq, time_ms, swapped_to FROM ev WHERE event_type = 'WEAPON_SWAP'),
    rg AS (SELECT sw.*, coalesce((SELECT min(n.time_ms) FROM sw n WHERE n.fight_id = sw.fight_id AND n.source_agent_id = sw.source_agent_id AND n.time_ms > sw.time_ms + 10), 9000000000) AS nx FROM sw WHERE swapped_to = 2),
    hit AS (SELECT rg.fight_id, rg.source_agent_id, rg.seq, rg.time_ms, a.skill_id, a.activation IN (1, 2) AS st FROM rg JOIN ev a ON a.event_type = 'SKILL_ACTIVATION' AND a.fight_id = rg.fight_id
      AND a.source_agent_id = rg.source_agent_id AND a.time_ms >= rg.time_ms + 10 AND a.time_ms < nx),
    ag AS (SELECT fight_id, source_agent_id, seq, time_ms, bool_or(st) AS any_start, bool_or(st AND skill_id = 101) AS s1, bool_or(st AND skill_id IN (102, 103)) AS s2,
      bool_or(skill_id = 101) AS a1, bool_or(skill_id IN (102, 103)) AS a2 FROM hit GROUP BY 1, 2, 3, 4)
    SELECT fight_id, source_agent_id, CASE WHEN any_start THEN CASE WHEN s1 THEN 901 ELSE 902 END ELSE CASE WHEN a1 THEN 901 ELSE 902 END END AS skill_id, seq, time_ms - 1 AS time_ms, 0 AS duration_ms
    FROM ag WHERE CASE WHEN any_start THEN s1 OR s2 ELSE a1 OR a2 END""")
def kit_casts(c: Corpus) -> DataFrame:
    bundles = c.spark.createDataFrame([(1, 901, 101), (2, 902, 102), (2, 902, 103)], "kit_order INT, kit_skill_id BIGINT, skill_id BIGINT")
    return rotation.kit_casts(c.events(["WEAPON_SWAP", "SKILL_ACTIVATION"]), bundles, chunk_ms=HOUR_MS)


def _anchor_sql(where: str) -> str:
    """Groups by jumps: each anchor leads to the first time at least ten minutes later."""
    return f"""WITH RECURSIVE rw AS (SELECT fight_id, target_agent_id, time_ms, skill_id FROM ev WHERE event_type = 'BOON_APPLY' {where}),
    tm AS (SELECT DISTINCT fight_id, target_agent_id, time_ms FROM rw),
    nx AS (SELECT a.fight_id, a.target_agent_id, a.time_ms, min(b.time_ms) AS jump FROM tm a JOIN tm b ON a.fight_id = b.fight_id AND a.target_agent_id = b.target_agent_id
      AND b.time_ms >= a.time_ms + 600000 GROUP BY 1, 2, 3),
    an AS (SELECT fight_id, target_agent_id, min(time_ms) AS anchor_ms FROM tm GROUP BY 1, 2
      UNION ALL SELECT an.fight_id, an.target_agent_id, jump FROM an JOIN nx ON nx.fight_id = an.fight_id AND nx.target_agent_id = an.target_agent_id AND nx.time_ms = an.anchor_ms),
    gr AS (SELECT rw.*, anchor_ms FROM rw ASOF JOIN an ON rw.fight_id = an.fight_id AND rw.target_agent_id = an.target_agent_id AND rw.time_ms >= an.anchor_ms)"""


@query("F23", _anchor_sql("") + " SELECT fight_id, target_agent_id, anchor_ms, count(*) AS events, count(DISTINCT skill_id) AS buffs FROM gr GROUP BY 1, 2, 3")
def anchored_buff_groups(c: Corpus) -> DataFrame:
    rows = c.events(["BOON_APPLY"]).select("fight_id", "target_agent_id", "seq", "time_ms", "skill_id")
    grouped = rotation.anchor_groups(rows, ["fight_id", "target_agent_id"], 600_000, HOUR_MS)
    return grouped.groupBy("fight_id", "target_agent_id", "anchor_ms").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("skill_id").alias("buffs"))


_CHOICES = ", ".join(str(x) for x in sorted(BUFF_CHOICES))


@query("F23", _anchor_sql("AND kind = 'apply'") + f""", st AS (SELECT fight_id, target_agent_id, anchor_ms AS time_ms, list_sort(list(DISTINCT skill_id)) AS ids FROM gr GROUP BY 1, 2, 3)
    SELECT fight_id, target_agent_id, CAST(CASE WHEN len(ids) = 1 THEN ids[1] ELSE ids[1] * 100000 + ids[2] END AS BIGINT) AS skill_id, time_ms FROM st
    WHERE len(ids) <= 2 AND list_has_all([{_CHOICES}], ids)""")
def translated_buff_groups(c: Corpus) -> DataFrame:
    rows = c.events(["BOON_APPLY"]).filter("kind = 'apply'").select("fight_id", "target_agent_id", "seq", "time_ms", "skill_id")
    # every pair of choices stands for a combined skill, single ones for themselves
    ids = sorted(BUFF_CHOICES)
    pairs = [(f"{a},{b}", a * 100000 + b) for i, a in enumerate(ids) for b in ids[i + 1 :]] + [(str(a), a) for a in ids]
    table = c.spark.createDataFrame(pairs, "id_set STRING, cast_skill_id BIGINT")
    return rotation.grouped_translation(rows, ["fight_id", "target_agent_id"], table, 600_000, HOUR_MS)


@query("F25", f"""
    WITH {_INTERVALS}, st AS (SELECT fight_id, source_agent_id AS agent_id, seq, time_ms, 700 + skill_id AS cast_skill FROM ev WHERE event_type = 'SKILL_ACTIVATION' AND activation IN (1, 2)),
    so AS (SELECT fight_id, target_agent_id AS agent_id, min_by(source_agent_id, seq) AS spawn_owner FROM ev WHERE event_type = 'SPAWN' GROUP BY 1, 2),
    rs AS (SELECT st.fight_id, seq, time_ms, cast_skill, coalesce(iv.owner_agent_id, nullif(spawn_owner, 0)) AS source_agent_id FROM st
      LEFT JOIN iv ON st.fight_id = iv.fight_id AND st.agent_id = iv.agent_id AND start_ms <= time_ms AND time_ms < end_ms
      LEFT JOIN so ON so.fight_id = st.fight_id AND so.agent_id = st.agent_id),
    lg AS (SELECT *, lag(time_ms) OVER (PARTITION BY fight_id, source_agent_id, cast_skill ORDER BY time_ms, seq) AS pv FROM rs WHERE source_agent_id IS NOT NULL)
    SELECT fight_id, source_agent_id, cast_skill AS skill_id, seq, time_ms, 0 AS duration_ms FROM lg WHERE pv IS NULL OR time_ms - pv >= 50""")
def minion_casts(c: Corpus) -> DataFrame:
    return rotation.minion_casts(c.events(["SKILL_ACTIVATION", "SPAWN"]), minion_skills(c), intervals(c), HOUR_MS)


def minion_skills(c: Corpus) -> DataFrame:
    return c.events(["SKILL_ACTIVATION"]).select("skill_id").distinct().withColumn("cast_skill_id", 700 + F.col("skill_id"))


_EFFECTS = """er AS (SELECT * FROM (VALUES ('G0', 800, 0, 9, 740), ('G1', 801, 600000, NULL, NULL), ('G2', 802, 0, NULL, 1122), ('G3', 803, 0, 12, NULL), ('G4', 804, 1000, NULL, NULL))
      AS v(guid, cast_skill_id, cooldown_ms, blocked, needs))"""


@query("F24", f"""
    WITH {_EFFECTS}, ef AS (SELECT e.fight_id, e.source_agent_id, e.seq, e.time_ms, er.* FROM ev e JOIN er ON e.guid = er.guid WHERE event_type = 'EFFECT'),
    ok AS (SELECT * FROM ef WHERE (blocked IS NULL OR NOT EXISTS (SELECT 1 FROM ev d WHERE d.event_type = 'DAMAGE' AND d.fight_id = ef.fight_id AND d.source_agent_id = ef.source_agent_id
        AND d.skill_id = blocked AND abs(d.time_ms - ef.time_ms) <= 7199999))
      AND (needs IS NULL OR EXISTS (SELECT 1 FROM ev b WHERE b.kind = 'apply' AND b.fight_id = ef.fight_id AND b.target_agent_id = ef.source_agent_id AND b.skill_id = needs AND abs(b.time_ms - ef.time_ms) <= 7199999))),
    lg AS (SELECT *, lag(time_ms) OVER (PARTITION BY fight_id, source_agent_id, cast_skill_id ORDER BY time_ms, seq) AS pv FROM ok)
    SELECT fight_id, source_agent_id, cast_skill_id AS skill_id, seq, time_ms, 0 AS duration_ms FROM lg WHERE pv IS NULL OR time_ms - pv >= cooldown_ms""")
def effect_casts(c: Corpus) -> DataFrame:
    return rotation.effect_casts(c.events(["EFFECT", "DAMAGE", "BOON_APPLY"]), effect_rules(c), c.agents(), HOUR_MS, 7_200_000)


def effect_rules(c: Corpus) -> DataFrame:
    return c.spark.createDataFrame(
        [("G0", 800, 0, 9, 740), ("G1", 801, 600000, None, None), ("G2", 802, 0, None, 1122), ("G3", 803, 0, 12, None), ("G4", 804, 1000, None, None)],
        "guid STRING, cast_skill_id BIGINT, cooldown_ms INT, blocked_by_damage_skill BIGINT, needs_buff_id BIGINT",
    ).withColumns({"gate_profession": F.lit(None).cast("int"), "gate_elite": F.lit(None).cast("int")})


_ALL = f"""{_CASTS}, al AS (SELECT * FROM pc WHERE duration_ms IS NOT NULL UNION SELECT fight_id, source_agent_id, -2, time_ms, 0 FROM ev WHERE event_type = 'WEAPON_SWAP'),
    fin AS (SELECT fight_id, source_agent_id, skill_id, time_ms, duration_ms FROM (SELECT *, lead(time_ms) OVER (PARTITION BY fight_id, source_agent_id, skill_id ORDER BY time_ms) AS nx FROM al) x
      WHERE skill_id <> -2 OR nx IS NULL OR nx - time_ms > 1)"""


def all_casts(c: Corpus) -> DataFrame:
    return rotation.final_casts(casts(c).unionByName(rotation.swap_casts(c.events(["WEAPON_SWAP"]))), HOUR_MS)


@query("F27", f"WITH {_ALL} SELECT * FROM fin")
def final_casts(c: Corpus) -> DataFrame:
    return all_casts(c)


def _twin(name: str) -> str:
    return f"({QUERIES[name].sql})"


# every trigger with the other side, for rules on oneself
_SIDED = """tr AS (SELECT fight_id, seq, time_ms, 'buff_gain' AS trigger_kind, CAST(skill_id AS VARCHAR) AS trigger_id, target_agent_id AS agent, source_agent_id AS other FROM ev WHERE kind = 'apply'
      UNION ALL SELECT fight_id, seq, time_ms, 'buff_loss', CAST(skill_id AS VARCHAR), target_agent_id, source_agent_id FROM ev WHERE kind = 'remove_all'
      UNION ALL SELECT fight_id, seq, time_ms, 'buff_give', CAST(skill_id AS VARCHAR), source_agent_id, target_agent_id FROM ev WHERE kind = 'apply'
      UNION ALL SELECT fight_id, seq, time_ms, lower(event_type), CAST(skill_id AS VARCHAR), source_agent_id, target_agent_id FROM ev WHERE event_type IN ('DAMAGE', 'HEALING', 'MISSILE'))"""


ROTATION_KINDS = ["DAMAGE", "HEALING", "MISSILE", "BOON_APPLY", "EFFECT", "SKILL_ACTIVATION", "SPAWN", "WEAPON_SWAP"]
ROTATION_COLUMNS = ["kind", "guid", "activation", "duration_ms", "expected_duration_ms", "swapped_to"]
SWAP_RADIUS = 600_000


@query("F20 F27 F19", f"""
    WITH {_RULES}, {_SIDED}, {_GUARDS}, {_EFFECTS}, {_INTERVALS}, {_CASTS},
    t0 AS (SELECT tr.fight_id, agent AS source_agent_id, cast_skill_id AS skill_id, tr.seq, tr.time_ms, cooldown_ms, tr.trigger_kind, tr.trigger_id
      FROM tr JOIN ru ON tr.trigger_kind = ru.trigger_kind AND tr.trigger_id = ru.trigger_id LEFT JOIN agents a ON a.fight_id = tr.fight_id AND a.agent_id = agent
      WHERE (gate_profession IS NULL OR gate_profession = profession) AND (cast_skill_id <> 1004 OR agent = other)
        AND (cast_skill_id <> 1005 OR NOT EXISTS (SELECT 1 FROM gw WHERE gw.fight_id = tr.fight_id AND gw.source_agent_id = agent AND guard_skill_id = 100 AND start_ms <= tr.time_ms AND tr.time_ms < end_ms))),
    sp AS (SELECT DISTINCT fight_id, source_agent_id, time_ms AS swap_ms FROM ev WHERE event_type = 'WEAPON_SWAP'),
    sn AS (SELECT t0.*, CASE WHEN skill_id IN (1001, 1002) THEN coalesce((SELECT max(swap_ms) FROM sp WHERE sp.fight_id = t0.fight_id AND sp.source_agent_id = t0.source_agent_id AND swap_ms <= time_ms AND time_ms - swap_ms < {SWAP_RADIUS}),
      (SELECT min(swap_ms) FROM sp WHERE sp.fight_id = t0.fight_id AND sp.source_agent_id = t0.source_agent_id AND swap_ms > time_ms AND swap_ms - time_ms < {SWAP_RADIUS})) END AS near FROM t0),
    t1 AS (SELECT * EXCLUDE (near) REPLACE (CASE WHEN near IS NULL THEN time_ms WHEN skill_id = 1001 THEN least(time_ms, near - 1) ELSE greatest(time_ms, near + 1) END AS time_ms) FROM sn),
    ef AS (SELECT e.fight_id, e.source_agent_id, e.seq, e.time_ms, er.* FROM ev e JOIN er ON e.guid = er.guid WHERE event_type = 'EFFECT'),
    t2 AS (SELECT fight_id, source_agent_id, cast_skill_id AS skill_id, seq, time_ms, cooldown_ms, 'effect' AS trigger_kind, guid AS trigger_id FROM ef
      WHERE (blocked IS NULL OR NOT EXISTS (SELECT 1 FROM ev d WHERE d.event_type = 'DAMAGE' AND d.fight_id = ef.fight_id AND d.source_agent_id = ef.source_agent_id AND d.skill_id = blocked AND abs(d.time_ms - ef.time_ms) <= 7199999))
      AND (needs IS NULL OR EXISTS (SELECT 1 FROM ev b WHERE b.kind = 'apply' AND b.fight_id = ef.fight_id AND b.target_agent_id = ef.source_agent_id AND b.skill_id = needs AND abs(b.time_ms - ef.time_ms) <= 7199999))),
    ms AS (SELECT fight_id, source_agent_id AS agent_id, seq, time_ms, 700 + skill_id AS cast_skill FROM ev WHERE event_type = 'SKILL_ACTIVATION' AND activation IN (1, 2)),
    so AS (SELECT fight_id, target_agent_id AS agent_id, min_by(source_agent_id, seq) AS spawn_owner FROM ev WHERE event_type = 'SPAWN' GROUP BY 1, 2),
    t3 AS (SELECT ms.fight_id, coalesce(iv.owner_agent_id, nullif(spawn_owner, 0)) AS source_agent_id, cast_skill AS skill_id, ms.seq, ms.time_ms, 50 AS cooldown_ms, 'minion' AS trigger_kind, CAST(ms.agent_id AS VARCHAR) AS trigger_id
      FROM ms LEFT JOIN iv ON ms.fight_id = iv.fight_id AND ms.agent_id = iv.agent_id AND start_ms <= ms.time_ms AND ms.time_ms < end_ms
      LEFT JOIN so ON so.fight_id = ms.fight_id AND so.agent_id = ms.agent_id),
    tg AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3 WHERE source_agent_id IS NOT NULL),
    lg AS (SELECT *, lag(time_ms) OVER (PARTITION BY fight_id, source_agent_id, skill_id ORDER BY time_ms, seq, trigger_kind, trigger_id) AS pv FROM tg),
    al AS (SELECT fight_id, source_agent_id, skill_id, time_ms, 0 AS duration_ms FROM lg WHERE pv IS NULL OR time_ms - pv >= cooldown_ms
      UNION SELECT fight_id, source_agent_id, skill_id, time_ms, duration_ms FROM pc WHERE duration_ms IS NOT NULL
      UNION SELECT fight_id, source_agent_id, -2, time_ms, 0 FROM ev WHERE event_type = 'WEAPON_SWAP'
      UNION SELECT fight_id, source_agent_id, skill_id, time_ms, duration_ms FROM {_twin("kit_casts")} k
      UNION SELECT fight_id, target_agent_id, skill_id, time_ms, 0 FROM {_twin("translated_buff_groups")} g)
    SELECT fight_id, source_agent_id, skill_id, time_ms, duration_ms FROM (SELECT *, lead(time_ms) OVER (PARTITION BY fight_id, source_agent_id, skill_id ORDER BY time_ms) AS nx FROM al) x
      WHERE skill_id <> -2 OR nx IS NULL OR nx - time_ms > 1""")
def complete_rotation(c: Corpus) -> DataFrame:
    """Activations, swaps, kits, groups, and the triggers of rules, effects and minions under one cooldown.

    Rules of cast 1001 move before a swap beside them, those of 1002 behind it; rules of cast 1004 act on oneself only, those
    of 1005 not while skill 100 is being cast. The events of a rotation are staged once, as are the results that running
    values read.
    """
    stage = Stage(c.spark, "rotation")
    ends, lives = stage(fight_ends(c), "ends"), stage(intervals(c), "intervals")
    c = StagedCorpus(c, stage, ROTATION_KINDS, ROTATION_COLUMNS)
    table = rules(c).withColumns({"self_only": F.col("cast_skill_id") == 1004, "guard_skill_id": F.when(F.col("cast_skill_id") == 1005, 100).cast("bigint")})
    guards = stage(rotation.guard_windows(c.events(["SKILL_ACTIVATION"]), [100], chunk_ms=HOUR_MS), "guards")
    triggered = [
        rotation.rule_triggers(c.events(["DAMAGE", "HEALING", "MISSILE", "BOON_APPLY", "WEAPON_SWAP"]), table, c.agents(), guards, HOUR_MS, SWAP_RADIUS, stage),
        rotation.effect_triggers(c.events(["EFFECT", "DAMAGE", "BOON_APPLY"]), effect_rules(c), c.agents(), HOUR_MS, 7_200_000, stage),
        rotation.minion_triggers(c.events(["SKILL_ACTIVATION", "SPAWN"]), minion_skills(c), lives, HOUR_MS),
    ]
    groups = translated_buff_groups(c).select("fight_id", F.col("target_agent_id").alias("source_agent_id"), "skill_id", "time_ms", F.lit(0).cast("bigint").alias("duration_ms"))
    paired = rotation.paired_casts(c.events(["SKILL_ACTIVATION"]), ends, expected_when_open=[101], chunk_ms=HOUR_MS)
    return rotation.complete_rotation(triggered, [paired, rotation.swap_casts(c.events(["WEAPON_SWAP"])), kit_casts(c), groups], HOUR_MS, stage)


@query("F26", f"""
    WITH {_ALL}, sl AS (SELECT fight_id, source_agent_id, min(time_ms) + 3600000 AS lo_ms, max(time_ms) - 3600000 AS hi_ms FROM ev WHERE event_type = 'WEAPON_SWAP' GROUP BY 1, 2)
    SELECT fin.* FROM fin JOIN sl ON fin.fight_id = sl.fight_id AND fin.source_agent_id = sl.source_agent_id
    WHERE time_ms BETWEEN lo_ms AND hi_ms OR (time_ms < 0 AND time_ms + duration_ms BETWEEN lo_ms AND hi_ms)""")
def casts_in_slice(c: Corpus) -> DataFrame:
    stretch = c.events(["WEAPON_SWAP"]).groupBy("fight_id", "source_agent_id").agg(
        (F.min("time_ms") + 3600000).alias("lo_ms"), (F.max("time_ms") - 3600000).alias("hi_ms")
    )
    return rotation.casts_in_slice(all_casts(c), stretch).drop("lo_ms", "hi_ms")


# -- positions ---------------------------------------------------------------------------
_POS = """ps AS (SELECT fight_id, source_agent_id AS agent_id, seq, time_ms // 1800000 * 1800000 AS time_ms, x, y FROM ev WHERE event_type = 'POSITION'),
    ds AS (SELECT fight_id, agent_id, max_by(time_ms, seq) AS time_ms, max_by(x, seq) AS x, max_by(y, seq) AS y FROM ps GROUP BY fight_id, agent_id, time_ms // 500)"""


def position_events(c: Corpus) -> DataFrame:
    """Positions on a half-hour clock, so that players share sample times."""
    return c.events(["POSITION"]).select(
        "fight_id", F.col("source_agent_id").alias("agent_id"), "seq", F.expr("time_ms div 1800000 * 1800000").alias("time_ms"), "x", "y"
    )


def samples(c: Corpus) -> DataFrame:
    return positions.downsample(position_events(c))


@query("P1", f"WITH {_POS} SELECT * FROM ds")
def position_samples(c: Corpus) -> DataFrame:
    return samples(c)


@query("P1", """
    WITH ds AS (SELECT fight_id, time_ms // 500 AS step, max_by(time_ms, struct_pack(t := time_ms, s := seq)) AS time_ms, max_by(damage, struct_pack(t := time_ms, s := seq)) AS x FROM ev WHERE event_type = 'DAMAGE' GROUP BY 1, 2),
    nn AS (SELECT *, row_number() OVER (PARTITION BY fight_id ORDER BY step) - 1 AS j, count(*) OVER (PARTITION BY fight_id) AS n FROM ds),
    ix AS (SELECT DISTINCT fight_id, CAST(n * i // 20 AS BIGINT) AS j FROM (SELECT DISTINCT fight_id, n FROM nn WHERE n > 20) q CROSS JOIN generate_series(0, 19) g(i))
    SELECT nn.fight_id, time_ms, CAST(x AS DOUBLE) AS x FROM nn LEFT JOIN ix ON nn.fight_id = ix.fight_id AND nn.j = ix.j WHERE n <= 20 OR ix.j IS NOT NULL""")
def thinned_hits(c: Corpus) -> DataFrame:
    """The same down-sampling with a limit of 20, on one dense series per fight."""
    rows = c.events(["DAMAGE"]).select(
        "fight_id", F.lit(0).cast("bigint").alias("agent_id"), "seq", "time_ms", F.col("damage").cast("double").alias("x"), F.lit(0.0).alias("y")
    )
    return positions.downsample(rows, limit=20).select("fight_id", "time_ms", "x")


_FILL = f"""{_POS}, ts AS (SELECT DISTINCT fight_id, time_ms AS t FROM ds),
    hd AS (SELECT *, lead(time_ms, 1, 9000000000) OVER (PARTITION BY fight_id, agent_id ORDER BY time_ms) AS until FROM ds),
    fl AS (SELECT ts.fight_id, t AS time_ms, agent_id, x, y FROM ts JOIN hd ON ts.fight_id = hd.fight_id AND hd.time_ms <= t AND t < until)"""


_TRUE_CLOCK = "time_ms // 1800000 * 1800000 AS time_ms", "time_ms"


@query("P2 J12", f"WITH {_FILL} SELECT * FROM fl")
def filled_positions(c: Corpus) -> DataFrame:
    return positions.forward_filled(samples(c), HOUR_MS, HOUR_MS)


_SPACING = f"""{_FILL}, ce AS (SELECT fight_id, time_ms, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM fl GROUP BY 1, 2),
    tc AS (SELECT fl.fight_id, agent_id, avg(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))) AS dist_to_com FROM fl JOIN ce ON fl.fight_id = ce.fight_id AND fl.time_ms = ce.time_ms WHERE n > 1 GROUP BY 1, 2),
    so AS (SELECT a.fight_id, a.agent_id, a.time_ms, avg(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM fl a JOIN fl b ON a.fight_id = b.fight_id AND a.time_ms = b.time_ms AND a.agent_id <> b.agent_id GROUP BY 1, 2, 3),
    sd AS (SELECT fight_id, agent_id, avg(d) AS stack_dist FROM so GROUP BY 1, 2),
    mt AS (SELECT a.fight_id, a.agent_id, dist_to_com, stack_dist FROM (SELECT DISTINCT fight_id, agent_id FROM ds) a
      LEFT JOIN tc ON a.fight_id = tc.fight_id AND a.agent_id = tc.agent_id LEFT JOIN sd ON a.fight_id = sd.fight_id AND a.agent_id = sd.agent_id)"""


@query("P3 P4", f"WITH {_SPACING} SELECT fight_id, agent_id, round(dist_to_com, 6) AS dist_to_com, round(stack_dist, 6) AS stack_dist FROM mt")
def spacing_metrics(c: Corpus) -> DataFrame:
    return rounded(positions.spacing(samples(c), HOUR_MS, HOUR_MS), "dist_to_com", "stack_dist")


@query("P3 P4", f"WITH {_SPACING.replace(*_TRUE_CLOCK)} SELECT fight_id, agent_id, round(dist_to_com, 6) AS dist_to_com, round(stack_dist, 6) AS stack_dist FROM mt")
def spacing_on_own_clocks(c: Corpus) -> DataFrame:
    """Spacing where every player has sample times of its own."""
    own = c.events(["POSITION"]).select("fight_id", F.col("source_agent_id").alias("agent_id"), "seq", "time_ms", "x", "y")
    return rounded(positions.spacing(positions.downsample(own), HOUR_MS, HOUR_MS), "dist_to_com", "stack_dist")


_COMMANDER = f"""cm AS (SELECT fight_id, min(agent_id) AS cid FROM agents WHERE name LIKE '% [CMDR]' GROUP BY 1),
    cp AS (SELECT ds.fight_id, time_ms, x AS cx, y AS cy, cid FROM ds JOIN cm ON ds.fight_id = cm.fight_id AND ds.agent_id = cid),
    cd AS (SELECT ds.fight_id, ds.agent_id, CASE WHEN ds.agent_id = any_value(cid) THEN 0.0 ELSE avg(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))) END AS commander_dist
      FROM ds JOIN cp ON ds.fight_id = cp.fight_id AND ds.time_ms = cp.time_ms GROUP BY 1, 2)"""


def commander(c: Corpus) -> DataFrame:
    leads = c.agents().filter(F.col("name").endswith(" [CMDR]")).select("fight_id", "agent_id")
    return positions.commander_distance(samples(c), leads)


@query("P5 J16", f"WITH {_POS}, {_COMMANDER} SELECT fight_id, agent_id, round(commander_dist, 6) AS commander_dist FROM cd")
def commander_distances(c: Corpus) -> DataFrame:
    return rounded(commander(c), "commander_dist")


@query("P6", f"""
    WITH {_SPACING}, {_COMMANDER}, sa AS (SELECT fight_id, agent_id, string_agg(time_ms || ':' || CAST(x AS BIGINT) || ':' || CAST(y AS BIGINT), ';' ORDER BY time_ms) AS samples FROM ds GROUP BY 1, 2)
    SELECT sa.fight_id, account_name, p.name, samples, round(dist_to_com, 6) AS dist_to_com, round(stack_dist, 6) AS stack_dist, round(commander_dist, 6) AS commander_dist
    FROM sa JOIN players p ON sa.fight_id = p.fight_id AND sa.agent_id = p.agent_id LEFT JOIN mt ON sa.fight_id = mt.fight_id AND sa.agent_id = mt.agent_id
    LEFT JOIN cd ON sa.fight_id = cd.fight_id AND sa.agent_id = cd.agent_id""")
def player_positions(c: Corpus) -> DataFrame:
    track = samples(c)
    shown = positions.downsample(position_events(c), limit=positions.SAMPLE_LIMIT)
    rows = positions.position_rows(shown, c.players(), positions.spacing(track, HOUR_MS, HOUR_MS), commander(c))
    text = F.transform("samples", lambda s: F.concat_ws(":", s["time_ms"], s["x"].cast("bigint"), s["y"].cast("bigint")))
    rows = rows.withColumn("samples", F.array_join(text, ";")).drop("agent_id")
    return rounded(rows, "dist_to_com", "stack_dist", "commander_dist")


@query("P7", f"WITH {_POS} SELECT fight_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, max(time_ms) AS max_time_ms FROM ds GROUP BY 1")
def position_bounds(c: Corpus) -> DataFrame:
    return positions.bounding_boxes(samples(c))


@query("T6", f"""
    WITH {_SPACING} SELECT * FROM (SELECT fight_id, agent_id, round(stack_dist, 6) AS stack_dist,
      row_number() OVER (PARTITION BY fight_id ORDER BY coalesce(stack_dist, 9999), agent_id) AS rank FROM mt) x WHERE rank <= 5""")
def closest_players(c: Corpus) -> DataFrame:
    from frayline.operators import profiles

    rows = positions.spacing(samples(c), HOUR_MS, HOUR_MS).withColumn("closeness", -F.coalesce("stack_dist", F.lit(9999.0)))
    top = profiles.top_per_key(rows, ["fight_id"], "closeness", "agent_id", 5)
    return rounded(top, "stack_dist").select("fight_id", "agent_id", "stack_dist", "rank")
