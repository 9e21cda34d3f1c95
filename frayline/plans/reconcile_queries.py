"""Statistics slices, comparison with an expected report, corpus diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frayline.operators import downs, reconcile
from frayline.plans.registry import query
from frayline.plans.rollup_queries import fight_seconds
from frayline.plans.sequence_queries import DOWN_KINDS, HOUR_MS, _OUTCOMES, _WINDOWS, _CASTS, casts
from frayline.sources.corpus import Corpus

_LANDED = "(CASE WHEN is_condition THEN connected WHEN connected THEN true WHEN buff_dmg > 0 THEN damage > 0 ELSE result IN (0, 1, 2, 8, 10) END)"
_COUNTED = "event_type = 'DAMAGE' AND result <> 10"


def _pair(cond: str, count: str, total: str) -> str:
    return f"count(*) FILTER ({cond}) AS {count}, CAST(coalesce(sum(damage) FILTER ({cond}), 0) AS BIGINT) AS {total}"


@query("A26", f"""
    WITH {_WINDOWS}, {_OUTCOMES}, ac AS (SELECT *, EXISTS (SELECT 1 FROM win WHERE win.fight_id = ev.fight_id AND win.agent_id = ev.target_agent_id AND start_ms <= ev.time_ms AND ev.time_ms < end_ms) AS inw,
      event_type = 'DAMAGE' AND against_downed AND {_LANDED} AS dh FROM ev WHERE event_type IN ('DAMAGE', 'CC')),
    g AS (SELECT fight_id, source_agent_id, {_pair(_COUNTED, 'totalDamageCount', 'totalDmg')},
      {_pair(f"{_COUNTED} AND {_LANDED}", 'connectedDamageCount', 'connectedDmg')},
      {_pair(f"{_COUNTED} AND {_LANDED} AND NOT is_condition", 'connectedDirectDamageCount', 'connectedDirectDmg')},
      {_pair(f"{_COUNTED} AND {_LANDED} AND (is_condition OR buff_dmg > 0)", 'connectedConditionCount', 'connectedConditionDamage')},
      count(*) FILTER ({_COUNTED} AND {_LANDED} AND NOT is_condition AND skill_id NOT IN (5, 11, 23)) AS critableDirectDamageCount,
      {_pair(f"{_COUNTED} AND {_LANDED} AND NOT is_condition AND skill_id NOT IN (5, 11, 23) AND result IN (1, 8)", 'criticalRate', 'criticalDmg')},
      count(*) FILTER ({_COUNTED} AND (CASE WHEN is_condition THEN absorbed ELSE absorbed OR result = 6 END)) AS invulned,
      count(*) FILTER (event_type = 'CC') AS appliedCrowdControl, CAST(coalesce(sum(cc_value), 0) AS BIGINT) AS appliedCrowdControlDuration,
      count(*) FILTER (dh) AS againstDownedCount, CAST(coalesce(sum(damage) FILTER (dh), 0) AS BIGINT) AS againstDownedDamage,
      CAST(coalesce(sum(damage) FILTER (inw AND damage > 0), 0) AS BIGINT) AS downContribution,
      count(*) FILTER (inw AND event_type = 'CC') AS appliedCrowdControlDownContribution, CAST(coalesce(sum(cc_value) FILTER (inw), 0) AS BIGINT) AS appliedCrowdControlDurationDownContribution
      FROM ac GROUP BY 1, 2)
    SELECT g.*, coalesce(kills, 0) AS killed, coalesce(downs, 0) AS downed FROM g LEFT JOIN oc ON g.fight_id = oc.fight_id AND g.source_agent_id = oc.source_agent_id""")
def attack_statistics(c: Corpus) -> DataFrame:
    events = c.events(DOWN_KINDS)
    return reconcile.attack_statistics(events, downs.down_contribution(events, fight_seconds(c), HOUR_MS), [5, 11, 23])


@query("A27", f"""
    SELECT s.fight_id, s.source_agent_id, s.skill_id, totalDamage, crit, critDamage,
      CASE WHEN nd + ct > 0 THEN nd + ct WHEN fl = 0 AND i.skill_id IS NULL THEN bb ELSE 0 END AS connectedHits
    FROM (SELECT fight_id, source_agent_id, skill_id, CAST(sum(damage) AS BIGINT) AS totalDamage, count(*) FILTER (NOT is_condition AND result IN (0, 1, 2)) AS nd,
      count(*) FILTER (is_condition AND {_LANDED}) AS ct, count(*) FILTER (NOT is_condition AND result = 10) AS bb, count(*) FILTER (NOT is_condition AND result NOT IN (0, 1, 2, 10)) AS fl,
      count(*) FILTER (NOT is_condition AND result IN (1, 8) AND buff_dmg = 0) AS crit, CAST(coalesce(sum(damage) FILTER (NOT is_condition AND result IN (1, 8) AND buff_dmg = 0), 0) AS BIGINT) AS critDamage
      FROM ev WHERE event_type = 'DAMAGE' GROUP BY 1, 2, 3) s
    LEFT JOIN (SELECT DISTINCT fight_id, source_agent_id, skill_id FROM ev WHERE event_type = 'INTERRUPT') i
      ON s.fight_id = i.fight_id AND s.source_agent_id = i.source_agent_id AND s.skill_id = i.skill_id""")
def skill_statistics(c: Corpus) -> DataFrame:
    cut = c.events(["INTERRUPT"]).select("fight_id", "source_agent_id", "skill_id")
    return reconcile.skill_statistics(c.events(["DAMAGE"]), ["fight_id", "source_agent_id"], cut)


_CONDI = "CASE WHEN (is_condition OR buff_dmg > 0) AND NOT is_life_leech THEN least(damage, buff_dmg) ELSE 0 END"


@query("A28", f"""
    WITH r AS (SELECT *, CASE WHEN event_type IN ('DAMAGE', 'COMBAT_OUTCOME', 'BOON_APPLY') THEN target_agent_id ELSE source_agent_id END AS agent_id FROM ev
      WHERE event_type IN ('DAMAGE', 'BLOCK', 'DODGE', 'DOWN', 'DEATH') OR outcome = 'downed' OR (kind = 'apply' AND skill_id = 50001)),
    g AS (SELECT fight_id, agent_id, CAST(coalesce(sum(damage), 0) AS BIGINT) AS damageTaken,
      count(*) FILTER (event_type = 'DAMAGE' AND {_LANDED} AND NOT (NOT is_condition AND result = 10 AND damage = 0 AND buff_dmg = 0)) AS damageTakenCount,
      CAST(coalesce(sum({_CONDI}) FILTER (event_type = 'DAMAGE'), 0) AS BIGINT) AS conditionDamageTaken,
      count(*) FILTER (event_type = 'BLOCK') AS blockedCount, count(*) FILTER (event_type = 'DODGE') AS evadedCount, count(*) FILTER (event_type = 'DOWN') AS dn,
      CAST(coalesce(sum(downtime_ms), 0) AS BIGINT) AS downDuration, count(*) FILTER (event_type = 'DEATH') AS deadCount,
      count(DISTINCT time_ms) FILTER (event_type = 'COMBAT_OUTCOME') AS oc, count(DISTINCT time_ms) FILTER (event_type = 'BOON_APPLY') AS bf FROM r GROUP BY 1, 2)
    SELECT g.fight_id, g.agent_id, damageTaken, damageTakenCount, conditionDamageTaken, damageTaken - conditionDamageTaken AS powerDamageTaken, blockedCount, evadedCount, downDuration, deadCount,
      CASE WHEN (CASE WHEN oc > 0 AND NOT an THEN oc ELSE bf END) > 0 THEN (CASE WHEN oc > 0 AND NOT an THEN oc ELSE bf END)
           WHEN an THEN dn WHEN NOT EXISTS (SELECT 1 FROM ev b WHERE b.fight_id = g.fight_id AND b.kind = 'apply' AND b.skill_id = 50001) THEN oc ELSE 0 END AS downCount
    FROM (SELECT g.*, a.account_name IS NULL AS an FROM g JOIN agents a ON g.fight_id = a.fight_id AND g.agent_id = a.agent_id) g""")
def defence_statistics(c: Corpus) -> DataFrame:
    kinds = ["DAMAGE", "COMBAT_OUTCOME", "BOON_APPLY", "BLOCK", "DODGE", "DOWN", "DEATH"]
    return reconcile.defence_statistics(c.events(kinds), 50001, anonymous=c.agents().filter("account_name is null"))


@query("A29", f"""
    SELECT s.fight_id, source_agent_id, target_agent_id, damage, condiDamage, damage - condiDamage AS powerDamage, CAST(round_even(damage / duration_s, 0) AS BIGINT) AS dps,
      CAST(round_even(condiDamage / duration_s, 0) AS BIGINT) AS "condiDps", CAST(round_even((damage - condiDamage) / duration_s, 0) AS BIGINT) AS "powerDps"
    FROM (SELECT fight_id, source_agent_id, target_agent_id, CAST(sum(damage) AS BIGINT) AS damage, CAST(sum({_CONDI}) AS BIGINT) AS condiDamage FROM ev WHERE event_type = 'DAMAGE' GROUP BY 1, 2, 3) s
    JOIN durations d ON s.fight_id = d.fight_id""")
def target_statistics(c: Corpus) -> DataFrame:
    return reconcile.target_statistics(c.events(["DAMAGE"]), fight_seconds(c))


# -- orders as the expected report, line items as the computed metrics -----------------
_ACTUAL = """act AS (SELECT l_orderkey AS id, CAST(count(*) AS DOUBLE) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1),
    ex AS (SELECT o_orderkey AS id, CAST(o_orderkey % 7 + 1 AS DOUBLE) AS lines, CAST(o_custkey % 120 AS DOUBLE) AS quantity, o_orderstatus AS account, o_custkey FROM orders)"""
_COMPARED = f"""{_ACTUAL}, lg AS (SELECT ex.id, account, o_custkey % 13 AS skill_id, 'lines' AS field, ex.lines AS expected, act.lines AS actual FROM ex LEFT JOIN act ON ex.id = act.id
      UNION ALL SELECT ex.id, account, o_custkey % 13, 'quantity', ex.quantity, act.quantity FROM ex LEFT JOIN act ON ex.id = act.id),
    cmp AS (SELECT id, account, skill_id, 'orders[' || id || '].' || field AS key, CASE WHEN expected = actual THEN 'PASS' ELSE 'FAIL' END AS status, expected, actual, actual - expected AS delta FROM lg)"""


def expected_orders(c: Corpus) -> DataFrame:
    return c.table("orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 7 + 1).cast("double").alias("lines"),
        (F.col("o_custkey") % 120).cast("double").alias("quantity"), F.col("o_orderstatus").alias("account"), "o_custkey",
    )


def actual_orders(c: Corpus) -> DataFrame:
    return c.table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count(F.lit(1)).cast("double").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


def compared(c: Corpus) -> DataFrame:
    rows = reconcile.compare_fields(expected_orders(c), actual_orders(c), ["id"], ["lines", "quantity"], "orders")
    who = expected_orders(c).select("id", "account", (F.col("o_custkey") % 13).alias("skill_id"))
    return rows.join(who, "id")


@query("D1 J19", f"WITH {_COMPARED} SELECT id, key, status, expected, actual, delta, 'field-equal' AS rule FROM cmp")
def compared_fields(c: Corpus) -> DataFrame:
    return reconcile.compare_fields(expected_orders(c), actual_orders(c), ["id"], ["lines", "quantity"], "orders")


@query("D2", """
    WITH e AS (SELECT l_orderkey AS id, sum(l_discount) AS expected FROM lineitem GROUP BY 1), a AS (SELECT l_orderkey AS id, sum(l_tax) AS actual FROM lineitem GROUP BY 1)
    SELECT e.id, round(expected, 6) AS expected, round(actual, 6) AS actual,
      CASE WHEN abs(round(actual * 1000) - round(expected * 1000)) <= 5 THEN 'PASS' ELSE 'FAIL' END AS status
    FROM e JOIN a ON e.id = a.id""")
def compared_within_tolerance(c: Corpus) -> DataFrame:
    lines = c.table("lineitem").withColumnRenamed("l_orderkey", "id")
    expected = lines.select("id", F.col("l_discount").alias("value"))
    actual = lines.groupBy("id").agg(F.sum("l_tax").alias("value"))
    rows = reconcile.compare_within(expected, actual, ["id"], "value")
    return rows.select("id", F.round("expected", 6).alias("expected"), F.round("actual", 6).alias("actual"), "status")


@query("D5", """
    WITH n AS (SELECT o_custkey, count(*) AS parts FROM orders GROUP BY 1)
    SELECT o.o_custkey AS entity, o_orderkey AS slice, 'entities[' || o.o_custkey || CASE WHEN parts > 1 THEN '@' || o_orderkey ELSE '' END || ']' AS key, 'FAIL' AS status, 'entity-present' AS rule
    FROM orders o JOIN n ON o.o_custkey = n.o_custkey WHERE o.o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def missing_entities(c: Corpus) -> DataFrame:
    """Customers expected by orders, those with money as the present entities."""
    expected = c.table("orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("slice"))
    return reconcile.missing_entities(expected, c.table("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("entity")), "entity", "slice")


@query("D4", """
    WITH e AS (SELECT fight_id, target_agent_id, skill_id, stacks, count(*) AS want FROM ev WHERE event_type = 'BUFF_APPLY' GROUP BY ALL),
    a AS (SELECT fight_id, target_agent_id, skill_id, stacks, count(*) AS have FROM ev WHERE kind = 'apply' GROUP BY ALL)
    SELECT coalesce(e.fight_id, a.fight_id) AS fight_id, coalesce(e.target_agent_id, a.target_agent_id) AS target_agent_id,
      CAST(sum(abs(coalesce(want, 0) - coalesce(have, 0))) AS BIGINT) AS differing, CAST(sum(coalesce(want, 0)) AS BIGINT) AS expected_items,
      CASE WHEN sum(abs(coalesce(want, 0) - coalesce(have, 0))) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
    FROM e FULL JOIN a ON e.fight_id = a.fight_id AND e.target_agent_id = a.target_agent_id AND e.skill_id = a.skill_id AND e.stacks = a.stacks GROUP BY 1, 2""")
def compared_multisets(c: Corpus) -> DataFrame:
    columns = ["fight_id", "target_agent_id", "skill_id", "stacks"]
    snapshots = c.events(["BUFF_APPLY"]).select(*columns)
    applies = c.events(["BOON_APPLY"]).filter("kind = 'apply'").select(*columns)
    return reconcile.compare_multisets(snapshots, applies, columns[:2], columns[2:])


def _expected_casts(c: Corpus) -> DataFrame:
    """Reported casts: the computed ones on a 2 ms shift for odd times, instant for every third millisecond."""
    t = F.col("time_ms")
    return casts(c).withColumns(
        {"duration_ms": F.when(t % 3 == 0, 0).otherwise(F.col("duration_ms")), "time_ms": F.when(t % 2 == 1, t + 2 + t % 3).otherwise(t)}
    )


_EXPECTED_CASTS = f"""{_CASTS}, ca AS (SELECT * FROM pc WHERE duration_ms IS NOT NULL), xc AS (SELECT fight_id, source_agent_id, skill_id,
      CASE WHEN time_ms % 2 = 1 THEN time_ms + 2 + time_ms % 3 ELSE time_ms END AS time_ms, CASE WHEN time_ms % 3 = 0 THEN 0 ELSE duration_ms END AS duration_ms FROM ca)"""


def _greedy(name: str, expected: str, actual: str, keys: list[str]) -> str:
    """CTEs up to ``gv_<name>`` (keys, matched, missing, extra): one expected cast after the other takes the first actual one left that fits."""
    cols, on = ", ".join(keys), lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    return f"""xn_{name} AS MATERIALIZED (SELECT {cols}, time_ms, duration_ms, row_number() OVER (PARTITION BY {cols} ORDER BY time_ms, duration_ms) AS i FROM {expected}),
    al_{name} AS (SELECT {cols}, list({{'t': time_ms, 'd': duration_ms}} ORDER BY time_ms, duration_ms) AS l FROM {actual} GROUP BY {cols}),
    gp_{name} AS (SELECT {cols} FROM {expected} UNION SELECT {cols} FROM {actual}),
    wk_{name} AS (SELECT {", ".join(f"g.{k}" for k in keys)}, 0::BIGINT AS i, coalesce(l, []) AS l, NULL::BOOLEAN AS ok FROM gp_{name} g LEFT JOIN al_{name} a ON {on("g", "a")}
      UNION ALL SELECT {cols}, i, CASE WHEN p > 0 THEN list_concat(l[1 : p - 1], l[p + 1 : len(l)]) ELSE l END, p > 0
      FROM (SELECT {", ".join(f"w.{k}" for k in keys)}, x.i, w.l, coalesce(list_position(list_transform(w.l, lambda y: (y.d = x.duration_ms AND abs(y.t - x.time_ms) <= 2)
          OR (y.t = x.time_ms AND (y.d = 0 OR x.duration_ms = 0))), true), 0) AS p FROM wk_{name} w JOIN xn_{name} x ON {on("x", "w")} AND x.i = w.i + 1) s),
    gv_{name} AS (SELECT {cols}, count(*) FILTER (ok) AS matched, count(*) FILTER (NOT ok) AS missing, min(len(l)) AS extra FROM wk_{name} GROUP BY {cols})"""


_CAST_KEYS = ["fight_id", "source_agent_id", "skill_id"]


@query("D3", f"""
    WITH RECURSIVE {_EXPECTED_CASTS}, {_greedy("m", "xc", "ca", _CAST_KEYS)} SELECT fight_id, source_agent_id, skill_id, u.verdict, CAST(u.n AS BIGINT) AS casts
    FROM gv_m, unnest([{{'verdict': 'MATCHED', 'n': matched}}, {{'verdict': 'MISSING', 'n': missing}}, {{'verdict': 'EXTRA', 'n': extra}}]) AS t(u) WHERE u.n > 0""")
def matched_casts(c: Corpus) -> DataFrame:
    rows = reconcile.match_casts(_expected_casts(c), casts(c), ["fight_id", "source_agent_id"], chunk_ms=HOUR_MS)
    return rows.groupBy("fight_id", "source_agent_id", "skill_id", "verdict").agg(F.sum("n").alias("casts"))


@query("U3", f"""
    WITH {_EXPECTED_CASTS} SELECT skill_id, direction, count(*) AS casts FROM (
      SELECT *, 'missing' AS direction FROM (SELECT * FROM xc EXCEPT SELECT * FROM ca) a UNION ALL SELECT *, 'extra' FROM (SELECT * FROM ca EXCEPT SELECT * FROM xc) b) x GROUP BY 1, 2""")
def cast_differences(c: Corpus) -> DataFrame:
    return reconcile.cast_differences(_expected_casts(c), casts(c))


@query("T9", f"""
    WITH {_EXPECTED_CASTS}, df AS (SELECT skill_id, direction, count(*) AS casts FROM (
      SELECT *, 'missing' AS direction FROM (SELECT * FROM xc EXCEPT SELECT * FROM ca) a UNION ALL SELECT *, 'extra' FROM (SELECT * FROM ca EXCEPT SELECT * FROM xc) b) x GROUP BY 1, 2)
    SELECT * FROM (SELECT skill_id, CAST(coalesce(sum(casts) FILTER (direction = 'missing'), 0) AS BIGINT) AS missing, CAST(coalesce(sum(casts) FILTER (direction = 'extra'), 0) AS BIGINT) AS extra,
      row_number() OVER (ORDER BY sum(casts) DESC, skill_id) AS rank FROM df GROUP BY 1) y WHERE rank <= 10""")
def worst_skills(c: Corpus) -> DataFrame:
    """The ten skills with the most missing and extra casts."""
    return reconcile.worst_skills(reconcile.cast_differences(_expected_casts(c), casts(c)), 10)


@query("D6", f"""
    WITH {_COMPARED} SELECT regexp_replace(key, '\\[[^\\]]*\\]', '', 'g') AS bucket, status, count(*) AS results FROM cmp GROUP BY 1, 2""")
def result_buckets(c: Corpus) -> DataFrame:
    rows = compared(c).withColumn("bucket", reconcile.bucket(F.col("key")))
    return rows.groupBy("bucket", "status").agg(F.count(F.lit(1)).alias("results"))


_RULES = [
    (0, "small-quantity", None, None, "orders.quantity", None, 3.0, "rounding"),
    (1, "failed-lines", None, "F", "orders.lines", None, 2.0, "late lines"),
    (2, "skill-7", None, None, None, "7", None, "skill 7 is unreliable"),
    (3, "tiny", None, None, None, None, 1.0, "off by one"),
]
_RULE_SQL = """ru AS (SELECT * FROM (VALUES (0, 'small-quantity', NULL, 'orders.quantity', NULL, 3.0), (1, 'failed-lines', 'F', 'orders.lines', NULL, 2.0),
      (2, 'skill-7', NULL, NULL, 7, NULL), (3, 'tiny', NULL, NULL, NULL, 1.0)) AS v(ord, rule_id, acc, bk, sk, bound))"""
_CLASSED = f"""{_COMPARED}, {_RULE_SQL}, cb AS (SELECT *, 'orders.' || split_part(key, '.', 2) AS bucket FROM cmp),
    kn AS (SELECT id, key, min_by(rule_id, ord) AS rule_id FROM cb JOIN ru ON cb.status = 'FAIL' AND (acc IS NULL OR acc = account) AND (bk IS NULL OR bk = bucket)
      AND (sk IS NULL OR sk = skill_id) AND (bound IS NULL OR abs(delta) <= bound) GROUP BY 1, 2),
    cl AS (SELECT cb.key, cb.bucket, CASE WHEN kn.key IS NOT NULL THEN 'KNOWN_DELTA' ELSE status END AS status, rule_id, delta FROM cb LEFT JOIN kn ON cb.key = kn.key)"""


def classified(c: Corpus) -> DataFrame:
    rules = c.spark.createDataFrame(
        _RULES,
        "ord INT, rule_id STRING, sel_stem STRING, sel_account STRING, sel_bucket STRING, sel_skill_id STRING, max_abs_delta DOUBLE, reason STRING",
    ).withColumn("sel_key", F.lit(None).cast("string"))
    sets = [["bucket"], ["account", "bucket"], ["skill_id"], []]
    return reconcile.classify_known(compared(c).withColumn("stem", F.lit("orders")), rules, sets)


@query("D7", f"WITH {_CLASSED} SELECT key, bucket, status, rule_id FROM cl")
def classified_results(c: Corpus) -> DataFrame:
    return classified(c).select("key", "bucket", "status", "rule_id")


@query("D8 T9", f"""
    WITH {_CLASSED} SELECT bucket, count(*) FILTER (status = 'PASS') AS pass, count(*) FILTER (status = 'FAIL') AS fail, count(*) FILTER (status = 'KNOWN_DELTA') AS known_delta FROM cl GROUP BY 1""")
def status_report(c: Corpus) -> DataFrame:
    return reconcile.status_report(classified(c)).orderBy(F.col("fail").desc(), "bucket")


@query("D9", """
    SELECT o_orderkey AS entry, o_custkey AS account, CASE WHEN o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) THEN 100 + o_custkey % 3 ELSE 0 END AS team
    FROM orders""")
def last_slice_teams(c: Corpus) -> DataFrame:
    """The team shows only on the last entry of an account."""
    entries = c.table("orders").select(F.col("o_orderkey").alias("entry"), F.col("o_custkey").alias("account"), (100 + F.col("o_custkey") % 3).alias("team"))
    return reconcile.entry_teams(entries, ["account"], "entry", "team")


@query("D9", """
    WITH en AS (SELECT fight_id, agent_id, k AS entry, CASE WHEN agent_id % 5 <> 0 THEN k * 21600000 END AS first_ms, CASE WHEN agent_id % 7 = 0 THEN -1 ELSE k * 21600000 + 21599999 END AS last_ms
      FROM players CROSS JOIN generate_series(0, 3) g(k) WHERE k = 0 OR (agent_id % 5 <> 0 AND agent_id % 7 <> 0))
    SELECT en.fight_id, source_agent_id, entry, CAST(sum(damage) AS BIGINT) AS damage, count(*) AS hits FROM ev JOIN en ON ev.fight_id = en.fight_id AND source_agent_id = agent_id
    WHERE event_type = 'DAMAGE' AND (first_ms IS NULL OR last_ms < first_ms OR time_ms BETWEEN first_ms AND last_ms) GROUP BY 1, 2, 3""")
def slice_damage(c: Corpus) -> DataFrame:
    """Damage per entry of six hours; entries without a valid stretch cover the fight."""
    agent = F.col("source_agent_id")
    entries = c.players().select("fight_id", F.col("agent_id").alias("source_agent_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("entry"))
    entries = entries.filter((F.col("entry") == 0) | ((agent % 5 != 0) & (agent % 7 != 0))).withColumns({
        "first_ms": F.when(agent % 5 != 0, F.col("entry") * 21_600_000), "last_ms": F.when(agent % 7 == 0, -1).otherwise(F.col("entry") * 21_600_000 + 21_599_999)})
    rows = reconcile.events_in_slices(c.events(["DAMAGE"]), reconcile.slice_bounds(entries))
    return rows.groupBy("fight_id", "source_agent_id", "entry").agg(F.sum("damage").alias("damage"), F.count(F.lit(1)).alias("hits"))


@query("D9", """
    WITH ac AS (SELECT fight_id, source_agent_id AS agent_id, max(time_ms) AS last_ms FROM ev GROUP BY 1, 2), fe AS (SELECT fight_id, max(time_ms) AS end_ms FROM ev GROUP BY 1)
    SELECT ac.fight_id, agent_id, last_ms, CASE WHEN end_ms - last_ms > 1000 THEN last_ms + 10 END AS stop_ms FROM ac JOIN fe ON ac.fight_id = fe.fight_id""")
def absence_stops(c: Corpus) -> DataFrame:
    """When agents that leave early stop holding buffs."""
    last = c.events().groupBy("fight_id", F.col("source_agent_id").alias("agent_id")).agg(F.max("time_ms").alias("last_ms"))
    ends = c.events().groupBy("fight_id").agg(F.max("time_ms").alias("end_ms"))
    return reconcile.absence_stops(last, ends)


@query("D9", """
    WITH fe AS (SELECT fight_id, max(time_ms) AS duration FROM ev GROUP BY 1)
    SELECT f.fight_id, u.field, CASE WHEN u.expected = u.actual THEN 'PASS' ELSE 'FAIL' END AS status FROM fights f JOIN fe ON f.fight_id = fe.fight_id,
      unnest([{'field': 'durationMS', 'expected': CAST(duration + CASE WHEN CAST(f.fight_id AS BIGINT) % 4 = 0 THEN 5 ELSE 0 END AS VARCHAR), 'actual': CAST(duration AS VARCHAR)},
        {'field': 'arcVersion', 'expected': 'EVTC' || build_version, 'actual': CASE WHEN CAST(f.fight_id AS BIGINT) % 3 = 0 THEN build_version ELSE 'EVTC' || build_version END}]) AS t(u)""")
def header_results(c: Corpus) -> DataFrame:
    """Header fields of every fight against an expectation that is off in some."""
    number = F.col("fight_id").cast("bigint")
    ends = c.events().groupBy("fight_id").agg(F.max("time_ms").alias("duration"))
    rows = c.fights().join(ends, "fight_id")
    version = F.concat(F.lit("EVTC"), F.col("build_version"))
    expected = {"durationMS": (F.col("duration") + F.when(number % 4 == 0, 5).otherwise(0)).cast("string"), "arcVersion": version}
    actual = {"durationMS": F.col("duration").cast("string"), "arcVersion": F.when(number % 3 == 0, F.col("build_version")).otherwise(version)}
    return reconcile.header_results(rows, expected, actual)


@query("G6", f"""
    WITH {_COMPARED}, cb AS (SELECT 'orders.' || split_part(key, '.', 2) AS bucket, round(delta, 3) AS delta, count(*) AS n FROM cmp WHERE status = 'FAIL' AND delta IS NOT NULL GROUP BY 1, 2),
    tt AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (delta > 0), 0) AS BIGINT) AS positive, CAST(coalesce(sum(n) FILTER (delta < 0), 0) AS BIGINT) AS negative, round(sum(delta * n), 3) AS delta_sum FROM cb GROUP BY 1)
    SELECT x.bucket, delta, n, rank, positive, negative, delta_sum FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, delta) AS rank FROM cb) x JOIN tt ON x.bucket = tt.bucket WHERE rank <= 4""")
def delta_profile(c: Corpus) -> DataFrame:
    return reconcile.delta_profile(compared(c).withColumn("bucket", reconcile.bucket(F.col("key"))))


_MARKS = """cs AS (SELECT fight_id, time_ms AS cast_ms FROM ev WHERE event_type = 'WEAPON_SWAP'), me AS (SELECT fight_id, time_ms, event_type AS event_key FROM ev WHERE event_type <> 'WEAPON_SWAP'),
    co AS (SELECT cs.fight_id, cast_ms, event_key FROM cs JOIN me ON cs.fight_id = me.fight_id AND abs(me.time_ms - cast_ms) <= 1800000 GROUP BY ALL),
    cn AS (SELECT fight_id, cast_ms, count(*) AS n FROM cs GROUP BY 1, 2)"""


def _marks(c: Corpus) -> tuple[DataFrame, DataFrame]:
    swaps = c.events(["WEAPON_SWAP"]).select("fight_id", F.col("time_ms").alias("cast_ms"))
    others = c.events().filter("event_type <> 'WEAPON_SWAP'").select("fight_id", "time_ms", F.col("event_type").alias("event_key"))
    return swaps, others


@query("G1", f"""
    WITH {_MARKS}, cv AS (SELECT event_key, CAST(sum(n) AS BIGINT) AS covers FROM co JOIN cn ON co.fight_id = cn.fight_id AND co.cast_ms = cn.cast_ms GROUP BY 1)
    SELECT cv.event_key, covers, (SELECT count(*) FROM me WHERE me.event_key = cv.event_key) AS fires, (SELECT count(*) FROM cs) AS casts,
      (SELECT count(*) FROM me WHERE me.event_key = cv.event_key) = (SELECT count(*) FROM cs) AS one_to_one
    FROM cv WHERE covers >= (SELECT count(*) FROM cs) * 0.5""")
def trigger_candidates(c: Corpus) -> DataFrame:
    swaps, others = _marks(c)
    return reconcile.trigger_candidates(swaps, others, ["fight_id"], 1_800_000, 0.5)


@query("G2", f"WITH {_MARKS} SELECT event_key, CAST(sum(n) AS BIGINT) AS casts FROM co JOIN cn ON co.fight_id = cn.fight_id AND co.cast_ms = cn.cast_ms GROUP BY 1")
def coincidence_counts(c: Corpus) -> DataFrame:
    swaps, others = _marks(c)
    return reconcile.coincidences(swaps, others, ["fight_id"], 1_800_000).groupBy("event_key").agg(F.sum("n").alias("casts"))


_TAGGED = ["candidate_id", *_CAST_KEYS]


def _what_if_sql() -> str:
    sums = lambda n, name: f"SELECT candidate_id, fight_id, source_agent_id, CAST(sum(missing + extra) AS BIGINT) AS {name} FROM gv_{n} GROUP BY 1, 2, 3 HAVING sum(missing + extra) > 0"
    return f"""WITH RECURSIVE {_EXPECTED_CASTS}, cd AS (SELECT lower(event_type) AS candidate_id, fight_id, source_agent_id, 100 + skill_id % 4 AS skill_id, time_ms, 0 AS duration_ms FROM ev
      WHERE event_type IN ('INTERRUPT', 'MISSILE')), tc AS (SELECT DISTINCT candidate_id, skill_id FROM cd),
    xw AS (SELECT candidate_id, xc.* FROM xc JOIN tc ON xc.skill_id = tc.skill_id), bw AS (SELECT candidate_id, ca.fight_id, ca.source_agent_id, ca.skill_id, time_ms, duration_ms FROM ca JOIN tc ON ca.skill_id = tc.skill_id),
    aw AS (SELECT * FROM bw UNION ALL SELECT candidate_id, fight_id, source_agent_id, skill_id, time_ms, duration_ms FROM cd),
    {_greedy("b", "xw", "bw", _TAGGED)}, {_greedy("a", "xw", "aw", _TAGGED)}, bs AS ({sums("b", "before")}), ass AS ({sums("a", "after")})
    SELECT candidate_id, fight_id, source_agent_id, coalesce(before, 0) AS before, coalesce("after", 0) AS "after", coalesce("after", 0) - coalesce(before, 0) AS change
    FROM bs FULL JOIN ass USING (candidate_id, fight_id, source_agent_id)""".replace("AS after FROM gv", 'AS "after" FROM gv')


@query("G3", _what_if_sql())
def rule_what_if(c: Corpus) -> DataFrame:
    """What adding every interrupt (or every missile) as an instant cast would change."""
    t = c.events(["INTERRUPT", "MISSILE"])
    candidates = t.select(
        F.lower("event_type").alias("candidate_id"), "fight_id", F.col("source_agent_id").cast("bigint"), (100 + F.col("skill_id") % 4).alias("skill_id"), "time_ms",
        F.lit(0).cast("bigint").alias("duration_ms"),
    )
    return reconcile.rule_what_if(_expected_casts(c), casts(c), candidates, ["fight_id", "source_agent_id"], HOUR_MS)


@query("G4", f"""
    WITH h AS (SELECT fight_id, source_agent_id, skill_id, count(*) AS rows, min(result) AS result, count(DISTINCT result) AS rs, count(DISTINCT is_condition) AS cs, bool_or(is_condition) AS is_condition,
      count(*) FILTER ({_LANDED}) AS connected FROM ev WHERE event_type = 'DAMAGE' GROUP BY 1, 2, 3)
    SELECT is_condition, result, count(*) FILTER (connected = rows) AS "all", count(*) FILTER (connected = 0) AS none, count(*) FILTER (connected NOT IN (0, rows)) AS partial
    FROM h WHERE rs = 1 AND cs = 1 GROUP BY 1, 2""")
def code_votes(c: Corpus) -> DataFrame:
    from frayline.functions.combat import landed_hit

    hits = c.events(["DAMAGE"])
    keys = ["fight_id", "source_agent_id", "skill_id"]
    groups = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"), F.count(F.when(landed_hit(), 1)).alias("connected"))
    return reconcile.code_votes(groups, hits.select(*keys, "is_condition", "result"), keys, ["is_condition", "result"])


@query("G5", f"""
    WITH {_COMPARED} SELECT l_returnflag, l_linestatus, count(*) AS rows FROM lineitem WHERE l_orderkey IN (SELECT id FROM cmp WHERE status = 'FAIL' AND key LIKE '%.lines') GROUP BY 1, 2""")
def residual_profile(c: Corpus) -> DataFrame:
    bad = compared(c).filter("status = 'FAIL' and key like '%.lines'").select("id").distinct()
    rows = c.table("lineitem").withColumnRenamed("l_orderkey", "id")
    return reconcile.residual_profile(bad, rows, ["id"], ["l_returnflag", "l_linestatus"])


@query("G7", """
    SELECT CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unique' END AS verdict, count(*) AS targets
    FROM (SELECT DISTINCT fight_id, target_agent_id % 45 AS instance_id FROM ev) t LEFT JOIN (SELECT fight_id, instance_id, count(*) AS n FROM agents WHERE is_player GROUP BY 1, 2) a
      ON t.fight_id = a.fight_id AND t.instance_id = a.instance_id GROUP BY 1""")
def match_verdicts(c: Corpus) -> DataFrame:
    targets = c.events().select("fight_id", (F.col("target_agent_id") % 45).cast("int").alias("instance_id")).distinct()
    return reconcile.match_verdicts(targets, c.agents().filter("is_player"), ["fight_id", "instance_id"])


@query("G7", """
    SELECT profession, subgroup, count(*) AS pairs FROM agents WHERE is_player GROUP BY 1, 2""")
def code_label_pairs(c: Corpus) -> DataFrame:
    return c.agents().filter("is_player").groupBy("profession", "subgroup").agg(F.count(F.lit(1)).alias("pairs"))


@query("G7", """
    SELECT a.fight_id, agent_id, round((e.end_ms - last_ms) / e.end_ms * 100, 6) AS gap_pct
    FROM (SELECT fight_id, source_agent_id AS agent_id, max(time_ms) AS last_ms FROM ev GROUP BY 1, 2) a JOIN (SELECT fight_id, max(time_ms) AS end_ms FROM ev GROUP BY 1) e ON a.fight_id = e.fight_id""")
def awareness_gaps(c: Corpus) -> DataFrame:
    last = c.events().groupBy("fight_id", F.col("source_agent_id").alias("agent_id")).agg(F.max("time_ms").alias("last_ms"))
    ends = last.groupBy("fight_id").agg(F.max("last_ms").alias("end_ms"))
    gap = F.round((F.col("end_ms") - F.col("last_ms")) / F.col("end_ms") * 100, 6)
    return last.join(ends, "fight_id").select("fight_id", "agent_id", gap.alias("gap_pct"))
