"""Record classification and per-record context queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frayline.functions import combat, names
from frayline.operators import classify, records
from frayline.plans.registry import query
from frayline.sources.corpus import Corpus


@query("C3", "SELECT fight_id, seq, master FROM mst")
def record_masters(c: Corpus) -> DataFrame:
    return classify.resolve_masters(c.raw_records()).filter("src_master <> 0").select("fight_id", "seq", "master")


@query("C2", "SELECT fight_id, src, time, downtime_ms FROM dd")
def down_durations(c: Corpus) -> DataFrame:
    return classify.down_durations(c.raw_records())


@query("C4", """
    SELECT f.fight_id, f.seq FROM folded f WHERE build >= 20250000 AND buffremove IN (2, 3) AND EXISTS (
      SELECT 1 FROM raw r WHERE build >= 20250000 AND r.buffremove = 1 AND r.fight_id = f.fight_id AND r.time = f.time AND r.src = f.src AND r.skill = f.skill)""")
def suppressed_removals(c: Corpus) -> DataFrame:
    raw = c.raw_records()
    singles = raw.filter("build >= 20250000 and buffremove in (2, 3)").withColumnRenamed("src", "actor")
    return singles.join(classify.all_removals(raw), ["fight_id", "time", "actor", "skill"], "left_semi").select("fight_id", "seq")


@query("C5", "SELECT fight_id, skill, guid FROM gd")
def effect_guids(c: Corpus) -> DataFrame:
    return classify.effect_guids(c.raw_records())


@query("C11", """
    WITH o AS (SELECT fight_id, min(time) AS origin FROM raw WHERE time > 0 GROUP BY 1)
    SELECT a.fight_id, agent_id, min(time) - any_value(origin) AS first_ms, max(time) - any_value(origin) AS last_ms
    FROM (SELECT fight_id, time, src AS agent_id, statechange FROM raw UNION ALL SELECT fight_id, time, dst, statechange FROM raw) a
    JOIN o ON a.fight_id = o.fight_id WHERE time > 0 AND agent_id <> 0 AND statechange NOT IN (8, 27) GROUP BY 1, 2""")
def agent_awareness(c: Corpus) -> DataFrame:
    return classify.awareness(c.raw_records())


@query("C13", """
    SELECT fight_id, seq, src AS agent_id, time AS time_ms, value AS removed_ms, pad AS stack_id FROM raw
    WHERE build >= 20250000 AND skill = 718 AND buffremove = 2 AND statechange IN (0, 71) AND iff = 2 AND dst = 0 AND value > 15""")
def displaced_stack_hints(c: Corpus) -> DataFrame:
    return classify.displaced_stack_hints(c.raw_records())


@query("C14", """
    SELECT a.fight_id, a.agent_id, name, first_instance_id, team_id FROM agents a
    LEFT JOIN (SELECT fight_id, src, min_by(src_inst, seq) AS first_instance_id FROM raw WHERE src <> 0 AND src_inst <> 0 GROUP BY 1, 2) i
      ON a.fight_id = i.fight_id AND a.agent_id = i.src
    LEFT JOIN (SELECT fight_id, src, max_by(dst, seq) AS team_id FROM raw WHERE statechange = 22 AND src <> 0 GROUP BY 1, 2) t
      ON a.fight_id = t.fight_id AND a.agent_id = t.src""")
def enriched_agents(c: Corpus) -> DataFrame:
    agents = c.agents().select("fight_id", "agent_id", "name")
    return classify.enriched_agents(c.raw_records(), agents)


@query("C9", """
    SELECT fight_id, seq, CASE WHEN abs_time >= 9223372036854775807 THEN 0
      WHEN base >= 86400000 THEN greatest(abs_time - base, 0) ELSE abs_time END AS time_ms
    FROM (SELECT fight_id, seq, abs_time, min(abs_time) FILTER (abs_time > 0 AND abs_time < 9223372036854775807) OVER (PARTITION BY fight_id) AS base
      FROM (SELECT fight_id, seq, CASE WHEN seq % 97 = 0 THEN 9223372036854775807 WHEN CAST(substring(fight_id, 7, 2) AS INTEGER) % 2 = 0
              THEN time_ms + 900000000000 ELSE time_ms END AS abs_time FROM ev) x) y""")
def normalised_times(c: Corpus) -> DataFrame:
    """Even days carry an absolute clock, some records a sentinel."""
    even = F.substring("fight_id", 7, 2).cast("int") % 2 == 0
    clock = F.when(F.col("seq") % 97 == 0, F.lit(records.SENTINEL)).when(even, F.col("time_ms") + 900000000000).otherwise(F.col("time_ms"))
    return records.normalise_time(c.events().select("fight_id", "seq", clock.alias("time_ms")))


@query("C18", """
    SELECT fight_id, seq, greatest(time_ms - 60000, 0) AS time_ms, target_agent_id AS agent_id, skill_id AS buff_id, stacks, duration_ms
    FROM ev WHERE event_type = 'BUFF_APPLY' AND skill_id IN (740, 1122, 718)""")
def initial_buffs(c: Corpus) -> DataFrame:
    return records.initial_buffs(c.events(["BUFF_APPLY"]), 60_000, [740, 1122, 718])


@query("C6 C7 C8 C15", """
    SELECT fight_id, seq, CASE WHEN value >= 2147483647 THEN 0 ELSE greatest(value, 0) END AS magnitude,
      CASE WHEN result = 6 THEN false WHEN build >= 20260507 THEN result >= 13 AND result % 2 = 0 ELSE result = 0 END AS landed,
      CASE WHEN result = 6 THEN true WHEN build >= 20260507 THEN result >= 13 AND result % 2 = 1 ELSE result <> 0 END AS absorbed,
      CASE buffremove WHEN 0 THEN 'apply' WHEN 1 THEN 'remove_all' ELSE 'remove_single' END AS change,
      CASE WHEN skill + 720 IN (740, 725, 717, 718, 719, 726, 743, 1122, 1187, 873, 5974, 30336, 13017, 26980) THEN 'boon'
        WHEN skill + 720 IN (736, 737, 721, 722, 723) THEN 'condition_damage'
        WHEN skill + 720 IN (727, 728, 730, 731, 732, 733, 734, 735, 742) THEN 'condition_control' END AS category,
      skill + 720 IN (736, 737, 721, 722, 723, 727, 728, 730, 731, 732, 733, 734, 735, 742) AS is_condition
    FROM raw""")
def record_scalars(c: Corpus) -> DataFrame:
    buff = F.col("skill") + 720
    return c.raw_records().select(
        "fight_id", "seq", combat.clamp_magnitude(F.col("value")).alias("magnitude"),
        combat.condition_landed(F.col("result"), F.col("build")).alias("landed"),
        combat.condition_absorbed(F.col("result"), F.col("build")).alias("absorbed"),
        combat.buff_change_kind(F.col("buffremove")).alias("change"),
        combat.buff_category(buff).alias("category"), combat.is_condition_buff(buff).alias("is_condition"),
    )


@query("C16 A30", """
    SELECT fight_id, seq, CASE WHEN is_condition THEN connected WHEN connected THEN true WHEN buff_dmg > 0 THEN damage > 0 ELSE result IN (0, 1, 2, 8, 10) END AS landed,
      CASE WHEN is_condition THEN absorbed ELSE absorbed OR result = 6 END AS absorbed,
      CASE WHEN (is_condition OR buff_dmg > 0) AND NOT is_life_leech THEN least(damage, buff_dmg) ELSE 0 END AS condition_damage,
      CASE WHEN skill_id IN (3, 12, 21, 30) AND NOT is_life_leech THEN least(damage, buff_dmg) ELSE 0 END AS listed_condition_damage
    FROM ev WHERE event_type = 'DAMAGE'""")
def hit_verdicts(c: Corpus) -> DataFrame:
    return c.events(["DAMAGE"]).select(
        "fight_id", "seq", combat.landed_hit().alias("landed"), combat.absorbed_hit().alias("absorbed"),
        combat.catalogue_condition_damage().alias("condition_damage"),
        combat.catalogue_condition_damage([3, 12, 21, 30]).alias("listed_condition_damage"),
    )


_PROF = """CASE WHEN p = 0 THEN 'UNKNOWN' WHEN p <= 9 THEN (['Guardian', 'Warrior', 'Engineer', 'Ranger', 'Thief', 'Elementalist', 'Mesmer', 'Necromancer', 'Revenant'])[p]
      ELSE 'PROF(' || p || ')' END"""


@query("C19 C20 C22 C23 C26 C27", f"""
    WITH s AS (SELECT c_custkey AS id, c_custkey % 12 AS p, c_custkey % 90 AS e, c_name || CASE WHEN c_custkey % 3 = 0 THEN ' [CMDR]' ELSE '' END AS nm,
      CASE c_custkey % 4 WHEN 0 THEN 'Subgroup ' || c_custkey % 7 WHEN 1 THEN CAST(c_custkey % 9 AS VARCHAR) WHEN 2 THEN 'Sub A' END AS sg,
      CASE WHEN c_custkey % 2 = 0 THEN '::' ELSE '' END || c_name AS acc FROM customer)
    SELECT id, {_PROF} AS profession_label, p AS profession,
      CASE WHEN e = 0 THEN 'BASE' WHEN e = 5 THEN 'Druid' WHEN e = 62 THEN 'Firebrand' WHEN e IN (7, 18, 27, 34, 40, 43, 48, 52, 55, 56, 57, 58, 59, 60, 61, 63, 64, 65, 66, 67, 68, 69, 70, 71, 72, 73, 74, 75, 76, 77, 78, 79, 80, 81) THEN 'listed'
        ELSE 'ELITE(' || e || ')' END AS elite_label,
      CASE WHEN (p, e) IN ((1, 27), (1, 62), (1, 65), (1, 81), (2, 18), (2, 61), (2, 68), (2, 74), (3, 43), (3, 57), (3, 70), (3, 75), (4, 5), (4, 55), (4, 72), (4, 78),
        (5, 7), (5, 58), (5, 71), (5, 77), (6, 48), (6, 56), (6, 67), (6, 80), (7, 40), (7, 59), (7, 66), (7, 73), (8, 34), (8, 60), (8, 64), (8, 76), (9, 52), (9, 63), (9, 69), (9, 79))
        THEN e ELSE 0 END AS valid_elite,
      CASE id % 4 WHEN 0 THEN id % 7 WHEN 1 THEN id % 9 ELSE 0 END AS subgroup_number,
      id % 3 = 0 AS commander, CASE WHEN id % 3 = 0 THEN substring(nm, 1, length(nm) - 7) ELSE nm END AS plain_name,
      substring(nm, 1, 12) AS short_name, ltrim(acc, ':') AS bare_account, regexp_replace(acc, '^:', '') AS migrated_account
    FROM s""")
def label_functions(c: Corpus) -> DataFrame:
    """Label, name and account expressions over the customer names."""
    key = F.col("c_custkey")
    label = (
        F.when(key % 4 == 0, F.concat(F.lit("Subgroup "), (key % 7).cast("string")))
        .when(key % 4 == 1, (key % 9).cast("string"))
        .when(key % 4 == 2, "Sub A")
    )
    rows = c.table("customer").select(
        key.alias("id"), (key % 12).cast("int").alias("profession"), (key % 90).cast("int").alias("e"),
        F.concat("c_name", F.when(key % 3 == 0, " [CMDR]").otherwise("")).alias("nm"), label.alias("sg"),
        F.concat(F.when(key % 2 == 0, "::").otherwise(""), F.col("c_name")).alias("acc"),
    )
    elite = names.elite_label(F.col("e"))
    known = elite.isin("BASE", "Druid", "Firebrand") | elite.startswith("ELITE(")
    return rows.select(
        "id", "profession", names.profession_label(F.col("profession")).alias("profession_label"),
        F.when(known, elite).otherwise("listed").alias("elite_label"),
        names.valid_elite(F.col("profession"), F.col("e")).alias("valid_elite"),
        names.subgroup_number(F.col("sg")).alias("subgroup_number"),
        names.is_commander(F.col("nm")).alias("commander"), names.without_commander_tag(F.col("nm")).alias("plain_name"),
        names.sanitise_name(F.col("nm"), 12).alias("short_name"), names.bare_account(F.col("acc")).alias("bare_account"),
        names.strip_one_colon(F.col("acc")).alias("migrated_account"),
    )


@query("C28", """
    SELECT fight_id, seq, CAST(time_ms // 60000 AS VARCHAR) || ':' || lpad(CAST(time_ms // 1000 % 60 AS VARCHAR), 2, '0') AS clock,
      CASE WHEN time_ms < 1024 THEN time_ms || ' B' WHEN time_ms < 1048576 THEN printf('%.1f KiB', time_ms / 1024.0::DOUBLE) ELSE printf('%.1f MiB', time_ms / 1048576.0::DOUBLE) END AS size_label
    FROM ev""")
def display_labels(c: Corpus) -> DataFrame:
    return c.events().select(
        "fight_id", "seq", names.clock_label(F.col("time_ms")).alias("clock"), names.byte_size(F.col("time_ms")).alias("size_label")
    )


@query("C25", """
    SELECT fight_id, event_type, count(*) AS events FROM ev GROUP BY 1, 2""")
def events_by_kind(c: Corpus) -> DataFrame:
    return c.events().groupBy("fight_id", "event_type").agg(F.count(F.lit(1)).alias("events"))


# Independent formulation of the record rules: one SELECT per emitted event.
_PLAIN = "statechange = 0 AND NOT activation BETWEEN 1 AND 6"
_FIGHTING = f"{_PLAIN} AND NOT buffremove BETWEEN 1 AND 3"
_MODERN_HIT = f"""{_FIGHTING} AND modern AND NOT (buff <> 0 AND buff_dmg = 0 AND value > 0 AND activation = 0)
      AND (iff IN (1, 2) OR (actor = dst AND buff <> 0 AND value = 0 AND buff_dmg > 0))"""
_DIRECT = f"{_MODERN_HIT} AND buff = 0"
_HEAL = "CASE WHEN buff = 0 AND value < 0 THEN -value WHEN buff <> 0 AND value = 0 AND buff_dmg < 0 THEN -buff_dmg ELSE 0 END"
_BITS = lambda e: (
    f"(CASE WHEN ({e}) >> 23 & 255 < 255 THEN pow(2.0, ({e} >> 23 & 255) - 127) * (1.0 + ({e} & 8388607) / 8388608.0::DOUBLE) END)"
)
_BRANCHES = [
    # kind, source, target, skill, condition, magnitude, duration, detail
    ("BUFF_APPLY", "src", "dst", "skill", "statechange = 18", "NULL", "size", "pad"),
    ("BUFF_STACK_ACTIVE", "src", "src", "skill", "statechange = 27", "NULL", "NULL", "dst"),
    ("BUFF_EXTENSION", "src", "dst", "skill", "statechange = 70", "greatest(value, 0)", "NULL", "pad"),
    ("BUFF_INFO", "src", "dst", "skill", "statechange = 30", "overstack", "NULL", "NULL"),
    ("HEALING", "actor", "dst", "skill", f"statechange = 49 AND pad = 2627419289 AND offcycle & 128 <> 0 AND {_HEAL} > 0", f"CASE WHEN shields <> 0 THEN 0 ELSE {_HEAL} END", "NULL", "NULL"),
    ("SPAWN", "coalesce(owner, 0)", "src", "0", "statechange = 6", "NULL", "NULL", "NULL"),
    ("DESPAWN", "src", "0", "0", "statechange = 7", "NULL", "NULL", "NULL"),
    ("MISSILE", "coalesce(owner, actor)", "dst", "skill", "statechange = 57", "NULL", "NULL", "NULL"),
    ("WEAPON_SWAP", "src", "0", "0", "statechange = 11", "dst", "NULL", "NULL"),
    ("EFFECT", "coalesce(owner, src)", "dst", "skill", "statechange IN (45, 51, 60, 62) AND guid IS NOT NULL", "NULL",
     "CASE WHEN statechange = 51 THEN iff + buff * 256 + result * 65536 + activation * 16777216 ELSE 0 END", "NULL"),
    ("POSITION", "src", "0", "0", f"statechange = 19 AND abs({_BITS('(dst & 4294967295)')}) <= 100000", f"CAST({_BITS('(dst & 4294967295)')} * 4096 AS BIGINT)", "NULL", "NULL"),
    ("UP", "src", "0", "0", "statechange = 3", "NULL", "NULL", "NULL"),
    ("DOWN", "src", "0", "0", "statechange = 5 AND (NOT modern OR downtime_ms IS NOT NULL)", "coalesce(downtime_ms, 0)", "NULL", "NULL"),
    ("DEATH", "src", "0", "0", "statechange = 4", "NULL", "NULL", "NULL"),
    ("HEALTH_UPDATE", "src", "0", "0", "statechange = 8", "dst", "NULL", "NULL"),
    ("STUN_BREAK", "src", "0", "0", "statechange = 56", "NULL", "NULL", "NULL"),
    ("BARRIER", "src", "dst", "skill", "statechange = 38", "NULL", "0", "NULL"),
    ("SKILL_ACTIVATION", "src", "0", "skill", "statechange = 0 AND activation BETWEEN 1 AND 6", "activation", "greatest(value, 0)", "NULL"),
    ("BOON_APPLY", "dst", "src", "skill", f"""{_PLAIN} AND buffremove BETWEEN 1 AND 3 AND NOT (modern AND buffremove <> 1 AND ((iff = 2 AND dst = 0) OR cleared))""",
     "CASE WHEN buffremove = 1 THEN greatest(result, 1) ELSE 1 END", "size", "pad"),
    ("BOON_APPLY", "actor", "dst", "skill", f"{_FIGHTING} AND modern AND buff <> 0 AND buff_dmg = 0 AND value > 0 AND offcycle = 0", "1", "size", "pad"),
    ("BUFF_EXTENSION", "actor", "dst", "skill", f"{_FIGHTING} AND modern AND buff <> 0 AND buff_dmg = 0 AND value > 0 AND offcycle <> 0", "size", "NULL", "pad"),
    ("DAMAGE", "actor", "dst", "skill", f"{_MODERN_HIT} AND buff <> 0 AND NOT (iff = 2 AND src = 0 AND src_master <> 0) AND (strip > 0 OR result <> 0)", "strip", "NULL", "NULL"),
    ("COMBAT_OUTCOME", "actor", "dst", "skill", f"{_DIRECT} AND result IN (8, 9)", "NULL", "NULL", "NULL"),
    ("CC", "actor", "dst", "skill", f"{_DIRECT} AND result = 12", "size", "NULL", "NULL"),
    ("BLOCK", "dst", "0", "0", f"{_DIRECT} AND result = 3", "NULL", "NULL", "NULL"),
    ("DODGE", "dst", "0", "0", f"{_DIRECT} AND result = 4", "NULL", "NULL", "NULL"),
    ("INTERRUPT", "actor", "dst", "skill", f"{_DIRECT} AND result = 5", "NULL", "NULL", "NULL"),
    ("DAMAGE", "actor", "dst", "skill", f"""{_DIRECT} AND result NOT IN (5, 8, 9, 11, 12) AND ((size > 0 AND result <> 10) OR (dst <> 0 AND skill <> 0 AND result IN (0, 1, 2, 3, 4, 6, 7, 8, 10, 13)))""",
     "CASE WHEN result = 10 THEN 0 ELSE size END", "NULL", "NULL"),
    ("HEALING", "actor", "dst", "skill", f"{_FIGHTING} AND NOT modern AND buff <> 0 AND nondamage <> 0 AND (size > 0 OR strip > 0)", "size", "NULL", "NULL"),
    ("BOON_APPLY", "actor", "dst", "skill", f"{_FIGHTING} AND NOT modern AND buff <> 0", "1", "0", "NULL"),
    ("HEALING", "actor", "dst", "skill", f"{_FIGHTING} AND NOT modern AND buff = 0 AND nondamage <> 0 AND size > 0", "size", "NULL", "NULL"),
    ("BUFF_REMOVAL", "actor", "dst", "skill", f"{_FIGHTING} AND NOT modern AND buff = 0 AND nondamage <> 0 AND strip > 0", "strip", "NULL", "NULL"),
    ("BLOCK", "dst", "0", "0", f"{_FIGHTING} AND NOT modern AND buff = 0 AND nondamage = 0 AND result = 3", "NULL", "NULL", "NULL"),
    ("DODGE", "dst", "0", "0", f"{_FIGHTING} AND NOT modern AND buff = 0 AND nondamage = 0 AND result = 4", "NULL", "NULL", "NULL"),
    ("INTERRUPT", "actor", "dst", "skill", f"{_FIGHTING} AND NOT modern AND buff = 0 AND nondamage = 0 AND result = 5", "NULL", "NULL", "NULL"),
    ("DAMAGE", "actor", "dst", "skill", f"{_FIGHTING} AND NOT modern AND buff = 0 AND nondamage = 0 AND size > 0", "size", "NULL", "NULL"),
]
_CLASSIFIED = "\n    UNION ALL ".join(
    f"SELECT fight_id, seq, time AS time_ms, '{kind}' AS event_type, {s} AS source_agent_id, {t} AS target_agent_id, {k} AS skill_id, "
    f"CAST({mag} AS BIGINT) AS magnitude, CAST({dur} AS BIGINT) AS duration_ms, CAST({det} AS BIGINT) AS stack_id FROM ctx WHERE {cond}"
    for kind, s, t, k, cond, mag, dur, det in _BRANCHES
)


@query("C1a C1b C1c C1d C1e C1f C1g C1h C1i C1j C1k C1l C1m C1n C1o C1p C1q", _CLASSIFIED)
def classified_events(c: Corpus) -> DataFrame:
    """All record rules; the kind's main number is shown as ``magnitude``."""
    rows = classify.classify(c.raw_records())
    on = lambda *kinds: F.col("event_type").isin(list(kinds))
    magnitude = (
        F.when(on("BUFF_EXTENSION"), F.col("extended_duration_ms")).when(on("BUFF_INFO"), F.col("duration_cap"))
        .when(on("HEALING"), F.col("healing")).when(on("WEAPON_SWAP"), F.col("swapped_to"))
        .when(on("POSITION"), F.col("x") * 4096).when(on("DOWN"), F.col("downtime_ms"))
        .when(on("HEALTH_UPDATE"), F.col("health_percent") * 100).when(on("SKILL_ACTIVATION"), F.col("activation"))
        .when(on("BOON_APPLY"), F.col("stacks")).when(on("DAMAGE"), F.col("damage")).when(on("CC"), F.col("cc_value"))
        .when(on("BUFF_REMOVAL"), F.col("buff_removal"))
    )
    return rows.select(
        "fight_id", "seq", "time_ms", "event_type", "source_agent_id", "target_agent_id", "skill_id",
        F.round(magnitude).cast("bigint").alias("magnitude"), "duration_ms", "stack_id",
    )


@query("C1m C1n", """
    SELECT fight_id, seq, buff <> 0 AND modern AS is_condition,
      CASE WHEN buff <> 0 AND modern THEN CASE WHEN result = 6 THEN false WHEN build >= 20260507 THEN result >= 13 AND result % 2 = 0 ELSE result = 0 END ELSE result IN (0, 1, 2, 8, 10) END AS connected,
      CASE WHEN buff <> 0 AND modern THEN CASE WHEN result = 6 THEN true WHEN build >= 20260507 THEN result >= 13 AND result % 2 = 1 ELSE result <> 0 END ELSE result = 6 END AS absorbed,
      CASE WHEN NOT modern THEN false WHEN buff <> 0 AND build < 20260507 THEN pad & 255 <> 0 ELSE offcycle <> 0 END AS against_downed,
      buff <> 0 AND modern AND offcycle IN (3, 5) AS is_life_leech, overstack AS shield_damage
    FROM ctx WHERE """ + " OR ".join(f"({b[4]})" for b in _BRANCHES if b[0] == "DAMAGE"))
def classified_hit_flags(c: Corpus) -> DataFrame:
    rows = classify.classify(c.raw_records()).filter("event_type = 'DAMAGE'")
    return rows.select("fight_id", "seq", "is_condition", "connected", "absorbed", "against_downed", "is_life_leech", "shield_damage")


@query("G8", """
    SELECT fight_id, src, skill, statechange, result, count(*) AS records, CAST(sum(value) AS BIGINT) AS value_sum, min(time) AS first_time, max(time) AS last_time
    FROM raw GROUP BY 1, 2, 3, 4, 5""")
def record_profile(c: Corpus) -> DataFrame:
    return c.raw_records().groupBy("fight_id", "src", "skill", "statechange", "result").agg(
        F.count(F.lit(1)).alias("records"), F.sum("value").alias("value_sum"), F.min("time").alias("first_time"), F.max("time").alias("last_time")
    )
