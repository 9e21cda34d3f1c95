"""Roll-up queries: rosters, targets, players, squads, skills, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frayline.operators import records, rollups
from frayline.plans.registry import query
from frayline.sources.corpus import Corpus


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


def fight_seconds(c: Corpus) -> DataFrame:
    return records.fight_durations(c.events())


@query("C10", """
    SELECT fight_id, duration_s FROM durations""")
def fight_duration(c: Corpus) -> DataFrame:
    return fight_seconds(c)


@query("A1 V1", """
    SELECT a.fight_id, count(*) AS agent_count,
           count(*) FILTER (is_player AND account_name IS NOT NULL) AS player_count,
           count(*) FILTER (NOT (is_player AND account_name IS NOT NULL)) AS npc_count,
           any_value(s.skill_count) AS skill_count
    FROM agents a JOIN (SELECT fight_id, count(DISTINCT skill_id) AS skill_count FROM ev GROUP BY fight_id) s
      ON a.fight_id = s.fight_id GROUP BY a.fight_id""")
def fight_roster(c: Corpus) -> DataFrame:
    return rollups.fight_roster(c.agents(), c.events().select("fight_id", "skill_id").distinct())


@query("A2", """
    SELECT fight_id, coalesce(subgroup, '') AS subgroup, count(*) AS player_count,
           min(account_name) AS first_account, max(account_name) AS last_account
    FROM players GROUP BY 1, 2""")
def subgroup_roster(c: Corpus) -> DataFrame:
    return rollups.subgroup_members(c.players())


@query("A2", """
    SELECT fight_id, coalesce(subgroup, '') AS subgroup, account_name, count(*) AS characters,
      row_number() OVER (PARTITION BY fight_id, coalesce(subgroup, '') ORDER BY account_name) AS position
    FROM players GROUP BY 1, 2, 3""")
def subgroup_member_list(c: Corpus) -> DataFrame:
    return rollups.subgroup_accounts(c.players())


@query("A3 C24 T7", """
    SELECT fight_id, agent_id, account_name, name, coalesce(subgroup, '') AS subgroup, profession, elite FROM players""")
def combatant_list(c: Corpus) -> DataFrame:
    return rollups.combatants(c.players()).orderBy("fight_id", "account_name", "name")


@query("A4 N2", """
    SELECT account_name, count(DISTINCT p.fight_id) AS fights_attended,
      CAST(arg_min(profession, struct_pack(a := started_at, b := p.fight_id, c := agent_id)) AS INTEGER) AS profession,
      arg_min(elite, struct_pack(a := started_at, b := p.fight_id, c := agent_id)) AS elite,
      arg_max(name, struct_pack(a := started_at, b := p.fight_id, c := agent_id)) AS name
    FROM players p JOIN fights f ON p.fight_id = f.fight_id GROUP BY account_name""")
def account_attendance(c: Corpus) -> DataFrame:
    return rollups.attendance(c.players(), c.fights())


def _target_sql(kind: str, value: str, total: str, count: str, rate: str, key: str = "target_agent_id") -> str:
    return f"""
    SELECT r.fight_id, r.{key}, {total}, {count},
           round(CASE WHEN duration_s > 0 THEN {total} / duration_s ELSE 0.0 END, 6) AS {rate}, name
    FROM (SELECT fight_id, {key}, CAST(sum({value}) AS BIGINT) AS {total}, count(*) AS {count}
          FROM ev WHERE event_type = '{kind}' GROUP BY 1, 2) r
    LEFT JOIN durations d ON r.fight_id = d.fight_id
    LEFT JOIN agents a ON r.fight_id = a.fight_id AND r.{key} = a.agent_id"""


@query("A5 J1", _target_sql("DAMAGE", "damage", "total_damage", "hit_count", "dps"))
def target_damage(c: Corpus) -> DataFrame:
    return rounded(rollups.target_damage(c.events(["DAMAGE"]), fight_seconds(c), c.agents()), "dps")


@query("A6", _target_sql("HEALING", "healing", "total_healing", "heal_count", "hps"))
def target_healing(c: Corpus) -> DataFrame:
    return rounded(rollups.target_healing(c.events(["HEALING"]), fight_seconds(c), c.agents()), "hps")


@query("A7", _target_sql("BUFF_REMOVAL", "buff_removal", "total_removed", "removal_count", "bps"))
def target_buff_removal(c: Corpus) -> DataFrame:
    return rounded(rollups.target_buff_removal(c.events(["BUFF_REMOVAL"]), fight_seconds(c), c.agents()), "bps")


_CONDI = """
    SELECT e.fight_id, e.seq, source_agent_id, target_agent_id, damage,
      CASE WHEN coalesce(TRY_CAST(CASE WHEN regexp_full_match(build_version, '[0-9]+') THEN build_version END AS BIGINT) >= 20240501, false)
           THEN least(damage, greatest(buff_dmg, 0))
           WHEN skill_name IN ('Bleeding', 'Burning', 'Confusion', 'Poisoned', 'Torment') THEN damage ELSE 0 END AS condi
    FROM ev e LEFT JOIN fights f ON e.fight_id = f.fight_id LEFT JOIN skills s ON e.skill_id = s.skill_id
    WHERE event_type = 'DAMAGE'"""


@query("C17", f"""
    SELECT fight_id, CAST(sum(condi) AS BIGINT) AS condi_total, CAST(sum(damage - condi) AS BIGINT) AS power_total
    FROM ({_CONDI}) h GROUP BY fight_id""")
def condition_power_split(c: Corpus) -> DataFrame:
    split = rollups.condition_split(c.events(["DAMAGE"]), c.fights(), c.skills())
    return split.groupBy("fight_id").agg(
        F.sum("condi").cast("bigint").alias("condi_total"), F.sum(F.col("damage") - F.col("condi")).cast("bigint").alias("power_total")
    )


@query("A8", f"""
    SELECT h.fight_id, h.source_agent_id, total_damage, hit_count, condi_damage, total_damage - condi_damage AS power_damage,
      round(CASE WHEN duration_s > 0 THEN total_damage / duration_s ELSE 0.0 END, 6) AS dps,
      round(CASE WHEN duration_s > 0 THEN (total_damage - condi_damage) / duration_s ELSE 0.0 END, 6) AS power_dps,
      round(CASE WHEN duration_s > 0 THEN condi_damage / duration_s ELSE 0.0 END, 6) AS condi_dps, name
    FROM (SELECT fight_id, source_agent_id, CAST(sum(damage) AS BIGINT) AS total_damage, count(*) AS hit_count,
                 CAST(sum(condi) AS BIGINT) AS condi_damage FROM ({_CONDI}) x GROUP BY 1, 2) h
    LEFT JOIN durations d ON h.fight_id = d.fight_id
    LEFT JOIN agents a ON h.fight_id = a.fight_id AND h.source_agent_id = a.agent_id""")
def player_damage(c: Corpus) -> DataFrame:
    split = rollups.condition_split(c.events(["DAMAGE"]), c.fights(), c.skills())
    rows = rollups.player_damage_split(split, fight_seconds(c), c.agents())
    return rounded(rows, "dps", "power_dps", "condi_dps")


@query("A9", """
    SELECT h.fight_id, h.source_agent_id, total_healing, heal_count, barrier_total, stun_breaks,
      round(CASE WHEN duration_s > 0 THEN total_healing / duration_s ELSE 0.0 END, 6) AS hps,
      round(CASE WHEN duration_s > 0 THEN barrier_total / duration_s ELSE 0.0 END, 6) AS barrier_ps, name
    FROM (SELECT fight_id, source_agent_id, CAST(coalesce(sum(healing), 0) AS BIGINT) AS total_healing,
                 greatest(count(healing), 1) AS heal_count, CAST(coalesce(sum(barrier), 0) AS BIGINT) AS barrier_total,
                 count(*) FILTER (event_type = 'STUN_BREAK') AS stun_breaks
          FROM ev WHERE event_type IN ('HEALING', 'STUN_BREAK') GROUP BY 1, 2) h
    LEFT JOIN durations d ON h.fight_id = d.fight_id
    LEFT JOIN agents a ON h.fight_id = a.fight_id AND h.source_agent_id = a.agent_id""")
def player_healing(c: Corpus) -> DataFrame:
    rows = rollups.player_healing(c.events(["HEALING", "STUN_BREAK"]), fight_seconds(c), c.agents(), F.col("barrier"))
    return rounded(rows, "hps", "barrier_ps")


@query("A10", """
    SELECT b.fight_id, agent_id, boons_out, boons_in, stability_out, alacrity_out, resistance_out, aegis_out,
      superspeed_out, stealth_out, strips_received_in,
      round(CASE WHEN duration_s > 0 THEN boons_out / duration_s ELSE 0.0 END, 6) AS boons_out_rate,
      round(CASE WHEN duration_s > 0 THEN boons_in / duration_s ELSE 0.0 END, 6) AS boons_in_rate
    FROM (SELECT fight_id, agent_id, count(*) FILTER (side = 'out') AS boons_out, count(*) FILTER (side = 'in') AS boons_in,
            count(*) FILTER (side = 'out' AND skill_id = 1122) AS stability_out,
            count(*) FILTER (side = 'out' AND skill_id = 30328) AS alacrity_out,
            count(*) FILTER (side = 'out' AND skill_id = 894) AS resistance_out,
            count(*) FILTER (side = 'out' AND skill_id = 743) AS aegis_out,
            count(*) FILTER (side = 'out' AND skill_id = 597) AS superspeed_out,
            count(*) FILTER (side = 'out' AND skill_id = 1305) AS stealth_out,
            count(*) FILTER (side = 'strip') AS strips_received_in
          FROM (SELECT fight_id, source_agent_id AS agent_id, skill_id, 'out' AS side FROM ev WHERE kind = 'apply'
                UNION ALL SELECT fight_id, target_agent_id, skill_id, 'in' FROM ev WHERE kind = 'apply'
                UNION ALL SELECT fight_id, target_agent_id, skill_id, 'strip' FROM ev
                          WHERE event_type = 'BUFF_REMOVAL' AND target_agent_id > 0) s GROUP BY 1, 2) b
    LEFT JOIN durations d ON b.fight_id = d.fight_id""")
def player_boons(c: Corpus) -> DataFrame:
    rows = rollups.player_boons(c.events(["BOON_APPLY", "BUFF_REMOVAL"]), fight_seconds(c))
    return rounded(rows, "boons_out_rate", "boons_in_rate")


@query("A10 M4", """
    SELECT fight_id, agent_id, string_agg(boon || '=' || n, ';' ORDER BY boon) AS other_boons_out
    FROM (SELECT fight_id, source_agent_id AS agent_id, coalesce(skill_name, 'Unknown (' || e.skill_id || ')') AS boon, count(*) AS n
          FROM ev e LEFT JOIN skills s ON e.skill_id = s.skill_id
          WHERE kind = 'apply' AND e.skill_id NOT IN (1122, 30328, 894, 743, 597, 1305) GROUP BY 1, 2, 3) x
    GROUP BY 1, 2""")
def other_boon_maps(c: Corpus) -> DataFrame:
    rows = rollups.other_boons(c.events(["BOON_APPLY"]), c.skills())
    entry = F.transform(
        F.map_entries("other_boons_out"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return rows.select("fight_id", "agent_id", F.array_join(F.sort_array(entry), ";").alias("other_boons_out"))


@query("A11 V10", """
    SELECT fight_id, CASE WHEN event_type IN ('DAMAGE', 'CC') THEN target_agent_id ELSE source_agent_id END AS agent_id,
      CAST(coalesce(sum(damage), 0) AS BIGINT) AS damage_taken, CAST(coalesce(sum(shield_damage), 0) AS BIGINT) AS barrier_absorbed,
      CAST(coalesce(sum(cc_value), 0) AS BIGINT) AS cc_taken,
      count(*) FILTER (event_type = 'DEATH') AS deaths, count(*) FILTER (event_type = 'DODGE') AS dodges,
      count(*) FILTER (event_type = 'BLOCK') AS blocks, count(*) FILTER (event_type = 'INTERRUPT') AS interrupts
    FROM ev WHERE event_type IN ('DAMAGE', 'CC', 'DEATH', 'DODGE', 'BLOCK', 'INTERRUPT') GROUP BY 1, 2""")
def player_defense(c: Corpus) -> DataFrame:
    kinds = ["DAMAGE", "CC", "DEATH", "DODGE", "BLOCK", "INTERRUPT"]
    return rollups.player_defense(c.events(kinds), F.col("shield_damage"))


_ACTIONS = """count(*) AS hit_count, CAST(coalesce(sum(damage), 0) AS BIGINT) AS total_damage,
      CAST(coalesce(sum(healing), 0) AS BIGINT) AS total_healing, CAST(coalesce(sum(buff_removal), 0) AS BIGINT) AS total_buff_removal"""
_ACTION_FILTER = "event_type IN ('DAMAGE', 'HEALING', 'BUFF_REMOVAL')"


@query("A12 V3", f"""
    SELECT s.*, round(CASE WHEN duration_s > 0 THEN total_damage / duration_s ELSE 0.0 END, 6) AS dps,
      round(CASE WHEN duration_s > 0 THEN total_healing / duration_s ELSE 0.0 END, 6) AS hps,
      round(CASE WHEN duration_s > 0 THEN total_buff_removal / duration_s ELSE 0.0 END, 6) AS bps
    FROM (SELECT e.fight_id, coalesce(subgroup, '') AS subgroup, {_ACTIONS} FROM ev e
          LEFT JOIN agents a ON e.fight_id = a.fight_id AND e.source_agent_id = a.agent_id
          WHERE {_ACTION_FILTER} GROUP BY 1, 2) s LEFT JOIN durations d ON s.fight_id = d.fight_id""")
def squad_rollup(c: Corpus) -> DataFrame:
    return rounded(rollups.squad_rollup(c.events(rollups.ACTION_KINDS), c.agents(), fight_seconds(c)), "dps", "hps", "bps")


@query("A13", f"""
    SELECT e.fight_id, e.skill_id, {_ACTIONS}, coalesce(any_value(skill_name), '') AS skill_name
    FROM ev e LEFT JOIN skills s ON e.skill_id = s.skill_id WHERE {_ACTION_FILTER} GROUP BY 1, 2""")
def skill_usage(c: Corpus) -> DataFrame:
    return rollups.skill_usage(c.events(rollups.ACTION_KINDS), c.skills())


@query("A14 J2", f"""
    SELECT e.fight_id, account_name, e.skill_id, {_ACTIONS}, coalesce(any_value(skill_name), '') AS skill_name
    FROM ev e JOIN players p ON e.fight_id = p.fight_id AND e.source_agent_id = p.agent_id
    LEFT JOIN skills s ON e.skill_id = s.skill_id WHERE {_ACTION_FILTER} GROUP BY 1, 2, 3""")
def player_skill_usage(c: Corpus) -> DataFrame:
    return rollups.player_skill_usage(c.events(rollups.ACTION_KINDS), c.players(), c.skills())


@query("A15 A16 A18 C15", """
    SELECT fight_id, source_agent_id AS agent_id,
      CAST(count(*) FILTER (buff_id IN (736, 737, 721, 722, 723, 727, 728, 730, 731, 732, 733, 734, 735, 742)) AS BIGINT) AS cleanses,
      CAST(count(*) FILTER (buff_id NOT IN (736, 737, 721, 722, 723, 727, 728, 730, 731, 732, 733, 734, 735, 742)) AS BIGINT) AS strips,
      count(*) FILTER (event_type = 'CC') AS cc,
      count(DISTINCT target_agent_id) FILTER (event_type = 'DAMAGE') AS cleave_targets,
      CAST(coalesce(sum(downtime_ms) FILTER (downtime_ms > 0), 0) AS BIGINT) AS downtime_ms
    FROM ev WHERE event_type IN ('BUFF_REMOVAL', 'CC', 'DAMAGE', 'DOWN') GROUP BY 1, 2""")
def combat_counters(c: Corpus) -> DataFrame:
    return rollups.combat_counters(c.events(["BUFF_REMOVAL", "CC", "DAMAGE", "DOWN"]))


@query("A17", """
    SELECT h.fight_id, h.agent_id, CAST(sum(n) AS BIGINT) AS kill_participation
    FROM (SELECT DISTINCT fight_id, target_agent_id AS victim, source_agent_id AS agent_id FROM ev WHERE event_type = 'DAMAGE') h
    JOIN (SELECT fight_id, source_agent_id AS victim, count(*) AS n FROM ev WHERE event_type = 'DEATH' GROUP BY 1, 2) d
      ON h.fight_id = d.fight_id AND h.victim = d.victim GROUP BY 1, 2""")
def kill_participation(c: Corpus) -> DataFrame:
    return rollups.kill_participation(c.events(["DAMAGE", "DEATH"]))


@query("A19", """
    SELECT s.fight_id, s.agent_id, count(DISTINCT bucket) AS active_buckets,
      round(least(100.0, count(DISTINCT bucket) / greatest(1, ceil(floor(any_value(duration_s) * 1000) / 5000)) * 100.0), 6) AS presence_pct
    FROM (SELECT fight_id, source_agent_id AS agent_id, time_ms // 5000 AS bucket FROM ev
          UNION ALL SELECT fight_id, target_agent_id, time_ms // 5000 FROM ev) s
    JOIN players p ON s.fight_id = p.fight_id AND s.agent_id = p.agent_id
    JOIN durations d ON s.fight_id = d.fight_id GROUP BY 1, 2""")
def presence(c: Corpus) -> DataFrame:
    return rounded(rollups.presence(c.events(), c.players(), fight_seconds(c)), "presence_pct")
