"""Shared SQL views the oracle statements build on (ANSI SQL over the driver tables)."""

from __future__ import annotations

import re

from frayline.sources.corpus import BUFF_CHOICES, ELITES, KIND_RULES, REMOVED_BUFFS, STATECHANGES


def _list(values: list) -> str:
    return "[" + ", ".join(str(v) for v in values) + "]"


_KIND = "CASE " + " ".join(
    f"WHEN stored_type = '{s}' AND k BETWEEN {lo} AND {hi} THEN '{n}'" for n, (s, lo, hi) in KIND_RULES.items()
) + " END"

_BUFFY = "event_type IN ('BOON_APPLY', 'BUFF_APPLY', 'BUFF_EXTENSION')"

def _little_endian(column: str) -> str:
    text = f"lpad(to_hex({column}), 16, '0')"
    return "(" + " || ".join(f"substring({text}, {i}, 2)" for i in range(15, 0, -2)) + ")"


LE_SRC, LE_DST = _little_endian("src"), _little_endian("dst")

VIEWS: dict[str, str] = {
    "ev0": f"""
        SELECT *, {_KIND} AS event_type FROM (
            SELECT strftime(ts, '%Y%m%d') AS fight_id, event_id AS seq,
                   (epoch_us(ts) - epoch_us(date_trunc('day', ts))) // 1000 AS time_ms, user_id,
                   CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
                   CAST(round(value * 100) AS BIGINT) AS m, event_type AS stored_type
            FROM events) AS b0""",
    "ev": f"""
        SELECT fight_id, seq, time_ms, event_type,
          CASE WHEN stored_type = 'view' AND k >= 40 THEN user_id % 4 WHEN stored_type = 'error' THEN user_id % 5
               ELSE user_id END AS source_agent_id,
          CASE WHEN stored_type = 'signup' THEN k % 3 WHEN stored_type = 'purchase' AND k < 50 THEN k % 5
               ELSE k % 50 END AS target_agent_id,
          CASE WHEN {_BUFFY} THEN ({_list(BUFF_CHOICES)})[m % 6 + 1]
               WHEN event_type = 'SKILL_ACTIVATION' THEN 100 + k % 4 ELSE k END AS skill_id,
          CASE WHEN event_type = 'DAMAGE' THEN m END AS damage,
          CASE WHEN event_type = 'DAMAGE' THEN CASE WHEN k % 3 = 0 THEN m // 2 ELSE 0 END END AS buff_dmg,
          CASE WHEN event_type = 'DAMAGE' THEN k % 13 END AS result,
          CASE WHEN event_type = 'DAMAGE' THEN k % 7 = 0 END AS is_condition,
          CASE WHEN event_type = 'DAMAGE' THEN m // 10 END AS shield_damage,
          CASE WHEN event_type = 'DAMAGE' THEN k % 13 IN (0, 1, 2, 8, 10) END AS connected,
          CASE WHEN event_type = 'DAMAGE' THEN k % 13 = 6 END AS absorbed,
          CASE WHEN event_type = 'DAMAGE' THEN k % 11 = 0 END AS against_downed,
          CASE WHEN event_type = 'DAMAGE' THEN k % 17 = 0 END AS is_life_leech,
          CASE WHEN event_type = 'HEALING' THEN m END AS healing,
          CASE WHEN event_type = 'HEALING' THEN k % 20 * 10 END AS barrier,
          CASE WHEN event_type = 'BUFF_REMOVAL' THEN 1 + m % 5 END AS buff_removal,
          CASE WHEN event_type = 'BUFF_REMOVAL' THEN ({_list(REMOVED_BUFFS)})[k % 6 + 1] END AS buff_id,
          CASE WHEN event_type = 'CC' THEN m END AS cc_value,
          CASE WHEN event_type = 'DEATH' AND k % 2 = 0 THEN m % 50 END AS killed_by_agent_id,
          CASE WHEN event_type = 'DOWN' THEN m * 10 END AS downtime_ms,
          CASE WHEN event_type = 'HEALTH_UPDATE' THEN (m * 37 % 10001) / 100.0::DOUBLE END AS health_percent,
          CASE WHEN event_type = 'COMBAT_OUTCOME' THEN CASE WHEN k % 2 = 0 THEN 'downed' ELSE 'killed' END END AS outcome,
          CASE WHEN event_type = 'POSITION' THEN CAST(m % 1000 AS DOUBLE) END AS x,
          CASE WHEN event_type = 'POSITION' THEN CAST(k * 10 AS DOUBLE) END AS y,
          CASE WHEN event_type = 'SKILL_ACTIVATION' THEN m % 5 + 1 END AS activation,
          CASE WHEN event_type = 'SKILL_ACTIVATION' THEN m * 1000 END AS expected_duration_ms,
          CASE WHEN event_type = 'WEAPON_SWAP' THEN k % 4 END AS swapped_from,
          CASE WHEN event_type = 'WEAPON_SWAP' THEN m % 4 END AS swapped_to,
          CASE WHEN event_type = 'EFFECT' THEN 'G' || (k % 5) END AS guid,
          CASE WHEN event_type = 'BOON_APPLY' THEN CASE m % 10 WHEN 7 THEN 'remove_single' WHEN 8 THEN 'remove_all'
               WHEN 9 THEN 'remove_manual' ELSE 'apply' END END AS kind,
          CASE WHEN event_type IN ('BOON_APPLY', 'BUFF_APPLY') THEN 1 + k % 3 END AS stacks,
          CASE WHEN {_BUFFY} THEN k % 7 END AS stack_id,
          CASE WHEN event_type IN ('BOON_APPLY', 'BUFF_APPLY') THEN (1 + m % 50) * 200000
               WHEN event_type = 'SKILL_ACTIVATION' THEN m % 500 + 1 END AS duration_ms,
          CASE WHEN event_type = 'BUFF_EXTENSION' THEN (1 + m % 50) * 200000 END AS extended_duration_ms,
          CASE WHEN event_type = 'BUFF_EXTENSION' THEN (1 + m % 50) * 200000 + k * 1000 END AS new_duration_ms
        FROM ev0""",
    "agents": f"""
        SELECT fight_id, agent_id, 'Agent ' || agent_id || CASE WHEN agent_id % 10 = 1 THEN ' [CMDR]' ELSE '' END AS name,
          agent_id % 3 < 2 AS is_player,
          CASE WHEN agent_id % 3 < 2 AND agent_id % 11 <> 10
               THEN CASE WHEN agent_id % 7 = 0 THEN ':' ELSE '' END || 'acct.' || (agent_id // 2) END AS account_name,
          CASE WHEN agent_id % 3 < 2
               THEN CASE WHEN agent_id % 2 = 0 THEN 'Subgroup ' ELSE '' END || (agent_id % 5) END AS subgroup,
          CAST(agent_id % 10 AS INTEGER) AS profession, ({_list(ELITES)})[agent_id % 10 + 1] AS elite,
          CAST(agent_id % 40 AS INTEGER) AS instance_id
        FROM (SELECT fight_id, source_agent_id AS agent_id FROM ev
              UNION SELECT fight_id, target_agent_id FROM ev) AS ids""",
    "players": """
        SELECT * REPLACE (ltrim(account_name, ':') AS account_name) FROM agents
        WHERE is_player AND account_name IS NOT NULL""",
    "skills": """
        SELECT p_partkey AS skill_id,
          CASE WHEN p_name LIKE 'red %' THEN 'Burning' WHEN p_name LIKE 'old %' THEN 'Bleeding' ELSE p_name END AS skill_name
        FROM part""",
    "fights": """
        SELECT strftime(day, '%Y%m%d') AS fight_id, day + to_hours(dayofmonth(day) % 24) AS started_at,
          CASE WHEN dayofmonth(day) % 2 = 0 THEN '20240301' WHEN dayofmonth(day) % 5 = 0 THEN 'dev'
               ELSE '20240701' END AS build_version
        FROM (SELECT DISTINCT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day FROM events) AS d""",
    # duration by stream order: first non-zero to last time of a hit or heal, else the latest time
    "durations": """
        SELECT fight_id, CASE WHEN last_ms > coalesce(first_ms, 0) THEN (last_ms - coalesce(first_ms, 0)) / 1000.0::DOUBLE
                              ELSE max_ms / 1000.0::DOUBLE END AS duration_s
        FROM (SELECT fight_id, max(time_ms) AS max_ms,
                min_by(time_ms, seq) FILTER (time_ms <> 0 AND (damage > 0 OR healing > 0)) AS first_ms,
                max_by(time_ms, seq) FILTER (damage > 0 OR healing > 0) AS last_ms
              FROM ev GROUP BY fight_id) AS bounds""",
    "raw": f"""
        SELECT fight_id, seq, build, time, src,
          CAST(CASE WHEN statechange = 19 THEN (1073741824 + k * 8192) * 4294967296 +
            CASE WHEN k % 17 = 0 THEN 2139095040 WHEN k % 19 = 0 THEN 1232348160 ELSE 1065353216 + (m % 1000) * 4096 END ELSE dst END AS BIGINT) AS dst,
          CAST(CASE WHEN statechange = 19 THEN 1092616192 WHEN m % 50 = 0 THEN 2147483647 WHEN m % 9 = 0 THEN -m WHEN m % 9 = 1 THEN 0 ELSE m END AS BIGINT) AS value,
          CASE k % 4 WHEN 0 THEN m // 3 WHEN 1 THEN -m ELSE 0 END AS buff_dmg,
          CASE WHEN build >= 20250000 THEN m // 5 ELSE 0 END AS overstack,
          CASE WHEN k % 20 = 7 THEN 718 ELSE k % 20 END AS skill,
          CASE WHEN build >= 20250000 THEN 1 + user_id % 7 ELSE 0 END AS src_inst,
          CASE WHEN build >= 20250000 AND dst <> 0 THEN 1 + k * 3 % 7 ELSE 0 END AS dst_inst,
          CASE WHEN build >= 20250000 AND k % 5 = 0 THEN 1 + (k + m) % 7 ELSE 0 END AS src_master,
          (k + m) % 3 AS iff, m % 2 AS buff, (k + m) % 16 AS result, CASE WHEN k % 10 = 9 THEN 1 + m % 6 ELSE 0 END AS activation,
          CASE WHEN k % 20 = 7 OR (m + k) % 7 = 0 THEN 1 + m % 3 ELSE 0 END AS buffremove, statechange,
          CASE WHEN build >= 20250000 THEN m % 3 ELSE 0 END AS shields,
          CASE WHEN build >= 20250000 THEN ([0, 128, 3, 0])[m % 4 + 1] ELSE 0 END AS offcycle,
          CASE WHEN build >= 20250000 THEN CASE WHEN statechange = 49 AND k % 2 = 0 THEN 2627419289 ELSE k % 9 END ELSE 0 END AS pad,
          CASE WHEN build >= 20250000 THEN 0 ELSE k % 2 END AS nondamage
        FROM (SELECT fight_id, seq, time_ms // 14400000 * 14400000 + 1 AS time, user_id, k, m, user_id % 12 AS src, CASE WHEN k % 20 = 7 AND m % 2 = 0 THEN 0 ELSE (k + seq) % 12 END AS dst,
                CASE WHEN d % 2 = 0 THEN 20240301 WHEN d % 4 = 1 THEN 20250315 ELSE 20260601 END AS build,
                ({_list(STATECHANGES)})[(seq * 31 + k * 7 + m) % 40 + 1] AS statechange
              FROM (SELECT *, CAST(substring(fight_id, 7, 2) AS INTEGER) AS d FROM ev0) AS r0) AS r1""",
    "folded": """
        SELECT * REPLACE (CASE WHEN build >= 20260507 AND statechange = 67 THEN 1 ELSE activation END AS activation,
          CASE WHEN build >= 20260507 AND statechange IN (67, 68, 69, 71, 72) THEN 0 ELSE statechange END AS statechange) FROM raw""",
    "mst": """
        SELECT fight_id, seq, agent AS master FROM (
          SELECT fight_id, seq, prio, last_value(agent IGNORE NULLS) OVER (PARTITION BY fight_id, inst ORDER BY seq, prio
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS agent
          FROM (SELECT fight_id, seq, src_inst AS inst, src AS agent, 0 AS prio FROM raw WHERE src_inst <> 0 AND src <> 0
                UNION ALL SELECT fight_id, seq, dst_inst, dst, 1 FROM raw WHERE dst_inst <> 0 AND dst <> 0
                UNION ALL SELECT fight_id, seq, src_master, NULL, 2 FROM raw WHERE src_master <> 0) AS u) AS v WHERE prio = 2""",
    "own": """
        SELECT r.fight_id, src, max_by(master, r.seq) AS owner FROM raw r JOIN mst ON r.fight_id = mst.fight_id AND r.seq = mst.seq
        WHERE master IS NOT NULL AND src <> 0 GROUP BY 1, 2""",
    "gd": f"""
        SELECT fight_id, skill, max_by({LE_SRC} || {LE_DST}, seq) AS guid FROM raw WHERE statechange = 46 GROUP BY 1, 2""",
    "dd": """
        SELECT i.fight_id, i.actor AS src, started AS time, max_by(CASE WHEN closed IS NOT NULL THEN closed - started ELSE greatest(0, coalesce(last_time, started) - started) END, island) AS downtime_ms
        FROM (SELECT fight_id, src AS actor, island, min_by(time, seq) FILTER (statechange = 5) AS started, max(time) FILTER (statechange <> 5) AS closed
              FROM (SELECT *, count(*) FILTER (statechange <> 5) OVER (PARTITION BY fight_id, src ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS island
                    FROM raw WHERE build >= 20250000 AND statechange IN (3, 4, 5)) AS l GROUP BY 1, 2, 3) AS i
        LEFT JOIN (SELECT fight_id, actor, max(time) AS last_time FROM (SELECT fight_id, time, src AS actor FROM raw WHERE build >= 20250000
                   UNION ALL SELECT fight_id, time, dst FROM raw WHERE build >= 20250000) AS a WHERE time > 0 AND actor <> 0 GROUP BY 1, 2) AS aw
          ON i.fight_id = aw.fight_id AND i.actor = aw.actor
        WHERE started IS NOT NULL GROUP BY 1, 2, 3""",
    "ctx": """
        SELECT f.*, mst.master, owner, guid, downtime_ms, coalesce(mst.master, f.src) AS actor,
          rm.fight_id IS NOT NULL AS cleared,
          CASE WHEN value >= 2147483647 THEN 0 ELSE greatest(value, 0) END AS size,
          CASE WHEN buff_dmg >= 2147483647 THEN 0 ELSE greatest(buff_dmg, 0) END AS strip, build >= 20250000 AS modern
        FROM folded f LEFT JOIN mst ON f.fight_id = mst.fight_id AND f.seq = mst.seq
        LEFT JOIN own ON f.fight_id = own.fight_id AND f.src = own.src
        LEFT JOIN gd ON f.fight_id = gd.fight_id AND f.skill = gd.skill
        LEFT JOIN dd ON f.fight_id = dd.fight_id AND f.src = dd.src AND f.time = dd.time
        LEFT JOIN (SELECT DISTINCT fight_id, time, src AS actor, skill FROM raw WHERE build >= 20250000 AND buffremove = 1) rm
          ON f.fight_id = rm.fight_id AND f.time = rm.time AND coalesce(mst.master, f.src) = rm.actor AND f.skill = rm.skill""",
}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with exactly the views it (transitively) names."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                visit(body)

    visit(sql)
    if not needed:
        return sql
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in VIEWS if name in needed]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
