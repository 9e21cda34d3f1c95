"""SQL twin of the stack rules: one recursion over the numbered events of every key, with the stack list as state."""

from __future__ import annotations

from frayline.functions import lookups as L


def _values(values) -> str:
    return "(" + ", ".join(str(v) for v in values) + ")"


TRACKED = _values(L.TRACKED_BOONS.values())
INTENSITY = _values(L.TRACKED_BOONS[n] for n in L.INTENSITY_BOONS)
NAMES = "CASE buff_id " + " ".join(f"WHEN {i} THEN '{n}'" for n, i in L.TRACKED_BOONS.items()) + " END"
_CAPACITY = "CASE buff_id " + " ".join(f"WHEN {L.TRACKED_BOONS[n]} THEN {c}" for n, c in L.BOON_CAPACITY.items()) + " ELSE 25 END"
ENDS = "ends AS (SELECT fight_id, max(time_ms) AS end_ms FROM ev GROUP BY 1)"

# the list with its element number p gone; unchanged where p is null
_WITHOUT = "CASE WHEN p IS NULL THEN a ELSE list_concat(a[1 : p - 1], a[p + 1 : len(a)]) END"
# the list with element p replaced by x
_REPLACED = "CASE WHEN p IS NULL THEN a ELSE list_concat(list_append(a[1 : p - 1], x), a[p + 1 : len(a)]) END"
# endless stacks of intensity boons stand first, the others by expiry, equal ones in order of arrival
_INSERTED = """list_concat(list_append(list_filter(a, lambda y: isinf(y.e) OR (NOT isinf(x.e) AND y.e <= x.e)), x),
      list_filter(a, lambda y: NOT isinf(y.e) AND (isinf(x.e) OR y.e > x.e)))"""


def stack_ctes(clears: bool = False) -> str:
    """CTEs up to ``sg``: (fight_id, agent_id, buff_id, intensity, t, until, s), s the stacks held from t to until."""
    cleared = f"""UNION ALL SELECT DISTINCT d.fight_id, d.source_agent_id, e.skill_id, d.seq, d.time_ms + {L.DESPAWN_GRACE_MS}, 'remove_all', 0, 1, -1, 0, 0
      FROM ev d JOIN ev e ON d.fight_id = e.fight_id AND d.source_agent_id = e.target_agent_id
      WHERE d.event_type = 'DESPAWN' AND e.event_type IN ('BOON_APPLY', 'BUFF_APPLY', 'BUFF_EXTENSION') AND e.skill_id IN {TRACKED}
        AND coalesce(e.kind, '') <> 'remove_manual' AND NOT (e.event_type = 'BUFF_EXTENSION' AND coalesce(e.extended_duration_ms, 0) < 1)""" if clears else ""
    return f"""{ENDS}, s0 AS (
      SELECT fight_id, target_agent_id AS agent_id, skill_id AS buff_id, seq, time_ms AS t,
        CASE event_type WHEN 'BUFF_EXTENSION' THEN 'extend' WHEN 'BUFF_APPLY' THEN 'snapshot' ELSE kind END AS action,
        coalesce(duration_ms, 0) AS dur, coalesce(stacks, 1) AS n, coalesce(stack_id, -1) AS sid,
        coalesce(extended_duration_ms, 0) AS ext, coalesce(new_duration_ms, 0) AS ren
      FROM ev WHERE event_type IN ('BOON_APPLY', 'BUFF_APPLY', 'BUFF_EXTENSION') AND skill_id IN {TRACKED} AND coalesce(kind, '') <> 'remove_manual'
        AND NOT (event_type = 'BUFF_EXTENSION' AND coalesce(extended_duration_ms, 0) < 1)
      {cleared}),
    s1 AS (SELECT * EXCLUDE (n), buff_id IN {INTENSITY} AS intensity, {_CAPACITY} AS cap,
        unnest(range(CASE WHEN action = 'snapshot' OR (action = 'apply' AND buff_id IN {INTENSITY}) THEN n ELSE 1 END)) AS copy FROM s0),
    se AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY fight_id, agent_id, buff_id ORDER BY t, seq, action, dur, copy) AS i FROM s1),
    st AS (
      SELECT fight_id, agent_id, buff_id, intensity, 0 AS i, 0::BIGINT AS t, []::STRUCT(e DOUBLE, id BIGINT)[] AS s FROM se WHERE i = 1
      UNION ALL
      SELECT fight_id, agent_id, buff_id, intensity, i, t,
        CASE action
          WHEN 'remove_all' THEN []::STRUCT(e DOUBLE, id BIGINT)[]
          WHEN 'remove_single' THEN {_WITHOUT}
          WHEN 'extend' THEN CASE WHEN len(a) = 0 THEN [x] WHEN intensity AND p IS NOT NULL
            THEN list_transform(list_sort(list_transform({_REPLACED}, lambda y, j: {{'endless': NOT isinf(y.e), 'e': y.e, 'j': j, 'id': y.id}})), lambda y: {{'e': y.e, 'id': y.id}}) ELSE {_REPLACED} END
          ELSE CASE WHEN intensity THEN {_INSERTED} WHEN p IS NULL THEN list_append(a, x) WHEN action = 'snapshot' THEN {_REPLACED} ELSE list_append({_WITHOUT}, x) END
        END AS s
      FROM (SELECT * REPLACE (CASE WHEN intensity AND action IN ('apply', 'snapshot') AND len(a) >= cap THEN a[2 : len(a)] ELSE a END AS a),
        CASE WHEN action IN ('apply', 'snapshot') AND NOT intensity AND len(a) >= cap
            THEN CASE WHEN len(a) > 1 THEN 1 + list_position(list_transform(a[2 : len(a)], lambda y: y.e), list_min(list_transform(a[2 : len(a)], lambda y: y.e))) ELSE 1 END
          WHEN action = 'remove_single' THEN coalesce(CASE WHEN sid >= 0 THEN nullif(list_position(list_transform(a, lambda y: y.id), sid), 0) END,
            nullif(list_position(list_transform(a, lambda y: abs(y.e - base - dur) < {L.REMOVAL_TOLERANCE_MS}), true), 0))
          WHEN action = 'extend' THEN coalesce(CASE WHEN NOT intensity AND sid >= 0 THEN nullif(list_position(list_transform(a, lambda y: y.id), sid), 0) END,
            nullif(list_position(near, list_min(near)), 0)) END AS p,
        CASE action WHEN 'extend' THEN CASE WHEN len(a) = 0 THEN {{'e': (base + ren)::DOUBLE, 'id': sid}} ELSE NULL END
          ELSE {{'e': CASE WHEN dur <= 0 AND (NOT intensity OR action = 'snapshot') THEN 'inf'::DOUBLE ELSE (base + greatest(dur, 0))::DOUBLE END, 'id': sid}} END AS x0
      FROM (SELECT *, list_transform(a, lambda y: CASE WHEN isinf(y.e) THEN NULL ELSE abs(y.e - base - (ren - ext)) END) AS near
      FROM (SELECT se.*, CASE WHEN se.intensity THEN se.t ELSE 0 END AS base, CASE WHEN se.t <= st.t THEN st.s
          WHEN se.intensity THEN list_filter(st.s, lambda y: y.e > se.t)
          ELSE list_transform(list_filter(list_transform(range(1, len(st.s) + 1), lambda j: {{'c': list_sum(list_transform(st.s[1 : j], lambda y: y.e)), 'e': st.s[j].e, 'id': st.s[j].id}}),
            lambda y: y.c > se.t - st.t), lambda y: {{'e': least(y.e, y.c - (se.t - st.t)), 'id': y.id}}) END AS a
        FROM st JOIN se ON se.fight_id = st.fight_id AND se.agent_id = st.agent_id AND se.buff_id = st.buff_id AND se.i = st.i + 1))
      ) AS step, LATERAL (SELECT CASE WHEN action = 'extend' AND len(a) > 0 AND p IS NOT NULL THEN {{'e': a[p].e + ext, 'id': a[p].id}} ELSE x0 END AS x) AS entry
    ),
    sg AS (SELECT st.* EXCLUDE (i), coalesce(lead(t) OVER (PARTITION BY st.fight_id, agent_id, buff_id ORDER BY i), end_ms) AS until FROM st JOIN ends ON st.fight_id = ends.fight_id)"""


def level_ctes() -> str:
    """CTEs from ``sg`` on to ``lv``: the longest stretches (start_ms, end_ms) of one positive level per key."""
    work, key = "t + coalesce(list_sum(list_transform(s, lambda y: y.e)), 0)", "fight_id, agent_id, buff_id"
    return f"""pc AS (SELECT *, unnest(list_sort(list_distinct(list_concat([t::DOUBLE, until::DOUBLE],
        list_filter(CASE WHEN intensity THEN list_transform(s, lambda y: y.e) ELSE [{work}] END, lambda e: e > t AND e < until))))) AS a FROM sg WHERE until > t),
      pd AS (SELECT *, lead(a) OVER (PARTITION BY {key}, t ORDER BY a) AS b FROM pc),
      pl AS (SELECT {key}, a, b, CASE WHEN intensity THEN len(list_filter(s, lambda y: y.e > a)) WHEN {work} > a THEN 1 ELSE 0 END AS n FROM pd WHERE b IS NOT NULL),
      pg AS (SELECT *, CASE WHEN lag(b) OVER w = a AND lag(n) OVER w = n THEN 0 ELSE 1 END AS opens FROM pl WHERE n > 0 WINDOW w AS (PARTITION BY {key} ORDER BY a)),
      ph AS (SELECT *, sum(opens) OVER (PARTITION BY {key} ORDER BY a) AS g FROM pg),
      lv AS (SELECT {key}, CAST(min(a) AS BIGINT) AS start_ms, CAST(max(b) AS BIGINT) AS end_ms, CAST(max(n) AS BIGINT) AS stacks FROM ph GROUP BY {key}, g)"""


def area(low: str = "0", high: str = "9e18") -> str:
    """Stack time of a row of ``sg`` inside [low, high)."""
    return f"""CASE WHEN intensity THEN coalesce(list_sum(list_transform(s, lambda y: greatest(0, least(y.e, until, {high}) - greatest(t, {low})))), 0)
      ELSE greatest(0, least(until, t + coalesce(list_sum(list_transform(s, lambda y: y.e)), 0), {high}) - greatest(t, {low})) END"""
