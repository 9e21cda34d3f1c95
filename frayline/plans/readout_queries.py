"""Per-player readout and what is computed from it. Its SQL twin composes the twins of the metric sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frayline.functions import lookups as L
from frayline.operators import buffs, profiles, rollups, summaries
from frayline.operators import readout as fused
from frayline.plans import buff_queries, rollup_queries, sequence_queries, service_queries  # noqa: F401  (registers the metric sets)
from frayline.plans.registry import QUERIES, query
from frayline.plans.rollup_queries import fight_seconds, rounded
from frayline.sources.corpus import Corpus


def readout(c: Corpus) -> DataFrame:
    return fused.readout(c.events(), c.players().drop("is_player"), fight_seconds(c), c.fights(), c.skills())


def _twin(name: str) -> str:
    return f"({QUERIES[name].sql})"


_SETS = {"dmg": "player_damage", "hl": "player_healing", "bo": "player_boons", "df": "player_defense", "cn": "combat_counters", "kp": "kill_participation", "pz": "presence", "og": "outgoing_boons"}
_ID = {"dmg": "source_agent_id", "hl": "source_agent_id"}
_FROM = {
    "dmg": ["total_damage", "hit_count", "condi_damage", "power_damage", "dps"], "hl": ["total_healing", "hps", "barrier_total", "stun_breaks"],
    "bo": ["boons_out", "boons_in", "strips_received_in"], "df": ["damage_taken", "barrier_absorbed", "cc_taken", "deaths", "dodges", "blocks", "interrupts"],
    "cn": ["cleanses", "strips", "cc", "cleave_targets", "downtime_ms"], "kp": ["kill_participation"], "pz": ["presence_pct"],
}
_MEMBERS = " UNION ".join(f"SELECT fight_id, {_ID.get(a, 'agent_id')} AS agent_id FROM {a}" for a in ("dmg", "hl", "bo", "df", "kp")) + " UNION SELECT fight_id, agent_id FROM cn WHERE cleanses + strips + cc > 0"
_VALUES = ", ".join(f"coalesce({a}.{col}, 0) AS {col}" for a, cols in _FROM.items() for col in cols)
_JOINS = " ".join(f"LEFT JOIN {a} ON mb.fight_id = {a}.fight_id AND mb.agent_id = {a}.{_ID.get(a, 'agent_id')}" for a in _FROM)
_SCORE = "CASE boon " + " ".join(f"WHEN '{b}' THEN {w}" for b, w in L.BOON_WEIGHTS.items()) + " ELSE 0 END"
_READOUT = f"""WITH {", ".join(f"{a} AS MATERIALIZED {_twin(q)}" for a, q in _SETS.items())}, mb AS ({_MEMBERS}),
    sc AS MATERIALIZED (SELECT fight_id, agent_id, sum(outgoing * {_SCORE}) AS boon_score FROM og GROUP BY 1, 2),
    rd AS MATERIALIZED (SELECT mb.fight_id, mb.agent_id, p.name, account_name, subgroup, profession, elite, instance_id, {_VALUES}, boon_score
      FROM mb JOIN players p ON mb.fight_id = p.fight_id AND mb.agent_id = p.agent_id {_JOINS}
      LEFT JOIN sc ON mb.fight_id = sc.fight_id AND mb.agent_id = sc.agent_id),
    src AS (SELECT * RENAME (strips AS total_buff_removal), NULL::BIGINT AS power FROM rd), {service_queries._ROLE},
    lb AS (SELECT *, list_filter([CASE role WHEN 'HEAL' THEN 'Heal' WHEN 'BOON' THEN 'Support' WHEN 'STRIP' THEN 'Strip' WHEN 'DPS' THEN 'DPS' END,
      CASE WHEN cleanses > 10 THEN 'Cleanser' END, CASE WHEN cc > 3 THEN 'CC' END], lambda x: x IS NOT NULL) AS ls FROM r7),
    ro AS MATERIALIZED (SELECT *, CASE WHEN len(ls) > 0 THEN ls ELSE ['DPS'] END AS role_list FROM lb)"""


@query("A20 J6 U4 R7", _READOUT + """
    SELECT fight_id, agent_id, name, account_name, subgroup, profession, elite, instance_id, total_damage, hit_count, condi_damage, power_damage, dps, total_healing, hps,
      barrier_total, stun_breaks, boons_out, boons_in, strips_received_in, damage_taken, barrier_absorbed, cc_taken, deaths, dodges, blocks, interrupts, cleanses,
      total_buff_removal AS strips, cc, cleave_targets, downtime_ms, kill_participation, presence_pct, role AS detected_role, array_to_string(tags, ',') AS detected_tags,
      array_to_string(role_list, ',') AS roles FROM ro""")
def combat_readout(c: Corpus) -> DataFrame:
    rows = rounded(readout(c), "dps", "hps", "presence_pct").drop(*[f"outgoing_{b}" for b in L.TRACKED_BOONS], *_RATES, *_BOONS_OUT)
    return rows.withColumns({"roles": F.array_join("roles", ","), "detected_tags": F.array_join("detected_tags", ",")})


_RATES = ["power_dps", "condi_dps", "barrier_ps", "boons_out_rate", "boons_in_rate"]
_BOONS_OUT = [f"{b}_out" for b in L.READOUT_BOONS]
_DOWN = ["down_contribution_dps", "downs", "kills"]
_UPTIMES = [f"{b}_uptime" for b in L.TRACKED_BOONS]
_GIVEN = [f"outgoing_{b}" for b in L.TRACKED_BOONS]


def _pivot(source: str, value: str, columns: dict[str, str]) -> str:
    cells = ", ".join(f"max({value}) FILTER (boon = '{b}') AS {c}" for c, b in columns.items())
    return f"SELECT fight_id, agent_id, {cells} FROM {source} GROUP BY 1, 2"


@query("A20 J6", f"""{_READOUT.replace('WITH ', 'WITH RECURSIVE ', 1)}, dc AS MATERIALIZED {_twin("down_contribution")}, bu AS MATERIALIZED {_twin("boon_uptimes")},
    cd AS MATERIALIZED {_twin("commander_distances")}, ob AS MATERIALIZED {_twin("other_boon_maps")},
    uw AS ({_pivot("bu", "uptime", dict(zip(_UPTIMES, L.TRACKED_BOONS)))}), gw AS ({_pivot("og", "outgoing", dict(zip(_GIVEN, L.TRACKED_BOONS)))})
    SELECT ro.fight_id, ro.agent_id, ro.total_damage, {", ".join(f"coalesce(dmg.{c}, 0) AS {c}" for c in _RATES[:2])}, coalesce(hl.barrier_ps, 0) AS barrier_ps,
      {", ".join(f"coalesce(bo.{c}, 0) AS {c}" for c in _RATES[3:] + _BOONS_OUT)}, {", ".join(f"coalesce(dc.{c}, 0) AS {c}" for c in _DOWN)},
      {", ".join(_UPTIMES)}, {", ".join(f"coalesce({c}, 0) AS {c}" for c in _GIVEN)}, commander_dist, other_boons_out
    FROM ro LEFT JOIN dmg ON dmg.fight_id = ro.fight_id AND dmg.source_agent_id = ro.agent_id LEFT JOIN hl ON hl.fight_id = ro.fight_id AND hl.source_agent_id = ro.agent_id
    LEFT JOIN bo ON bo.fight_id = ro.fight_id AND bo.agent_id = ro.agent_id LEFT JOIN dc ON dc.fight_id = ro.fight_id AND dc.source_agent_id = ro.agent_id
    LEFT JOIN uw ON uw.fight_id = ro.fight_id AND uw.agent_id = ro.agent_id LEFT JOIN gw ON gw.fight_id = ro.fight_id AND gw.agent_id = ro.agent_id
    LEFT JOIN cd ON cd.fight_id = ro.fight_id AND cd.agent_id = ro.agent_id LEFT JOIN ob ON ob.fight_id = ro.fight_id AND ob.agent_id = ro.agent_id""")
def full_readout(c: Corpus) -> DataFrame:
    """The readout's further columns: rates, boon columns, down contribution, uptimes, outgoing boons, commander distance."""
    run = lambda name: QUERIES[name].build(c)
    parts = [run("down_contribution").withColumnRenamed("source_agent_id", "agent_id").select("fight_id", "agent_id", *_DOWN), run("commander_distances"), run("other_boon_maps")]
    rows = rounded(readout(c), *_RATES).select("fight_id", "agent_id", "total_damage", *_RATES, *_BOONS_OUT, *_GIVEN)
    rows = rounded(buffs.with_uptimes(rows, buff_queries.segments(c), buff_queries.fight_ends(c)), *_UPTIMES)
    return summaries.readout_details(rows, parts, _DOWN)


@query("A25", _READOUT + """
    SELECT fight_id, round(sum(dps), 3) AS dps, round(sum(hps), 3) AS hps, CAST(sum(total_buff_removal) AS BIGINT) AS strips, CAST(sum(cleanses) AS BIGINT) AS cleanses, CAST(sum(cc) AS BIGINT) AS cc,
      count(*) FILTER (list_contains(role_list, 'Heal')) AS healers, count(*) FILTER (list_contains(role_list, 'Support')) AS supports FROM ro GROUP BY 1""")
def squad_totals(c: Corpus) -> DataFrame:
    return rounded(rollups.squad_totals(rounded(readout(c), "dps", "hps")), "dps", "hps", places=3)


@query("T10", _READOUT + """
    SELECT fight_id, role, count(*) AS players FROM (SELECT fight_id, unnest(role_list) AS role FROM ro) x GROUP BY 1, 2""")
def readout_role_counts(c: Corpus) -> DataFrame:
    return profiles.role_counts(readout(c))


_WIDE = ", ".join(f"max(uptime) FILTER (boon_name = '{b}') AS {b}_uptime, max(outgoing) FILTER (boon_name = '{b}') AS outgoing_{b}" for b in L.TRACKED_BOONS)
_COLUMNS = ", ".join(f"{b}_uptime, outgoing_{b}" for b in L.TRACKED_BOONS)


@query("A22 A23 N7", f"""
    WITH RECURSIVE {buff_queries._ACCOUNT_BOONS}, sb AS MATERIALIZED {_twin("summary_buckets")}, wb AS MATERIALIZED (SELECT fight_id, account_name, {_WIDE} FROM ab GROUP BY 1, 2),
    sq AS (SELECT fight_id, sum(total_healing) AS squad FROM sb GROUP BY 1), sp AS (SELECT fight_id, (max(time_ms) - min(time_ms)) / 1000.0::DOUBLE AS seconds FROM ev GROUP BY 1),
    src AS MATERIALIZED (SELECT sb.*, wb.* EXCLUDE (fight_id, account_name), power_damage AS power, squad, seconds,
        {" + ".join(f"coalesce(outgoing_{b}, 0) * {w}" for b, w in L.BOON_WEIGHTS.items())} AS boon_score,
        {" + ".join(f"coalesce(outgoing_{b}, 0)" for b in L.TRACKED_BOONS)} AS given
      FROM sb LEFT JOIN wb ON sb.fight_id = wb.fight_id AND sb.account_name = wb.account_name JOIN sq ON sq.fight_id = sb.fight_id LEFT JOIN sp ON sp.fight_id = sb.fight_id), {service_queries._ROLE},
    ls AS (SELECT *, list_filter([CASE WHEN squad > 0 AND total_healing / squad > 0.10 THEN 'Heal' END, CASE WHEN given / greatest(coalesce(seconds, 0), 1.0) > 1.0 THEN 'Support' END,
      CASE WHEN boon_strips > 5 THEN 'Strip' END, CASE WHEN condition_cleanses > 10 THEN 'Cleanser' END, CASE WHEN cc_applied > 3 THEN 'CC' END], lambda x: x IS NOT NULL) AS additive FROM r7)
    SELECT fight_id, account_name, name, profession, elite, total_damage, condi_damage, power_damage, total_healing, total_buff_removal, boon_strips, condition_cleanses, cc_applied,
      {_COLUMNS}, role AS detected_role, array_to_string(tags, ',') AS detected_tags, array_to_string(CASE WHEN len(additive) > 0 THEN additive ELSE ['DPS'] END, ',') AS roles FROM ls""")
def fight_player_summaries(c: Corpus) -> DataFrame:
    rows = rounded(buff_queries.summary_rows(c), *[f"{b}_uptime" for b in L.TRACKED_BOONS])
    return rows.withColumns({"roles": F.array_join("roles", ","), "detected_tags": F.array_join("detected_tags", ",")})
