import math
import random

import pytest
from pyspark.sql import functions as F

from frayline.operators import downs, identity, positions, reconcile, rotation
from tests.rows import event_frame, hit, state


def seconds(spark, s=10.0):
    return spark.createDataFrame([("f1", s)], "fight_id STRING, duration_s DOUBLE")


def contribution(spark, events):
    rows = downs.down_contribution(event_frame(spark, events), seconds(spark), 50).collect()
    return {r.source_agent_id: r for r in rows}


def health(t, agent, pct):
    return state(t, "HEALTH_UPDATE", agent, health_percent=float(pct))


def test_window_opens_at_first_low_reading_after_the_last_high_one(spark):
    events = [health(0, 9, 100), health(100, 9, 80), health(150, 9, 95), health(200, 9, 85), hit(120, 1, 9, 5), hit(210, 1, 9, 7), state(300, "DOWN", 9), hit(300, 1, 9, 11)]
    assert contribution(spark, events)[1].down_contribution_damage == 7


def test_no_high_reading_counts_from_the_last_rally(spark):
    events = [health(5, 9, 50), hit(10, 1, 9, 5), state(20, "UP", 9), hit(20, 1, 9, 50), hit(21, 1, 9, 7), state(30, "DOWN", 9)]
    assert contribution(spark, events)[1].down_contribution_damage == 7


def test_instant_death_opens_no_window_unless_rallied_in_the_same_moment(spark):
    base = [health(0, 9, 50), hit(10, 1, 9, 5), state(20, "DOWN", 9), state(20, "DEATH", 9)]
    assert contribution(spark, base)[1].down_contribution_damage == 0
    assert contribution(spark, [*base, state(20, "UP", 9)])[1].down_contribution_damage == 5


def test_against_downed_needs_a_landed_hit_and_kills_come_from_both_sources(spark):
    events = [
        health(0, 9, 50), hit(10, 1, 9, 4, against_downed=True), hit(11, 1, 9, 0, against_downed=True, connected=False, result=3),
        state(20, "COMBAT_OUTCOME", 1, target_agent_id=9, outcome="killed"), state(21, "COMBAT_OUTCOME", 1, target_agent_id=9, outcome="downed"),
        state(22, "DEATH", 9, killed_by_agent_id=1),
    ]
    row = contribution(spark, events)[1]
    assert (row.against_downed_count, row.against_downed_damage, row.kills, row.downs) == (1, 4, 2, 1)


def test_legacy_same_tick_hit_resolves_before_the_down(spark):
    events = [hit(10, 1, 9, 3), state(10, "DOWN", 9), hit(11, 1, 9, 5), state(12, "UP", 9), hit(12, 1, 9, 7), hit(13, 1, 9, 9), hit(11, 1, 9, 100, skill=740)]
    rows = downs.legacy_down_contribution(event_frame(spark, events), seconds(spark), chunk_ms=5).collect()
    assert [(r.source_agent_id, r.down_contribution_damage) for r in rows] == [(1, 12)]


# -- casts ------------------------------------------------------------------------------
def act(t, agent, skill, code, duration=0, expected=0):
    return dict(event_type="SKILL_ACTIVATION", time_ms=t, source_agent_id=agent, skill_id=skill, activation=code, duration_ms=duration, expected_duration_ms=expected)


def cast_list(df):
    return sorted((r.skill_id, r.time_ms, r.duration_ms) for r in df.collect())


def test_cast_pairing(spark):
    ends = spark.createDataFrame([("f1", 1000)], "fight_id STRING, end_ms BIGINT")
    events = [
        act(0, 1, 10, 1, expected=500), act(100, 1, 10, 3),  # plain pair
        act(200, 1, 10, 1, expected=50), act(300, 1, 10, 2, expected=900), act(301, 1, 10, 4),  # restart, then a 1 ms cast
        act(500, 1, 11, 5, duration=40),  # lone end
        act(900, 1, 12, 1, duration=30, expected=700), act(900, 1, 13, 1, duration=30, expected=700),
    ]
    got = cast_list(rotation.paired_casts(event_frame(spark, events), ends, expected_when_open=[13], chunk_ms=60))
    assert got == [(10, 0, 100), (10, 200, 50), (11, 460, 40), (12, 900, 30), (13, 900, 100)]


def test_swaps_merge_to_the_later_and_duplicates_go(spark):
    ddl = "fight_id STRING, source_agent_id BIGINT, skill_id BIGINT, time_ms BIGINT, duration_ms BIGINT"
    casts = spark.createDataFrame([("f1", 1, -2, 10, 0), ("f1", 1, -2, 11, 0), ("f1", 1, -2, 20, 0), ("f1", 2, -2, 11, 0), ("f1", 1, 5, 7, 3), ("f1", 1, 5, 7, 3)], ddl)
    assert cast_list(rotation.final_casts(casts, 5)) == [(-2, 11, 0), (-2, 11, 0), (-2, 20, 0), (5, 7, 3)]


def test_cooldown_counts_dropped_triggers_too(spark):
    rows = [("f1", 1, 7, i, t, 50) for i, t in enumerate([0, 40, 80, 130, 200])]
    df = spark.createDataFrame(rows, "fight_id STRING, source_agent_id BIGINT, skill_id BIGINT, seq BIGINT, time_ms BIGINT, cooldown_ms INT")
    assert [r.time_ms for r in rotation.apply_cooldown(df, 60).orderBy("time_ms").collect()] == [0, 130, 200]


@pytest.mark.parametrize("chunk", [4, 25, 50, 10_000])
def test_anchor_groups_equal_a_plain_walk(spark, chunk):
    rng = random.Random(5)
    lines = {"f1": sorted(rng.randrange(-50, 400) for _ in range(120)), "f2": list(range(0, 300, 3)), None: [7, 8, 40]}  # dense, without any gap of 10
    df = spark.createDataFrame([(f, t, i) for f, times in lines.items() for i, t in enumerate(times)], "fight_id STRING, time_ms BIGINT, seq BIGINT")
    got = {(r.fight_id, r.seq): r.anchor_ms for r in rotation.anchor_groups(df, ["fight_id"], 10, chunk).collect()}
    for fight, times in lines.items():
        anchor = None
        for i, t in enumerate(times):
            anchor = t if anchor is None or t - anchor >= 10 else anchor
            assert got[fight, i] == anchor
    assert len(got) == sum(map(len, lines.values()))


@pytest.mark.parametrize("chunk", [25, 10_000])
def test_cast_match_equals_the_greedy_walk(spark, chunk):
    rng = random.Random(6)
    make = lambda n: sorted((rng.randrange(120), rng.choice([0, 5, 6])) for _ in range(n))
    want, have = make(60), make(60)
    ddl = "fight_id STRING, skill_id BIGINT, time_ms BIGINT, duration_ms BIGINT"
    frame = lambda rows: spark.createDataFrame([("f1", 1, t, d) for t, d in rows], ddl)
    got = {}
    for r in reconcile.match_casts(frame(want), frame(have), ["fight_id"], chunk_ms=chunk).collect():
        got[r.verdict] = got.get(r.verdict, 0) + r.n
    left, counts = list(have), {"MATCHED": 0, "MISSING": 0, "EXTRA": 0}
    for t, d in want:
        found = next((o for o in left if (o[1] == d and abs(o[0] - t) <= 2) or (o[0] == t and 0 in (o[1], d))), None)
        counts["MISSING" if found is None else "MATCHED"] += 1
        if found:
            left.remove(found)
    counts["EXTRA"] = len(left)
    assert {k: got.get(k, 0) for k in counts} == counts


# -- positions and identity ---------------------------------------------------------------
def samples(spark, rows):
    return spark.createDataFrame([("f1", *r) for r in rows], "fight_id STRING, agent_id BIGINT, time_ms BIGINT, x DOUBLE, y DOUBLE")


def test_two_players_ten_apart_and_a_lone_one(spark):
    rows = {r.agent_id: r for r in positions.spacing(samples(spark, [(1, 0, 0.0, 0.0), (2, 0, 10.0, 0.0)]), 100, 100).collect()}
    assert (rows[1].stack_dist, rows[1].dist_to_com) == (10.0, 5.0) == (rows[2].stack_dist, rows[2].dist_to_com)
    alone = positions.spacing(samples(spark, [(1, 0, 0.0, 0.0), (1, 900, 4.0, 0.0)]), 100, 100).collect()
    assert [(r.stack_dist, r.dist_to_com) for r in alone] == [(None, None)]


def test_samples_of_one_step_collapse_to_the_last(spark):
    df = samples(spark, [(1, t, float(t), 0.0) for t in (0, 200, 499, 500, 1200)]).selectExpr("*", "time_ms AS seq")
    assert [r.time_ms for r in positions.downsample(df).orderBy("time_ms").collect()] == [499, 500, 1200]
    kept = [r.time_ms // 500 for r in positions.downsample(samples(spark, [(1, 500 * i, 0.0, 0.0) for i in range(37)]).selectExpr("*", "time_ms AS seq"), limit=10).collect()]
    assert sorted(kept) == [37 * i // 10 for i in range(10)]


def test_commander_distance_uses_shared_times_only(spark):
    leads = spark.createDataFrame([("f1", 1)], "fight_id STRING, agent_id BIGINT")
    rows = positions.commander_distance(samples(spark, [(1, 0, 0.0, 0.0), (2, 0, 3.0, 4.0), (2, 700, 50.0, 0.0), (3, 900, 1.0, 1.0)]), leads).collect()
    assert {r.agent_id: r.commander_dist for r in rows} == {1: 0.0, 2: 5.0}


def test_active_duration_rules(spark):
    ddl = "fight_id STRING, agent_id BIGINT, instance_id INT, "
    slices = spark.createDataFrame([("f1", 1, 5, 0, 100), ("f1", 3, 6, 0, 100), ("f1", 4, 0, 0, 100)], ddl + "lo_ms BIGINT, hi_ms BIGINT")
    spans = spark.createDataFrame([("f1", 1, 5, 0, 40), ("f1", 2, 5, 100, 200), ("f1", 3, 6, 0, 500), ("f1", 4, 0, 0, 9)], ddl + "first_ms BIGINT, last_ms BIGINT")
    fights = spark.createDataFrame([("f1", 2000)], "fight_id STRING, duration_ms BIGINT")
    got = {r.agent_id: r.active_ms for r in identity.active_durations(slices, spans, fights, 30).collect()}
    assert got == {1: 100, 3: 510, 4: None}


@pytest.mark.parametrize("block", [2, 3, 512])
def test_spacing_in_blocks_equals_the_filled_positions(spark, block):
    rng = random.Random(block)
    rows = [(a, rng.randrange(0, 900), float(rng.randrange(50)), float(rng.randrange(50))) for a in range(7) for _ in range(a + 1)]
    df = samples(spark, list({(a, t): (a, t, x, y) for a, t, x, y in rows}.values()))
    filled = {}
    for r in positions.forward_filled(df, 100, 100).collect():
        filled.setdefault(r.time_ms, {})[r.agent_id] = (r.x, r.y)
    total = {}
    for place in filled.values():
        if len(place) > 1:
            cx, cy = (sum(p[i] for p in place.values()) / len(place) for i in (0, 1))
            for a, (x, y) in place.items():
                others = sum(math.hypot(x - u, y - v) for u, v in place.values()) / (len(place) - 1)
                total.setdefault(a, []).append((math.hypot(x - cx, y - cy), others))
    for r in positions.spacing(df, 100, 100, block).collect():
        own = total[r.agent_id]
        assert r.dist_to_com == pytest.approx(sum(c for c, _ in own) / len(own)) and r.stack_dist == pytest.approx(sum(o for _, o in own) / len(own))


def test_spacing_of_a_crowd_uses_many_tasks(spark):
    crowd = spark.range(1200).selectExpr("'f1' AS fight_id", "9007199254740993L + id AS agent_id", "0L AS time_ms", "cast(id % 40 AS double) AS x", "0.0D AS y")  # ids beyond doubles
    rows = positions.spacing(crowd, 100, 100, 300).agg(F.count("stack_dist"), F.avg("dist_to_com")).first()
    assert rows[0] == 1200 and rows[1] == pytest.approx(10.0)
