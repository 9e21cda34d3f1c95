"""Rows that only larger tables hold: ties within a millisecond, wide keys, crowded groups."""

from pyspark.sql import functions as F

from frayline.functions import names
from frayline.operators import downs, identity, ops, rotation
from tests.rows import event_frame, state


def test_size_labels_round_ties_to_even(spark):
    sizes = [(1280, "1.2 KiB"), (1331, "1.3 KiB"), (1792, "1.8 KiB"), (1024, "1.0 KiB"), (1_310_720, "1.2 MiB"), (1_835_008, "1.8 MiB"), (1023, "1023 B")]
    df = spark.createDataFrame(sizes, "size BIGINT, want STRING")
    assert df.filter(names.byte_size(F.col("size")) != F.col("want")).collect() == []


def test_fights_of_an_upload_are_ordered_by_a_struct(spark):
    # as one number, 1 * 10**10 + 200,000 * 10**5 would come after 2 * 10**10 + 1 * 10**5
    rows = [(7, 1, 200_000, "first"), (7, 2, 1, "second"), (8, None, None, None)]
    df = spark.createDataFrame(rows, "upload_id BIGINT, line INT, part BIGINT, fight_id STRING").selectExpr(
        "upload_id", "cast(NULL AS string) AS error_class", "cast(NULL AS string) AS error_text",
        "if(line IS NULL, NULL, struct(line, part)) AS fight_no", "fight_id", "true AS has_header", "false AS collides",
    )
    got = {r.upload_id: (r.fight_id, r.ignored_fights, r.error_message) for r in ops.parse_outcomes(df, "v1").collect()}
    assert got == {7: ("first", 1, None), 8: (None, 0, "parser yielded no fights")}


def _swap(t, seq, to):
    return state(t, "WEAPON_SWAP", 1, seq=seq, swapped_to=to, swapped_from=0)


def _act(t, seq, skill, activation=1):
    return state(t, "SKILL_ACTIVATION", 1, seq=seq, skill_id=skill, activation=activation, duration_ms=5)


def test_swaps_close_together_all_equip_the_kit(spark):
    events = event_frame(spark, [
        # two swaps of one millisecond, one four later: 112 lies in the stretches of 100 and of nothing later
        _swap(100, 1, 2), _swap(100, 2, 2), _swap(104, 3, 2), _act(112, 4, 101),
        # the swap at 1,010 does not close the stretch of 1,000, the one at 1,011 would
        _swap(1000, 5, 2), _swap(1010, 6, 0), _act(1030, 7, 102),
        _swap(2000, 8, 2), _swap(2011, 9, 0), _act(2030, 10, 102),
        # a start counts before an end, whatever the order of the kits
        _swap(3000, 11, 2), _act(3020, 12, 101, 5), _act(3030, 13, 102),
        _swap(4000, 14, 2), _act(4009, 15, 101), _act(4010, 16, 102),
    ])
    bundles = spark.createDataFrame([(1, 901, 101), (2, 902, 102)], "kit_order INT, kit_skill_id BIGINT, skill_id BIGINT")
    for chunk in (100, 1_000_000):
        got = {(r.seq, r.skill_id, r.time_ms) for r in rotation.kit_casts(events, bundles, chunk_ms=chunk).collect()}
        assert got == {(1, 901, 99), (2, 901, 99), (5, 902, 999), (11, 902, 2999), (14, 902, 3999)}


def test_readings_of_the_millisecond_of_a_high_one_open_no_window(spark):
    health = lambda t, percent: state(t, "HEALTH_UPDATE", 1, health_percent=percent)
    events = event_frame(spark, [
        health(100, 95.0), health(100, 50.0), health(300, 40.0), state(400, "DOWN", 1), state(500, "UP", 1),
        health(600, 95.0), health(600, 50.0), state(700, "DOWN", 1), state(800, "UP", 1),  # low at once only: no window
        health(900, 95.0), health(950, 20.0), health(950, 90.0), state(990, "DOWN", 1),
        state(1000, "UP", 1), state(1001, "DOWN", 1),  # down again at once: an empty window, still a row
    ])
    for chunk in (50, 1_000_000):
        got = sorted((r.start_ms, r.end_ms) for r in downs.pre_down_windows(events, chunk).collect())
        assert got == [(300, 400), (950, 990), (1001, 1001)]


def _joined_rows(node):
    """The most rows that a join of an executed plan has put out."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _joined_rows(node.executedPlan())
    if name.endswith("QueryStageExec"):
        return _joined_rows(node.plan())
    own = node.metrics().apply("numOutputRows").value() if "Join" in name else 0
    return max([own, *[_joined_rows(node.children().apply(i)) for i in range(node.children().size())]])


def _matched(entries, agents, spans, prefix="Non Squad Player"):
    """Every pair of entry and agent, plainly."""
    out = {}
    for entry, account, name, instance, lo, hi in entries:
        mid = None if lo is None else (lo + hi) // 2
        ranked = []
        for agent, a_name, a_account, a_instance in agents:
            first, last = spans.get(agent, (None, None))
            here = mid is not None and first is not None and first <= mid <= last
            if a_account == account:
                rank = (1 if a_name == name else 3) if here else (6 if a_name == name else 8)
                ranked.append((rank, -agent if rank == 8 else agent, agent))
            if a_instance == instance:
                nameless = account.startswith(prefix) and a_account is None
                rank = (0 if nameless else 4) if here else (5 if nameless else 9)
                ranked.append((rank, -agent if rank == 9 else agent, agent))
        if ranked:
            out[entry] = (min(ranked)[2], min(ranked)[0])
    return out


def test_a_shared_instance_gives_each_entry_its_best_agent_without_pairs(spark):
    import random

    rng = random.Random(7)
    agents = [(i, f"n{rng.randrange(6)}", rng.choice([None, f"a{rng.randrange(8)}"]), rng.randrange(4)) for i in range(40)]
    spans = {i: (t, t + rng.randrange(60)) for i in range(0, 40, 2) for t in [rng.randrange(80)]}
    entries = [(i, rng.choice([f"Non Squad Player {i}", f"a{rng.randrange(10)}"]), f"n{rng.randrange(6)}", rng.randrange(5), *rng.choice([(0, 40), (10, 90), (80, 120), (None, None)])) for i in range(60)]
    e = spark.createDataFrame([("f", *r[:3], "other", *r[3:]) for r in entries], "fight_id STRING, entry_id BIGINT, account STRING, name STRING, profession_label STRING, instance_id INT, lo_ms BIGINT, hi_ms BIGINT")
    a = spark.createDataFrame([("f", *r[:3], r[3], 0, 0) for r in agents], "fight_id STRING, agent_id BIGINT, name STRING, account_name STRING, instance_id INT, profession INT, elite INT")
    s = spark.createDataFrame([("f", k, *v) for k, v in spans.items()], "fight_id STRING, agent_id BIGINT, first_ms BIGINT, last_ms BIGINT")
    found = identity.match_entities(e, a, s)
    assert {r.entry_id: (r.agent_id, r["rank"]) for r in found.collect()} == _matched(entries, agents, spans)
    # a crowd on one instance: no join yields the pairs
    crowd = 600
    ids = spark.range(crowd).selectExpr("'f' AS fight_id", "id", "concat('x', id) AS text", "1 AS instance_id")
    found = identity.match_entities(
        ids.selectExpr("fight_id", "id AS entry_id", "text AS account", "text AS name", "text AS profession_label", "instance_id", "0L AS lo_ms", "40L AS hi_ms"),
        ids.selectExpr("fight_id", "id AS agent_id", "text AS name", "cast(NULL AS string) AS account_name", "instance_id", "0 AS profession", "0 AS elite"), s,
    )
    assert len(found.collect()) == crowd
    assert 0 < _joined_rows(found._jdf.queryExecution().executedPlan()) <= crowd
