"""Queries whose cost grew faster than their input."""

import random

from pyspark.sql import functions as F

from frayline.operators import reconcile, scan
from frayline.streaming import partials
from tests.rows import event_frame, hit


def _join_rows(df):
    """Rows that come out of each join of the plan that ran."""
    df.collect()
    rows, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if "Join" in node.nodeName():
            rows.append(node.metrics().apply("numOutputRows").value())
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        else:
            todo.extend(node.children().apply(i) for i in range(node.children().size()))
    return rows


def test_casts_meet_event_keys_not_events(spark):
    rng = random.Random(12)
    casts = [("f", rng.randrange(0, 4000)) for _ in range(300)] + [(None, 5), ("f", None), ("g", 100), ("g", 100), ("g", 400)]
    events = [("f", rng.randrange(0, 4000), rng.choice("abc")) for _ in range(3000)]
    # both edges of the radius, one beyond each, a null event key, times that are null
    events += [("f", 3990, "rare"), ("g", 70, "low"), ("g", 130, "high"), ("g", 69, "far"), ("g", 131, "far"), ("g", 110, None), ("g", None, "low"), (None, 5, "a")]
    c = spark.createDataFrame(casts, "fight_id STRING, cast_ms BIGINT")
    e = spark.createDataFrame(events, "fight_id STRING, time_ms BIGINT, event_key STRING")
    counts = {}
    for f, t in casts:
        counts[f, t] = counts.get((f, t), 0) + 1
    want = {(f, t, k, counts[f, t]) for f, t in counts if f and t is not None for g, s, k in events if f == g and s is not None and abs(t - s) <= 30}
    found = reconcile.coincidences(c, e, ["fight_id"], 30)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert max(_join_rows(found)) <= len(counts) * 4  # four event keys near any cast at most; 11,641 rows before

    covers, fires = {}, {}
    for _, _, k, n in want:
        covers[k] = covers.get(k, 0) + n
    for _, _, k in events:
        fires[k] = fires.get(k, 0) + 1
    chosen = reconcile.trigger_candidates(c, e, ["fight_id"], 30, 0.5).collect()
    assert {(r.event_key, r.covers, r.fires, r.casts) for r in chosen} == {(k, n, fires[k], len(casts)) for k, n in covers.items() if k and n >= len(casts) * 0.5}


def test_next_values_and_swaps_of_a_crowded_chunk(spark):
    rng = random.Random(13)
    rows = spark.createDataFrame([(None if i % 9 == 0 else "k", rng.randrange(90), i, rng.choice([None, i])) for i in range(400)], "k STRING, time_ms BIGINT, seq BIGINT, v BIGINT")
    for chunk in (None, 30):
        df = scan.running(rows, ["k"], [scan.Running("after", "next", F.col("v"))], chunk_ms=chunk)
        # a frame that ends with the partition is summed up anew for every row of a chunk
        assert "unboundedfollowing" not in df._jdf.queryExecution().toString().lower()
        got = sorted(df.collect(), key=lambda r: (r.time_ms, r.seq))
        assert len(got) == 400
        for i, r in enumerate(got):
            assert r.after == next((x.v for x in got[i + 1 :] if x.k == r.k and x.v is not None), None)


def test_presence_is_kept_in_words_and_unread_tables_are_not_kept(spark, tmp_path):
    times = [0, 1, 63 * 5000, 64 * 5000, 64 * 5000 + 4999, 200 * 5000]
    events = event_frame(spark, [hit(t, 1, 2, 5) for t in times])
    skills = spark.createDataFrame([(1, "Burning")], "skill_id BIGINT, skill_name STRING")
    players = spark.createDataFrame([("f1", 1, "n", "acc", 1, 2)], "fight_id STRING, agent_id BIGINT, name STRING, account_name STRING, profession INT, elite INT")
    words = {(r.agent_id, r.part_no): r.bits for r in partials.partial_presence(events).collect()}
    # numbers, three words an agent; a bitmap of 4 KiB for each agent before
    assert words == {(a, part): bits for a in (1, 2) for part, bits in ((0, 1 - 2**63), (1, 1), (3, 2**8))}
    seen = partials.LiveSummaries(spark, str(tmp_path / "seen"), ("presence", "spans"))
    sums = partials.LiveSummaries(spark, str(tmp_path / "sums"), ("sums",))
    for states in (seen, sums):
        states.put(events.limit(4).select(*states.columns()), skills, 0)
        states.put(events.subtract(events.limit(4)).select(*states.columns()), skills, 1)
    assert [r.active_buckets for r in seen.presence_pct(players).collect()] == [4]
    assert [(r.total_damage, r.condi_damage) for r in sums.account_buckets(players).collect()] == [(30, 30)]
    assert [p.name for p in (tmp_path / "sums").iterdir()] == ["sums"]
    assert "time_ms" not in sums.columns() and "damage" not in partials.TABLES["presence"]


