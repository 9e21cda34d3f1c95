import random

import pytest
from pyspark.sql import functions as F

from frayline.operators.scan import Running, clamped_sum, covered_by_any, near_any, running, value_at


def random_rows(n, seed, keys=3, span=400):
    rng = random.Random(seed)
    return [(f"k{rng.randrange(keys)}", rng.randrange(span), i, rng.choice([None, *range(-5, 9)])) for i in range(n)]


@pytest.mark.parametrize("chunk", [1, 37, 10_000, None])
def test_running_values_equal_a_plain_walk(spark, chunk):
    data = random_rows(300, 1)
    df = spark.createDataFrame(data, "k STRING, time_ms BIGINT, seq BIGINT, v BIGINT")
    kinds = ["last", "prev", "next", "sum", "before", "max", "min", "max_before"]
    out = running(df, ["k"], [Running(f"x_{s}", s, F.col("v")) for s in kinds], chunk_ms=chunk).collect()
    assert len(out) == len(data)
    by_key = {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        by_key.setdefault(r[0], []).append(r)
    got = {r.seq: r for r in out}
    for rows in by_key.values():
        values = [r[3] for r in rows]
        for i, r in enumerate(rows):
            seen, prior, later = ([v for v in part if v is not None] for part in (values[: i + 1], values[:i], values[i + 1 :]))
            g = got[r[2]]
            assert g.x_last == (seen[-1] if seen else None)
            assert g.x_prev == (prior[-1] if prior else None)
            assert g.x_next == (later[0] if later else None)
            assert g.x_sum == sum(seen) and g.x_before == sum(prior)
            assert g.x_max == max(seen, default=None) and g.x_min == min(seen, default=None)
            assert g.x_max_before == max(prior, default=None)


@pytest.mark.parametrize("chunk", [1, 25, 10_000])
def test_clamped_sum_equals_a_plain_walk(spark, chunk):
    data = [(k, t, s, v if v is not None else 0, v is None) for k, t, s, v in random_rows(400, 2)]
    df = spark.createDataFrame(data, "k STRING, time_ms BIGINT, seq BIGINT, d BIGINT, r BOOLEAN")
    got = {r.seq: r.level for r in clamped_sum(df, ["k"], F.col("d"), F.col("r"), "level", chunk_ms=chunk).collect()}
    level = {}
    for k, _, s, d, r in sorted(data, key=lambda x: (x[1], x[2])):
        level[k] = 0 if r else max(0, level.get(k, 0) + d)
        assert got[s] == level[k]


@pytest.mark.parametrize("chunk", [50, 10_000])
def test_interval_and_proximity_lookups_equal_brute_force(spark, chunk):
    rng = random.Random(3)
    probes = [(f"k{rng.randrange(3)}", rng.randrange(300), i) for i in range(150)]
    spans = [(f"k{rng.randrange(3)}", a, a + rng.randrange(1, 60)) for a in (rng.randrange(300) for _ in range(40))]
    p = spark.createDataFrame(probes, "k STRING, time_ms BIGINT, seq BIGINT")
    s = spark.createDataFrame(spans, "k STRING, start_ms BIGINT, end_ms BIGINT")
    inside = {r.seq: r.hit for r in covered_by_any(p, s, ["k"], "hit", chunk).collect()}
    marks = [(k, a) for k, a, _ in spans]
    near = {r.seq: r.hit for r in near_any(p, spark.createDataFrame(marks, "k STRING, time_ms BIGINT"), ["k"], 4, "hit", chunk).collect()}
    for k, t, i in probes:
        assert inside[i] == any(k == kk and a <= t < b for kk, a, b in spans)
        assert near[i] == any(k == kk and abs(a - t) <= 4 for kk, a in marks)


def test_value_at_half_open_intervals(spark):
    spans = [("k", 10, 20, 1), ("k", 20, 30, 2), ("k", 50, 60, 3)]
    s = spark.createDataFrame(spans, "k STRING, start_ms BIGINT, end_ms BIGINT, owner BIGINT")
    times = [9, 10, 19, 20, 29, 30, 49, 50, 59, 60]
    p = spark.createDataFrame([("k", t, t) for t in times], "k STRING, time_ms BIGINT, seq BIGINT")
    got = {r.time_ms: r.o for r in value_at(p, s, ["k"], "owner", "o", 7).collect()}
    assert [got[t] for t in times] == [None, 1, 1, 2, 2, None, None, 3, 3, None]


def test_rows_with_null_keys_or_times_keep_their_values(spark):
    rows = [("a", 5, 0, 1), (None, 5, 1, 2), (None, 90, 2, 3), (None, None, 3, 4), ("a", None, 4, 5)]
    df = spark.createDataFrame(rows, "k STRING, time_ms BIGINT, seq BIGINT, v BIGINT")
    for chunk in (10, None):
        got = {r.seq: r.x for r in running(df, ["k"], [Running("x", "sum", F.col("v"))], chunk_ms=chunk).collect()}
        assert got == {0: 6, 1: 6, 2: 9, 3: 4, 4: 5}  # a null time comes first
    got = {r.seq: r.level for r in clamped_sum(df, ["k"], F.col("v"), F.lit(False), "level", chunk_ms=10).collect()}
    assert got == {0: 6, 1: 6, 2: 9, 3: 4, 4: 5}


def test_lookups_of_null_keys(spark):
    probes = spark.createDataFrame([(None, 5, 0), (None, 50, 1), ("a", 5, 2)], "k STRING, time_ms BIGINT, seq BIGINT")
    spans = spark.createDataFrame([(None, 0, 10, 7)], "k STRING, start_ms BIGINT, end_ms BIGINT, v BIGINT")
    marks = spark.createDataFrame([(None, 48)], "k STRING, time_ms BIGINT")
    by_seq = lambda df: {r.seq: r.x for r in df.collect()}
    assert by_seq(covered_by_any(probes, spans, ["k"], "x", 20)) == {0: True, 1: False, 2: False}
    assert by_seq(value_at(probes, spans, ["k"], "v", "x", 20)) == {0: 7, 1: None, 2: None}
    assert by_seq(near_any(probes, marks, ["k"], 3, "x", 20)) == {0: False, 1: True, 2: False}
