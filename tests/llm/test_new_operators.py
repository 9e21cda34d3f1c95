import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from frayline.llm import fill_in_middle, sharding, whitening
from frayline.llm.boundary_set import Array, Bitmap, BoundarySet, Runs
from frayline.llm.symmetric_eigen import leading
from tests.llm import texts

EIGHT = dict.fromkeys(range(8), 1.0)


# -- 11 ---------------------------------------------------------------------------------------
def brute_shard(ident, weights):
    key = "-" if ident is None else f"{len(str(ident))}:{ident}"
    score = lambda s: weights[s] / -math.log((int(hashlib.md5(f"{key}|{s}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13)
    return max((s for s in weights if weights[s] > 0), key=lambda s: (score(s), -s))


def test_places_and_slots(spark):
    docs = texts.documents(spark).drop("row").withColumnsRenamed({"score": "shard", "key": "__row"})
    docs = docs.unionByName(docs.filter("doc_id is null")).unionByName(docs.filter("doc_id = 5"))
    rows = sharding.placed(docs, EIGHT, EIGHT | {8: 1.0}).collect()
    want = [(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect()]
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in rows), key=str) == sorted(want, key=str)
    for s in range(8):
        own = sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        keys = [(r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32) for r in own]
        assert keys == sorted(keys)
    for r in rows:
        assert r.shard == brute_shard(r.doc_id, EIGHT) and r.grown_shard == brute_shard(r.doc_id, EIGHT | {8: 1.0})
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
    assert sharding.placed(texts.empty(spark), EIGHT, EIGHT).count() == 0


def test_slots_of_one_hot_key_span_ranges(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(0, 900, 1, 7).selectExpr("if(id < 600, null, id) AS doc_id", "1 AS shard", "id AS slot")
        got = [r.place for r in sharding.slots(rows, "shard", ["doc_id"], "place").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sorted(got) == list(range(900))


def test_few_rows_move(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    weights = {0: 1.0, 1: 2.0, 3: 1.0, 4: 0.0}
    counts = {r.shard: r["count"] for r in sharding.assigned(rows, weights).groupBy("shard").count().collect()}
    assert set(counts) == {0, 1, 3} and all(abs(counts[s] / 20_000 - weights[s] / 4) < 0.02 for s in counts)
    flows = lambda new: {(r.from_shard, r.to_shard): r.n_rows for r in sharding.moved(rows, weights, new).collect()}
    assert all(a == b or b == 7 for a, b in flows(weights | {7: 1.0}))
    assert all(a == b or a == 1 for a, b in flows({0: 1.0, 3: 1.0}))
    assert all(a == b or b == 3 for a, b in flows(weights | {3: 1.5}))
    with pytest.raises(ValueError):
        sharding.assigned(rows, {0: 0.0})


def test_written_shards(spark, tmp_path):
    docs = texts.documents(spark)
    sharding.write_shards(docs, EIGHT, str(tmp_path / "out"), ("doc_id", "text"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.drop("shard").collect())) == sorted(map(str, docs.collect()))
    keys = docs.select(sharding.stable_key("doc_id", "text").alias("k")).distinct().count()
    assert keys == docs.select("doc_id", "text").distinct().count()


# -- 12 ---------------------------------------------------------------------------------------
def test_boundary_set_selects_and_ranks():
    rng = np.random.default_rng(1)
    parts = [
        rng.choice(65536, 100, replace=False), 65536 + rng.choice(65536, 30_000, replace=False), 3 * 65536 + np.arange(500, 60_000),
        5 * 65536 + np.concatenate([np.arange(0, 3000), np.arange(4000, 65536)]), [7 * 65536 + 65535], [2**32 - 1],
    ]
    values = np.sort(np.concatenate(parts))
    made = BoundarySet(values)
    assert [type(c) for c in made.containers] == [Array, Bitmap, Runs, Runs, Array, Array]
    assert len(made) == len(values)
    asked = [0, 99, 100, 30_099, 30_100, len(values) - 1, *rng.integers(0, len(values), 500).tolist()]
    assert [made.select(k) for k in asked] == values[asked].tolist()
    probes = [0, 65535, 2 * 65536 + 5, 2**32 - 1, *rng.integers(0, 8 * 65536, 500).tolist(), *values[asked].tolist()]
    assert [made.rank(x) for x in probes] == np.searchsorted(values, probes, side="right").tolist()
    assert len(BoundarySet(np.empty(0))) == 0 and BoundarySet(np.empty(0)).rank(9) == 0
    for k in (-1, len(values)):
        with pytest.raises(IndexError):
            made.select(k)


UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fim(ident, text):
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"42:{'' if ident is None else ident}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle(spark):
    rng = random.Random(4)
    odd = ["a <P> b", "<S", "x<M>", " lead", "trail \n", "\x0b\x0c", " é  b\x85c", "w " * 70_000, "q" * 140_000 + " z"]
    made = ["".join(rng.choice(["a", "é", "😀", " ", "\n", "\t", "<", "P>", "\x1c"]) for _ in range(rng.randrange(60))) for _ in range(200)]
    docs = texts.documents(spark, extra=odd + made).withColumnRenamed("row", "form")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs.collect():
        n, form, p, m, out = brute_fim(r.doc_id, r.text)
        want.append((r.doc_id, n, form, p, m, sha(out), sha(r.text or "")))
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert sorted(map(tuple, fill_in_middle.digests(docs).collect()), key=str) == sorted(want, key=str)
    full = fill_in_middle.transformed(docs)
    assert full.columns == ["doc_id", "text", "key", "score", "fim_text", "form", "n", "prefix_chars", "middle_chars"]
    assert sorted((str(r.doc_id), r.fim_text) for r in full.collect()) == sorted((str(r.doc_id), brute_fim(r.doc_id, r.text)[4]) for r in docs.collect())
    back = fill_in_middle.restored(full)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert fill_in_middle.digests(texts.empty(spark)).count() == fill_in_middle.transformed(texts.empty(spark)).count() == 0


# -- 13 ---------------------------------------------------------------------------------------
def matrices():
    rng = np.random.default_rng(5)
    for d in (1, 2, 3, 9, 40):
        a = rng.normal(size=(3 * d, d))
        yield a.T @ a
    yield np.diag([3.0, 3.0, 3.0, 1.0, 0.0, 3.0])  # decoupled, one value four times
    yield np.zeros((5, 5))
    yield np.ones((6, 6))
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    yield q @ np.diag([5, 5, 5 - 1e-13, 4, 4, 2, 2, 2, 2, 1e-9, 0, 0]) @ q.T
    yield 1e12 * (q @ np.diag(np.arange(12.0)) @ q.T)
    wilkinson = np.diag(np.abs(np.arange(-10.0, 11))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    yield wilkinson


@pytest.mark.parametrize("matrix", list(matrices()))
def test_leading_pairs(matrix):
    values, vectors = leading(matrix, 8)
    want = np.linalg.eigvalsh(matrix)[::-1][:8]
    norm = max(np.abs(want).max(), 1e-290)  # of the zero matrix: the bracket has the width of the least numbers
    assert np.allclose(values, want, rtol=0, atol=1e-13 * norm)
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-10
    assert np.abs(matrix @ vectors.T - vectors.T * values).max() <= 1e-12 * norm


def brute_white(rows, k=8):
    x = {i: [math.floor(1024 * c) + 100_000 for c in v] for i, v in rows}
    n, d = len(x), len(next(iter(x.values())))
    s = [sum(v[j] for v in x.values()) for j in range(d)]
    y = np.array([[(n * v[j] - s[j]) / n for j in range(d)] for v in x.values()])
    e, c = np.linalg.eigh(y.T @ y / n)
    e, c = e[::-1][:k], c[:, ::-1][:, :k]
    dev = [sum((n * v[j] - s[j]) ** 2 for j in range(d)) for v in x.values()]
    return list(x), n, dev, y @ c / np.sqrt(e), e / np.trace(y.T @ y / n)


def test_whitening(spark):
    rng = np.random.default_rng(6)
    made = (rng.normal(size=(400, 12)) * np.linspace(3, 0.2, 12)).tolist()
    good = [(i, v) for i, v in enumerate(made)] + [(None, made[0])]
    bad = [(900, None), (901, []), (902, [None] * 12), (903, [float("nan")] * 12), (904, [1.0] * 11 + [float("inf")])]
    table = spark.createDataFrame([(i, v, 1) for i, v in good + bad], "vec_id long, embedding array<double>, n long").repartition(5)
    rows = whitening.whitened(table).collect()
    assert len(rows) == 8 * len(good)
    ids, n, dev, white, explained = brute_white([(str(i), v) for i, v in good])
    for k in range(8):
        own = {str(r.vec_id): r for r in rows if r.component == k + 1}
        sign = np.sign(own["0"].whitened * white[0, k])
        for at, i in enumerate(ids):
            r = own[i]
            assert r.n == n and int(r.deviation) == dev[at]
            assert r.whitened == pytest.approx(sign * white[at, k], abs=1e-9) and r.explained == pytest.approx(explained[k], rel=1e-9)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_whitening_of_odd_tables(spark):
    ddl = "vec_id long, embedding array<double>, whitened string"
    assert whitening.whitened(spark.createDataFrame([], ddl)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [0.5, 0.5], ""), (2, [0.5, 0.5], "")], ddl)).count() == 0  # nothing varies
    mixed = spark.createDataFrame([(1, [0.0, 1.0], ""), (2, [2.0, 5.0], ""), (2, [2.0, 5.0], ""), (3, [1.0, 2.0, 3.0], ""), (4, [1e13, 2.0, 3.0], "")], ddl)
    rows = whitening.whitened(mixed).collect()
    assert sorted((r.vec_id, r.component, r.n) for r in rows) == [(1, 1, 3), (2, 1, 3), (2, 1, 3), (3, 1, 2), (4, 1, 2)]
    big = {r.vec_id: int(r.deviation) for r in rows if r.n == 2}
    assert big == {3: (1024 * (10**13 - 1)) ** 2, 4: (1024 * (10**13 - 1)) ** 2}
    assert "whitened" in whitening.projected(mixed, whitening.fitted(mixed)).columns
    with pytest.raises(Exception, match="62 bits"):
        whitening.fitted(spark.createDataFrame([(1, [1e300], "")], ddl))
