import base64
import hashlib
import random

import numpy as np
import pytest

from frayline.llm import quality_rules, tree_search, warc
from frayline.llm.common import saved, shared_folder
from tests.llm import texts


def test_warc_round_trip(spark):
    rows = [(i, f"http://Host{i % 3}.example.com/p/{i}?q=é x", f"<p>{i % 5}</p>" * (i % 7)) for i in range(60)]
    rows += [(100, None, None), (101, "not a url\r\nX: 1", ""), (102, "http://[bad", "z" * 200_000), (None, "http://a.b/", "<p>1</p>"), (5, "http://a.b/", rows[5][2]), (103, "http://a.b/", "solo"), (103, "http://a.b/", "solo")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, key string").repartition(4)
    for least in (0, 9):
        got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in warc.archived(pages, least).collect())
        want = []
        for ident, _, html in rows:
            data = (html or "").encode()
            same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
            first = min(same, default=None) if len(data) >= least else None
            revisit = first is not None and first != ident
            digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
            want.append((str(ident), len(data), digest, "revisit" if revisit else "response", str(first if revisit else None)))
        assert got == sorted(want)
    assert warc.archived(pages.limit(0)).count() == 0


def test_index_lookup_over_small_blocks(spark):
    pages = spark.createDataFrame([(i, f"http://h.example/{i % 4}", f"t{i}") for i in range(50)], "page_id long, url string, html string")
    folder = shared_folder(spark)
    entries = saved(warc.write_archive(pages.repartition(3), folder, archive_bytes=500))
    parts = saved(warc.write_index(entries.repartition(2), folder, block_entries=3))
    assert parts.agg({"entries": "sum"}).first()[0] == 50
    keys = spark.createDataFrame([(warc.entry_key("http://h.example/3", 7),), (warc.entry_key("http://h.example/9", 7),)], "key binary")
    found = warc.captures(keys, parts, folder).collect()
    assert [(r.page_id, bytes(r.payload), r.url) for r in found] == [(7, b"t7", "http://h.example/3")]
    assert warc.url_key("https://WWW.Example.com:8080/a?b#c") == "com,example,www:8080)/a?b"


def brute_top(rows, asked, k):
    good = {(i, tuple(np.floor(256 * np.array(v, dtype=np.float64)).astype(int).tolist())) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q, v in good:
        if asked(q):
            own = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(own[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard", [4096, 40])
def test_top_k(spark, shard):
    rng = np.random.default_rng(3)
    near = rng.normal(size=(6, 8))
    rows = [(i, [float(np.float32(x)) for x in near[i % 6] + 0.1 * rng.normal(size=8)]) for i in range(300)]
    rows += [(i, [0.5] * 8) for i in range(300, 420)]  # ties beyond a leaf
    rows += [(420, None), (421, [None] * 8), (422, [float("nan")] * 8), (423, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (425, [1.0, 2.0]), (400, [0.25, 3.0]), (426, []), rows[0], rows[0]]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = tree_search.top_k(table.filter("vec_id % 20 = 0"), table, shard=shard, block=10)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, lambda q: q % 20 == 0, 5)
    assert tree_search.top_k(table.limit(0), table.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1e6, 3e7, 1e12])
def test_top_k_of_long_vectors_is_exact(spark, size):
    rng = np.random.default_rng(7)
    rows = [(i, (size * rng.normal(size=6)).tolist()) for i in range(40)] + [(i, [x + 0.25 for x in rows_]) for i, rows_ in enumerate([[size] * 6] * 9, 40)]
    rows += [(i, rng.normal(size=6).tolist()) for i in range(50, 90)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    own = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    want = []
    for q in (i for i in own if i % 10 == 0):
        best = sorted((-sum(a * b for a, b in zip(own[q], w)), i) for i, w in own.items() if i != q)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    asked = table.filter("vec_id % 10 = 0")
    if max(abs(w[3]) for w in want) >= 2**63:
        with pytest.raises(Exception, match="64 bits"):
            tree_search.top_k(asked, table).collect()
    else:
        assert sorted(map(tuple, tree_search.top_k(asked, table, shard=30, block=5).collect())) == sorted(want)
    x = np.array([own[i] for i in sorted(own)], dtype=np.float64)
    found = tree_search.DualSearch(x[:9], np.arange(9), x, np.arange(len(x)), 3)
    for place, q in enumerate(found.qid.tolist()):
        brute = sorted((-sum(int(a) * int(b) for a, b in zip(x[q], w)), i) for i, w in enumerate(x.tolist()) if i != q)[:3]
        assert [(-int(s), int(i)) for s, i in zip(found.scores[place], found.ids[place])] == brute


def test_vectors_beyond_all_bounds_are_compared():
    x = np.array([[1e200, 1.0], [-1e200, 2.0], [3.0, 1e190], [5.0, 7.0]])
    found = tree_search.DualSearch(x, np.arange(4), x, np.arange(4), 2)
    assert [int(i) for i in found.ids[0]] == [3, 2] and found.scores[3][0] == 5 * int(1e200) + 7


def test_pruning_leaves_pairs_out():
    rng = np.random.default_rng(4)
    centers = 400 * rng.normal(size=(30, 6))
    x = np.round(np.repeat(centers, 60, axis=0) + rng.normal(size=(1800, 6)))
    ids = np.arange(1800)
    found = tree_search.DualSearch(x[::20], ids[::20], x, ids, 5)
    assert found.compared < 0.5 * 90 * 1800
    scores = x[::20] @ x.T
    scores[np.arange(90), ids[::20]] = -np.inf
    want = np.sort(scores, axis=1)[:, ::-1][:, :5]
    assert np.array_equal(found.scores[np.argsort(found.qid)], want)


def test_cells_that_cannot_score_are_left_out(spark):
    rng = np.random.default_rng(5)
    centers = 200 * rng.normal(size=(24, 6))
    x = np.round(np.repeat(centers, 50, axis=0) + rng.normal(size=(1200, 6)))
    net = tree_search.Net(x[rng.permutation(1200)[:300]], 24)
    cell, away = net.cells(x)
    assert np.all(np.sqrt(((x - net.centers[cell]) ** 2).sum(axis=1)) <= away)
    bounds = tree_search.Bounds(net, {int(c): float(away[cell == c].max()) for c in set(cell.tolist())})
    scores = x[::20] @ x.T
    most = bounds.most(x[::20])
    for k, c in enumerate(bounds.cells.tolist()):
        assert np.all(scores[:, cell == c].max(axis=1) <= most[:, k])
    floors = np.sort(scores, axis=1)[:, -6]
    assert (most >= floors[:, None]).mean() < 0.3
    rows = [(i, (v / 256).tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = tree_search.top_k(table.filter("vec_id % 20 = 0"), table, shard=50, block=16, sample=300)
    want = []
    for q in range(0, 1200, 20):
        order = sorted((-int(s), i) for i, s in enumerate(x[q] @ x.T) if i != q)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(order, 1)]
    assert sorted(map(tuple, got.collect())) == want


def labelled(spark, n=300):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        plain = " ".join(rng.choices(["the", "of", "stone", "river", "was", "near"], k=rng.randrange(5, 60))) + "."
        bad = i % 3 == 0
        rows.append((i, plain.upper().replace(" ", "!! ") if bad else plain, 0.1, "x"))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(n, None, 0.1, "x"), (n + 1, "", 0.1, "x"), (None, "the river was near", 0.1, "x"), (1, rows[1][1], 0.1, "x"), (n + 2, "A" * 100_000, 0.1, "x")]
    labels += [(n, None, 0), (n + 9, 1, 0), (None, 1, 0), (1, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, stats string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_rules(spark):
    docs, labels = labelled(spark)
    got = quality_rules.quality_scores(docs, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r.predicted == truth[r.doc_id] for r in got if r.held_out and truth.get(r.doc_id) is not None]
    assert len(held) > 20 and np.mean(held) > 0.95
    model = quality_rules.trained(docs, labels)
    x = np.stack([quality_rules.text_statistics(r.text) for r in docs.orderBy("doc_id", "text").collect()])
    columns = [r.score for r in quality_rules.scored(docs.select("doc_id", "text"), model).orderBy("doc_id", "text").collect()]
    assert np.allclose(columns, model.scores(x)) and len(model.rules) < 60
    kept = quality_rules.without_low_quality(docs, labels)
    assert kept.columns == docs.columns
    assert quality_rules.quality_scores(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality_rules.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = labelled(spark)
    other = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality", "toxic")
    assert quality_rules.trained(docs, labels) == quality_rules.trained(docs, other)


def test_an_id_on_very_many_rows_does_not_fill_the_sample(spark):
    docs, labels = labelled(spark)
    many = spark.range(4000).selectExpr("2L as doc_id", "concat('the river was near ', id) as text", "0.1d as score", "'x' as stats")
    labels = labels.unionByName(spark.range(500).selectExpr("2L as doc_id", "1 as quality", "0 as toxic"))
    model = quality_rules.trained(docs.unionByName(many), labels, sample=400)
    got = quality_rules.scored(docs, model).filter("doc_id > 2 and doc_id < 300").collect()
    assert np.mean([(r.score >= 0.3) == (r.doc_id % 3 != 0) for r in got]) > 0.95


def test_odd_texts_are_scored(spark):
    docs, labels = labelled(spark)
    got = quality_rules.quality_scores(texts.documents(spark), labels.filter("doc_id < 60"))
    assert got.count() == texts.documents(spark).count() and got.filter("score is null").count() == 0
