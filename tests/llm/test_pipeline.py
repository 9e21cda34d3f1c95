"""The pipeline against brute force, stage by stage, and the registration of all queries."""

import random
import re
from collections import Counter

import pytest

import __spark_entry__ as driver
import corpus_pipeline
from frayline.llm import decontamination, jaccard_join, quality_rules
from frayline.llm.common import saved
from tests.llm import texts
from tests.llm.test_text_operators import brute_classes, brute_removal

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small folder of tables with junk, near copies, repeated passages, benchmark passages, nulls and empty texts."""
    rng, root = random.Random(12), tmp_path_factory.mktemp("tables")
    item = " ".join(texts.words(rng, 15, 5000))
    shared = " ".join(texts.words(rng, 50, 5000))
    plain = [" ".join(texts.words(rng, rng.randrange(30, 120), 5000)) for _ in range(90)]
    rows = [t + "." for t in plain] + [t.upper().replace(" ", "!! ") for t in plain[:30]]
    rows += [t.replace(t.split()[7], "other", 1) for t in plain[40:50]] + plain[40:45]
    rows += [f"{plain[k + 50][:80]} new{k} {shared} {plain[k + 60][:80]}" for k in range(4)]
    rows += [f"{plain[k + 70][:90]} new{k} {item} {plain[k + 75][:90]}" for k in range(3)] + [item, None, "", "short"]
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(rows)]
    labels = [(i, int("!!" not in (t or "")), 0) for i, t in enumerate(rows[:120])]
    spark.createDataFrame(docs, COLUMNS).repartition(2).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    before, seen = {r.doc_id: r for r in docs.collect()}, []
    for name, stage in corpus_pipeline.STAGES:
        out = saved(stage(spark, docs, folder))
        rows = out.collect()
        seen.append(name)
        own = [(i, before[i].text) for i in sorted(before)]
        if name == "quality classifier":
            model = quality_rules.trained(docs, labels)
            want = {i: t for i, t in own if model.scores(quality_rules.text_statistics(t)[None, :])[0] >= quality_rules.CUT}
            assert not any("!!" in (t or "") for t in want.values()) and len(want) > 100
        elif name == "n-gram jaccard join":
            classes = {i: c for i, c, _ in brute_classes(own, jaccard_join.THRESHOLD)}
            want = {i: t for i, t in own if classes[str(i)] == str(i)}
            assert len(own) - len(want) >= 8
        elif name == "substring dedup":
            want = {}
            for (i, t), (_, gone, kept) in zip(own, brute_removal([t for _, t in own], 35)):
                if not gone or kept:
                    want[i] = kept.decode() if gone else t
            assert sum(want.get(i) != t for i, t in own) >= 4
        elif name == "benchmark decontamination":
            want = {i: t for i, t in own}
            for i, t in own:
                words = decontamination.normal_words(t)
                hit = {k + j for k in range(len(words) - 9) for _, x in items for y in [decontamination.normal_words(x)]
                       for m in range(len(y) - 9) if words[k : k + 10] == y[m : m + 10] for j in range(10)}
                if words and len(hit) >= 0.8 * len(words):
                    del want[i]
                elif hit:
                    assert item_free(next(r.text for r in rows if r.doc_id == i), items) and len(hit) == 15
                    want[i] = next(r.text for r in rows if r.doc_id == i)
                    assert decontamination.normal_words(want[i]) == [w for k, w in enumerate(words) if k not in hit]
            assert len(want) == len(own) - 1
        else:
            assert {r.doc_id for r in rows} == set(before)
            break
        assert out.columns == docs.columns and {r.doc_id: r.text for r in rows} == want
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
        docs, before = out, {r.doc_id: r for r in rows}
    assert len(seen) == 5


def test_repeated_rows_shared_and_null_ids_stay_once(spark, folder):
    rng = random.Random(5)
    a, b, c, d, e = (texts.words(rng, 60, 9000) for _ in range(5))
    near = lambda w, k: " ".join([*w[:k], "other", *w[k + 1 :]])
    a, b, c, d, e = ([" ".join(w), near(w, 0), near(w, 59)] for w in (a, b, c, d, e))
    rows = [(1, a[0])] * 3  # a repeated row
    rows += [(2, b[0]), (2, b[1]), (2, b[2]), (2, c[0])]  # near texts under one id, and one of another class
    rows += [(None, d[0]), (None, d[0]), (None, d[1]), (None, e[0]), (7, e[1])]  # classes of null ids, and with an id
    rows += [(8, None), (8, None), (None, "")]  # no words, no class
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    kept = saved(corpus_pipeline.near_copies(spark, docs, folder))
    assert kept.columns == docs.columns

    def held(df):
        groups = {t: name for name, g in zip("abcde", (a, b, c, d, e)) for t in g}
        return sorted((str(r.doc_id), groups.get(r.text, str(r.text))) for r in df.collect())

    want = sorted([("1", "a"), ("2", "b"), ("2", "c"), ("None", "d"), ("7", "e"), ("8", "None"), ("8", "None"), ("None", "")])
    assert held(kept) == want
    assert held(corpus_pipeline.repeated_passages(spark, kept, folder)) == want


def item_free(text, items):
    return not any(re.sub(r"\W+", " ", t) in re.sub(r"\W+", " ", text) for _, t in items)


def test_run_returns_the_last_stage(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert rows and max(used.values()) <= 2048


def test_all_queries_are_registered():
    names = driver.queries()
    assert "pipeline" in names and set(driver.oracle_sql()) <= set(names)
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
