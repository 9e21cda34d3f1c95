import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from frayline.llm import decontamination, jaccard_join, licences, substring_dedup
from frayline.llm.automaton import SuffixAutomaton, merged
from frayline.llm.components import components
from tests.llm import texts


def occurrences(sequences, part):
    n = len(part)
    return sum(tuple(s[i : i + n]) == tuple(part) for s in sequences for i in range(len(s) - n + 1))


def test_automaton_against_brute_force():
    rng = random.Random(1)
    for _ in range(40):
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(0, 12))] for _ in range(4)]
        auto, times = SuffixAutomaton(), [1, 2, 1, 3]
        for s, n in zip(sequences, times):
            auto.add(s, n)
        auto.finish()
        weighted = [s for s, n in zip(sequences, times) for _ in range(n)]
        probe = [rng.randrange(4) for _ in range(15)]
        for i, (n, v) in enumerate(auto.statistics(probe), 1):
            longest = next(k for k in range(i, -1, -1) if k == 0 or occurrences(sequences, probe[i - k : i]))
            assert n == longest
            if n:
                assert auto.count[auto.holder(v, n)] == occurrences(weighted, probe[i - n : i])
        for s in sequences:
            assert auto.repeated(s, 3) == [i for i in range(len(s) - 2) if occurrences(weighted, s[i : i + 3]) > 1]
    assert merged([(5, 7), (1, 3), (3, 4), (6, 9)]) == [(1, 4), (5, 9)]


def brute_contamination(docs, items, window):
    wins = {}
    for ident, text in items:
        w = decontamination.normal_words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1) if w else ():
            wins.setdefault(tuple(w[i : i + k]), set()).add(ident)
    out = []
    for ident, text in docs:
        w, hit, found = decontamination.normal_words(text), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                own = wins.get(tuple(w[i : i + k]))
                if own:
                    hit |= set(range(i, i + k))
                    found |= own
        ids = sorted(str(x) for x in found if x is not None)
        out.append((str(ident), len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out)


ITEMS = [(1, "alpha beta gamma delta eps"), (2, "Gamma DELTA, eps zeta"), (3, "one"), (4, None), (5, ""), (None, "no id here either"), (12, "alpha beta gamma delta eps"), (7, "w1 w2"), (6, "!!!")]


@pytest.mark.parametrize("shard_bytes", [2_000_000, 20])
def test_contamination(spark, shard_bytes):
    rng = random.Random(6)
    bits = ["alpha beta gamma delta eps", "gamma delta eps zeta", "one", "ONE!", "w1 w2", "beta", "no id here either", "x-y", "é"]
    docs = texts.documents(spark, [" ".join(rng.choices(bits, k=rng.randrange(6))) for _ in range(40)])
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found, (spans, hit_items, _) = decontamination.matched(docs.select("doc_id", "text"), items, 4, shard_bytes=shard_bytes)
    assert found.count() == docs.count()
    if shard_bytes > 20:
        got = decontamination.contamination(docs, items, 4).collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == brute_contamination([(r.doc_id, r.text) for r in docs.collect()], ITEMS, 4)
    else:
        assert (spans, hit_items) == ("__spans", "__items")
        whole, _ = decontamination.matched(docs.select("doc_id", "text"), items, 4)
        assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))


def test_decontaminate(spark):
    rows = [(1, "Keep this. Alpha beta gamma delta eps! And that.", "s"), (2, "alpha beta gamma delta", None), (3, None, "s"), (4, "", "s"), (4, "clean one-two", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    items = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    got = decontamination.decontaminate(docs, items, 4)
    assert got.columns == docs.columns
    kept = sorted(map(tuple, got.collect()), key=str)
    assert kept == [(1, "Keep this. ! And that.", "s"), (3, None, "s"), (4, "", "s"), (4, "clean one-two", "s")]
    assert decontamination.decontaminate(docs, items.limit(0)).count() == 5
    assert decontamination.decontaminate(docs.limit(0), items).count() == 0


def brute_removal(values, window):
    split = [(v or "").encode().split() for v in values]
    counts = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - window + 1) if counts[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("shard_words", [400_000, 30])
def test_substring_removal(spark, shard_words):
    docs = texts.documents(spark, ["a b " * 60, "c " + "a b " * 10])
    rows, removed = substring_dedup.repeats(docs, window=12, gram=5, shard_words=shard_words)
    got = {r.key: r for r in removed.collect()}
    have = sorted((str(r.doc_id), r.n_words, got[r.key].gone if r.key in got else 0, got[r.key].kept_digest if r.key in got else r.digest) for r in rows.collect())
    own = docs.collect()
    want = sorted((str(d.doc_id), n, g, hashlib.sha256(k).hexdigest()) for d, (n, g, k) in zip(own, brute_removal([d.text for d in own], 12)))
    assert have == want
    assert any(g for _, _, g, _ in want) and any(0 < g < n for _, n, g, _ in want)


def test_substring_rows_and_references(spark):
    docs = texts.documents(spark)
    counts = substring_dedup.removal_counts(docs).collect()
    assert len(counts) == docs.count() and substring_dedup.removal_counts(texts.empty(spark)).count() == 0
    kept = substring_dedup.without_repeats(docs, 12)
    assert kept.columns == docs.columns
    assert sorted(str(r.text) for r in kept.filter("text is null or text = ''").collect()) == ["", "None", "None"]
    refs = spark.createDataFrame([("p q r s t",), (None,), ("u v w x",)], "text string")
    table = spark.createDataFrame([(1, "a p q r s b"), (2, "u v w"), (3, None), (4, "p q r u v w x")], "doc_id long, text string")
    for shard_bytes in (1000, 5):
        got = {r.doc_id: r.text for r in substring_dedup.without_reference_spans(table, refs, 4, shard_bytes).collect()}
        assert got == {1: "a b", 2: "u v w", 3: None, 4: "p q r"}


def test_repeated_rows_are_removed_once_each(spark):
    text = " ".join(f"t{k}" for k in range(40))
    rows = [(1, text)] * 3 + [(2, f"own words before {text}"), (3, "b " * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.removal_counts(docs).collect())
    assert got == [(1, 40, 40)] * 3 + [(2, 43, 40), (3, 5, 0)]
    kept = sorted((r.doc_id, r.text) for r in substring_dedup.without_repeats(docs).collect())
    assert kept == [(2, "own words before"), (3, "b " * 5)]
    # no other copy: the repeats are each other's
    assert [r.n_removed for r in substring_dedup.removal_counts(docs.filter("doc_id = 1")).collect()] == [40] * 3


def brute_classes(rows, threshold):
    sets = [set(jaccard_join.ngram_set(t).tolist()) for _, t in rows]
    n = len(rows)
    link = [[i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold for j in range(n)] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if link[i][j]:
                    root[i] = root[j] = min(root[i], root[j])
    out = []
    for i, (ident, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        alone = sum(root[j] == root[i] for j in range(n)) == 1
        out.append((str(ident), str(ident if alone else min(ids, default=None)), sum(map(bool, link[i]))))
    return sorted(out)


@pytest.mark.parametrize("block", [128, 4])
def test_near_classes(spark, block):
    rng = random.Random(8)
    base = texts.words(rng, 90)
    near = []
    for _ in range(30):  # a large group whose members differ from each other, some too much
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(90)] = f"y{rng.randrange(9999)}"
        near.append(" ".join(w))
    docs = texts.documents(spark, near)
    got = jaccard_join.near_classes(docs, block=block).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == brute_classes([(r.doc_id, r.text) for r in docs.collect()], 0.8)


def test_one_document_of_each_class_stays(spark):
    docs = texts.documents(spark)
    kept = jaccard_join.without_near_copies(docs)
    assert kept.columns == docs.columns
    classes = jaccard_join.near_classes(docs)
    stay = sorted(str(r.doc_id) for r in classes.collect() if r.class_id is None or r.doc_id == r.class_id)
    assert sorted(str(r.doc_id) for r in kept.collect()) == stay and len(stay) < docs.count()
    # an id may stand on different texts: each row goes by its own text
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "something else that stays in any case")]
    own = jaccard_join.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, own.collect())) == [rows[0], rows[2]]
    assert jaccard_join.without_near_copies(texts.empty(spark)).count() == 0
    bands, rows = jaccard_join.choose_bands(0.8)
    assert (1 - 0.8**rows) ** bands <= 1e-6


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(3, 3)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == root
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(9)]
    for group in (sets, sets[:2]):
        assert jaccard_join.overlaps(group).tolist() == [[len(set(a) & set(b)) for b in group] for a in group]


def test_licences(spark):
    lines = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
             "This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under CC BY-SA 4.0": "CC-BY-SA"}
    extra = [f"some prose here\n{x}\nmore prose" for x in lines] + ["Her licence expired.\nHe works at MIT in Boston", "The general public was not admitted"]
    docs = texts.documents(spark, extra)
    got = licences.licence_families(docs).collect()
    assert len(got) == docs.count()
    by_text = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        want = {f for x, f in lines.items() if x in (by_text[r.doc_id] or "").split("\n")}
        assert r.families == ",".join(sorted(want)) and r.n_licences == len(want), by_text[r.doc_id]
    assert licences.licence_families(texts.empty(spark)).count() == 0
    # held-out forms of the templates are found, and confirmed by the family's own template only
    model, rng = licences.fit([]), random.Random(77)
    forms = [(licences._varied(t, ["lorem", "ipsum", "dolor"], rng), f) for f, ts in licences.TEMPLATES.items() for t in ts for _ in range(5)]
    right = [model.family(x) is not None and model.family(x)[0] == f for x, f in forms]
    assert np.mean(right) > 0.85


def test_short_and_wrapped_notices(spark):
    whole = {"All rights reserved.": "Proprietary", "The MIT License (MIT)": "MIT"}
    wrapped = {
        'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal': "MIT",
        "# modify it under the terms of the GNU Lesser General Public\n# License as published by the Free Software Foundation; either": "LGPL",
        "Redistribution and use in source and binary forms, with or\nwithout modification, are permitted": "BSD",
        "Licensed under the Apache\nLicense, Version 2.0": "Apache-2.0",
    }
    given = [(f"some prose here\n{x}\nmore prose", f, 1) for x, f in (whole | wrapped).items()]
    given += [(f"{x}\n\n{y}", ",".join(sorted((f, g))), 2) for (x, f), (y, g) in zip(wrapped.items(), list(wrapped.items())[1:])]
    given += [("Licensed under the\n\nApache License of the tribe\nin Version 3", "", 0), ("All rights\nof way were\nreserved", "", 0)]
    docs = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(given)], "doc_id long, text string")
    got = {r.doc_id: (r.families, r.n_licences) for r in licences.licence_families(docs).collect()}
    assert {given[k][0]: x for k, x in got.items()} == {t: (f, n) for t, f, n in given}
