"""Small tables with the cases every operator must stand: nulls, empty and long texts, ties, repeated rows."""

import random

DOCS = "doc_id long, text string, row string, key long, score double"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def documents(spark, extra=(), seed=3, n=60):
    """Documents with copies, near copies, shared passages, odd rows, and columns whose names the operators use too."""
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(1, 140)) for _ in range(n // 3)]
    shared = words(rng, 60)
    texts = [" ".join(w) for w in base]
    for w in base:
        near = list(w)
        for _ in range(len(near) // 40 + 1):
            near[rng.randrange(len(near))] = f"x{rng.randrange(9999)}"
        texts.append("\n".join([" ".join(near[:20]), " ".join(near[20:])]))
    texts += [" ".join(words(rng, 20) + shared + words(rng, 20)) for _ in range(4)] + texts[:4]
    texts += [None, "", " \t\n", None, "A", "É è 😀 x", "word " * 3000, "a" * 50_000, *extra]
    rows = [(i, t, "r", i, 0.5) for i, t in enumerate(texts)]
    rows += [(None, "no id " + texts[0], None, None, None), rows[0], rows[0]]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)
