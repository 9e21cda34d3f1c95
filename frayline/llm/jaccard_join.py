"""N-gram Jaccard self-join by MinHash banding (operator 8).

Words are runs of ASCII letters, ASCII digits and non-ASCII characters of the lower-cased text, so case, punctuation and
spacing do not count; n-grams are ``size`` consecutive words (a shorter text has one, of all its words). Texts with equal n-gram sets are copies and go on as one node with a number of copies.

1. Banding: ``choose_bands`` takes the least number of bands for which a pair at the threshold is missed with a
   probability of ``miss`` at most. Nodes are shuffled on their band hashes.
2. Nodes that share a bucket are chained by star edges (bucket member, least member), never as pairs; the connected
   parts of these edges hold every candidate pair.
3. Verification: a part is cut by hash into blocks of about ``block`` nodes, and each pair of blocks is one group of
   bounded size that compares full n-gram sets. It returns sums of links and local stars, no pairs.
4. Classes are the connected components of the verified links; the class id is the least document id.

Rows: texts that are null or without words have no n-grams: no links, and the class is their own id. Null ids never name
a class that holds another id. Repeated rows count as copies. Further columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frayline.llm.common import ALPHANUMERIC, batched, mixed, saved, unused, window_hashes, word_bounds, word_hashes
from frayline.llm.components import components

SIZE = 5
THRESHOLD = 0.8
MISS = 1e-6
BLOCK = 128
MAX_HASHES = 200


def choose_bands(threshold: float, miss: float = MISS, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band, hence the fewest false candidates, within ``most`` hashes."""
    best = (1, 1)
    for rows in range(1, 17):
        chance = threshold**rows
        bands = 1 if chance >= 1 else math.ceil(math.log(miss) / math.log1p(-chance))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def ngram_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-grams."""
    data = np.frombuffer((text or "").lower().encode(), dtype=np.uint8)
    words = word_hashes(data, *word_bounds(data, ALPHANUMERIC))
    return np.unique(window_hashes(words, min(size, len(words)))) if len(words) else np.empty(0, dtype=np.uint64)


class Signer:
    """Band hashes of an n-gram set."""

    def __init__(self, bands: int, rows: int, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.shape = (bands, rows)
        self.factors = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shifts = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
        self.weights = rng.integers(1, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def bands(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factors), np.iinfo(np.uint64).max)
        for k in range(0, len(grams), 512):
            np.minimum(least, (grams[k : k + 512, None] * self.factors + self.shifts).min(axis=0), out=least)
        sums = (mixed(least).reshape(self.shape) * self.weights).sum(axis=1, dtype=np.uint64)
        return mixed(sums + np.arange(self.shape[0], dtype=np.uint64)).view(np.int64)


def signatures(documents: DataFrame, size: int, threshold: float, miss: float, number: str | None = None) -> DataFrame:
    """(doc_id, row key, row number, node, number of n-grams, band hashes) per row; node is null without n-grams."""
    shape = choose_bands(threshold, miss)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(*shape)
        for batch in batches:
            nodes, sizes, bands = [], [], []
            for value in batch.column(3):
                grams = ngram_set(value.as_py(), size)
                nodes.append(hashlib.md5(grams.tobytes()).digest() if len(grams) else None)
                sizes.append(len(grams))
                bands.append(signer.bands(grams) if len(grams) else [])
            arrays = [*batch.columns[:3], pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row", "number", "node", "grams", "bands"])

    return _keyed(documents, number).mapInArrow(sign, "doc_id long, row long, number long, node binary, grams long, bands array<long>")


def _keyed(documents: DataFrame, number: str | None = None) -> DataFrame:
    numbered = F.lit(None).cast("long") if number is None else F.col(number)
    return batched(documents).select("doc_id", F.xxhash64("doc_id", "text").alias("row"), numbered.alias("number"), "text")


def gram_sets(documents: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """(node, packed n-gram set) of the representative rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [ngram_set(v.as_py(), size).tobytes() for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(s).digest() for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["node", "packed"])

    own = _keyed(documents).join(rows, "row", "left_semi").select("text")
    return own.mapInArrow(cut, "node binary, packed binary").groupBy("node").agg(F.first("packed").alias("packed"))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections among the sets of one group."""
    n = len(sets)
    if n == 2:
        shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), shared], [shared, len(sets[1])]], dtype=np.int64)
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    often = np.bincount(place, minlength=len(values)) > 1
    column = np.cumsum(often) - 1
    keep = often[place]
    owner, place = owner[keep], column[place[keep]]
    out, width = np.zeros((n, n), dtype=np.float64), 1 << 14
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for k in range(0, int(often.sum()), width):
        a, b = np.searchsorted(place, [k, k + width])
        part = np.zeros((n, width), dtype=np.float32)
        part[owner[a:b], place[a:b] - k] = 1
        out += part @ part.T
    shared = np.rint(out).astype(np.int64)
    np.fill_diagonal(shared, [len(s) for s in sets])
    return shared


def _group_links(rows: list[tuple], threshold: float) -> tuple[list, list]:
    """Link sums per node, and each node with the least one it is connected to here. Rows: (node, block, copies, set)."""
    if len(rows) < 2:
        return [], []
    rows = sorted(rows, key=lambda r: r[0])
    sizes = np.array([len(r[3]) for r in rows])
    shared = overlaps([r[3] for r in rows])
    linked = shared / (sizes[:, None] + sizes[None, :] - shared) >= threshold
    np.fill_diagonal(linked, False)
    blocks = np.array([r[1] for r in rows])
    if len(set(blocks.tolist())) > 1:  # pairs inside a block belong to that block's own group
        linked &= blocks[:, None] != blocks[None, :]
    copies = np.array([r[2] for r in rows], dtype=np.int64)
    sums, root = linked @ copies, list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in np.argwhere(np.triu(linked)).tolist():
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    edges = [(r[0], rows[find(k)][0]) for k, r in enumerate(rows) if find(k) != k]
    return [(r[0], int(s)) for r, s in zip(rows, sums) if s], edges


def verified(placed: DataFrame, threshold: float) -> DataFrame:
    """Rows (node, links, other): link sums have no ``other``, star edges no ``links``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def result() -> pa.RecordBatch:
            sums, edges = _group_links(rows, threshold)
            nodes = [n for n, _ in sums] + [a for a, _ in edges]
            links = [s for _, s in sums] + [None] * len(edges)
            others = [None] * len(sums) + [b for _, b in edges]
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(links, pa.int64()), pa.array(others, pa.binary())], ["node", "links", "other"])

        for batch in batches:
            for root, i, j, node, block, copies, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if (root, i, j) != key:
                    if rows:
                        yield result()
                    key, rows = (root, i, j), []
                rows.append((node, block, copies, np.frombuffer(packed, dtype=np.uint64)))
        if rows:
            yield result()

    # the pair of blocks (i, i) is met once by each node of block i, (i, j) by the nodes of both
    dealt = placed.select("root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("k"), "node", "block", "copies", "packed")
    dealt = dealt.select("root", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "node", "block", "copies", "packed")
    return dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(compare, "node binary, links long, other binary")


def near_classes(documents: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links) per row: the class of near copies and the number of other rows linked to it."""
    return _classes(documents, size, threshold, miss, block).select("doc_id", "class_id", "n_links")


def _classes(documents: DataFrame, size: int, threshold: float, miss: float, block: int, number: str | None = None) -> DataFrame:
    """``near_classes`` with the row key (a hash of id and text), the row number if there is one, and the class's root.

    The root is a node, null for rows without copies: unlike the class id, it is never shared by two classes.
    """
    signed = saved(signatures(documents, size, threshold, miss, number))
    nodes = saved(
        signed.filter("node is not null").groupBy("node")
        .agg(F.count("*").alias("copies"), F.min("doc_id").alias("least_id"), F.min("row").alias("row"), F.first("bands").alias("bands"))
    )
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = saved(banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("head")).filter("n > 1").select("bucket", "head"))
    parts = saved(components(banded.join(buckets, "bucket").select(F.col("node").alias("u"), F.col("head").alias("v"))))

    blocks = saved(parts.groupBy("root").agg(F.ceil(F.count("*") / block).cast("long").alias("n_blocks")).filter("n_blocks > 1"))
    small = nodes.select("node", "copies", "row", "least_id")
    members = saved(parts.join(small, "node").join(blocks, "root", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1).cast("long"))))
    sets = gram_sets(documents, members.select("row"), size)
    placed = members.join(sets, "node").select(
        "root", "node", "copies", "packed", "n_blocks", F.pmod(F.xxhash64("node"), F.col("n_blocks")).alias("block"))
    found = saved(verified(placed, threshold))

    links = found.filter("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.filter("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")))
    named = classes.join(small, "node").groupBy("root").agg(F.min("least_id").alias("class_id"))
    linked = classes.join(named, "root").join(links, "node").select("node", "root", "class_id", "links")
    copied = small.filter("copies > 1").select("node", "copies", "least_id")
    told = saved(
        linked.join(copied, "node", "full").select(
            "node", F.coalesce("root", "node").alias("root"), F.coalesce("class_id", "least_id").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"))
    )
    return signed.join(told, "node", "left").select(
        "row", "number", "root", "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def without_near_copies(documents: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """One document of each class stays, that with the least id; rows that repeat its id and text stay with it."""
    classes = _classes(documents, size, threshold, miss, block)
    others = F.col("class_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("class_id"))
    row = unused(documents, "row")
    gone = saved(classes.filter(others).select(F.col("row").alias(row)).distinct())
    keyed = documents.withColumn(row, F.xxhash64("doc_id", "text"))
    return keyed.join(gone, row, "left_anti").select(*documents.columns)


def one_row_of_each_class(documents: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """One row of each class stays, also of repeated rows, of texts that share an id and of rows without id.

    It is the least by id (null last), hash of id and text, and a row number. The number is written with the rows once,
    so that it means the same row wherever it is read. Rows without n-grams are in no class and stay.
    """
    name = unused(documents, "number")
    numbered = saved(documents.withColumn(name, F.monotonically_increasing_id()))
    members = saved(_classes(numbered, size, threshold, miss, block, name).filter("root is not null").select("root", "doc_id", "row", "number"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "number")
    stay = members.groupBy("root").agg(F.min(order).alias("least")).select(F.col("least.number").alias("number"))
    gone = saved(members.select("number").join(stay, "number", "left_anti").withColumnRenamed("number", name))
    return numbered.join(gone, name, "left_anti").select(*documents.columns)
