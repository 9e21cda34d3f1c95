"""Substring dedup with suffix automata of reference shards (operator 2).

Words are runs without ASCII white space. A word goes when it lies in a window of ``window`` words that occurs elsewhere.

Against a reference table (``without_reference_spans``) an automaton per shard of bounded size is broadcast and documents
are streamed through it, one pass per shard.

Against the corpus itself (``repeats``) automata of all shards would be as large as the corpus, so nothing is broadcast:
the shards are dealt to tasks, and only stretches that can match are streamed through them.

1. Every window elects an anchor, the least of its ``gram``-word hashes; equal windows elect equal anchors at equal places.
2. Anchors that occur once rule their windows out. Every other anchor has an owner, its least (text, ordinal). Owners
   cut repeated text into reference shards of ``BLOCK`` anchors, so copies of a passage meet in the passage's own shard.
3. A text's windows whose anchors belong to a shard form fragments. Equal fragments of a shard become one with a count,
   before they are shuffled. The shard's task builds one automaton with counts over its distinct fragments and reads the
   matching statistics of each: a window is repeated if its state occurs more than once.
4. A shard with more than ``SHARD_WORDS`` words of distinct fragments is dealt anew as single windows, which pre-aggregate.

Equal texts are handled once, with their number of copies; texts are told apart by their md5. Anchor
hashes only choose what meets; what is removed is decided on the words. Rows: null text has no words and stays; texts without white space are one word; repeated rows are copies of
each other, hence removed like other repeats; an empty table gives no rows; further columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frayline.llm.automaton import SuffixAutomaton, merged
from frayline.llm.common import batched, saved, unused, window_hashes, word_bounds, word_hashes

WINDOW = 35
GRAM = 12
BLOCK = 24
SHARD_WORDS = 400_000
REFERENCE_BYTES = 2_000_000


def elected(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor hashes in order, and the first window of each, with the number of windows at the end."""
    grams = window_hashes(words, gram)
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64), np.zeros(1, dtype=np.int64)
    width = window - gram + 1
    place = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return grams[place[first]], np.append(first, n)


def _hashed(text: str | None) -> tuple[list[bytes], np.ndarray]:
    data = (text or "").encode()
    raw = np.frombuffer(data, dtype=np.uint8)
    return data.split(), word_hashes(raw, *word_bounds(raw))


def _keyed(documents: DataFrame) -> DataFrame:
    return batched(documents).select("doc_id", text_key().alias("key"), "text")


def text_key() -> Column:
    """128 bits of the text; null for null."""
    return F.unhex(F.md5(F.col("text").cast("binary")))


def scanned(documents: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, key, n_words, digest of all words, anchors) per row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, anchors = [], [], []
            for value in batch.column(2):
                words, hashes = _hashed(value.as_py())
                sizes.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                anchors.append(elected(hashes, window, gram)[0].view(np.int64))
            arrays = [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(digests), pa.array(anchors, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "n_words", "digest", "anchors"])

    return _keyed(documents).mapInArrow(scan, "doc_id long, key binary, n_words long, digest string, anchors array<long>")


def _fragments(documents: DataFrame, lists: DataFrame, window: int, gram: int) -> DataFrame:
    """Texts with repeated anchors: their words, and their stretches per reference shard."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = [], []
            for value, marks in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                words, hashes = _hashed(value)
                first = elected(hashes, window, gram)[1]
                shards = {m["k"]: (m["owner"], m["block"]) for m in marks if m["k"] < len(first) - 1}
                own, run = [], None
                for k in sorted(shards):
                    a, b = int(first[k]), int(first[k + 1]) + window - 1
                    if run is not None and run[0] == shards[k] and run[3] == k:
                        run[2], run[3] = b, k + 1
                    else:
                        run = [shards[k], a, b, k + 1]
                        own.append(run)
                texts.append(b" ".join(words).decode())
                found.append([{"owner": s[0], "block": s[1], "start": a, "words": b" ".join(words[a:b]).decode()} for s, a, b, _ in own])
            kind = pa.list_(pa.struct([("owner", pa.int64()), ("block", pa.int64()), ("start", pa.int64()), ("words", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2), pa.array(found, kind)], ["key", "words", "copies", "found"])

    # a text may stand on many rows: it is cut once
    once = _keyed(documents).groupBy("key").agg(F.first("text").alias("text"))
    own = once.join(lists, "key").select("key", "text", "copies", "marks")
    return own.mapInArrow(cut, "key binary, words string, copies long, found array<struct<owner:long,block:long,start:long,words:string>>")


def _windows(value: str, window: int) -> list[str]:
    words = value.split(" ")
    return [" ".join(words[i : i + window]) for i in range(len(words) - window + 1)]


def _dealt_anew(fragments: DataFrame, window: int, shard_words: int) -> DataFrame:
    """``fragments`` with those of oversized shards cut into single windows, each a shard of its own."""
    distinct = fragments.groupBy("owner", "block", "words").agg(F.count("*").alias("n"))
    size = F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1
    large = saved(distinct.groupBy("owner", "block").agg(F.sum(size).alias("size")).filter(F.col("size") > shard_words).select("owner", "block", F.lit(True).alias("large")))
    if large.isEmpty():
        return fragments

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pieces = _windows(row["words"], window)
                yield pa.RecordBatch.from_pylist([row | {"start": row["start"] + i, "words": w} for i, w in enumerate(pieces)], batch.schema)

    marked = fragments.join(large, ["owner", "block"], "left")
    small = marked.filter("large is null").select(*fragments.columns)
    single = marked.filter("large").select(*fragments.columns).mapInArrow(cut, fragments.schema)
    return small.unionByName(single.withColumn("sub", F.xxhash64("words")))


def _shard_repeats(distinct: DataFrame, window: int) -> DataFrame:
    """Covered (first word, end) stretches of every distinct fragment, found in its shard's automaton."""
    keys = ["owner", "block", "sub"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []

        def result() -> pa.RecordBatch:
            auto = SuffixAutomaton()
            for words, n, _ in rows:
                auto.add(words, n)
            auto.finish()
            out = []
            for words, _, ident in rows:
                covered = merged([(i, i + window) for i in auto.repeated(words, window)])
                out += [(*shard, ident, a, b) for a, b in covered]
            columns = zip(*out) if out else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], [*keys, "ident", "first", "end"])

        for batch in batches:
            for owner, block, sub, ident, n, words in zip(*(batch.column(c).to_pylist() for c in (*keys, "ident", "n", "words"))):
                if (owner, block, sub) != shard:
                    if rows:
                        yield result()
                    shard, rows = (owner, block, sub), []
                rows.append((words.split(" "), n, ident))
        if rows:
            yield result()

    ordered = distinct.repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(search, "owner long, block long, sub long, ident long, first long, end long")


def repeats(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """(rows, removed): the scanned rows, and per text key its number of removed words, kept words and their digest."""
    rows = saved(scanned(documents, window, gram))
    anchors = rows.select("key", F.posexplode("anchors").alias("k", "anchor"))
    # owners only name shards: two texts of one hash would share theirs, and no window less would be judged
    owners = anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("key").alias("text"), "k")).alias("own"))
    owners = saved(owners.filter("n > 1").select("anchor", F.col("own.text").alias("owner"), F.floor(F.col("own.k") / BLOCK).alias("block")))
    marks = anchors.join(owners, "anchor").groupBy("key").agg(
        F.count("*").alias("n"), F.collect_set(F.struct("k", "owner", "block")).alias("marks"))
    # every copy of a text gives the same marks
    lists = marks.select("key", "marks", (F.col("n") / F.size("marks")).cast("long").alias("copies"))
    texts = saved(_fragments(documents, lists, window, gram))

    fragments = texts.select("key", "copies", F.explode("found").alias("f")).select("key", "copies", "f.*").withColumn("sub", F.lit(0).cast("long"))
    fragments = _dealt_anew(fragments, window, shard_words).withColumn("ident", F.xxhash64("words"))
    place = ["owner", "block", "sub", "ident"]
    distinct = fragments.groupBy(*place, "words").agg(F.sum("copies").alias("n"))
    covered = saved(_shard_repeats(distinct, window))
    spans = fragments.select("key", "start", *place).join(covered, place).select(
        "key", F.struct((F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("end")).alias("b")).alias("span"))
    spans = spans.groupBy("key").agg(F.collect_set("span").alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, kept, digests = [], [], []
            for value, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words, parts, at, n = value.split(" "), [], 0, 0
                for a, b in merged([(s["a"], s["b"]) for s in found]):
                    parts += words[at:a]
                    at, n = b, n + b - a
                kept.append(" ".join(parts + words[at:]))
                gone.append(n)
                digests.append(hashlib.sha256(kept[-1].encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(digests)], ["key", "gone", "kept", "kept_digest"])

    removed = texts.select("key", "words").join(spans, "key").select("key", "words", "spans")
    return rows, removed.mapInArrow(remove, "key binary, gone long, kept string, kept_digest string")


def removal_counts(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row."""
    rows, removed = repeats(documents, window)
    removed = saved(removed.drop("kept"))
    return rows.join(removed, "key", "left").select(
        "doc_id", "n_words", F.coalesce("gone", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_digest", "digest").alias("kept_sha256"))


def without_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """``documents`` without repeated stretches; a text that loses words keeps the rest joined by one space, and
    a row that loses all its words goes."""
    names = documents.columns
    _, removed = repeats(documents, window)
    key, kept = unused(documents, "key"), unused(documents, "kept")
    removed = saved(removed.select(F.col("key").alias(key), F.col("kept").alias(kept)))
    joined = documents.withColumn(key, text_key()).join(removed, key, "left").filter(F.col(kept).isNull() | (F.col(kept) != ""))
    return joined.withColumn("text", F.coalesce(kept, "text")).select(*names)


def without_reference_spans(documents: DataFrame, references: DataFrame, window: int = WINDOW, shard_bytes: int = REFERENCE_BYTES) -> DataFrame:
    """``documents`` without the stretches of at least ``window`` words that also stand in ``references`` (column text)."""
    spark, names = documents.sparkSession, documents.columns
    shards = max(1, -(-(references.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))
    for k in range(shards):
        own = references.filter(F.pmod(F.xxhash64("text"), F.lit(shards)) == k).select("text")
        auto = SuffixAutomaton()
        for (text,) in own.toLocalIterator():
            auto.add((text or "").encode().split())
        # words cut from the middle must not bring new neighbours together: a mark stays until all shards are done
        documents = _pass(documents if k == 0 else saved(documents), spark.sparkContext.broadcast(auto), window)
    return documents.withColumn("text", F.trim(F.regexp_replace("text", "(?: ?\x00)+", ""))).select(*names)


def _pass(documents: DataFrame, automaton, window: int) -> DataFrame:
    place = documents.columns.index("text")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton.value
        for batch in batches:
            out = []
            for value in batch.column(place).to_pylist():
                words = (value or "").encode().split()
                spans = merged([(i - n, i) for i, (n, _) in enumerate(auto.statistics(words), 1) if n >= window])
                for a, b in reversed(spans):
                    words[a:b] = [b"\x00"]
                out.append(b" ".join(words).decode() if spans else value)
            columns = [pa.array(out, c.type) if k == place else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return batched(documents).mapInArrow(stream, documents.schema)
