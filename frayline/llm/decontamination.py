"""Benchmark decontamination with a generalised suffix automaton (operator 1).

Test items are cut into normalised words (A-Z lower-cased; ASCII letters, digits and all non-ASCII characters make
words). Their windows are ``window`` consecutive words; a shorter item is one window. The items' automaton is broadcast,
document words are streamed through it, and a word is hit when it lies in an occurrence of a window, which shows as a
matching length of the window's size or more.

A benchmark has no fixed size, so its distinct rows are dealt by id and text into shards of about ``SHARD_BYTES`` text
each, whatever one id holds; one automaton is broadcast per pass, and passes hand their spans on. One shard, the usual
case, is one pass without any shuffle of documents. A single item longer than a shard is a shard of its own size.

Rows: null or empty text has no words; items without words hit nothing; windows of items with a null id hit but carry no
id; rows with the same id are one item; every document row gives one row, repeated rows and null ids included; an empty
benchmark leaves all documents clean; very long texts are read whole, by one task each. Further columns pass through
``decontaminate`` unchanged, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frayline.llm.automaton import SuffixAutomaton, merged
from frayline.llm.common import batched, saved, unused

WINDOW = 10
SHARD_BYTES = 2_000_000
COVERAGE = 0.8
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def normal_words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


class ItemMatcher:
    """The automaton of some items with the windows that end in each state."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int) -> None:
        self.window, self.auto, self.ids = window, SuffixAutomaton(), {}
        coded = [(ident, [self.ids.setdefault(w, len(self.ids) + 1) for w in words]) for ident, words in items if words]
        for _, words in coded:
            self.auto.add(words)
        self.full: dict[int, set] = {}  # state of a full window: its items
        self.short: dict[int, list] = {}  # state of a short item: (size, ids)
        for ident, words in coded:
            v, size = 0, min(window, len(words))
            for i, w in enumerate(words):
                v = self.auto.next[v][w]
                v = self.auto.holder(v, size) if i + 1 >= size else v
                if i + 1 >= size == window:
                    self.full.setdefault(v, set()).add(ident)
            if size < window:
                self.short.setdefault(v, []).append((size, ident))
        self.least = min((min(window, len(w)) for _, w in coded), default=0)
        pairs = {a << 32 | b for _, words in coded for a, b in zip(words, words[1:])}
        self.pairs = np.array(sorted(pairs) or [-1], dtype=np.int64)

    def _stretches(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of item words whose neighbours are neighbours in an item too, long enough for a window."""
        known = codes > 0
        if self.least > 1:
            pair = codes[:-1] << 32 | codes[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            known = self.pairs[at] == pair
        edges = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            b += self.least > 1
            if b - a >= self.least:
                yield a, b

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit word spans, and the ids of the items with occurring windows."""
        if not self.least or len(words) < self.least:
            return [], set()
        get, auto = self.ids.get, self.auto
        codes = np.array([get(w, 0) for w in words], dtype=np.int64)
        spans, found = [], set()
        for a, b in self._stretches(codes):
            for i, (size, v) in enumerate(auto.statistics(codes[a:b].tolist()), a + 1):
                if size >= self.window:
                    spans.append((i - self.window, i))
                    found |= self.full[auto.holder(v, self.window)]
                u = v
                while u > 0 and self.short:
                    for k, ident in self.short.get(u, ()):
                        if k <= size:
                            spans.append((i - k, i))
                            found.add(ident)
                    u = auto.link[u]
        return merged(spans), found


def shard_matcher(items: DataFrame, k: int, shards: int, window: int, id_column: str, text: str) -> ItemMatcher:
    """The matcher of shard k; only one shard is on the driver at a time."""
    own = items.filter(F.pmod(F.xxhash64(id_column, text), F.lit(shards)) == k).select(id_column, text)
    return ItemMatcher([(r[0], normal_words(r[1])) for r in own.toLocalIterator()], window)


def matched(documents: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES, clean: bool = False) -> tuple[DataFrame, list[str]]:
    """``documents`` with three more columns, and their names: hit word spans, occurring items, number of words.

    ``clean``: the last pass also takes the hit spans out of the text.
    """
    items = items.select(item_id, item_text).distinct()
    added = [unused(documents, name) for name in ("spans", "items", "words")]
    shards = max(1, -(-(items.agg(F.sum(F.octet_length(item_text))).first()[0] or 0) // shard_bytes))
    empty = F.lit(None).cast("array<struct<start:long,end:long>>"), F.lit(None).cast("array<long>"), F.lit(0).cast("long")
    found = documents.withColumns(dict(zip(added, empty)))
    for k in range(shards):
        matcher = documents.sparkSession.sparkContext.broadcast(shard_matcher(items, k, shards, window, item_id, item_text))
        found = _pass(saved(found) if k else found, matcher, text, added, clean and k == shards - 1)
    return found, added


def _pass(documents: DataFrame, matcher, text: str, added: list[str], clean: bool) -> DataFrame:
    spans_, items_, words_ = added

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = matcher.value
        for batch in batches:
            place = {n: batch.schema.get_field_index(n) for n in (text, spans_, items_, words_)}
            spans, items, sizes, texts = [], [], [], []
            for value, s, i in zip(batch.column(place[text]), batch.column(place[spans_]).to_pylist(), batch.column(place[items_]).to_pylist()):
                words = normal_words(value.as_py())
                hit, found = own.match(words)
                hit = merged([(x["start"], x["end"]) for x in s or ()] + hit)
                spans.append([{"start": a, "end": b} for a, b in hit])
                if clean:
                    texts.append(without_spans(value.as_py(), hit) if hit else value.as_py())
                items.append(sorted({*(i or ()), *(x for x in found if x is not None)}))
                sizes.append(len(words))
            new = {place[spans_]: spans, place[items_]: items, place[words_]: sizes} | ({place[text]: texts} if clean else {})
            columns = [pa.array(new[k], c.type) if k in new else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return batched(documents).mapInArrow(scan, documents.schema)


def contamination(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, hit words, items with occurring windows, their digest, and the verdict."""
    found, (spans, items_, words) = matched(documents.select("doc_id", "text"), items, window)
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform(items_, lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", F.col(words).alias("n_words"), hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def without_spans(value: str, spans: list[tuple[int, int]]) -> str:
    """``value`` without the given spans of normalised words; what stood around a removed span is joined by a space."""
    data = value.encode()
    places = [m.span() for m in _WORD.finditer(data.lower())]
    parts, at = [], 0
    for a, b in spans:
        parts.append(data[at : places[a][0]])
        at = places[b - 1][1]
    parts.append(data[at:])
    return " ".join(x.decode().strip() for x in parts).strip()


def decontaminate(documents: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, text: str = "text") -> DataFrame:
    """``documents`` without the spans that hit items; documents with at least ``coverage`` of their words hit go."""
    names = documents.columns
    found, (spans, _, words) = matched(documents, items, window, text, clean=True)
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.filter((hit == 0) | (hit < coverage * F.col(words))).select(*names)
