"""Best-two-fit packing of token sequences (operator 9).

Documents are encoded once; pieces of at most ``capacity`` tokens are packed by length classes. The histogram of piece
lengths has at most ``capacity`` rows, so the packing itself is planned on it: a bin is filled greedily with the largest
piece that fits, then its smallest piece gives way to two unpacked pieces that fill the widened gap more tightly, and
the finished pattern is used for as many bins as the counts allow. Pieces find their bin by their rank in their length
class; ranks come from counts per (write task, length), so no class is ever gathered in one task.

Rows: null text counts as empty (the closing id alone); repeated rows and null ids are packed like all others; an empty
table gives no rows; ties between equal lengths are settled by the order of writing. A very long text is encoded whole by
one task and cut into pieces of ``capacity``. Further columns are not read.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frayline.llm.common import batched, saved

CAPACITY = 2048
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _task int, _rank long"
# classes of these characters do not differ between the two libraries
_PLAIN = regex.compile(r"[^\t\n\r\x20-\x7e¡-ɏ‐-‧€]")


class Encoder:
    """Ids of a text as the tokenizer file gives them; plain texts go to a faster library with the same merges."""

    def __init__(self, path: str) -> None:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = special
        import public_tokenizers

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if _PLAIN.search(text) is None and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one, or full pieces after a first one that may be shorter."""
    if total <= capacity:
        return [(0, total)]
    head = total % capacity
    starts = ([0] if head else []) + list(range(head, total, capacity))
    return [(s, head if s == 0 and head else capacity) for s in starts]


def encoded_pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece; ``_task`` and ``_rank`` number the pieces of a length inside the task that wrote them."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen, enc = TaskContext.get().partitionId(), {}, encoder(path)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.asarray([*enc.ids(text.as_py() or ""), end_id], dtype="<u4")
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    rank = seen[length] = seen.get(length, -1) + 1
                    for col, x in zip(out, (ident, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), task, rank)):
                        col.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "_task", "_rank"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return batched(documents).select("doc_id", "text").mapInArrow(encode, _PIECES)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: pieces per bin}, number of bins) that hold all pieces."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    plans = []
    while left.any():
        bin_, gap = [], capacity
        while gap > 0:
            fits = np.flatnonzero(left[: gap + 1] > 0)
            if not len(fits):
                break
            x = int(fits[-1])
            left[x] -= 1
            bin_.append(x)
            gap -= x
        if gap > 0 and len(bin_) > 1:
            small = bin_[-1]
            pair = _tightest_pair(left, gap + small, small)
            if pair is not None:
                left[small] += 1
                bin_[-1:] = pair
                for x in pair:
                    left[x] -= 1
        need: dict[int, int] = {}
        for x in bin_:
            need[x] = need.get(x, 0) + 1
        more = int(min(left[x] // c for x, c in need.items()))
        for x, c in need.items():
            left[x] -= more * c
        plans.append((need, 1 + more))
    return plans


def _tightest_pair(left: np.ndarray, room: int, beat: int) -> tuple[int, int] | None:
    """Two unpacked pieces with the largest sum in (beat, room]."""
    there = np.flatnonzero(left[: room + 1] > 0)
    if not len(there):
        return None
    partner = np.searchsorted(there, room - there, side="right") - 1
    # a length can be its own partner only if two pieces of it are left
    alone = (partner >= 0) & (there[partner] == there) & (left[there] < 2)
    partner = np.where(alone, partner - 1, partner)
    sums = np.where(partner >= 0, there + there[partner], -1)
    best = int(sums.argmax())
    if sums[best] <= beat:
        return None
    a, b = int(there[best]), int(there[partner[best]])
    return max(a, b), min(a, b)


def slots(plans: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first rank, pieces per bin, first sequence and first offset of every pattern that uses it."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for need, bins in plans:
        at = 0
        for length, c in need.items():
            rows.setdefault(length, []).append((used.get(length, 0), c, sequence, at))
            used[length] = used.get(length, 0) + c * bins
            at += c * length
        sequence += bins
    return {length: tuple(np.array(x, dtype=np.int64) for x in zip(*r)) for length, r in rows.items()}


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece."""
    pieces = saved(encoded_pieces(documents, path, capacity, end_id))
    parts = saved(pieces.groupBy("length", "_task").agg(F.count("*").alias("n")))
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    table = pieces.sparkSession.sparkContext.broadcast(slots(plan_bins(counts, capacity)))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("length", "_task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("_at")).to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, edges) if len(order) else []:
                first, each, base, at = table.value[int(length[own[0]])]
                k = np.searchsorted(first, rank[own], side="right") - 1
                into = rank[own] - first[k]
                sequence[own] = base[k] + into // each[k]
                offset[own] = at[k] + into % each[k] * length[own[0]]
            keep = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    # the table has a row per length and write task, so it grows with the corpus: merged, never broadcast
    ranked = pieces.join(starts.hint("merge"), ["length", "_task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_first") + F.col("_rank")).alias("_at"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
