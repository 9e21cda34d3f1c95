"""Chat formatting with offset-aligned loss masks (operator 10).

A conversation is rendered as one text, encoded once with offsets, and the sorted spans of assistant texts are cut with
the sorted token spans by binary search. Every span of text under the mask is kept in characters as well, so a token
that straddles a turn border adds exactly its part inside the turn.

Template, per turn: ``<|turn|>`` role newline text ``<|end|>``. Inside roles and texts a backslash is doubled and ``<|``
becomes ``<\\|``; in roles a newline becomes ``\\n``. ``parse`` undoes both.

Rows: null role or text counts as empty; turns go by (turn, role, text), nulls first, so ties and repeated rows have a
fixed place; rows of a null conversation form one conversation; an empty table gives no rows. A conversation is one
training example and one output row, which bounds what a task holds.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frayline.llm.common import batched

OPEN, CLOSE = "<|turn|>", "<|end|>"
_ESCAPED = re.compile(r"\\([\\|n])")
FORMATTED = "conv_id long, formatted string, input_ids array<int>, loss_mask array<boolean>, loss_starts array<long>, loss_ends array<long>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text and the character spans of the texts to learn, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role).replace("\n", "\\n") + "\n", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns back from the rendered text."""
    turns = []
    for part in formatted.split(CLOSE)[:-1]:
        role, _, text = part.removeprefix(OPEN).partition("\n")
        turns.append((unescape(role), unescape(text)))
    return turns


def aligned(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Token mask, and the characters under it: token spans cut with turn spans, each character once."""
    mask = np.zeros(len(offsets), dtype=bool)
    kept: list[tuple[int, int]] = []
    if not offsets:
        return mask, kept
    places = np.asarray(offsets, dtype=np.int64)
    for start, end in spans:
        first = int(np.searchsorted(places[:, 1], start, side="right"))
        last = int(np.searchsorted(places[:, 0], end, side="left"))
        if start == end or first >= last:
            continue
        mask[first:last] = True
        begin, stop = np.maximum(places[first:last, 0], start), np.minimum(places[first:last, 1], end)
        # a character whose bytes fall to several tokens counts with the first
        begin = np.maximum(begin, np.concatenate([[start], np.maximum.accumulate(stop)[:-1]]))
        for a, b in zip(begin.tolist(), stop.tolist()):
            if a >= b:
                continue
            if kept and kept[-1][1] == a:
                kept[-1] = (kept[-1][0], b)
            else:
                kept.append((a, b))
    return mask, kept


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def format_conversations(rows: DataFrame, path: str) -> DataFrame:
    """One row per conversation: rendered text, ids, token mask and the character spans under the mask."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for ident, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text, spans = render([(t["role"] or "", t["text"] or "") for t in turns])
                got = tok.encode(text, add_special_tokens=False)
                mask, kept = aligned(got.offsets, spans)
                for col, x in zip(out, (ident, text, got.ids, mask.tolist(), [a for a, _ in kept], [b for _, b in kept])):
                    col.append(x)
            kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            names = ["conv_id", "formatted", "input_ids", "loss_mask", "loss_starts", "loss_ends"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    turns = batched(rows).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return turns.mapInArrow(encode, FORMATTED)


def digests(formatted: DataFrame) -> DataFrame:
    """What the output says: turns parsed from the text, and the unescaped text under the mask."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for ident, text, starts, ends in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_starts", "loss_ends"))):
                turns = parse(text)
                learned = unescape("".join(text[a:b] for a, b in zip(starts, ends)))
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                digest = [hashlib.sha256(x.encode()).hexdigest() for x in (said, learned)]
                for col, x in zip(out, (ident, len(turns), digest[0], len(learned), digest[1], len(text))):
                    col.append(x)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return formatted.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
