"""Token counts per document from distinct pre-tokens (operator 7).

Tokens of a document are the tokens of its pre-tokens, which are encoded apart. So pieces are counted once for each
distinct pre-token of the corpus, and a document's count is the sum of frequency times pieces; no ids are made.

* ``vocabulary``: distinct pre-tokens with corpus frequency and piece count.
* Pre-tokens with a frequency of at least N / ``frequent`` (N: pre-tokens of the corpus) number at most ``frequent``;
  only they are broadcast. All rarer ones go through a join, pre-aggregated per document.

Rows: null text counts as empty; empty texts have 0 tokens; every row of the input gives one row, repeated rows and
null ids included; further columns do not matter.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frayline.llm.common import batched, saved

FREQUENT = 400_000
LIMIT = 2048
_FLUSH = 300_000
# letters whose normal form, case mapping and classes are the same in every Unicode version
_PLAIN = regex.compile(r"[^\t\n\r\x20-\x7e¡-¬®-įı-ňŊ-ž]")


class PreTokens:
    """Pre-tokens of a text as the tokenizer file defines them (normaliser, then pre-tokenizer)."""

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(split)
        self.to_text = {c: b for b, c in self._alphabet(pre_tokenizers).items()}
        self.to_letters = {b: c for c, b in self.to_text.items()}

    @staticmethod
    def _alphabet(pre_tokenizers) -> dict[int, str]:
        """Byte value to the letter that stands for it in the vocabulary, asked of the library byte by byte."""
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = {}
        for value in range(128):
            letters[value] = level.pre_tokenize_str(chr(value))[0][0]
        for lead in range(0xC2, 0xF5):
            for low in range(0x80, 0xC0):
                tail = {0xE0: b"\xa0\x80", 0xF0: b"\x90\x80\x80"}.get(lead)
                raw = bytes([lead, low]) if lead < 0xE0 else bytes([lead]) + (
                    tail if tail else b"\x80" * (2 if lead < 0xF0 else 3))
                try:
                    shown = level.pre_tokenize_str(raw.decode())[0][0]
                except UnicodeDecodeError:
                    continue
                letters.update(zip(raw, shown))
                if lead >= 0xE0:
                    break
        return letters

    def of(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens and the number of special tokens in the text."""
        if self.special is not None and "<" in text and self.special.search(text):
            parts = self.special.split(text)
            found = [x for part in parts for x in self._plain(part)]
            return found, len(parts) - 1
        return self._plain(text), 0

    def _plain(self, text: str) -> list[str]:
        if not text:
            return []
        if _PLAIN.search(text) is None:
            return self.pattern.findall(unicodedata.normalize("NFC", text).lower())
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        return [bytes(self.to_text[c] for c in piece).decode("utf-8") for piece, _ in pieces]

    def pieces(self, pre_token: str) -> int:
        return len(self.model.tokenize("".join(self.to_letters[b] for b in pre_token.encode())))


@functools.lru_cache(maxsize=2)
def pre_tokens(path: str) -> PreTokens:
    return PreTokens(path)


def vocabulary(documents: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(pre_token, n, pieces): every distinct pre-token, its corpus frequency and its number of tokens."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, counts = pre_tokens(path), Counter()
        for batch in batches:
            for value in batch.column(0):
                counts.update(cut.of(value.as_py() or "")[0])
                if len(counts) >= _FLUSH:
                    yield _pairs(counts)
                    counts = Counter()
        if counts:
            yield _pairs(counts)

    def count_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = pre_tokens(path)
        for batch in batches:
            pieces = [cut.pieces(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces, pa.int64())], ["pre_token", "n", "pieces"])

    counts = batched(documents).select(F.col(text)).mapInArrow(tally, "pre_token string, n long")
    distinct = counts.groupBy("pre_token").agg(F.sum("n").alias("n"))
    return distinct.mapInArrow(count_pieces, "pre_token string, n long, pieces long")


def _pairs(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pre_token", "n"])


def count_tokens(documents: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", frequent: int = FREQUENT, limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``documents``."""
    spark = documents.sparkSession
    words = saved(vocabulary(documents, path, text))
    total = words.agg(F.sum("n")).first()[0] or 0
    # at most ``frequent`` pre-tokens can reach this frequency
    known = words.filter(F.col("n") >= max(1, -(-total // frequent))).select("pre_token", "pieces").toArrow()
    common = spark.sparkContext.broadcast(dict(zip(known.column(0).to_pylist(), known.column(1).to_pylist())))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for the known part of each document and one for each rare pre-token in it."""
        cut, known = pre_tokens(path), common.value
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for row, ident, value in zip(*(c.to_pylist() for c in batch.columns)):
                found, special = cut.of(value or "")
                tokens, rare = special, []
                for x in found:
                    p = known.get(x)
                    if p is None:
                        rare.append(x)
                    else:
                        tokens += p
                # no pre-token begins with a space: this key meets nothing and spreads these rows
                for col, x in zip(out, (row, ident, len((value or "").encode()), tokens, f" {row}", 0)):
                    col.append(x)
                for x, n in Counter(rare).items():
                    for col, y in zip(out, (row, None, None, 0, x, n)):
                        col.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _KINDS)], _NAMES)

    numbered = documents.select(F.monotonically_increasing_id().alias("_row"), F.col(id_column).alias("_id"), F.col(text).alias("_text"))
    parts = numbered.mapInArrow(sums, "_row long, _id long, n_bytes long, known long, pre_token string, times long")
    rare = words.select("pre_token", "pieces")
    return (
        parts.join(rare, "pre_token", "left")
        .groupBy("_row")
        .agg(
            F.max("_id").alias(id_column),
            F.max("n_bytes").alias("n_bytes"),
            F.sum(F.col("known") + F.col("times") * F.coalesce("pieces", F.lit(0))).alias("n_tokens"),
        )
        .withColumn("over_limit", F.col("n_tokens") > limit)
        .drop("_row")
    )


_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
_NAMES = ["_row", "_id", "n_bytes", "known", "pre_token", "times"]
