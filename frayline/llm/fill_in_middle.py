"""Fill-in-middle transformation (operator 12).

A text is cut into units, each a word with the white space before it, or white space at the end. The byte offsets at which
units end are kept in a ``BoundarySet``; the hashes of the document's id choose how many units the prefix and the middle end
after, and two selects return both cut offsets. Cuts fall between code points, as units do.

Rows: a null text is the empty one, which stays plain; a null id is hashed as empty digits; texts that hold one of the marks
stay plain, so a text can always be rebuilt; repeated rows give equal rows; texts of any length are cut whole (a text has
at most 2**31 bytes in Spark, the set holds offsets below 2**32); an empty table gives no rows; further columns are carried
by ``transformed`` and not read, columns of the names it adds are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string

from frayline.llm.boundary_set import BoundarySet
from frayline.llm.common import UNSPACED, batched

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 42
RATE = 50  # percent of texts that are transformed
SPM = 80  # percent of those with the suffix first
ADDED = "fim_text string, form string, n long, prefix_chars long, middle_chars long"


@dataclass(frozen=True)
class Rule:
    """Which texts are transformed, and how: percentages and the seed of the hash."""

    seed: int = SEED
    rate: int = RATE
    spm: int = SPM


def boundaries(data: bytes) -> BoundarySet:
    """Byte offsets at which the units of a text end."""
    letters = UNSPACED[np.frombuffer(data, dtype=np.uint8)]
    ends = np.flatnonzero(letters[:-1] & ~letters[1:]) + 1
    return BoundarySet(np.append(ends, len(data)) if data else ends)


def hashes(ident: object, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def cut(data: bytes, ident: object, rule: Rule) -> tuple[bytes, str, int, int | None, int | None]:
    """Output, form, number of units, and bytes at which prefix and middle end (none if plain)."""
    ends = boundaries(data)
    n = len(ends)
    h1, h2, h3, h4 = hashes(ident, rule.seed)
    if not data or PREFIX in data or SUFFIX in data or MIDDLE in data or h3 % 100 >= rule.rate:
        return data, "plain", n, None, None
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends.select(k - 1) if k else 0 for k in (first, second))
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < rule.spm:
        return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle, "spm", n, a, b
    return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle, "psm", n, a, b


def rebuilt(output: bytes, form: str) -> bytes:
    """The text behind an output."""
    if form == "plain":
        return output
    marks = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    head, _, middle = output.partition(marks[2])
    one, _, two = head[len(marks[0]) :].partition(marks[1])
    return two + middle + one if form == "spm" else one + middle + two


def _chars(data: bytes) -> int:
    """Code points of whole UTF-8."""
    return int(np.count_nonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80))


def _values(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield value.as_py() or b""


def _columns(batch: pa.RecordBatch, ident: str, text: str, rule: Rule) -> Iterator[tuple]:
    """Id, text and cut of every row; the texts are read one by one, so a batch is held once."""
    for key, data in zip(batch.column(ident).to_pylist(), _values(batch.column(text))):
        yield key, data, cut(data, key, rule)


def transformed(documents: DataFrame, rule: Rule = Rule(), ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with the transformed text, its form, units, and code points of prefix and middle."""
    added = _parse_datatype_string(ADDED)
    names = {f.name.lower() for f in added}
    kept = documents.select(*[c for c in documents.columns if c.lower() not in names])
    schema = StructType([*kept.schema.fields, *added.fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for _, data, (output, form, n, a, b) in _columns(batch, ident, text, rule):
                plain = a is None
                made.append((output.decode(), form, n, None if plain else _chars(data[:a]), None if plain else _chars(data[a:b])))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            new = [pa.array(list(v), k) for v, k in zip(zip(*made) if made else [[]] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *added.names])

    return batched(kept).mapInArrow(scan, schema)


DIGEST = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def digests(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Per document: units, form, code points of prefix and middle, digests of the output and of the text rebuilt from it."""
    names = [f.name for f in _parse_datatype_string(DIGEST)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, data, (output, form, n, a, b) in _columns(batch, "doc_id", "text", rule):
                counts = (None, None) if a is None else (_chars(data[:a]), _chars(data[a:b]))
                rows.append((key, n, form, *counts, hashlib.sha256(output).hexdigest(), hashlib.sha256(rebuilt(output, form)).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)

    return batched(documents.select("doc_id", "text")).mapInArrow(scan, DIGEST)


def restored(rows: DataFrame, text: str = "text") -> DataFrame:
    """``transformed`` rows with ``text`` rebuilt from the output and its form alone."""
    schema = rows.drop(text).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(batch.schema.get_field_index("fim_text"))
            forms = batch.column(batch.schema.get_field_index("form")).to_pylist()
            texts = pa.array([rebuilt(v, f).decode() for v, f in zip(_values(own), forms)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, text])

    return batched(rows.drop(text)).mapInArrow(scan, StructType([*schema.fields, *_parse_datatype_string(f"`{text}` string").fields]))
