"""Embedding whitening (operator 13).

Entries become whole numbers, x = floor(1024 * c) + 100000. One pass sums them exactly, a second sums centred products, both
as one small partial result per task that Spark adds up by matrix place. The driver gets sums and covariance only (d and
d * d / 2 numbers for vectors of length d), finds the leading components by ``symmetric_eigen`` and broadcasts the
projection of ``components`` * d numbers. The third pass projects; its result is written, and the covariance of what was
written tells how far from the identity it is.

Rows: a vector takes no part if it is null or empty or holds a null or non-finite entry; a null id is kept as it is;
vectors of one length are one fit of their own; repeated rows count as often as they stand; components whose eigenvalue is
0 up to rounding are left out (all of them where all vectors are equal), as are those beyond the length; an empty table
gives no rows; an entry whose x does not fit 62 bits is an error, as is a deviation beyond 38 digits; further columns are
carried by ``projected``, the names it adds are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from frayline.llm.common import saved
from frayline.llm.symmetric_eigen import EPS, leading

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
MODEL_BYTES = 1 << 28  # of all broadcast projections together; lengths differ in a few values, if at all
_LIMIT = 2.0**62


@dataclass
class Model:
    """Fit of the vectors of one length: count, exact sums, components as rows, eigenvalues, trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def whole(entries: np.ndarray) -> np.ndarray:
    x = np.floor(SCALE * entries)
    if len(x) and np.abs(x).max() >= _LIMIT:
        raise OverflowError("an entry is too large for a whole number of 62 bits")
    return x.astype(np.int64) + SHIFT


def groups(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and entries (rows x length) of the usable vectors of a batch, by length."""
    offsets = column.offsets.to_numpy()
    entries = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    sizes = np.diff(offsets)
    fine = column.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]]) & (sizes > 0)
    for size in np.unique(sizes[fine]).tolist():
        rows = np.flatnonzero(fine & (sizes == size))
        yield rows, entries[offsets[rows][:, None] + np.arange(size)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: in 64 bits where all fit, else as Python's numbers."""
    if n * max(int(x.max()), -int(x.min())) < _LIMIT and max(map(abs, sums)) < _LIMIT:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def squares(y: np.ndarray) -> list[int]:
    """Sum of squares of every row, exact."""
    if y.dtype != object and float(np.abs(y).max()) ** 2 * y.shape[1] < _LIMIT:
        return (y * y).sum(axis=1).tolist()
    y = y.astype(object)
    return (y * y).sum(axis=1).tolist()


def _sums(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for rows, entries in groups(batch.column(0)):
                n, s = found.get(entries.shape[1], (0, 0))
                found[entries.shape[1]] = n + len(rows), s + whole(entries).astype(object).sum(axis=0)
        for d, (n, s) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(v) for v in s], pa.decimal128(38, 0))], ["d", "i", "n", "s"]
            )

    rows = vectors.mapInArrow(scan, "d int, i int, n long, s decimal(38,0)").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in rows.collect():  # a row for each place of a vector
        found.setdefault(r.d, (r.n, [0] * r.d))[1][r.i] = int(r.s)
    return found


def _products(vectors: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Covariance by length, from centred products."""
    fit = vectors.sparkSession.sparkContext.broadcast(sums)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, entries in groups(batch.column(0)):
                d = entries.shape[1]
                n, s = fit.value[d]
                y = centred(whole(entries), n, s).astype(np.float64) / n
                found[d] = found.get(d, 0.0) + y.T @ y
        for d, products in found.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(products[i, j])], ["d", "i", "j", "v"])

    rows = vectors.mapInArrow(scan, "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    d, i, j, v = (c.to_numpy() for c in rows.columns)
    found = {}
    for size, (n, _) in sums.items():
        own = d == size
        found[size] = np.zeros((size, size))
        found[size][i[own], j[own]] = found[size][j[own], i[own]] = v[own] / n
    return found


def fitted(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> dict[int, Model]:
    """The fit of all usable vectors, by length."""
    rows = vectors.select(column)
    sums = _sums(rows)
    models = {}
    for d, covariance in _products(rows, sums).items():
        values, found = leading(covariance, components)
        real = values > 4 * max(d, 8) * EPS * max(values[0], 0.0)
        models[d] = Model(*sums[d], found[real], values[real], float(np.trace(covariance)))
    if sum(m.vectors.nbytes + 40 * d for d, m in models.items()) > MODEL_BYTES:
        raise ValueError("the projections of all vector lengths are too large to broadcast")
    return models


ADDED = "n long, deviation decimal(38,0), whitened array<struct<component:int,whitened:double,explained:double>>"


def projected(vectors: DataFrame, models: dict[int, Model], column: str = "embedding") -> DataFrame:
    """Usable rows of ``vectors`` with the size of their fit, exact deviation, and whitened components."""
    names = [f.name for f in _parse_datatype_string(ADDED)]
    kept = vectors.select(*[c for c in vectors.columns if c.lower() not in names])
    schema = StructType([*kept.schema.fields, *_parse_datatype_string(ADDED).fields])
    fit = vectors.sparkSession.sparkContext.broadcast(models)
    place = [c.lower() for c in kept.columns].index(column.lower())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, entries in groups(batch.column(place)):
                m = fit.value[entries.shape[1]]
                y, k = centred(whole(entries), m.n, m.sums), len(m.values)
                w = (y.astype(np.float64) / m.n) @ m.vectors.T / np.sqrt(m.values)
                flat = pa.StructArray.from_arrays(
                    [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(w.reshape(-1)), pa.array(np.tile(m.values / m.trace if k else m.values, len(rows)))],
                    ["component", "whitened", "explained"],
                )
                new = [
                    pa.array(np.full(len(rows), m.n), pa.int64()), pa.array([Decimal(v) for v in squares(y)], pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * k, pa.int32()), flat),
                ]
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, *new], [*batch.schema.names, *names])

    return kept.mapInArrow(scan, schema)


def identity_error(rows: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> float:
    """Largest distance from the identity of the covariance of ``projected`` rows, over all vector lengths."""
    w = lambda i: F.get("whitened", F.lit(i))["whitened"]
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    means = rows.groupBy("_d").agg(*[F.avg(w(i)).alias(f"m{i}") for i in range(components)]).collect()
    if not means:
        return 0.0
    mean = lambda i: F.coalesce(*[F.when(F.col("_d") == r._d, F.lit(r[f"m{i}"])) for r in means])
    found = rows.groupBy("_d").agg(*[(F.avg((w(i) - mean(i)) * (w(j) - mean(j))) - float(i == j)).alias(f"c{i}_{j}") for i, j in pairs]).drop("_d")
    return max((abs(v) for r in found.collect() for v in r if v is not None), default=0.0)


def whitened(vectors: DataFrame, components: int = COMPONENTS, ident: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Per usable row and component: id, component, n, deviation, whitened, explained and the one identity error."""
    vectors = vectors.select(ident, column)
    models = fitted(vectors, components, column)
    rows = saved(projected(vectors, models, column).withColumn("_d", F.size(column)).drop(column))
    error = identity_error(rows, components)
    return rows.select(ident, "n", "deviation", F.inline("whitened")).withColumn("identity_error", F.lit(error))
