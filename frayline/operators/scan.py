"""Running values over ordered rows that survive hot keys.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. Here rows are
windowed inside (key, time chunk) only; what crosses a chunk border is a carry,
computed from one pre-aggregated row per (key, chunk) and joined back. A key
holding a third of all rows is thus spread over its chunks, and the only
key-wide window runs over chunk summaries.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_MS = 60_000
ORDER = ("time_ms", "seq")


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` says how ``value`` is combined along the order.

    last / prev   last non-null value up to and including / strictly before the row
    next          first non-null value strictly after the row
    sum / before  running sum including / excluding the row
    max / min     running extreme including the row
    max_before    running maximum excluding the row
    """

    name: str
    kind: str
    value: Column


_UNBOUNDED = Window.unboundedPreceding


def _windows(by: Sequence[str], ordering: Sequence[Column]) -> tuple:
    """The window of a key in order, and in the order turned round: a frame that ends with the partition starts anew at
    every row, which is quadratic, so what follows a row is read as what came before it in the other direction.
    """
    return Window.partitionBy(*by).orderBy(*[c.asc() for c in ordering]), Window.partitionBy(*by).orderBy(*[c.desc() for c in ordering])


def _local(step: Running, windows: tuple) -> Column:
    w, back = windows
    through = w.rowsBetween(_UNBOUNDED, Window.currentRow)
    earlier = w.rowsBetween(_UNBOUNDED, -1)
    later = back.rowsBetween(_UNBOUNDED, -1)
    return {
        "last": lambda v: F.last(v, True).over(through),
        "prev": lambda v: F.last(v, True).over(earlier),
        "next": lambda v: F.last(v, True).over(later),
        "sum": lambda v: F.coalesce(F.sum(v).over(through), F.lit(0)),
        "before": lambda v: F.coalesce(F.sum(v).over(earlier), F.lit(0)),
        "max": lambda v: F.max(v).over(through),
        "min": lambda v: F.min(v).over(through),
        "max_before": lambda v: F.max(v).over(earlier),
    }[step.kind](step.value)


def _summary(step: Running, order: Column) -> Column:
    v = step.value
    position = F.when(v.isNotNull(), order)
    return {
        "last": lambda: F.max_by(v, position),
        "prev": lambda: F.max_by(v, position),
        "next": lambda: F.min_by(v, position),
        "sum": lambda: F.sum(v),
        "before": lambda: F.sum(v),
        "max": lambda: F.max(v),
        "min": lambda: F.min(v),
        "max_before": lambda: F.max(v),
    }[step.kind]()


def _carry(step: Running, column: str, windows: tuple) -> Column:
    w, back = windows
    earlier = w.rowsBetween(_UNBOUNDED, -1)
    later = back.rowsBetween(_UNBOUNDED, -1)
    v = F.col(column)
    return {
        "last": lambda: F.last(v, True).over(earlier),
        "prev": lambda: F.last(v, True).over(earlier),
        "next": lambda: F.last(v, True).over(later),
        "sum": lambda: F.sum(v).over(earlier),
        "before": lambda: F.sum(v).over(earlier),
        "max": lambda: F.max(v).over(earlier),
        "min": lambda: F.min(v).over(earlier),
        "max_before": lambda: F.max(v).over(earlier),
    }[step.kind]()


def _combine(step: Running, local: Column, carry: Column) -> Column:
    if step.kind in ("last", "prev", "next"):
        return F.coalesce(local, carry)
    if step.kind in ("sum", "before"):
        return local + F.coalesce(carry, F.lit(0))
    if step.kind == "min":
        return F.least(local, carry)
    return F.greatest(local, carry)


def _co_located(chunked: DataFrame, keys: list[str]) -> DataFrame:
    """One shuffle by (keys, chunk) that the row side and the summary side both read.

    The pair is one struct: structs with nulls inside are equal to each other, so rows with a null key or a null time
    keep their carry in a plain equi-join.
    """
    placed = chunked.select(F.struct(*keys, "_chunk").alias("_place"), *[c for c in chunked.columns if c not in (*keys, "_chunk")])
    # keys are read back from the place: they are shuffled once, and no reader needs other columns because of them
    back = [F.col(f"_place.{c}").alias(c) if c in (*keys, "_chunk") else F.col(c) for c in chunked.columns]
    return placed.repartition("_place").select("_place", *back)


def _whole_row(chunked: DataFrame, place: Column) -> Column:
    """A value of all columns. It makes both sides need the same columns, so Spark plans one exchange and reuses it; pruning
    would otherwise shuffle the input twice. As a number it is aggregated in place; maps have no hash, the last row stands in.
    """
    columns = [F.col(c) for c in chunked.columns]
    if any("map<" in kind for _, kind in chunked.dtypes):
        return F.max_by(F.struct(*columns), place).alias("_whole")
    return F.max(F.xxhash64(*columns)).alias("_whole")


def running(
    df: DataFrame,
    keys: Sequence[str],
    steps: Sequence[Running],
    order: Sequence[str] = ORDER,
    chunk_ms: int | None = CHUNK_MS,
) -> DataFrame:
    """``df`` plus one column per step. ``order`` must be total; its first column is a time in ms.

    ``chunk_ms=None`` is the plain single-window form for keys known to be small.
    """
    keys = list(keys)
    ordering = [F.col(c) for c in order]
    if chunk_ms is None:
        w = _windows(keys, ordering)
        return df.withColumns({s.name: _local(s, w) for s in steps})
    chunked = _co_located(df.withColumn("_chunk", F.floor(F.col(order[0]) / chunk_ms)), keys)
    w = _windows(["_place"], ordering)
    local = chunked.withColumns({f"_l_{s.name}": _local(s, w) for s in steps})
    place = F.struct(*ordering)
    chunks = chunked.groupBy("_place").agg(
        *[_summary(s, place).alias(f"_s_{s.name}") for s in steps], _whole_row(chunked, place)
    ).select("*", "_place.*")
    over_chunks = _windows(keys, [F.col("_chunk")])
    carries = chunks.filter("_whole is not null").select(
        "_place", *[_carry(s, f"_s_{s.name}", over_chunks).alias(f"_c_{s.name}") for s in steps]
    )
    rows = local.join(carries, "_place")
    rows = rows.withColumns({s.name: _combine(s, F.col(f"_l_{s.name}"), F.col(f"_c_{s.name}")) for s in steps})
    return rows.drop("_place", "_chunk", *[f"_l_{s.name}" for s in steps], *[f"_c_{s.name}" for s in steps])


def clamped_sum(
    df: DataFrame,
    keys: Sequence[str],
    delta: Column,
    reset: Column,
    out: str,
    order: Sequence[str] = ORDER,
    chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """Running sum that never falls below 0 and restarts at 0 on ``reset`` rows.

    Inside a stretch without reset and starting level s, the level is
    ``P + max(s, -min P)`` with P the prefix sum. That is a max-plus map of s, so
    a chunk is summarised by (has reset, sum, needed lift, level at end) and the
    chunks of a key compose by the same formula.
    """
    keys = list(keys)
    ordering = [F.col(c) for c in order]
    rows = df.withColumns(
        {
            "_chunk": F.floor(F.col(order[0]) / chunk_ms),
            "_reset": F.coalesce(reset, F.lit(False)),
        }
    ).withColumn("_d", F.when(F.col("_reset"), F.lit(0)).otherwise(delta).cast("bigint"))
    rows = _co_located(rows, keys)
    w = Window.partitionBy("_place").orderBy(*ordering).rowsBetween(_UNBOUNDED, Window.currentRow)
    rows = rows.withColumn("_r", F.sum(F.col("_reset").cast("int")).over(w))
    wr = Window.partitionBy("_place", "_r").orderBy(*ordering).rowsBetween(_UNBOUNDED, Window.currentRow)
    rows = rows.withColumn("_p", F.sum("_d").over(wr)).withColumn("_q", F.min("_p").over(wr))
    place = F.struct("_r", *ordering)
    chunks = rows.groupBy("_place").agg(
        F.max("_r").alias("resets"), F.max_by("_p", place).alias("p"), F.max_by("_q", place).alias("q"), _whole_row(rows, place)
    ).filter("_whole is not null").select("*", "_place.*")
    # a chunk with a reset ends at a known level; others add p and lift the level to at least p - q
    known = F.col("resets") > 0
    level = F.col("p") - F.least(F.col("q"), F.lit(0))
    wc = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(_UNBOUNDED, Window.currentRow)
    chunks = chunks.withColumn("_era", F.sum(known.cast("int")).over(wc))
    we = Window.partitionBy(*keys, "_era").orderBy("_chunk").rowsBetween(_UNBOUNDED, Window.currentRow)
    chunks = chunks.withColumns(
        {
            "_b": F.sum(F.when(known, F.lit(0)).otherwise(F.col("p"))).over(we),
            "_start": F.max(F.when(known, level).otherwise(F.lit(0))).over(we),
        }
    )
    floor_at = F.when(known, F.lit(0)).otherwise(F.col("_b") - F.col("p") + F.col("q"))
    chunks = chunks.withColumn("_low", F.min(floor_at).over(we))
    chunks = chunks.withColumn("_end", F.col("_b") + F.greatest(F.col("_start"), -F.col("_low")))
    wl = Window.partitionBy(*keys).orderBy("_chunk")
    carries = chunks.select("_place", F.coalesce(F.lag("_end").over(wl), F.lit(0)).alias("_in"))
    rows = rows.join(carries, "_place")
    base = F.when(F.col("_r") == 0, F.col("_in")).otherwise(F.lit(0))
    rows = rows.withColumn(out, F.col("_p") + F.greatest(base, -F.col("_q")))
    return rows.drop("_place", "_chunk", "_reset", "_d", "_r", "_p", "_q", "_in")


def timeline_union(left: DataFrame, right: DataFrame, keys: Sequence[str], payload: str) -> DataFrame:
    """Probe rows (``left``) and reference rows (``right``) on one timeline.

    ``right`` must carry ``time_ms`` and ``payload``; its rows sort before probes
    of the same time. Probe rows are those with ``_probe`` true.
    """
    marks = right.select(*keys, "time_ms", F.col(payload).alias("_mark")).withColumns(
        {"_probe": F.lit(False), "seq": F.lit(0).cast("bigint")}
    )
    probes = left.withColumns({"_probe": F.lit(True)})
    return probes.unionByName(marks, allowMissingColumns=True)


def covered_by_any(
    probes: DataFrame, intervals: DataFrame, keys: Sequence[str], out: str, chunk_ms: int | None = CHUNK_MS
) -> DataFrame:
    """Whether some interval ``[start_ms, end_ms)`` of the key holds the probe's ``time_ms``.

    Overlaps do not matter: among intervals begun by t, the largest end decides.
    No pair of probe and interval is ever formed.
    """
    spans = intervals.groupBy(*keys, F.col("start_ms").alias("time_ms")).agg(F.max("end_ms").alias("end_ms"))
    rows = timeline_union(probes, spans, keys, "end_ms")
    rows = running(rows, keys, [Running("_until", "max", F.col("_mark"))], ("time_ms", "_probe", "seq"), chunk_ms)
    rows = rows.filter("_probe").withColumn(out, F.coalesce(F.col("_until") > F.col("time_ms"), F.lit(False)))
    return rows.drop("_probe", "_mark", "_until")


def value_at(
    probes: DataFrame, intervals: DataFrame, keys: Sequence[str], value: str, out: str, chunk_ms: int | None = CHUNK_MS
) -> DataFrame:
    """Value of the key's interval ``[start_ms, end_ms)`` at the probe's time; null outside.

    The intervals of one key must not overlap. As-of lookup: last interval begun, if still open.
    """
    spans = intervals.select(
        *keys, F.col("start_ms").alias("time_ms"), F.struct("end_ms", F.col(value).alias("v")).alias("_span")
    )
    rows = timeline_union(probes, spans, keys, "_span")
    rows = running(rows, keys, [Running("_at", "last", F.col("_mark"))], ("time_ms", "_probe", "seq"), chunk_ms)
    hit = F.when(F.col("_at.end_ms") > F.col("time_ms"), F.col("_at.v"))
    return rows.filter("_probe").withColumn(out, hit).drop("_probe", "_mark", "_at")


def near_any(
    probes: DataFrame, events: DataFrame, keys: Sequence[str], radius_ms: int, out: str, chunk_ms: int | None = CHUNK_MS
) -> DataFrame:
    """Whether an event of the key lies within ``radius_ms`` (inclusive) of the probe.

    Only the nearest event on each side can decide, so two running values replace a band join.
    """
    marks = events.select(*keys, "time_ms").distinct().withColumn("at", F.col("time_ms"))
    rows = timeline_union(probes, marks, keys, "at")
    rows = running(
        rows, keys,
        [Running("_before", "last", F.col("_mark")), Running("_after", "next", F.col("_mark"))],
        ("time_ms", "_probe", "seq"), chunk_ms,
    )
    near = (F.col("time_ms") - F.col("_before") <= radius_ms) | (F.col("_after") - F.col("time_ms") <= radius_ms)
    return rows.filter("_probe").withColumn(out, F.coalesce(near, F.lit(False))).drop("_probe", "_mark", "_before", "_after")
