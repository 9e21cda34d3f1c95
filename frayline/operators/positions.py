"""Position samples: down-sampling, forward fill, spacing metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frayline.operators.scan import CHUNK_MS, Running, running

FIGHT = "fight_id"
SAMPLE_MS = 500
SAMPLE_LIMIT = 2000
FILL_BUCKET_MS = 10_000
CHUNK_STEPS = 10_000
BLOCK = 512  # players; a task holds two blocks of them


def downsample(positions: DataFrame, step_ms: int = SAMPLE_MS, limit: int | None = None) -> DataFrame:
    """Last sample per step; for display, ``limit`` leaves at most that many per agent, at indexes floor(n*i/limit).

    Metrics take all samples. A sample with index j stays when j = floor(n*i/limit) for some i, which can be
    tested on the row itself. The ranking runs over steps, not samples.
    """
    last = positions.groupBy(FIGHT, "agent_id", F.floor(F.col("time_ms") / step_ms).alias("step")).agg(
        F.max_by(F.struct("time_ms", "x", "y"), F.struct("time_ms", "seq")).alias("s")
    )
    if limit is None:
        return last.select(FIGHT, "agent_id", "s.time_ms", "s.x", "s.y")
    sizes = last.groupBy(FIGHT, "agent_id").agg(F.count(F.lit(1)).alias("n"))
    rows = running(last.join(sizes, [FIGHT, "agent_id"]), [FIGHT, "agent_id"], [Running("j", "before", F.lit(1))], ("step",), CHUNK_STEPS)
    i = F.ceil(F.col("j") * limit / F.col("n"))
    kept = (F.col("n") <= limit) | ((i < limit) & (F.floor(F.col("n") * i / limit) == F.col("j")))
    return rows.filter(kept).select(FIGHT, "agent_id", "s.time_ms", "s.x", "s.y")


def forward_filled(samples: DataFrame, bucket_ms: int = FILL_BUCKET_MS, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Position of every player at every sample time of its fight, from its first sample on.

    A sample holds until the player's next one. Holding intervals are cut at
    bucket borders and equi-joined with the times of the same (fight, bucket).
    """
    held = running(samples, [FIGHT, "agent_id"], [Running("until", "next", F.col("time_ms"))], ("time_ms",), chunk_ms)
    last = samples.groupBy(FIGHT).agg((F.max("time_ms") + 1).alias("last"))
    held = held.join(last, FIGHT).withColumn("until", F.coalesce("until", "last"))
    pieces = held.withColumn(
        "bucket", F.explode(F.sequence(F.floor(F.col("time_ms") / bucket_ms), F.floor((F.col("until") - 1) / bucket_ms)))
    ).select(FIGHT, "bucket", "agent_id", F.col("time_ms").alias("since"), "until", "x", "y")
    times = samples.select(FIGHT, "time_ms").distinct().withColumn("bucket", F.floor(F.col("time_ms") / bucket_ms))
    rows = times.join(pieces, [FIGHT, "bucket"])
    rows = rows.filter((F.col("since") <= F.col("time_ms")) & (F.col("time_ms") < F.col("until")))
    return rows.select(FIGHT, "time_ms", "agent_id", "x", "y")


def squad_times(samples: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Players present at every sample time of a fight, and the sums of where they stand.

    A sample moves its player from where it stood; these moves add up along time, so no filled position becomes a row. The
    samples of one player, at most one per step of its fight, are one window; the times of a fight are cut into chunks.
    """
    steps = running(samples, [FIGHT, "agent_id"], [Running("_was", "prev", F.struct("x", "y"))], ("time_ms",), None)
    from_ = lambda c: F.col(c) - F.coalesce(F.col(f"_was.{c}"), F.lit(0.0))
    moves = steps.groupBy(FIGHT, "time_ms").agg(
        F.count(F.when(F.col("_was").isNull(), 1)).alias("new"), F.sum(from_("x")).alias("dx"), F.sum(from_("y")).alias("dy")
    )
    total = lambda name, value: Running(name, "sum", F.col(value))
    return running(moves, [FIGHT], [total("n", "new"), total("sx", "dx"), total("sy", "dy")], ("time_ms",), chunk_ms).select(FIGHT, "time_ms", "n", "sx", "sy")


def spacing(samples: DataFrame, slice_ms: int = FILL_BUCKET_MS, chunk_ms: int = CHUNK_MS, block: int = BLOCK) -> DataFrame:
    """Mean distance to the squad's centre and to the other players, over times with two or more players.

    A fight is cut into slices of time, its players into blocks of about ``block``. A task adds up the distances
    of one block to another in arrays of players by times, from their samples and from where they stood before the slice;
    the sums of a player's blocks meet in one aggregation. A task holds two blocks, however many players there are.
    """
    agent, slice_ = [FIGHT, "agent_id"], [FIGHT, "slice"]
    rows = samples.withColumn("slice", F.floor(F.col("time_ms") / slice_ms))
    slices = rows.select(*slice_).distinct()
    # one row per player and slice after its first sample: the position held when the slice begins
    since = rows.groupBy(*agent).agg(F.min("slice").alias("_first"))
    asked = since.join(slices, FIGHT).filter("slice > _first").drop("_first").withColumns({"time_ms": F.col("slice") * slice_ms, "_probe": F.lit(0)})
    line = asked.unionByName(rows.withColumn("_probe", F.lit(1)), allowMissingColumns=True).withColumn("_here", F.when(F.col("_probe") == 1, F.struct("x", "y")))
    held = running(line, agent, [Running("_held", "prev", F.col("_here"))], ("time_ms", "_probe"), None).filter("_probe = 0")
    held = held.select(*agent, "slice", F.lit(None).cast("bigint").alias("time_ms"), F.col("_held.x").alias("x"), F.col("_held.y").alias("y"))
    sizes = since.groupBy(FIGHT).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    placed = held.unionByName(rows.select(held.columns)).join(sizes, FIGHT).withColumn("at", F.pmod(F.xxhash64("agent_id"), "blocks").cast("int"))
    # a row is its own block's in every group of that row of blocks, and the other block's in every group of that column
    groups = F.concat(F.transform(every, lambda j: F.struct(F.col("at").alias("own"), j.alias("other"))), F.transform(F.filter(every, lambda i: i != F.col("at")), lambda i: F.struct(i.alias("own"), F.col("at").alias("other"))))
    placed = placed.select(*slice_, "agent_id", "time_ms", "x", "y", "at", F.lit(None).cast("bigint").alias("n"), F.inline(groups))
    times = squad_times(samples, chunk_ms).withColumn("slice", F.floor(F.col("time_ms") / slice_ms)).join(sizes, FIGHT)
    pairs = F.flatten(F.transform(every, lambda i: F.transform(every, lambda j: F.struct(i.alias("own"), j.alias("other")))))
    times = times.select(
        *slice_, F.lit(0).cast("bigint").alias("agent_id"), "time_ms", (F.col("sx") / F.col("n")).alias("x"), (F.col("sy") / F.col("n")).alias("y"), F.lit(-1).alias("at"), "n", F.inline(pairs)
    )
    pair = [*slice_, "own", "other"]
    dealt = placed.unionByName(times).repartition(*pair).sortWithinPartitions(*pair).select(*pair, "agent_id", "time_ms", "x", "y", "at", "n")
    parts = dealt.mapInArrow(_pair_sums, PARTS_DDL)
    mean = lambda total: F.when(F.sum("n") > 0, F.sum(total) / F.sum("n"))
    metrics = parts.groupBy(*agent).agg(mean("to_centre").alias("dist_to_com"), mean("to_others").alias("stack_dist"))
    return samples.select(*agent).distinct().join(metrics, agent, "left")


PARTS_DDL = "fight_id string, agent_id bigint, to_centre double, to_others double, n bigint"
_PAIR = 4  # columns that name a pair of blocks


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of all pairs of blocks of a partition; rows come sorted by pair, and one pair at most waits for its other rows."""
    waiting: list[np.ndarray] | None = None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if waiting is not None:
            rows = [np.concatenate(x) for x in zip(waiting, rows)]
        changes = np.zeros(max(0, len(rows[0]) - 1), dtype=bool)
        for c in rows[:_PAIR]:
            changes |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(changes) + 1).tolist()]
        if len(edges) > 1:
            yield _parts([[c[a:b] for c in rows] for a, b in zip(edges, edges[1:])])
        waiting = [c[edges[-1] :] for c in rows] if len(rows[0]) else waiting
    if waiting is not None:
        yield _parts([waiting])


def _parts(pairs: list[list[np.ndarray]]) -> pa.RecordBatch:
    found = [_block_sums(*rows) for rows in pairs]
    fights = np.concatenate([np.full(len(f[0]), rows[0][0], dtype=object) for rows, f in zip(pairs, found)])
    columns = [np.concatenate(c) for c in zip(*found)]
    return pa.RecordBatch.from_arrays([pa.array(fights, pa.string()), *map(pa.array, columns)], ["fight_id", "agent_id", "to_centre", "to_others", "n"])


def _block_sums(fight, slice_, own, other, agent, time, x, y, at, n) -> tuple[np.ndarray, ...]:
    """Players of one block with their distances to another block's, summed over the slice's times; to the centre once."""
    once, ticks = own[0] == other[0], at == -1
    order = np.argsort(time[ticks])
    times, sizes, cx, cy = (c[ticks][order] for c in (time, n, x, y))
    agent, time, x, y, at = (c[~ticks] for c in (agent, time, x, y, at))
    agents, first, who = np.unique(agent.astype(np.int64), return_index=True, return_inverse=True)
    mine, theirs = at[first] == own[0], at[first] == other[0]
    held = np.isnan(time.astype(np.float64))
    when = np.where(held, 0, np.searchsorted(times, time) + 1)
    place = np.full((2, len(agents), len(times) + 1), np.nan)
    place[:, who, when] = np.stack([x, y])
    last = np.maximum.accumulate(np.where(np.isnan(place[0]), 0, np.arange(len(times) + 1)), axis=1)
    x, y = (np.take_along_axis(p, last, axis=1)[:, 1:] for p in place)
    ox, oy, x, y = x[theirs], y[theirs], x[mine], y[mine]
    counts = ~np.isnan(x) & (sizes > 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        others = np.stack([np.nansum(np.hypot(ox - x[k], oy - y[k]), axis=0) for k in range(len(x))]) / (sizes - 1) if len(x) else x
        centre = np.hypot(x - cx, y - cy)
    total = lambda d: np.where(counts, d, 0.0).sum(axis=1)
    seen = counts.sum(axis=1)
    return agents[mine], total(centre) * once, total(others), seen * int(once)


def commander_distance(samples: DataFrame, commanders: DataFrame) -> DataFrame:
    """Mean distance to the commander at exactly shared times; 0 for the commander, absent without a match."""
    lead = commanders.groupBy(FIGHT).agg(F.min("agent_id").alias("commander_id"))
    at = samples.join(lead, FIGHT).filter("agent_id = commander_id").select(FIGHT, "time_ms", F.col("x").alias("cx"), F.col("y").alias("cy"), "commander_id")
    rows = samples.join(at, [FIGHT, "time_ms"]).groupBy(FIGHT, "agent_id").agg(
        F.avg(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))).alias("dist"), F.max("commander_id").alias("commander_id")
    )
    return rows.select(FIGHT, "agent_id", F.when(F.col("agent_id") == F.col("commander_id"), 0.0).otherwise(F.col("dist")).alias("commander_dist"))


def position_rows(samples: DataFrame, players: DataFrame, metrics: DataFrame, commander: DataFrame) -> DataFrame:
    """One row per player with its samples (thinned for display) and spacing metrics."""
    arrays = samples.groupBy(FIGHT, "agent_id").agg(F.sort_array(F.collect_list(F.struct("time_ms", "x", "y"))).alias("samples"))
    rows = arrays.join(players.select(FIGHT, "agent_id", "account_name", "name"), [FIGHT, "agent_id"])
    return rows.join(metrics, [FIGHT, "agent_id"], "left").join(commander, [FIGHT, "agent_id"], "left")


def bounding_boxes(samples: DataFrame) -> DataFrame:
    return samples.groupBy(FIGHT).agg(
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"),
        F.max("time_ms").alias("max_time_ms"),
    )
