"""Cast reconstruction from activations and from rule-table triggers."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frayline.functions import lookups as L
from frayline.operators.scan import CHUNK_MS, Running, covered_by_any, near_any, running, value_at

FIGHT = "fight_id"
CAST = [FIGHT, "source_agent_id", "skill_id"]
REPEAT_SLACK_MS = 10
DEFAULT_COOLDOWN_MS = 50
SWAP_RADIUS_MS = 5
NO_SKILL = -1  # stands in for "no such gate" where the skill is part of a key
RULE_DDL = (
    "trigger_kind STRING, trigger_id STRING, cast_skill_id BIGINT, cooldown_ms INT, gate_profession INT, "
    "gate_elite INT, before_swap BOOLEAN, after_swap BOOLEAN, self_only BOOLEAN, guard_skill_id BIGINT"
)


Staging = Callable[[DataFrame, str], DataFrame]


def unstaged(rows: DataFrame, name: str) -> DataFrame:
    """Leaves a result in the plan. A running value reads its input twice, so chains of them grow; a stage cuts them."""
    return rows


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


def _activations(events: DataFrame) -> DataFrame:
    return events.filter(_is("SKILL_ACTIVATION")).select(
        *CAST, "seq", "time_ms", "duration_ms", "expected_duration_ms", F.col("activation").isin(L.CAST_START_CODES).alias("starts")
    )


def paired_casts(
    events: DataFrame, ends: DataFrame, clamp_skills: list[int] = (), expected_when_open: list[int] = (), chunk_ms: int = CHUNK_MS
) -> DataFrame:
    """Casts from start and end activations of one (agent, skill).

    A start followed by an end lasts between them (1 ms or less is dropped); a
    start followed by a start closes at min(expected, gap + 10); an end without a
    start back-dates itself by its own duration; a start nothing follows stays open
    and lasts its recorded (or, for listed skills, expected) time, clipped to the
    fight's end. Skills in ``clamp_skills`` also close at the agent's next start.
    """
    rows = _activations(events)
    here = F.struct("time_ms", "starts")
    rows = running(rows, CAST, [Running("_next", "next", here), Running("_prev", "prev", here)], chunk_ms=chunk_ms)
    gap = F.col("_next.time_ms") - F.col("time_ms")
    follows_start = F.col("_next.starts")
    if clamp_skills:
        starts = F.when(F.col("starts"), F.col("time_ms"))
        rows = running(rows, [FIGHT, "source_agent_id"], [Running("_other", "next", starts)], chunk_ms=chunk_ms)
        clamped = F.col("skill_id").isin(list(clamp_skills)) & (F.col("_other") <= F.coalesce("_next.time_ms", "_other"))
        clamped = F.coalesce(clamped, F.lit(False))
        gap = F.when(clamped, F.col("_other") - F.col("time_ms")).otherwise(gap)
        follows_start = F.when(clamped, True).otherwise(follows_start)
    rows = rows.join(ends.select(FIGHT, "end_ms"), FIGHT)
    open_length = F.when(F.col("skill_id").isin(list(expected_when_open)), F.col("expected_duration_ms")).otherwise(F.col("duration_ms"))
    length = (
        F.when(F.col("starts") & gap.isNull(), F.least(open_length, F.greatest(F.col("end_ms") - F.col("time_ms"), F.lit(0))))
        .when(F.col("starts") & follows_start, F.least(F.col("expected_duration_ms"), gap + REPEAT_SLACK_MS))
        .when(F.col("starts") & (gap > 1), gap)
        .when(~F.col("starts") & ~F.coalesce("_prev.starts", F.lit(False)) & (F.col("duration_ms") > 1), F.col("duration_ms"))
    )
    start = F.when(F.col("starts"), F.col("time_ms")).otherwise(F.col("time_ms") - F.col("duration_ms"))
    return rows.select(*CAST, start.alias("time_ms"), length.alias("duration_ms")).filter("duration_ms is not null")


def swap_casts(events: DataFrame) -> DataFrame:
    return events.filter(_is("WEAPON_SWAP")).select(
        FIGHT, "source_agent_id", F.lit(L.SWAP_SKILL_ID).cast("bigint").alias("skill_id"), "time_ms", F.lit(0).cast("bigint").alias("duration_ms")
    )


def apply_cooldown(triggers: DataFrame, chunk_ms: int = CHUNK_MS, order: tuple[str, ...] = ("time_ms", "seq")) -> DataFrame:
    """Keeps an instant cast when the previous trigger of its (agent, cast), kept or not, is a cooldown away."""
    # the time before is the greatest before: a number, where a last value carries its place along
    rows = running(triggers, CAST, [Running("_prev", "max_before", F.col("time_ms"))], order, chunk_ms)
    wait = F.coalesce("cooldown_ms", F.lit(DEFAULT_COOLDOWN_MS))
    return rows.filter(F.col("_prev").isNull() | (F.col("time_ms") - F.col("_prev") >= wait)).drop("_prev")


def triggers(events: DataFrame) -> DataFrame:
    """Rows a rule can match: (trigger_kind, trigger_id, credited agent, other agent, time)."""
    apply_, gone = F.col("kind") == "apply", F.col("kind") == "remove_all"
    buff, src, dst = F.col("skill_id").cast("string"), F.col("source_agent_id"), F.col("target_agent_id")
    entry = lambda cond, kind, key, who, other: F.when(
        cond, F.struct(F.lit(kind).alias("trigger_kind"), key.alias("trigger_id"), who.alias("source_agent_id"), other.alias("other_agent_id"))
    )
    entries = F.array_compact(
        F.array(
            entry(_is("BOON_APPLY") & apply_, "buff_gain", buff, dst, src),
            entry(_is("BOON_APPLY") & gone, "buff_loss", buff, dst, src),
            entry(_is("BOON_APPLY") & apply_, "buff_give", buff, src, dst),
            entry(_is("DAMAGE"), "damage", buff, src, dst),
            entry(_is("HEALING"), "healing", buff, src, dst),
            entry(_is("MISSILE"), "missile", buff, src, dst),
            entry(_is("EFFECT"), "effect", F.col("guid"), src, dst),
            entry(_is("SKILL_ACTIVATION") & F.col("activation").isin(L.CAST_START_CODES), "minion", buff, src, dst),
        )
    )
    return events.select(FIGHT, "seq", "time_ms", F.inline(entries))


def align_to_swaps(rows: DataFrame, swaps: DataFrame, radius_ms: int = SWAP_RADIUS_MS, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Moves ``before_swap`` casts to 1 ms before a swap closer than the radius, ``after_swap`` ones to 1 ms after."""
    keys = [FIGHT, "source_agent_id"]
    marks = swaps.select(*keys, "time_ms", F.col("time_ms").alias("_swap"), F.lit(0).alias("_p"), F.lit(0).cast("bigint").alias("seq")).distinct()
    line = rows.withColumn("_p", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    line = running(
        line, keys, [Running("_before", "last", F.col("_swap")), Running("_after", "next", F.col("_swap"))],
        ("time_ms", "_p", "seq"), chunk_ms,
    ).filter("_p = 1")
    t = F.col("time_ms")
    near = F.coalesce(
        F.when(t - F.col("_before") < radius_ms, F.col("_before")), F.when(F.col("_after") - t < radius_ms, F.col("_after"))
    )
    moved = (
        F.when(F.col("before_swap") & near.isNotNull(), F.least(t, near - 1))
        .when(F.col("after_swap") & near.isNotNull(), F.greatest(t, near + 1))
        .otherwise(t)
    )
    return line.withColumn("time_ms", moved).drop("_p", "_swap", "_before", "_after")


def guard_windows(events: DataFrame, skills: list[int], epsilon_ms: int = 10, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Cast windows of guarded skills, widened by ``epsilon_ms`` on both sides (half-open)."""
    rows = _activations(events).filter(F.col("skill_id").isin(skills))
    here = F.struct("time_ms", "starts")
    rows = running(rows, CAST, [Running("_next", "next", here), Running("_prev", "prev", here)], chunk_ms=chunk_ms)
    ended = F.col("starts") & ~F.coalesce("_next.starts", F.lit(True))
    opened = F.col("starts") & F.col("_next").isNull()
    lone = ~F.col("starts") & ~F.coalesce("_prev.starts", F.lit(False))
    start = F.when(lone, F.col("time_ms") - F.col("duration_ms")).otherwise(F.col("time_ms"))
    end = F.when(ended, F.col("_next.time_ms")).otherwise(F.col("time_ms"))
    return rows.filter(ended | opened | lone).select(
        FIGHT, "source_agent_id", F.col("skill_id").alias("guard_skill_id"), (start - epsilon_ms).alias("start_ms"), (end + epsilon_ms + 1).alias("end_ms")
    )


TRIGGER = [*CAST, "seq", "time_ms", "cooldown_ms", "trigger_kind", "trigger_id"]
# a total order for the cooldown: several rules may fire on one record
TRIGGER_ORDER = ("time_ms", "seq", "trigger_kind", "trigger_id")


def instant_casts(triggered: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Triggers that outlast the cooldown of their (agent, cast), whatever has triggered it before."""
    rows = apply_cooldown(triggered, chunk_ms, TRIGGER_ORDER)
    return rows.select(*CAST, "seq", "time_ms", F.lit(0).cast("bigint").alias("duration_ms"), "trigger_kind", "trigger_id")


def complete_rotation(triggered: list[DataFrame], casts: list[DataFrame], chunk_ms: int = CHUNK_MS, stage: Staging = unstaged) -> DataFrame:
    """All casts of a log: triggers of every source share one cooldown memory; other casts join them as they are.

    ``triggered``: tables of ``TRIGGER`` columns; ``casts``: tables with the cast, its time and its duration.
    """
    union = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
    columns = [*CAST, "time_ms", "duration_ms"]
    instant = instant_casts(stage(union([t.select(*TRIGGER) for t in triggered]), "triggers"), chunk_ms)
    return final_casts(stage(union([x.select(*columns) for x in [instant, *casts]]), "casts"), chunk_ms)


def inferred_casts(events: DataFrame, rules: DataFrame, agents: DataFrame, guards: DataFrame | None = None, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Instant casts from a rule table, with gates, guards, swap alignment and per-rule cooldown."""
    return instant_casts(rule_triggers(events, rules, agents, guards, chunk_ms), chunk_ms)


def rule_triggers(
    events: DataFrame, rules: DataFrame, agents: DataFrame, guards: DataFrame | None = None, chunk_ms: int = CHUNK_MS, swap_radius_ms: int = SWAP_RADIUS_MS, stage: Staging = unstaged
) -> DataFrame:
    """Rule matches before the cooldown, moved to the swaps beside them.

    The rule table is joined by key; AQE broadcasts it when its size allows. Only matches of rules with a guard meet the
    guards, and only those of rules that name a swap meet the swaps.
    """
    who = agents.select(FIGHT, F.col("agent_id").alias("source_agent_id"), "profession", "elite")
    gate = (
        (F.col("gate_profession").isNull() | F.col("gate_profession").eqNullSafe(F.col("profession")))
        & (F.col("gate_elite").isNull() | F.col("gate_elite").eqNullSafe(F.col("elite")))
        & (~F.coalesce("self_only", F.lit(False)) | (F.col("source_agent_id") == F.col("other_agent_id")))
    )

    def matches(some: DataFrame) -> DataFrame:
        rows = triggers(events).join(some, ["trigger_kind", "trigger_id"])
        return rows.join(who, [FIGHT, "source_agent_id"], "left").filter(gate)

    if guards is None:
        rows = matches(rules)
    else:
        guarded = covered_by_any(matches(rules.filter("guard_skill_id is not null")), guards, [FIGHT, "source_agent_id", "guard_skill_id"], "_guarded", chunk_ms)
        rows = matches(rules.filter("guard_skill_id is null")).unionByName(guarded.filter("not _guarded").drop("_guarded"))
    rows = stage(rows.withColumn("skill_id", F.col("cast_skill_id")).select(*TRIGGER, "before_swap", "after_swap"), "rule-matches")
    moves = F.coalesce("before_swap", F.lit(False)) | F.coalesce("after_swap", F.lit(False))
    moved = align_to_swaps(rows.filter(moves), events.filter(_is("WEAPON_SWAP")), swap_radius_ms, chunk_ms)
    return moved.select(*TRIGGER).unionByName(rows.filter(~moves).select(*TRIGGER))


def kit_casts(events: DataFrame, bundles: DataFrame, slot: int = 2, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Kit equips: a swap to ``slot`` followed, before the next swap, by a skill of the kit.

    ``bundles``: kit_order, kit_skill_id, skill_id. Starts count if there are any,
    else every activation; the first kit in order wins; the cast precedes the swap by 1 ms.
    """
    keys = [FIGHT, "source_agent_id"]
    all_swaps = events.filter(_is("WEAPON_SWAP"))
    swaps = all_swaps.select(*keys, "time_ms").distinct().select(*keys, "time_ms", F.col("time_ms").alias("swap_ms"), F.lit(0).alias("_p"))
    acts = _activations(events).select(*keys, "time_ms", "seq", "skill_id", "starts", F.lit(1).alias("_p"))
    line = running(acts.unionByName(swaps, allowMissingColumns=True), keys, [Running("at", "last", F.col("swap_ms"))], ("time_ms", "_p", "seq"), chunk_ms)
    acts = line.filter((F.col("_p") == 1) & F.col("at").isNotNull()).join(bundles, "skill_id", "left")
    kit = F.struct("kit_order", "kit_skill_id")
    chosen = [
        F.max("starts").alias("any_start"),
        F.min(F.when(F.col("kit_skill_id").isNotNull() & F.col("starts"), kit)).alias("by_start"),
        F.min(F.when(F.col("kit_skill_id").isNotNull(), kit)).alias("by_any"),
    ]
    # a stretch opens a little after its swap, and swaps until then do not close it: an activation lies in the stretches of
    # the last swap before it and of those shortly before that one, so its distance from the last one, up to the slack, decides
    after = F.least(F.col("time_ms") - F.col("at"), F.lit(REPEAT_SLACK_MS))
    near = acts.groupBy(*keys, "at", after.alias("after")).agg(*chosen)
    back = F.explode(F.sequence(F.lit(REPEAT_SLACK_MS) - F.col("after"), F.lit(REPEAT_SLACK_MS).cast("bigint")))
    near = near.select("*", back.alias("back")).withColumn("time_ms", F.col("at") - F.col("back"))
    per_swap = near.groupBy(*keys, "time_ms").agg(F.max("any_start").alias("any_start"), F.min("by_start").alias("by_start"), F.min("by_any").alias("by_any"))
    kit_swaps = all_swaps.filter(F.col("swapped_to").cast("int") == slot).select(*keys, "time_ms", "seq").join(per_swap, [*keys, "time_ms"])
    return kit_swaps.withColumn("kit", F.when(F.col("any_start"), F.col("by_start")).otherwise(F.col("by_any"))).filter("kit is not null").select(
        *keys, F.col("kit.kit_skill_id").alias("skill_id"), "seq", (F.col("time_ms") - 1).alias("time_ms"), F.lit(0).cast("bigint").alias("duration_ms")
    )


def anchor_groups(rows: DataFrame, keys: list[str], radius_ms: int = 10, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Adds ``anchor_ms``: rows within ``radius_ms`` of a group's first time share the group.

    An anchor leads to the first time at least ``radius_ms`` later, so where a chunk of time is entered decides all its
    anchors. A chunk does not know where; it maps every time it may be entered at (those less than ``radius_ms`` behind its
    start, and the next) to the last anchor that follows from it. The maps of a key are folded in order, one row per chunk,
    which tells every chunk the anchor before it; then all chunks place their times at once. A dense stretch of any length
    is thus spread over its chunks.
    """
    times = rows.select(*keys, "time_ms").distinct().withColumn("_key", F.to_json(F.struct(*keys))).withColumn("_chunk", F.floor(F.col("time_ms") / chunk_ms))
    place = ["_key", "_chunk"]
    dealt = times.select(*place, "time_ms").repartition(*place).sortWithinPartitions(*place, "time_ms")
    maps = dealt.mapInArrow(_chunk_maps(radius_ms, chunk_ms), "_key string, _chunk bigint, entries array<bigint>, exits array<bigint>")
    before = maps.repartition("_key").sortWithinPartitions(*place).mapInArrow(_folded_maps(radius_ms), "_key string, _chunk bigint, anchor_before bigint")
    known = times.select(*place, "time_ms").join(before, place).repartition(*place).sortWithinPartitions(*place, "time_ms")
    placed = known.select(*place, "time_ms", "anchor_before").mapInArrow(_placed_times(radius_ms), "_key string, time_ms bigint, anchor_ms bigint")
    return rows.withColumn("_key", F.to_json(F.struct(*keys))).join(placed, ["_key", "time_ms"]).drop("_key")


def _runs(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[list]]:
    """Rows of equal first ``by`` columns, as one list of columns each; rows come sorted, one run at most is held back."""
    held: list[list] | None = None
    for batch in batches:
        rows = [c.to_pylist() for c in batch.columns]
        if held is not None:
            rows = [x + y for x, y in zip(held, rows)]
        n = len(rows[0])
        heads = list(zip(*rows[:by]))
        edges = [k for k in range(n) if k == 0 or heads[k] != heads[k - 1]]
        for a, b in zip(edges, edges[1:]):
            yield [c[a:b] for c in rows]
        held = [c[edges[-1] :] for c in rows] if edges else held
    if held is not None:
        yield held


def _jumps(times: np.ndarray, radius_ms: int) -> np.ndarray:
    """Place of the first time at least ``radius_ms`` after each; the number of times where there is none."""
    return np.searchsorted(times, times + radius_ms)


def _chunk_maps(radius_ms: int, chunk_ms: int):
    def scan(batches):
        for keys, chunks, at in _runs(batches, 2):
            times = np.array(at, dtype=np.int64)
            follow, last = _jumps(times, radius_ms), np.arange(len(times))
            for k in range(len(times) - 1, -1, -1):
                if follow[k] < len(times):
                    last[k] = last[follow[k]]
            n = int(np.searchsorted(times, chunks[0] * chunk_ms + radius_ms)) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[:1]), pa.array(chunks[:1], pa.int64()), pa.array([times[:n].tolist()], pa.list_(pa.int64())), pa.array([times[last[:n]].tolist()], pa.list_(pa.int64()))],
                ["_key", "_chunk", "entries", "exits"],
            )

    return scan


def _folded_maps(radius_ms: int):
    def scan(batches):
        key, anchor = None, None
        for batch in batches:
            keys, chunks, before = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for k, entries, exits in zip(keys, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if k != key:
                    key, anchor = k, None
                before.append(anchor)
                place = 0 if anchor is None else bisect_left(entries, anchor + radius_ms)
                if place < len(entries):
                    anchor = exits[place]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(chunks, pa.int64()), pa.array(before, pa.int64())], ["_key", "_chunk", "anchor_before"])

    return scan


def _placed_times(radius_ms: int):
    def scan(batches):
        for keys, _, at, before in _runs(batches, 2):
            times, anchor = np.array(at, dtype=np.int64), before[0]
            anchors = np.empty_like(times)
            k = 0 if anchor is None else int(np.searchsorted(times, anchor + radius_ms))
            anchors[:k] = 0 if anchor is None else anchor
            follow = _jumps(times, radius_ms)
            while k < len(times):
                anchors[k : follow[k]] = times[k]
                k = int(follow[k])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(times), pa.array(anchors)], ["_key", "time_ms", "anchor_ms"])

    return scan


def grouped_translation(rows: DataFrame, keys: list[str], translation: DataFrame, radius_ms: int = 10, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Skill a group of simultaneous buff changes stands for.

    ``translation``: id_set (ascending ids joined by ','), cast_skill_id.
    """
    grouped = anchor_groups(rows, keys, radius_ms, chunk_ms)
    sets = grouped.groupBy(*keys, F.col("anchor_ms").alias("time_ms")).agg(
        F.array_join(F.sort_array(F.collect_set("skill_id")), ",").alias("id_set")  # distinct buff ids within radius_ms
    )
    return sets.join(translation, "id_set").select(*keys, F.col("cast_skill_id").alias("skill_id"), "time_ms")


def minion_casts(events: DataFrame, minion_skills: DataFrame, intervals: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Minion activations as instant casts of the owner."""
    return instant_casts(minion_triggers(events, minion_skills, intervals, chunk_ms), chunk_ms).drop("trigger_kind", "trigger_id")


def minion_triggers(events: DataFrame, minion_skills: DataFrame, intervals: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Minion activations credited to the owner: interval owner, else the owner named at its first spawn.

    ``minion_skills``: skill_id, cast_skill_id.
    """
    starts = _activations(events).filter("starts").join(minion_skills, "skill_id").select(
        FIGHT, F.col("source_agent_id").alias("agent_id"), "seq", "time_ms", "cast_skill_id"
    )
    rows = value_at(starts, intervals, [FIGHT, "agent_id"], "owner_agent_id", "interval_owner", chunk_ms)
    spawned = events.filter(_is("SPAWN")).groupBy(FIGHT, F.col("target_agent_id").alias("agent_id")).agg(F.min_by("source_agent_id", "seq").alias("spawn_owner"))
    rows = rows.join(spawned, [FIGHT, "agent_id"], "left").withColumn("source_agent_id", F.coalesce("interval_owner", F.when(F.col("spawn_owner") != 0, F.col("spawn_owner"))))
    rows = rows.filter("source_agent_id is not null").withColumn("skill_id", F.col("cast_skill_id"))
    own = {"cooldown_ms": F.lit(DEFAULT_COOLDOWN_MS), "trigger_kind": F.lit("minion"), "trigger_id": F.col("agent_id").cast("string")}
    return rows.withColumns(own).select(*TRIGGER)


def effect_casts(
    events: DataFrame, effect_rules: DataFrame, agents: DataFrame, chunk_ms: int = CHUNK_MS, radius_ms: int = 10
) -> DataFrame:
    """Effect-triggered casts with gates and their cooldown."""
    return instant_casts(effect_triggers(events, effect_rules, agents, chunk_ms, radius_ms), chunk_ms).drop("trigger_kind", "trigger_id")


def effect_triggers(
    events: DataFrame, effect_rules: DataFrame, agents: DataFrame, chunk_ms: int = CHUNK_MS, radius_ms: int = 10, stage: Staging = unstaged
) -> DataFrame:
    """Effects that trigger a cast, after the gates.

    ``effect_rules``: guid, cast_skill_id, cooldown_ms, gate_profession, gate_elite,
    blocked_by_damage_skill (hit of that skill by the same agent nearby drops the
    cast), needs_buff_id (apply of that buff to the agent nearby is required).
    """
    rows = events.filter(_is("EFFECT")).select(FIGHT, "source_agent_id", "seq", "time_ms", "guid").join(effect_rules, "guid")
    who = agents.select(FIGHT, F.col("agent_id").alias("source_agent_id"), "profession", "elite")
    rows = rows.join(who, [FIGHT, "source_agent_id"], "left").filter(
        (F.col("gate_profession").isNull() | F.col("gate_profession").eqNullSafe(F.col("profession")))
        & (F.col("gate_elite").isNull() | F.col("gate_elite").eqNullSafe(F.col("elite")))
    )
    rows = rows.withColumns({n: F.coalesce(n, F.lit(NO_SKILL)) for n in ("blocked_by_damage_skill", "needs_buff_id")})
    hits = events.filter(_is("DAMAGE")).select(FIGHT, "source_agent_id", F.col("skill_id").alias("blocked_by_damage_skill"), "time_ms")
    rows = near_any(rows, hits, [FIGHT, "source_agent_id", "blocked_by_damage_skill"], radius_ms - 1, "_blocked", chunk_ms)
    rows = stage(rows, "effect-matches")
    gains = events.filter(_is("BOON_APPLY") & (F.col("kind") == "apply")).select(
        FIGHT, F.col("target_agent_id").alias("source_agent_id"), F.col("skill_id").alias("needs_buff_id"), "time_ms"
    )
    rows = near_any(rows, gains, [FIGHT, "source_agent_id", "needs_buff_id"], radius_ms - 1, "_fed", chunk_ms)
    blocked = F.col("_blocked")
    starved = (F.col("needs_buff_id") != NO_SKILL) & ~F.col("_fed")
    rows = rows.filter(~blocked & ~starved).withColumn("skill_id", F.col("cast_skill_id"))
    return rows.withColumns({"trigger_kind": F.lit("effect"), "trigger_id": F.col("guid")}).select(*TRIGGER)


def final_casts(casts: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Exact duplicates removed; swaps of one agent at most 1 ms apart merge into the later."""
    rows = casts.select(*CAST, "time_ms", "duration_ms").distinct()
    swaps = rows.filter(F.col("skill_id") == L.SWAP_SKILL_ID)
    swaps = running(swaps, [FIGHT, "source_agent_id"], [Running("_next", "next", F.col("time_ms"))], ("time_ms", "duration_ms"), chunk_ms)
    swaps = swaps.filter(F.col("_next").isNull() | (F.col("_next") - F.col("time_ms") > 1)).drop("_next")
    return rows.filter(F.col("skill_id") != L.SWAP_SKILL_ID).unionByName(swaps)


def casts_in_slice(casts: DataFrame, slices: DataFrame) -> DataFrame:
    """Casts starting inside their agent's slice, or begun before the fight and ending inside it."""
    rows = casts.join(slices, [FIGHT, "source_agent_id"])
    starts = F.col("time_ms").between(F.col("lo_ms"), F.col("hi_ms"))
    ends = (F.col("time_ms") < 0) & (F.col("time_ms") + F.col("duration_ms")).between(F.col("lo_ms"), F.col("hi_ms"))
    return rows.filter(starts | ends)
