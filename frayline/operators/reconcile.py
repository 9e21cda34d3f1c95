"""Reconciliation of computed metrics with an expected report."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frayline.functions.combat import absorbed_hit, catalogue_condition, catalogue_condition_damage, landed_hit
from frayline.operators.rollups import count_where, sum_where
from frayline.functions import lookups as L
from frayline.operators.scan import CHUNK_MS, Running, running

FIGHT = "fight_id"
UPTIME_TOLERANCE = 0.005
CAST_SLACK_MS = 2


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


# -- statistics of a slice ------------------------------------------------------------
def attack_statistics(
    events: DataFrame, downs: DataFrame, noncritable: list[int] = (), condition_ids: list[int] | None = None
) -> DataFrame:
    """Counters per (fight, source) in one pass, joined with the down-contribution rows."""
    counted = _is("DAMAGE") & (F.col("result") != 10)
    hit = counted & landed_hit()
    direct = hit & ~F.col("is_condition")
    condition = hit & catalogue_condition(condition_ids)
    critable = direct & ~F.col("skill_id").isin(list(noncritable)) if noncritable else direct
    critical = critable & F.col("result").isin(1, 8)
    rows = events.filter(F.col("event_type").isin("DAMAGE", "CC")).groupBy(FIGHT, "source_agent_id").agg(
        count_where(counted).alias("totalDamageCount"), sum_where(counted, "damage").alias("totalDmg"),
        count_where(hit).alias("connectedDamageCount"), sum_where(hit, "damage").alias("connectedDmg"),
        count_where(direct).alias("connectedDirectDamageCount"), sum_where(direct, "damage").alias("connectedDirectDmg"),
        count_where(condition).alias("connectedConditionCount"), sum_where(condition, "damage").alias("connectedConditionDamage"),
        count_where(critable).alias("critableDirectDamageCount"),
        count_where(critical).alias("criticalRate"), sum_where(critical, "damage").alias("criticalDmg"),
        count_where(counted & absorbed_hit()).alias("invulned"),
        count_where(_is("CC")).alias("appliedCrowdControl"), sum_where(_is("CC"), "cc_value").alias("appliedCrowdControlDuration"),
    )
    names = {
        "kills": "killed", "downs": "downed", "against_downed_count": "againstDownedCount", "against_downed_damage": "againstDownedDamage",
        "down_contribution_damage": "downContribution", "down_contribution_cc_count": "appliedCrowdControlDownContribution",
        "down_contribution_cc_ms": "appliedCrowdControlDurationDownContribution",
    }
    down_part = downs.select(FIGHT, "source_agent_id", *[F.col(a).alias(b) for a, b in names.items()])
    rows = rows.join(down_part, [FIGHT, "source_agent_id"], "left")
    return rows.fillna(0, list(names.values()))


def skill_statistics(events: DataFrame, keys: list[str], interrupted: DataFrame | None = None) -> DataFrame:
    """Per-skill damage, connected hits and critical hits.

    Connected hits are normal plus landed condition hits; without any, breakbar
    hits count only when nothing else failed and the skill was not interrupted.
    ``interrupted``: keys + skill_id.
    """
    condition, result = F.col("is_condition"), F.col("result")
    normal = ~condition & result.isin(0, 1, 2)
    crit = ~condition & result.isin(1, 8) & (F.col("buff_dmg") == 0)
    rows = events.filter(_is("DAMAGE")).groupBy(*keys, "skill_id").agg(
        F.sum("damage").alias("totalDamage"), count_where(normal).alias("_normal"),
        count_where(condition & landed_hit()).alias("_ticks"), count_where(~condition & (result == 10)).alias("_breakbar"),
        count_where(~condition & ~result.isin(0, 1, 2, 10)).alias("_failed"),
        count_where(crit).alias("crit"), sum_where(crit, "damage").alias("critDamage"),
    )
    if interrupted is not None:
        rows = rows.join(interrupted.distinct().withColumn("_cut", F.lit(True)), [*keys, "skill_id"], "left")
    else:
        rows = rows.withColumn("_cut", F.lit(None).cast("boolean"))
    landed = F.col("_normal") + F.col("_ticks")
    connected = F.when(landed > 0, landed).when((F.col("_failed") == 0) & F.col("_cut").isNull(), F.col("_breakbar")).otherwise(0)
    return rows.withColumn("connectedHits", connected).drop("_normal", "_ticks", "_breakbar", "_failed", "_cut")


def defence_statistics(events: DataFrame, downed_buff_id: int, condition_ids: list[int] | None = None, anonymous: DataFrame | None = None) -> DataFrame:
    """Damage taken, avoidance and downs per (fight, agent).

    Down count: distinct downed-outcome times for named agents, else distinct
    times the downed buff was applied, else down events (anonymous agents) or the
    outcome times when the fight has no downed-buff applies at all.
    """
    taken_kinds = F.col("event_type").isin("DAMAGE", "COMBAT_OUTCOME", "BOON_APPLY")
    agent = F.when(taken_kinds, F.col("target_agent_id")).otherwise(F.col("source_agent_id"))
    downed_apply = _is("BOON_APPLY") & (F.col("kind") == "apply") & (F.col("skill_id") == downed_buff_id)
    rows = events.filter(
        F.col("event_type").isin("DAMAGE", "BLOCK", "DODGE", "DOWN", "DEATH") | (_is("COMBAT_OUTCOME") & (F.col("outcome") == "downed")) | downed_apply
    )
    real = landed_hit() & ~(~F.col("is_condition") & (F.col("result") == 10) & (F.col("damage") == 0) & (F.col("buff_dmg") == 0))
    condi = catalogue_condition_damage(condition_ids)
    moment = F.when(_is("COMBAT_OUTCOME") | downed_apply, F.col("time_ms"))
    # first per (agent, kind, time): distinct times become plain counts
    fine = rows.groupBy(FIGHT, agent.alias("agent_id"), F.when(moment.isNotNull(), F.col("event_type")).alias("mark"), moment.alias("mark_ms")).agg(
        sum_where(_is("DAMAGE"), "damage").alias("damageTaken"), count_where(_is("DAMAGE") & real).alias("damageTakenCount"),
        sum_where(_is("DAMAGE"), condi).alias("conditionDamageTaken"),
        count_where(_is("BLOCK")).alias("blockedCount"), count_where(_is("DODGE")).alias("evadedCount"),
        count_where(_is("DOWN")).alias("_downs"), sum_where(_is("DOWN"), "downtime_ms").alias("downDuration"),
        count_where(_is("DEATH")).alias("deadCount"),
    )
    sums = ["damageTaken", "damageTakenCount", "conditionDamageTaken", "blockedCount", "evadedCount", "_downs", "downDuration", "deadCount"]
    out = fine.groupBy(FIGHT, "agent_id").agg(
        *[F.sum(c).alias(c) for c in sums],
        count_where(F.col("mark") == "COMBAT_OUTCOME").alias("_outcomes"), count_where(F.col("mark") == "BOON_APPLY").alias("_buffed"),
    )
    out = out.withColumn("powerDamageTaken", F.col("damageTaken") - F.col("conditionDamageTaken"))
    has_buff = events.filter(downed_apply).select(FIGHT).distinct().withColumn("_has", F.lit(True))
    out = out.join(has_buff, FIGHT, "left")
    if anonymous is not None:
        out = out.join(anonymous.select(FIGHT, "agent_id").withColumn("_anon", F.lit(True)), [FIGHT, "agent_id"], "left")
    else:
        out = out.withColumn("_anon", F.lit(None).cast("boolean"))
    named = F.col("_anon").isNull()
    first = F.when((F.col("_outcomes") > 0) & named, F.col("_outcomes")).otherwise(F.col("_buffed"))
    fallback = F.when(~named, F.col("_downs")).when(F.col("_has").isNull(), F.col("_outcomes")).otherwise(0)
    out = out.withColumn("downCount", F.when(first > 0, first).otherwise(fallback))
    return out.drop("_downs", "_outcomes", "_buffed", "_has", "_anon")


def target_statistics(events: DataFrame, seconds: DataFrame, condition_ids: list[int] | None = None) -> DataFrame:
    """Damage split per (source, target) with whole-number rates, rounded half to even."""
    condi = catalogue_condition_damage(condition_ids)
    rows = events.filter(_is("DAMAGE")).groupBy(FIGHT, "source_agent_id", "target_agent_id").agg(
        F.sum("damage").alias("damage"), F.sum(condi).cast("bigint").alias("condiDamage")
    )
    rows = rows.withColumn("powerDamage", F.col("damage") - F.col("condiDamage")).join(seconds.select(FIGHT, "duration_s"), FIGHT, "left")
    rate = lambda c: F.when(F.col("duration_s") > 0, F.bround(F.col(c) / F.col("duration_s"))).otherwise(0.0).cast("bigint")
    return rows.withColumns({"dps": rate("damage"), "condiDps": rate("condiDamage"), "powerDps": rate("powerDamage")}).drop("duration_s")


# -- comparison ---------------------------------------------------------------------
def _verdict(matched: Column) -> Column:
    return F.when(matched, "PASS").otherwise("FAIL")


def compare_fields(expected: DataFrame, actual: DataFrame, keys: list[str], fields: list[str], prefix: str, rule: str = "field-equal") -> DataFrame:
    """One PASS/FAIL row per expected field with a value; a missing actual value fails."""
    long = lambda df, name: df.select(*keys, *[F.col(f).cast("double").alias(f) for f in fields]).unpivot(keys, fields, "field", name)
    rows = long(expected, "expected").filter(F.col("expected").isNotNull()).join(long(actual, "actual"), [*keys, "field"], "left")
    key = F.concat(F.lit(prefix + "["), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), F.lit("]."), F.col("field"))
    return rows.select(
        *keys, key.alias("key"), _verdict(F.col("expected").eqNullSafe(F.col("actual"))).alias("status"),
        "expected", "actual", (F.col("actual") - F.col("expected")).alias("delta"), F.lit(rule).alias("rule"),
    )


def compare_within(expected: DataFrame, actual: DataFrame, keys: list[str], value: str, tolerance: float = UPTIME_TOLERANCE) -> DataFrame:
    """Expected values summed per key, both rounded to 3 places, equal within a tolerance; one row per key."""
    want = expected.groupBy(*keys).agg(F.sum(value).alias("expected"))
    rows = want.join(actual.select(*keys, F.col(value).alias("actual")), keys, "left")
    a, e = F.bround(F.coalesce("actual", F.lit(0.0)), 3), F.bround("expected", 3)
    # compare in thousandths: exact for values rounded to three places
    close = F.abs(F.round(a * 1000) - F.round(e * 1000)) <= tolerance * 1000
    return rows.withColumns({"status": _verdict(close), "delta": F.round(a - e, 3)})


def missing_entities(expected: DataFrame, actual: DataFrame, key: str, slice_column: str) -> DataFrame:
    """FAIL row per expected entry whose entity is absent; split entities carry the slice in the key."""
    parts = expected.groupBy(key).agg(F.count(F.lit(1)).alias("_parts"))
    rows = expected.join(actual.select(key).distinct(), key, "left_anti").join(parts, key)
    name = F.when(F.col("_parts") > 1, F.concat_ws("@", F.col(key).cast("string"), F.col(slice_column).cast("string"))).otherwise(F.col(key).cast("string"))
    return rows.select(
        key, slice_column, F.concat(F.lit("entities["), name, F.lit("]")).alias("key"), F.lit("FAIL").alias("status"), F.lit("entity-present").alias("rule")
    )


def compare_multisets(expected: DataFrame, actual: DataFrame, keys: list[str], item: list[str]) -> DataFrame:
    """Whether two bags of rows are equal per key; the differing item count decides, no list is built."""
    count = lambda df, name: df.groupBy(*keys, *item).agg(F.count(F.lit(1)).alias(name))
    rows = count(expected, "want").join(count(actual, "have"), [*keys, *item], "full")
    off = F.abs(F.coalesce("want", F.lit(0)) - F.coalesce("have", F.lit(0)))
    out = rows.groupBy(*keys).agg(F.sum(off).alias("differing"), F.sum(F.coalesce("want", F.lit(0))).alias("expected_items"))
    return out.withColumn("status", _verdict(F.col("differing") == 0))


def match_casts(expected: DataFrame, actual: DataFrame, keys: list[str], slack_ms: int = CAST_SLACK_MS, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Greedy multiset match of casts per (keys, skill): MATCHED, MISSING and EXTRA rows.

    An expected cast takes the first remaining actual one with equal duration at
    most ``slack_ms`` away, or at equal time when either duration is 0. Candidates
    are always within ``slack_ms``, so the casts of a skill fall into islands at
    larger gaps. Islands are dealt to tasks and read in time order; a task holds
    the counted casts of the last ``2 * slack_ms`` only.
    """
    group = [*keys, "skill_id"]
    side = lambda df, flag: df.groupBy(*group, "time_ms", "duration_ms").agg(F.count(F.lit(1)).alias("n")).withColumn("_side", F.lit(flag))
    rows = side(expected, 0).unionByName(side(actual, 1))
    order = ("time_ms", "_side", "duration_ms")
    rows = running(rows, group, [Running("_prev", "prev", F.col("time_ms"))], order, chunk_ms)
    opens = F.col("_prev").isNull() | (F.col("time_ms") - F.col("_prev") > slack_ms)
    rows = running(rows, group, [Running("_island", "last", F.when(opens, F.col("time_ms")))], order, chunk_ms)
    rows = rows.withColumn("_group", F.to_json(F.struct(*group, "_island")))
    ordered = rows.select(*group, "_group", *order, "n").repartition("_group").sortWithinPartitions("_group", *order)
    schema = ordered.select(*group, F.lit("").alias("verdict"), "time_ms", "duration_ms", "n").schema

    def walk(batches):
        import pyarrow as pa

        current, head, window = None, (), CastWindow(slack_ms)
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if row["_group"] != current:
                    out.extend((*head, *found) for found in window.close())
                    current, head = row["_group"], tuple(row[g] for g in group)
                out.extend((*head, *found) for found in window.take(row["_side"], row["time_ms"], row["duration_ms"], row["n"]))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], arrow_schema)
        rest = [(*head, *found) for found in window.close()]
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rest], arrow_schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(schema)
    return ordered.mapInArrow(walk, schema)


class CastWindow:
    """Counted casts of one island that can still meet another, in time order."""

    def __init__(self, slack_ms: int) -> None:
        self.slack_ms = slack_ms
        self.wanted: list[tuple[int, int, int]] = []
        self.left: list[list[int]] = []

    def take(self, side: int, time: int, duration: int, n: int):
        """Add a cast; yields what is decided once no later cast can change it."""
        yield from self._settle(time - self.slack_ms)
        if side == 0:
            self.wanted.append((time, duration, n))
        else:
            self.left.append([time, duration, n])

    def close(self):
        yield from self._settle(None)
        yield from (("EXTRA", t, d, n) for t, d, n in self.left if n)
        self.left = []

    def _settle(self, before: int | None):
        ready = [w for w in self.wanted if before is None or w[0] < before]
        for t, d, need in ready:
            for other in self.left:
                same = other[1] == d and abs(other[0] - t) <= self.slack_ms
                instant = other[0] == t and (other[1] == 0 or d == 0)
                if need and other[2] and (same or instant):
                    used = min(need, other[2])
                    need, other[2] = need - used, other[2] - used
                    yield "MATCHED", t, d, used
            if need:
                yield "MISSING", t, d, need
        self.wanted = self.wanted[len(ready) :]
        if before is not None:
            # a waiting cast is at ``before`` or later, so it reaches back to before - slack at most
            gone = [x for x in self.left if x[0] < before - self.slack_ms]
            self.left = self.left[len(gone) :]
            yield from (("EXTRA", t, d, n) for t, d, n in gone if n)


def cast_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Distinct casts on one side only, counted per skill and direction."""
    columns = expected.columns
    missing = expected.select(*columns).subtract(actual.select(*columns)).withColumn("direction", F.lit("missing"))
    extra = actual.select(*columns).subtract(expected.select(*columns)).withColumn("direction", F.lit("extra"))
    return missing.unionByName(extra).groupBy("skill_id", "direction").agg(F.count(F.lit(1)).alias("casts"))


def worst_skills(differences: DataFrame, n: int) -> DataFrame:
    """The n skills with the largest sum of missing and extra casts, ties by skill."""
    side = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("casts"))), F.lit(0)).alias(d)
    totals = differences.groupBy("skill_id").agg(side("missing"), side("extra"), F.sum("casts").alias("_all"))
    order = [F.desc("_all"), "skill_id"]
    # the n rows are taken first, so only they are numbered together
    top = totals.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).drop("_all")


# -- slices -----------------------------------------------------------------------------
ABSENCE_FLOOR_MS = 1_000
UNBOUNDED_MS = 2**62


def slice_bounds(entries: DataFrame) -> DataFrame:
    """Adds ``lo_ms`` and ``hi_ms``: the stretch an entry covers; entries without a valid one cover all of the fight."""
    valid = F.col("first_ms").isNotNull() & F.col("last_ms").isNotNull() & (F.col("last_ms") >= F.col("first_ms"))
    bound = lambda name, other: F.when(valid, F.col(name)).otherwise(F.lit(other)).cast("bigint")
    return entries.withColumns({"lo_ms": bound("first_ms", -UNBOUNDED_MS), "hi_ms": bound("last_ms", UNBOUNDED_MS)})


def entry_teams(entries: DataFrame, keys: list[str], order: str, team: str) -> DataFrame:
    """The team shows on the last entry of an account only, 0 on the others."""
    last = entries.groupBy(*keys).agg(F.max(order).alias("_last"))
    rows = entries.join(last, keys)
    return rows.withColumn(team, F.when(F.col(order) == F.col("_last"), F.col(team)).otherwise(0)).drop("_last")


def events_in_slices(events: DataFrame, slices: DataFrame) -> DataFrame:
    """Events of every entry's agent inside its stretch (closed); an agent has few entries, so rows hardly multiply."""
    rows = events.join(slices, ["fight_id", "source_agent_id"])
    return rows.filter(F.col("time_ms").between(F.col("lo_ms"), F.col("hi_ms")))


def absence_stops(awareness: DataFrame, ends: DataFrame, grace_ms: int = L.DESPAWN_GRACE_MS) -> DataFrame:
    """When an agent that leaves early stops holding buffs; null for those last seen close to the fight's end."""
    rows = awareness.join(ends.select("fight_id", "end_ms"), "fight_id")
    gone = F.col("end_ms") - F.col("last_ms") > ABSENCE_FLOOR_MS
    return rows.withColumn("stop_ms", F.when(gone, F.col("last_ms") + grace_ms)).drop("end_ms")


def header_results(fights: DataFrame, expected: dict[str, Column], actual: dict[str, Column]) -> DataFrame:
    """One row per fight and expected header field: PASS when equal (nulls are equal to each other)."""
    fields = F.array(*[
        F.struct(F.lit(name).alias("field"), F.when(value.eqNullSafe(actual[name]), "PASS").otherwise("FAIL").alias("status")) for name, value in expected.items()
    ])
    return fights.select("fight_id", F.inline(fields))


# -- classification and report ------------------------------------------------------
def bucket(key: Column) -> Column:
    """``players[x].stats.total`` -> ``players.stats.total``."""
    return F.regexp_replace(key, r"\[[^\]]*\]", "")


SELECTORS = ["stem", "account", "bucket", "skill_id", "key"]
SELECTOR_SETS = [list(c) for n in range(len(SELECTORS) + 1) for c in combinations(SELECTORS, n)]


RULE_SHARES = 256


def classify_known(results: DataFrame, rules: DataFrame, selector_sets: list[list[str]] = SELECTOR_SETS) -> DataFrame:
    """FAIL rows explained by the first rule whose selectors all equal and whose bound holds become KNOWN_DELTA.

    ``rules``: ord, rule_id, ``sel_<selector>`` (null = any), max_abs_delta, reason.
    A rule and a failure meet on one text key: which selectors are used, and their
    values. A failure carries one key per selector set in use (pass the sets the
    rule file uses), so matching is a single equi-join. (stem, key) identifies a result.
    """
    results = results.withColumn("bucket", bucket(F.col("key")))

    def address(used: list[str], prefix: str) -> Column:
        parts = [F.concat(F.lit(f"{s}="), F.coalesce(F.col(prefix + s).cast("string"), F.lit("\x00"))) for s in used]
        return F.concat_ws("\x1f", *parts) if parts else F.lit("any")

    given = [F.when(F.col(f"sel_{s}").isNotNull(), F.concat(F.lit(f"{s}="), F.col(f"sel_{s}").cast("string"))) for s in SELECTORS]
    rule_address = F.when(F.coalesce(*given).isNull(), F.lit("any")).otherwise(F.concat_ws("\x1f", *given))
    keyed = rules.select("ord", "rule_id", "reason", "max_abs_delta", rule_address.alias("_at"))
    fails = results.filter("status = 'FAIL'").withColumn("_at", F.explode(F.array(*[address(u, "") for u in selector_sets])))
    bound = F.col("max_abs_delta").isNull() | (F.abs("delta") <= F.abs("max_abs_delta"))
    # few addresses hold all fails: each is spread over shares of the keys, rules stand in every share
    fails = fails.withColumn("_share", F.pmod(F.xxhash64("stem", "key"), F.lit(RULE_SHARES)))
    keyed = keyed.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(RULE_SHARES - 1).cast("bigint"))))
    best = fails.join(keyed, ["_at", "_share"]).filter(bound).groupBy("stem", "key").agg(F.min(F.struct("ord", "rule_id", "reason")).alias("r"))
    rows = results.join(best, ["stem", "key"], "left")
    known = (F.col("status") == "FAIL") & F.col("r").isNotNull()
    return rows.withColumns(
        {
            "status": F.when(known, "KNOWN_DELTA").otherwise(F.col("status")),
            "rule_id": F.when(known, F.col("r.rule_id")), "reason": F.when(known, F.col("r.reason")),
        }
    ).drop("r")


def status_report(results: DataFrame) -> DataFrame:
    """Counts per bucket with one column per status."""
    statuses = ["PASS", "FAIL", "KNOWN_DELTA"]
    return results.groupBy("bucket").agg(*[count_where(F.col("status") == s).alias(s.lower()) for s in statuses])


def delta_profile(results: DataFrame, top: int = 4) -> DataFrame:
    """Signed delta distribution per bucket: positive and negative counts, sum, most common deltas in long form."""
    rows = results.filter("status = 'FAIL' and delta is not null").withColumn("delta", F.bround("delta", 3))
    counts = rows.groupBy("bucket", "delta").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("bucket").agg(
        sum_where(F.col("delta") > 0, "n").alias("positive"), sum_where(F.col("delta") < 0, "n").alias("negative"),
        F.bround(F.sum(F.col("delta") * F.col("n")), 3).alias("delta_sum"),
    )
    from frayline.operators.profiles import top_per_key

    best = top_per_key(counts, ["bucket"], "n", "delta", top)
    return best.join(totals, "bucket")


# -- corpus diagnostics ---------------------------------------------------------------
def _spots(events: DataFrame, keys: list[str], radius_ms: int) -> DataFrame:
    """Least and greatest time per event key and bucket of ``radius_ms``, with how many events there are."""
    return events.groupBy(*keys, "event_key", F.floor(F.col("time_ms") / radius_ms).alias("_b")).agg(
        F.min("time_ms").alias("lo"), F.max("time_ms").alias("hi"), F.count(F.lit(1)).alias("fires")
    )


def _near(casts: DataFrame, spots: DataFrame, keys: list[str], radius_ms: int) -> DataFrame:
    marks = casts.groupBy(*keys, "cast_ms").agg(F.count(F.lit(1)).alias("n")).withColumn("_b", F.floor(F.col("cast_ms") / radius_ms))
    # a time of the cast's own bucket is always near; of the bucket before only the greatest can decide, of the one after the least
    seen = lambda side, at: F.struct((F.col("_b") + side).alias("_b"), *[F.when(F.lit(side == i), F.col(at)).alias(n) for i, n in ((0, "own"), (1, "before"), (-1, "after"))])
    around = spots.select(*keys, "event_key", F.inline(F.array(seen(0, "lo"), seen(1, "hi"), seen(-1, "lo"))))
    around = around.groupBy(*keys, "event_key", "_b").agg(*[F.max(c).alias(c) for c in ("own", "before", "after")])
    reached = [F.col("own").isNotNull(), F.col("cast_ms") - F.col("before") <= radius_ms, F.col("after") - F.col("cast_ms") <= radius_ms]
    return marks.join(around, [*keys, "_b"]).filter(reached[0] | reached[1] | reached[2]).select(*keys, "cast_ms", "event_key", "n")


def coincidences(casts: DataFrame, events: DataFrame, keys: list[str], radius_ms: int = 30) -> DataFrame:
    """Distinct (cast, event key) pairs within ``radius_ms``.

    ``casts``: keys + cast_ms; ``events``: keys + time_ms + event_key. Events become one row per event key and bucket of
    ``radius_ms``, which also holds the nearest times of the two buckets beside it. A cast time meets each event key
    once, however many events are near, so nothing is paired that does not share a bucket or touch it.
    """
    return _near(casts, _spots(events, keys, radius_ms), keys, radius_ms)


def trigger_candidates(casts: DataFrame, events: DataFrame, keys: list[str], radius_ms: int = 30, min_cover: float = 0.9) -> DataFrame:
    """Event keys found near at least ``min_cover`` of the casts, with how often they fire at all."""
    spots = _spots(events, keys, radius_ms)
    covers = _near(casts, spots, keys, radius_ms).groupBy("event_key").agg(F.sum("n").alias("covers"))
    fires = spots.groupBy("event_key").agg(F.sum("fires").alias("fires"))
    total = casts.agg(F.count(F.lit(1)).alias("casts"))  # one row
    rows = covers.join(fires, "event_key").join(total)
    return rows.filter(F.col("covers") >= F.col("casts") * min_cover).withColumn("one_to_one", F.col("fires") == F.col("casts"))


def rule_what_if(expected: DataFrame, baseline: DataFrame, candidates: DataFrame, keys: list[str], chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Change in unmatched casts per (log, candidate) if one candidate rule were added.

    ``candidates``: candidate_id + cast columns. Only skills a candidate produces
    can change, so each is compared on its own skills only.
    """
    unmatched = lambda df: df.filter("verdict <> 'MATCHED'")
    touched = candidates.select("candidate_id", "skill_id").distinct()
    want = expected.join(touched, "skill_id")
    have = baseline.join(touched, "skill_id")
    tagged = ["candidate_id", *keys]
    columns = [*tagged, "skill_id", "time_ms", "duration_ms"]
    count = lambda df, name: unmatched(match_casts(want.select(*columns), df.select(*columns), tagged, chunk_ms=chunk_ms)).groupBy(*tagged).agg(F.sum("n").alias(name))
    before = count(have, "before")
    after = count(have.select(*columns).unionByName(candidates.select(*columns)), "after")
    rows = before.join(after, tagged, "full").fillna(0, ["before", "after"])
    return rows.withColumn("change", F.col("after") - F.col("before"))


def code_votes(groups: DataFrame, hits: DataFrame, keys: list[str], codes: list[str]) -> DataFrame:
    """Votes of groups that hold one single code: did all, none or some of their hits connect?

    ``groups``: keys + hits + connected (as reported); ``hits``: keys + codes.
    """
    mine = hits.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.struct(*codes)).alias("low"), F.max(F.struct(*codes)).alias("high")
    ).filter(F.col("low") == F.col("high"))
    rows = groups.join(mine, keys).filter(F.col("hits") == F.col("rows"))
    vote = F.when(F.col("connected") == F.col("rows"), "all").when(F.col("connected") == 0, "none").otherwise("partial")
    rows = rows.select(*[F.col(f"low.{c}").alias(c) for c in codes], vote.alias("vote"))
    return rows.groupBy(*codes).agg(*[count_where(F.col("vote") == v).alias(v) for v in ("all", "none", "partial")])


def residual_profile(mismatched: DataFrame, rows: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """What the rows behind mismatched counters look like."""
    return rows.join(mismatched.select(*keys), keys, "left_semi").groupBy(*attributes).agg(F.count(F.lit(1)).alias("rows"))


def match_verdicts(targets: DataFrame, candidates: DataFrame, key: list[str]) -> DataFrame:
    """unique / ambiguous / unresolved per target, counted."""
    sizes = candidates.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    rows = targets.join(sizes, key, "left")
    verdict = F.when(F.col("n").isNull(), "unresolved").when(F.col("n") > 1, "ambiguous").otherwise("unique")
    return rows.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("targets"))
