"""Temporal identity: ownership intervals, presence, aliases and entity matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frayline.functions import lookups as L
from frayline.functions.names import bare_account, spec_label
from frayline.operators.scan import CHUNK_MS, Running, running, value_at

FIGHT = "fight_id"
ABSENCE_FLOOR_MS = 1_000
OWNER_BUCKET_MS = 60_000


def ownership_intervals(resolved: DataFrame, raw: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Lives of agents split by owner: ``[start_ms, end_ms)`` relative to the fight's first record.

    ``resolved`` are the ``raw`` records with their ``master``. A spawn (6) opens a
    life, a despawn (7) ends it, a record naming another master splits it; what is
    still open ends with the fight. Intervals without an owner are kept.
    """
    rows = resolved.filter("time > 0 and src <> 0")
    ends = raw.filter("time > 0").groupBy(FIGHT).agg(F.min("time").alias("origin"), F.max("time").alias("last"))
    spawn, despawn = F.col("statechange") == 6, F.col("statechange") == 7
    names_owner = F.col("src_master") != 0
    marks = rows.filter(spawn | despawn | names_owner).select(
        FIGHT, F.col("src").alias("agent_id"), "seq", F.col("time").alias("time_ms"),
        spawn.alias("fresh"),
        F.when(despawn, F.lit("gone")).otherwise(F.coalesce(F.col("master").cast("string"), F.lit("none"))).alias("state"),
        F.when(~despawn, F.col("master")).alias("owner_agent_id"), "src_inst",
    )
    keys = [FIGHT, "agent_id"]
    marks = running(marks, keys, [Running("before", "prev", F.col("state"))], ("time_ms", "seq"), chunk_ms)
    changed = F.col("fresh") | F.col("before").isNull() | (F.col("before") != F.col("state"))
    marks = marks.filter(changed)
    marks = running(marks, keys, [Running("next_ms", "next", F.col("time_ms"))], ("time_ms", "seq"), chunk_ms)
    out = marks.filter("state <> 'gone'").join(ends, FIGHT).select(
        *keys, "owner_agent_id", F.col("src_inst").alias("instance_id"),
        (F.col("time_ms") - F.col("origin")).alias("start_ms"),
        (F.coalesce("next_ms", "last") - F.col("origin")).alias("end_ms"),
    )
    return out.filter("end_ms > start_ms")


def owner_at(probes: DataFrame, intervals: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Adds ``owner_agent_id`` of ``agent_id`` at ``time_ms`` (null when unowned)."""
    return value_at(probes, intervals, [FIGHT, "agent_id"], "owner_agent_id", "owner_agent_id", chunk_ms)


def owned_agents_at(probes: DataFrame, intervals: DataFrame, bucket_ms: int = OWNER_BUCKET_MS) -> DataFrame:
    """Agents owned by ``owner_agent_id`` at ``time_ms``; one row per match.

    Intervals are cut at bucket borders, so the equi-join key carries the time and
    a busy owner spreads over its buckets.
    """
    pieces = intervals.select(
        FIGHT, "owner_agent_id", F.col("agent_id").alias("owned_agent_id"), "start_ms", "end_ms",
        F.explode(F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor((F.col("end_ms") - 1) / bucket_ms))).alias("_bucket"),
    )
    asked = probes.withColumn("_bucket", F.floor(F.col("time_ms") / bucket_ms))
    rows = asked.join(pieces, [FIGHT, "owner_agent_id", "_bucket"])
    rows = rows.filter((F.col("start_ms") <= F.col("time_ms")) & (F.col("time_ms") < F.col("end_ms")))
    return rows.drop("_bucket", "start_ms", "end_ms")


def account_slices(agents: DataFrame, awareness: DataFrame) -> DataFrame:
    """Position of each agent among the agents of its account, by first mention (an account has few agents per fight)."""
    rows = agents.filter("account_name is not null").join(awareness, [FIGHT, "agent_id"], "left")
    w = Window.partitionBy(FIGHT, "account").orderBy(F.col("first_ms").asc_nulls_last(), "agent_id")
    rows = rows.withColumn("account", bare_account(F.col("account_name")))
    return rows.select(FIGHT, "agent_id", (F.row_number().over(w) - 1).alias("slice_index"))


def identity_at(probes: DataFrame, agents: DataFrame, intervals: DataFrame, awareness: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Identity of an agent at a time, with its owner's account and its slice index."""
    rows = owner_at(probes, intervals, chunk_ms)
    rows = rows.join(agents.withColumn("account", bare_account(F.col("account_name"))).drop("account_name"), [FIGHT, "agent_id"])
    owners = agents.select(FIGHT, F.col("agent_id").alias("owner_agent_id"), bare_account(F.col("account_name")).alias("owner_account"))
    rows = rows.join(owners, [FIGHT, "owner_agent_id"], "left")
    return rows.join(account_slices(agents, awareness), [FIGHT, "agent_id"], "left")


def slice_owners(slices: DataFrame, intervals: DataFrame, agents: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Owner account at the midpoint of each slice (``agent_id, lo_ms, hi_ms``)."""
    probes = slices.withColumn("time_ms", F.expr("(lo_ms + hi_ms) div 2"))
    rows = owner_at(probes, intervals, chunk_ms)
    owners = agents.select(FIGHT, F.col("agent_id").alias("owner_agent_id"), bare_account(F.col("account_name")).alias("owner_account"))
    return rows.join(owners, [FIGHT, "owner_agent_id"], "left")


def presence_at(probes: DataFrame, awareness: DataFrame) -> DataFrame:
    """Whether the agent is mentioned around ``time_ms`` (closed span; one span per agent)."""
    rows = probes.join(awareness, [FIGHT, "agent_id"], "left")
    here = F.coalesce(F.col("time_ms").between(F.col("first_ms"), F.col("last_ms")), F.lit(False))
    return rows.withColumn("present", here).drop("first_ms", "last_ms")


def instance_recycling(intervals: DataFrame) -> DataFrame:
    """Distinct agents per instance id, with the instance's overall span."""
    per_agent = intervals.filter("instance_id <> 0").groupBy(FIGHT, "instance_id", "agent_id").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")
    )
    return per_agent.groupBy(FIGHT, "instance_id").agg(
        F.count(F.lit(1)).alias("agents"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")
    )


def overlapping_agents(slices: DataFrame, spans: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Number of spans of the slice's instance that overlap ``[lo_ms, hi_ms]``.

    Overlaps = spans begun by hi minus spans ended before lo: two running counts
    on one timeline per instance, no pairs.
    """
    keys = [FIGHT, "instance_id"]
    points = F.array(
        F.struct(F.col("lo_ms").alias("time_ms"), F.lit(0).alias("prio"), F.lit(0).alias("begun"), F.lit(0).alias("ended"), F.lit("lo").alias("what")),
        F.struct(F.col("hi_ms").alias("time_ms"), F.lit(2).alias("prio"), F.lit(0).alias("begun"), F.lit(0).alias("ended"), F.lit("hi").alias("what")),
    )
    asked = slices.select(*keys, "agent_id", "lo_ms", "hi_ms", F.inline(points))
    marks = spans.select(
        *keys, "agent_id", F.lit(None).cast("bigint").alias("lo_ms"), F.lit(None).cast("bigint").alias("hi_ms"),
        F.inline(
            F.array(
                F.struct(F.col("first_ms").alias("time_ms"), F.lit(1).alias("prio"), F.lit(1).alias("begun"), F.lit(0).alias("ended"), F.lit("span").alias("what")),
                F.struct(F.col("last_ms").alias("time_ms"), F.lit(1).alias("prio"), F.lit(0).alias("begun"), F.lit(1).alias("ended"), F.lit("span").alias("what")),
            )
        ),
    )
    rows = running(
        asked.unionByName(marks), keys,
        [Running("n_begun", "sum", F.col("begun")), Running("n_ended", "sum", F.col("ended"))],
        ("time_ms", "prio", "agent_id", "what", "begun"), chunk_ms,
    )
    return rows.filter("what <> 'span'").groupBy(*keys, "agent_id", "lo_ms", "hi_ms").agg(
        (F.max(F.when(F.col("what") == "hi", F.col("n_begun"))) - F.max(F.when(F.col("what") == "lo", F.col("n_ended")))).alias("overlapping")
    )


def active_durations(slices: DataFrame, spans: DataFrame, fights: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """How long buff time may run for an alias within a slice.

    ``slices``/``spans`` carry ``instance_id``; ``fights`` carries ``duration_ms``.
    Several agents on the instance: the slice length. Alone and gone more than a
    second before the end: last mention plus a grace. Otherwise unbounded (null).
    """
    counts = overlapping_agents(slices.filter("instance_id <> 0"), spans, chunk_ms)
    rows = slices.join(counts, [FIGHT, "instance_id", "agent_id", "lo_ms", "hi_ms"], "left")
    rows = rows.join(spans.select(FIGHT, "agent_id", "last_ms"), [FIGHT, "agent_id"], "left").join(fights.select(FIGHT, "duration_ms"), FIGHT)
    value = F.when(F.col("instance_id") == 0, F.lit(None).cast("bigint")).when(
        F.col("overlapping") > 1, F.col("hi_ms") - F.col("lo_ms")
    ).when(F.col("duration_ms") - F.col("last_ms") > ABSENCE_FLOOR_MS, F.col("last_ms") + L.DESPAWN_GRACE_MS)
    return rows.withColumn("active_ms", value).drop("last_ms", "duration_ms")


def match_entities(entries: DataFrame, agents: DataFrame, spans: DataFrame, anonymous_prefix: str = "Non Squad Player") -> DataFrame:
    """Best agent for every expected entry (``entry_id, account, name, profession_label, instance_id, lo_ms, hi_ms``).

    Candidates come from two equi-joins (account, instance); each gets the rank
    of the strongest rule it meets and the lowest (rank, order) wins: present at
    the slice's midpoint first, by anonymous instance, name, label, any, instance;
    then the same without presence.

    An instance id may be shared by a share of all agents, and its rules look at nothing but the midpoint: agents meet the
    distinct midpoints of their instance and are added up at once to the best ones, so no pair of entry and agent is stored.
    """
    mid = F.expr("(lo_ms + hi_ms) div 2")
    entries = entries.withColumn("_mid", mid).withColumn("_anonymous", F.col("account").startswith(anonymous_prefix))
    who = agents.join(spans, [FIGHT, "agent_id"], "left").select(
        FIGHT, "agent_id", F.col("name").alias("a_name"), bare_account(F.col("account_name")).alias("a_account"),
        spec_label(F.col("profession"), F.col("elite")).alias("a_label"), F.col("instance_id").alias("a_instance"), "first_ms", "last_ms",
    )
    by_account = entries.join(who.withColumn("account", F.col("a_account")), [FIGHT, "account"])
    columns = ["entry_id", FIGHT, "agent_id", "rank", "tie"]
    present = F.coalesce(F.col("_mid").between(F.col("first_ms"), F.col("last_ms")), F.lit(False))
    same_name, same_label = F.col("a_name") == F.col("name"), F.col("a_label") == F.col("profession_label")
    account_rank = (
        F.when(present & same_name, 1).when(present & same_label, 2).when(present, 3)
        .when(same_name, 6).when(same_label, 7).otherwise(8)
    )
    # unconditional fallbacks take the last agent, the others the first one
    tie = F.when(F.col("rank").isin(8, 9), -F.col("agent_id")).otherwise(F.col("agent_id"))
    place = [FIGHT, "instance_id", "_mid"]
    met = entries.select(*place).distinct().join(who.withColumn("instance_id", F.col("a_instance")), [FIGHT, "instance_id"])
    unnamed, agent = F.col("a_account").isNull(), F.col("agent_id")
    firsts = met.groupBy(*place).agg(
        F.min(F.when(unnamed & present, agent)).alias("_unnamed_here"), F.min(F.when(present, agent)).alias("_here"),
        F.min(F.when(unnamed, agent)).alias("_unnamed"), F.max(agent).alias("_last"),
    )
    rules = [(0, F.when(F.col("_anonymous"), F.col("_unnamed_here"))), (4, F.col("_here")), (5, F.when(F.col("_anonymous"), F.col("_unnamed"))), (9, F.col("_last"))]
    found = F.coalesce(*[F.when(who_.isNotNull(), F.struct(who_.alias("agent_id"), F.lit(rank).alias("rank"))) for rank, who_ in rules])
    # matched by a struct: a slice without a midpoint keeps its candidates
    by_instance = entries.select("entry_id", "_anonymous", F.struct(*place).alias("_place")).join(
        firsts.withColumn("_place", F.struct(*place)).drop("_mid"), "_place"
    ).select("entry_id", FIGHT, found.alias("found")).select("entry_id", FIGHT, "found.*")
    pool = by_account.withColumn("rank", account_rank).withColumn("tie", tie).select(*columns).unionByName(
        by_instance.withColumn("tie", tie).select(*columns)
    )
    best = pool.groupBy(FIGHT, "entry_id").agg(F.min_by(F.struct("agent_id", "rank"), F.struct("rank", "tie")).alias("b"))
    return best.select(FIGHT, "entry_id", "b.agent_id", "b.rank")


def alias_sets(slices: DataFrame, intervals: DataFrame, spans: DataFrame, bucket_ms: int = OWNER_BUCKET_MS) -> DataFrame:
    """Agents counted with an entity in a slice: itself, what it owns at the midpoint, its instance's others that overlap."""
    keys = [FIGHT, "agent_id", "lo_ms", "hi_ms"]
    own = slices.select(*keys, F.col("agent_id").alias("alias_id"))
    probes = slices.select(*keys, F.col("agent_id").alias("owner_agent_id"), F.expr("(lo_ms + hi_ms) div 2").alias("time_ms"))
    owned = owned_agents_at(probes, intervals.filter("owner_agent_id is not null"), bucket_ms).select(*keys, F.col("owned_agent_id").alias("alias_id"))
    shared = slices.filter("instance_id <> 0").join(
        spans.select(FIGHT, "instance_id", F.col("agent_id").alias("alias_id"), "first_ms", "last_ms"), [FIGHT, "instance_id"]
    )
    shared = shared.filter((F.col("last_ms") >= F.col("lo_ms")) & (F.col("first_ms") <= F.col("hi_ms"))).select(*keys, "alias_id")
    return own.unionByName(owned).unionByName(shared).distinct()


def awareness_bound(last_ms: Column, duration_ms: Column) -> Column:
    return F.when(duration_ms - last_ms > ABSENCE_FLOOR_MS, last_ms + L.DESPAWN_GRACE_MS)
