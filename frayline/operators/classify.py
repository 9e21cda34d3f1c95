"""Decoded combat records -> typed events, as projections.

A record yields zero to three events. Every record first gets the list of tags
it emits (one ``when`` chain in rule order), the list is exploded, and payload
columns are then plain expressions on the tag. Context a rule needs from other
records (masters, effect ids, paired downs, all-removals) is joined beforehand.
Mixed corpora run in one job: the layout is a column (``build``), not a branch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frayline.functions import lookups as L
from frayline.functions.combat import float32_from_bits
from frayline.operators.scan import Running, running

FIGHT = "fight_id"
SEQ_CHUNK = 1_000_000
POSITION_LIMIT = 1e5


def fold_recoded(raw: DataFrame) -> DataFrame:
    """From the recoded build on: buff and cast state changes move back onto plain records."""
    recoded = F.col("build") >= L.RECODED_BUILD
    sc = F.col("statechange")
    return raw.withColumns(
        {
            "activation": F.when(recoded & (sc == 67), F.lit(1)).otherwise(F.col("activation")),
            "statechange": F.when(recoded & sc.isin(67, 68, 69, 71, 72), F.lit(0)).otherwise(sc),
        }
    )


def _modern() -> Column:
    return F.col("build") >= L.MODERN_BUILD


def resolve_masters(raw: DataFrame, chunk: int = SEQ_CHUNK) -> DataFrame:
    """Adds ``master``: the agent behind ``src_master`` at that record, by carry-forward.

    Each record first announces its own instance ids, so announcements and the
    lookup share one timeline per (fight, instance), ordered by record.
    """
    found = _found_masters(raw, chunk)
    return raw.join(found.select(FIGHT, "seq", "master"), [FIGHT, "seq"], "left")


def _found_masters(raw: DataFrame, chunk: int) -> DataFrame:
    inst = lambda c: F.col(c).cast("int").alias("inst")
    entries = F.array_compact(
        F.array(
            F.when((F.col("src_inst") != 0) & (F.col("src") != 0), F.struct(inst("src_inst"), F.col("src").cast("bigint").alias("agent"), F.lit(0).alias("prio"))),
            F.when((F.col("dst_inst") != 0) & (F.col("dst") != 0), F.struct(inst("dst_inst"), F.col("dst").cast("bigint").alias("agent"), F.lit(1).alias("prio"))),
            F.when(F.col("src_master") != 0, F.struct(inst("src_master"), F.lit(None).cast("bigint").alias("agent"), F.lit(2).alias("prio"))),
        )
    )
    rows = raw.filter(_modern()).select(FIGHT, "seq", "src", F.inline(entries))
    rows = running(rows, [FIGHT, "inst"], [Running("master", "last", F.col("agent"))], ("seq", "prio"), chunk)
    return rows.filter("prio = 2").select(FIGHT, "seq", "src", "master")


def owners(found: DataFrame) -> DataFrame:
    """Last known owner of every agent."""
    rows = found.filter(F.col("master").isNotNull() & (F.col("src") != 0))
    return rows.groupBy(FIGHT, F.col("src").alias("agent")).agg(F.max_by("master", "seq").alias("owner"))


def _little_endian_hex(number: Column) -> Column:
    text = F.lpad(F.hex(number.cast("bigint")), 16, "0")
    return F.concat(*[F.substring(text, i, 2) for i in range(15, 0, -2)])


def effect_guids(raw: DataFrame) -> DataFrame:
    """Effect id -> GUID from definition records, last definition wins."""
    guid = F.concat(_little_endian_hex(F.col("src")), _little_endian_hex(F.col("dst")))
    return raw.filter("statechange = 46").groupBy(FIGHT, "skill").agg(F.max_by(guid, "seq").alias("guid"))


def down_durations(raw: DataFrame, chunk: int = SEQ_CHUNK) -> DataFrame:
    """Length of each down: first open down of an actor to its next up or death.

    Ups and deaths split an actor's records into islands; the first down of an
    island is the open one. Without a closing record it lasts to the actor's last
    mention.
    """
    modern = raw.filter(_modern())
    steps = modern.filter("statechange in (3, 4, 5)").select(FIGHT, F.col("src").alias("actor"), "seq", "time", "statechange")
    closes = F.col("statechange").isin(3, 4)
    rows = running(steps, [FIGHT, "actor"], [Running("island", "before", closes.cast("int"))], ("seq",), chunk)
    down = F.when(~closes, F.col("seq"))
    islands = rows.groupBy(FIGHT, "actor", "island").agg(
        F.min_by("time", down).alias("started"), F.max(F.when(closes, F.col("time"))).alias("closed")
    ).filter("started is not null")
    aware = (
        modern.filter("time > 0")
        .select(FIGHT, "time", F.explode(F.array("src", "dst")).alias("actor"))
        .filter("actor <> 0").groupBy(FIGHT, "actor").agg(F.max("time").alias("last_time"))
    )
    islands = islands.join(aware, [FIGHT, "actor"], "left")
    tail = F.greatest(F.coalesce("last_time", "started") - F.col("started"), F.lit(0))
    length = F.when(F.col("closed").isNotNull(), F.col("closed") - F.col("started")).otherwise(tail)
    return islands.groupBy(FIGHT, F.col("actor").alias("src"), F.col("started").alias("time")).agg(F.max_by(length, "island").alias("downtime_ms"))


def all_removals(raw: DataFrame) -> DataFrame:
    """(time, actor, buff) triples at which everything was removed at once."""
    return raw.filter(_modern() & (F.col("buffremove") == 1)).select(FIGHT, "time", F.col("src").alias("actor"), "skill").distinct()


def displaced_stack_hints(raw: DataFrame, buff_id: int = 718, delay_ms: int = 15) -> DataFrame:
    """Uncredited single removals of one buff with a residue above the server delay."""
    rows = raw.filter(
        _modern() & (F.col("skill") == buff_id) & (F.col("buffremove") == 2) & F.col("statechange").isin(0, 71)
        & (F.col("iff") == 2) & (F.col("dst") == 0) & (F.col("value") > delay_ms)
    )
    return rows.select(
        FIGHT, "seq", F.col("src").alias("agent_id"), F.col("time").alias("time_ms"),
        F.col("value").alias("removed_ms"), F.col("pad").alias("stack_id"),
    )


def awareness(raw: DataFrame) -> DataFrame:
    """First and last mention of every agent, relative to the fight's first record.

    Health and stack-active records do not count as mentions (they can name an
    agent after it is gone) but do count for the origin.
    """
    rows = raw.filter("time > 0")
    origin = rows.groupBy(FIGHT).agg(F.min("time").alias("origin"))
    spans = (
        rows.filter(~F.col("statechange").isin(8, 27))
        .select(FIGHT, "time", F.explode(F.array("src", "dst")).alias("agent_id")).filter("agent_id <> 0")
        .groupBy(FIGHT, "agent_id").agg(F.min("time").alias("first"), F.max("time").alias("last"))
    )
    return spans.join(origin, FIGHT).select(
        FIGHT, "agent_id", (F.col("first") - F.col("origin")).alias("first_ms"), (F.col("last") - F.col("origin")).alias("last_ms")
    )


def enriched_agents(raw: DataFrame, agents: DataFrame) -> DataFrame:
    """Adds each agent's first instance id and last team id (team records: code 22)."""
    first = raw.filter("src <> 0 and src_inst <> 0").groupBy(FIGHT, F.col("src").alias("agent_id")).agg(
        F.min_by("src_inst", "seq").alias("first_instance_id")
    )
    team = raw.filter("statechange = 22 and src <> 0").groupBy(FIGHT, F.col("src").alias("agent_id")).agg(
        F.max_by("dst", "seq").cast("bigint").alias("team_id")
    )
    return agents.join(first, [FIGHT, "agent_id"], "left").join(team, [FIGHT, "agent_id"], "left")


def _context_kind() -> Column:
    """Which lookups a record's rules read: each record has one kind, most have 0 and read none."""
    code, instant = F.col("statechange"), F.col("activation").between(1, 6)
    return (
        F.when(code.isin(45, 51, 60, 62), 1)
        .when(code == 5, 2)
        .when(code.isin(6, 57), 3)
        .when((code == 0) & ~instant & F.col("buffremove").isin(2, 3), 4)
        .when((F.col("src_master") != 0) & code.isin(0, 49), 5)
        .otherwise(0)
    )


def _struct(**fields: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def _long(value: Column | str | int) -> Column:
    column = F.lit(value) if isinstance(value, int) else F.col(value) if isinstance(value, str) else value
    return column.cast("bigint")


def _key(topic: str, *parts: Column | str | int) -> Column:
    """One lookup key: what is asked for, and up to three numbers."""
    padded = [*parts, *[0] * (3 - len(parts))]
    return _struct(topic=F.lit(topic), **{f"k{i}": _long(p) for i, p in enumerate(padded)})


KEY = [FIGHT, "topic", "k0", "k1", "k2"]


def _trail(raw: DataFrame, chunk: int) -> DataFrame:
    """Narrow rows in record order: announced instances, records that ask, and the ups, downs and deaths of actors.

    A record that has a master asks on its master's line, others on a line of their own; ``master`` is what the line knows
    by then, ``island`` counts the closed downs of an actor.
    """
    none = F.lit(None).cast("bigint")

    def line(name: str, ident: Column | str | int, prio: int, agent: Column = none, code: Column = F.lit(0)) -> Column:
        # one array of all numbers: no reader can prune some of them, so all readers share one exchange
        about = F.array(*[_long(c) for c in ("time", "src", "skill", "_kind")], _long(code), _long(ident))
        return _struct(line=F.lit(name), id=_long(ident), prio=F.lit(prio), agent=agent, about=about)

    mastered = _modern() & (F.col("src_master") != 0)
    entries = F.array_compact(F.array(
        F.when(_modern() & (F.col("src_inst") != 0) & (F.col("src") != 0), line("instance", "src_inst", 0, agent=_long("src"))),
        F.when(_modern() & (F.col("dst_inst") != 0) & (F.col("dst") != 0), line("instance", "dst_inst", 1, agent=_long("dst"))),
        F.when(mastered, line("instance", "src_master", 2)),
        F.when(~mastered & (F.col("_kind") > 0), line("record", 0, 2)),
        F.when(_modern() & F.col("statechange").isin(3, 4, 5), line("downs", "src", 0, code=F.col("statechange"))),
    ))
    rows = raw.withColumn("_kind", _context_kind()).select(FIGHT, "seq", F.inline(entries))
    closes = (F.col("line") == "downs") & F.col("about")[4].isin(3, 4)
    rows = running(rows, [FIGHT, "line", "id"], [Running("master", "last", F.col("agent")), Running("island", "before", closes.cast("int"))], ("seq", "prio"), chunk)
    numbers = ("time", "src", "skill", "wants", "code", "about_id")
    return rows.select(FIGHT, "line", "seq", "prio", "master", "island", *[F.col("about")[i].alias(n) for i, n in enumerate(numbers)])


def _trail_facts(trail: DataFrame) -> DataFrame:
    """Last owner of every agent, and every first down of an island with the time that closed it."""
    owner = (F.col("line") == "instance") & (F.col("prio") == 2) & F.col("master").isNotNull() & (F.col("src") != 0)
    opens, closes = F.col("code") == 5, F.col("code").isin(3, 4)
    rows = trail.withColumn("topic", F.when(owner, "owner").when(F.col("line") == "downs", "down")).filter("topic is not null")
    islands = rows.groupBy(FIGHT, "topic", F.when(owner, F.col("src")).otherwise(F.col("about_id")).alias("k0"), F.when(owner, 0).otherwise(F.col("island")).alias("island")).agg(
        F.max_by("master", F.when(owner, F.col("seq"))).alias("owner"), F.min_by("time", F.when(opens, F.col("seq"))).alias("started"), F.max(F.when(closes, F.col("time"))).alias("closed"),
    ).filter("topic = 'owner' or started is not null")
    last = F.max_by(F.struct("owner", "closed"), "island").alias("last")
    return islands.groupBy(FIGHT, "topic", "k0", F.coalesce("started", F.lit(0)).alias("k1")).agg(last).select(FIGHT, "topic", "k0", "k1", F.lit(0).cast("bigint").alias("k2"), "last.*")


def _record_facts(raw: DataFrame) -> DataFrame:
    """Effect ids with their GUID, moments at which all of a buff went, and the last mention of every actor."""
    guid = F.concat(_little_endian_hex(F.col("src")), _little_endian_hex(F.col("dst")))
    seen = lambda who: F.when(_modern() & (F.col("time") > 0) & (F.col(who) != 0), _key("seen", who))
    keys = F.array_compact(F.array(
        F.when(F.col("statechange") == 46, _key("effect", "skill")), F.when(_modern() & (F.col("buffremove") == 1), _key("cleared", "time", "src", "skill")), seen("src"), seen("dst"),
    ))
    rows = raw.select(FIGHT, "seq", "time", F.when(F.col("statechange") == 46, guid).alias("guid"), F.inline(keys))
    return rows.groupBy(*KEY).agg(F.max_by("guid", F.when(F.col("topic") == "effect", F.col("seq"))).alias("guid"), F.max("time").alias("last_time"))


def _answers(raw: DataFrame, chunk: int) -> DataFrame:
    """What the rules read besides the record, one narrow row per record that reads anything.

    All questions meet all facts in one join; a question is a key, and a record has two at most.
    """
    trail = _trail(raw, chunk)
    asking = trail.filter("prio = 2 and wants > 0").withColumn("master", F.when(F.col("wants") >= 3, F.col("master")))
    wants = F.col("wants")
    keys = (
        F.when(wants == 1, F.array(_key("effect", "skill"), _key("owner", "src")))
        .when(wants == 2, F.array(_key("down", "src", "time"), _key("seen", "src")))
        .when(wants == 3, F.array(_key("owner", "src")))
        .when(wants == 4, F.array(_key("cleared", "time", F.coalesce("master", "src"), "skill")))
        .otherwise(F.array(_key("nothing", "seq")))  # spread over all partitions, meets no fact
    )
    asked = asking.select(FIGHT, "seq", "time", "master", F.inline(keys))
    facts = _trail_facts(trail).unionByName(_record_facts(raw), allowMissingColumns=True).withColumn("known", F.lit(True))
    met = asked.join(facts, KEY, "left")
    of = lambda topic, value: F.max(F.when(F.col("topic") == topic, F.col(value)))
    rows = met.groupBy(FIGHT, "seq").agg(
        F.max("master").alias("master"), F.max("time").alias("time"), of("owner", "owner").alias("owner"), of("effect", "guid").alias("guid"),
        F.coalesce(of("cleared", "known"), F.lit(False)).alias("cleared"), of("down", "known").alias("down"), of("down", "closed").alias("closed"), of("seen", "last_time").alias("seen"),
    )
    tail = F.greatest(F.coalesce("seen", "time") - F.col("time"), F.lit(0))
    downtime = F.when(F.col("down"), F.coalesce(F.col("closed") - F.col("time"), tail))
    return rows.select(FIGHT, "seq", "master", "owner", "guid", "cleared", downtime.alias("downtime_ms"))


def routed(rows: DataFrame, route: Column) -> DataFrame:
    """The rows for which ``route`` holds, as a generator that yields them.

    A filter would be pushed below the projections that make the columns it reads, and those would be computed once for each
    mention and once more for the output; a generator stays where it is.
    """
    return rows.select("*", F.explode(F.when(route, F.array(F.lit(True)))).alias("_routed")).drop("_routed")


def with_context(raw: DataFrame, chunk: int = SEQ_CHUNK) -> DataFrame:
    """Everything the rules read besides the record itself.

    Most records read nothing and pass by. The others get their answers by (fight, seq) from one narrow table: effects
    their definition and owner, downs their length, spawns and missiles owner and master, single removals whether all went
    at that moment, records with a master the master.
    """
    raw = fold_recoded(raw)
    kinds = raw.withColumn("_kind", _context_kind())
    rows = routed(kinds, F.col("_kind") > 0).join(_answers(raw, chunk), [FIGHT, "seq"], "left")
    rows = routed(kinds, F.col("_kind") == 0).unionByName(rows, allowMissingColumns=True).drop("_kind")
    return rows.withColumns({"actor": F.coalesce("master", "src"), "cleared": F.coalesce("cleared", F.lit(False))})


# tags a record can emit, with the event kind each becomes
TAG_KINDS = {
    "BUFF_APPLY": "BUFF_APPLY", "BUFF_STACK_ACTIVE": "BUFF_STACK_ACTIVE", "BUFF_EXTENSION": "BUFF_EXTENSION", "EXTEND": "BUFF_EXTENSION",
    "BUFF_INFO": "BUFF_INFO", "EXTENSION_HEAL": "HEALING", "HEALING": "HEALING", "SPAWN": "SPAWN", "DESPAWN": "DESPAWN", "MISSILE": "MISSILE",
    "WEAPON_SWAP": "WEAPON_SWAP", "EFFECT": "EFFECT", "POSITION": "POSITION", "UP": "UP", "DOWN": "DOWN", "DEATH": "DEATH",
    "HEALTH_UPDATE": "HEALTH_UPDATE", "STUN_BREAK": "STUN_BREAK", "BARRIER": "BARRIER", "SKILL_ACTIVATION": "SKILL_ACTIVATION",
    "BOON_REMOVE": "BOON_APPLY", "BOON_APPLY": "BOON_APPLY", "EMPTY_APPLY": "BOON_APPLY", "CONDITION_DAMAGE": "DAMAGE", "DIRECT_DAMAGE": "DAMAGE",
    "PLAIN_DAMAGE": "DAMAGE", "COMBAT_OUTCOME": "COMBAT_OUTCOME", "CC": "CC", "BLOCK": "BLOCK", "DODGE": "DODGE", "INTERRUPT": "INTERRUPT",
    "BUFF_REMOVAL": "BUFF_REMOVAL",
}
TAG = {name: code for code, name in enumerate(TAG_KINDS)}


def _on(*tags: str) -> str:
    codes = [str(TAG[t]) for t in tags]
    return f"tag = {codes[0]}" if len(codes) == 1 else f"tag IN ({', '.join(codes)})"


def _emit(*tags: str) -> str:
    return f"array({', '.join(str(TAG[t]) for t in tags)})"


def _emit_if(**conditions: str) -> str:
    """Tags whose condition holds, in order."""
    return "array_compact(array(" + ", ".join(f"if({c}, {TAG[t]}, NULL)" for t, c in conditions.items()) + "))"


_NOTHING = "cast(array() AS array<int>)"
_HITS = ", ".join(map(str, L.HIT_RESULTS))
# numbers several rules read, computed once per record
RECORD_FACTS = {
    "modern": f"build >= {L.MODERN_BUILD}",
    "size": f"CASE WHEN value >= {L.MAGNITUDE_CEILING} THEN 0 ELSE greatest(value, 0) END",
    "strip": f"CASE WHEN buff_dmg >= {L.MAGNITUDE_CEILING} THEN 0 ELSE greatest(buff_dmg, 0) END",
    "extension_heal": """CASE WHEN buff = 0 AND value < 0 THEN -value
        WHEN buff <> 0 AND value = 0 AND buff_dmg < 0 THEN -buff_dmg ELSE 0 END""",
    "own_tick": "actor = dst AND buff <> 0 AND value = 0 AND buff_dmg > 0",
}


def emitted_tags() -> str:
    """SQL array of a record's tags, in emission order."""
    at_place = f"pos_x IS NOT NULL AND pos_y IS NOT NULL AND pos_z IS NOT NULL AND greatest(abs(pos_x), abs(pos_y), abs(pos_z)) <= {POSITION_LIMIT}"
    attempt = "(result <> 10 AND size > 0) OR (dst <> 0 AND skill <> 0 AND result IN (0, 1, 2, 3, 4, 6, 7, 8, 10, 13))"
    defence = {"BLOCK": "result = 3", "DODGE": "result = 4", "INTERRUPT": "result = 5"}
    direct = _emit_if(COMBAT_OUTCOME="result IN (8, 9)", **defence, DIRECT_DAMAGE=f"result NOT IN (5, 8, 9, 11) AND ({attempt})")
    modern = f"""CASE
        WHEN buff <> 0 AND buff_dmg = 0 AND value > 0 AND activation = 0
          THEN if(offcycle <> 0, {_emit("EXTEND")}, {_emit("BOON_APPLY")})
        WHEN iff NOT IN (1, 2) AND NOT own_tick THEN {_NOTHING}
        WHEN buff <> 0 THEN if(NOT (iff = 2 AND src = 0 AND src_master <> 0) AND (strip > 0 OR result <> 0), {_emit("CONDITION_DAMAGE")}, {_NOTHING})
        WHEN result = 12 THEN {_emit("CC")}
        ELSE {direct} END"""
    legacy = f"""CASE
        WHEN buff <> 0 THEN {_emit_if(HEALING="nondamage <> 0 AND (size > 0 OR strip > 0)", EMPTY_APPLY="true")}
        WHEN nondamage <> 0 THEN {_emit_if(HEALING="size > 0", BUFF_REMOVAL="strip > 0")}
        ELSE {_emit_if(**defence, PLAIN_DAMAGE="size > 0")} END"""
    dropped_removal = "modern AND buffremove <> 1 AND ((iff = 2 AND dst = 0) OR cleared)"
    states = {
        18: "BUFF_APPLY", 27: "BUFF_STACK_ACTIVE", 70: "BUFF_EXTENSION", 30: "BUFF_INFO", 6: "SPAWN", 7: "DESPAWN", 57: "MISSILE", 11: "WEAPON_SWAP",
        3: "UP", 4: "DEATH", 8: "HEALTH_UPDATE", 56: "STUN_BREAK", 38: "BARRIER",
    }
    conditional = {
        49: (f"pad = {L.HEAL_EXTENSION_SIGNATURE} AND extension_heal > 0 AND (cast(offcycle AS int) & 128) <> 0", "EXTENSION_HEAL"),
        19: (at_place, "POSITION"), 5: ("NOT modern OR downtime_ms IS NOT NULL", "DOWN"),
    } | {code: ("guid IS NOT NULL", "EFFECT") for code in (45, 51, 60, 62)}
    by_state = " ".join(f"WHEN {code} THEN {_emit(tag)}" for code, tag in states.items())
    by_state += " " + " ".join(f"WHEN {code} THEN if({cond}, {_emit(tag)}, {_NOTHING})" for code, (cond, tag) in conditional.items())
    return f"""CASE
        WHEN statechange <> 0 THEN CASE statechange {by_state} ELSE {_NOTHING} END
        WHEN activation BETWEEN 1 AND 6 THEN {_emit("SKILL_ACTIVATION")}
        WHEN buffremove BETWEEN 1 AND 3 THEN if({dropped_removal}, {_NOTHING}, {_emit("BOON_REMOVE")})
        WHEN modern THEN {modern} ELSE {legacy} END"""


_ACTOR_ONLY = ("DESPAWN", "WEAPON_SWAP", "POSITION", "UP", "DOWN", "DEATH", "HEALTH_UPDATE", "STUN_BREAK")
_HIT = _on("DIRECT_DAMAGE", "PLAIN_DAMAGE")
_TICK = _on("CONDITION_DAMAGE")
_ANY_HIT = _on("DIRECT_DAMAGE", "PLAIN_DAMAGE", "CONDITION_DAMAGE")


def _ids() -> dict[str, str]:
    raw_source = _on(*_ACTOR_ONLY, "BUFF_APPLY", "BUFF_STACK_ACTIVE", "BUFF_EXTENSION", "BUFF_INFO", "BARRIER", "SKILL_ACTIVATION")
    return {
        "source_agent_id": f"""CASE WHEN {raw_source} THEN src WHEN {_on("SPAWN")} THEN coalesce(owner, 0) WHEN {_on("MISSILE")} THEN coalesce(owner, actor)
            WHEN {_on("EFFECT")} THEN if(guid = '{L.FIXED_OWNER_GUID}', src, coalesce(owner, src)) WHEN {_on("BOON_REMOVE", "BLOCK", "DODGE")} THEN dst ELSE actor END""",
        "target_agent_id": f"""CASE WHEN {_on("BUFF_STACK_ACTIVE", "SPAWN", "BOON_REMOVE")} THEN src
            WHEN {_on(*_ACTOR_ONLY, "SKILL_ACTIVATION", "BLOCK", "DODGE")} THEN 0 ELSE dst END""",
        "skill_id": f"cast(if({_on(*_ACTOR_ONLY, 'SPAWN', 'BLOCK', 'DODGE')}, 0, skill) AS bigint)",
    }


def _payload() -> dict[str, str]:
    """SQL per payload column; null where the event kind does not carry it."""
    landed = f"CASE WHEN result = {L.ABSORB_RESULT} THEN false WHEN build >= {L.RECODED_BUILD} THEN result >= 13 AND result % 2 = 0 ELSE result = 0 END"
    immune = f"CASE WHEN result = {L.ABSORB_RESULT} THEN true WHEN build >= {L.RECODED_BUILD} THEN result >= 13 AND result % 2 = 1 ELSE result <> 0 END"
    byte = lambda c: f"pmod(cast({c} AS bigint), 256)"
    effect_ms = f"{byte('iff')} + {byte('buff')} * 256 + {byte('result')} * 65536 + {byte('activation')} * 16777216"
    when = lambda *pairs: "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + " END"
    ext, heal = _on("EXTENSION_HEAL"), _on("HEALING")
    return {
        "damage": when((_on("DIRECT_DAMAGE"), "if(result = 10, 0, size)"), (_on("PLAIN_DAMAGE"), "size"), (_TICK, "strip")),
        "buff_dmg": when((_on("DIRECT_DAMAGE"), "0"), (_on("PLAIN_DAMAGE", "CONDITION_DAMAGE"), "strip")),
        "result": when((_ANY_HIT, "result")),
        "is_condition": when((_ANY_HIT, f"({_TICK})")),
        "shield_damage": when((_ANY_HIT, f"if(overstack >= {L.MAGNITUDE_CEILING}, 0, overstack)")),
        "connected": when((_TICK, landed), (_HIT, f"result IN ({_HITS})")),
        "absorbed": when((_TICK, immune), (_HIT, f"result = {L.ABSORB_RESULT}")),
        "against_downed": when(
            (f"{_TICK} AND build < {L.RECODED_BUILD}", "pmod(pad, 256) <> 0"), (_on("CONDITION_DAMAGE", "DIRECT_DAMAGE"), "offcycle <> 0"), (_on("PLAIN_DAMAGE"), "false")
        ),
        "is_life_leech": when((_ANY_HIT, f"({_TICK}) AND offcycle IN (3, 5)")),
        "healing": when((ext, "if(shields <> 0, 0, extension_heal)"), (heal, "size")),
        "barrier": when((ext, "if(shields <> 0, extension_heal, 0)"), (heal, "strip")),
        "src_is_peer": when((ext, "true"), (heal, "false")),
        "buff_removal": when((_on("BUFF_REMOVAL"), "strip")),
        "buff_id": when((_on("BUFF_REMOVAL"), byte("buff"))),
        "cc_value": when((_on("CC"), "size")),
        "outcome": when((_on("COMBAT_OUTCOME"), "if(result = 8, 'killed', 'downed')")),
        "downtime_ms": when((_on("DOWN"), "coalesce(downtime_ms, 0)")),
        "health_percent": when((_on("HEALTH_UPDATE"), "least(greatest(dst / 100.0D, 0.0D), 100.0D)")),
        "x": when((_on("POSITION"), "pos_x")),
        "y": when((_on("POSITION"), "pos_y")),
        "activation": when((_on("SKILL_ACTIVATION"), "activation")),
        "expected_duration_ms": when((_on("SKILL_ACTIVATION"), "greatest(buff_dmg, 0)")),
        "swapped_from": when((_on("WEAPON_SWAP"), "greatest(value, 0)")),
        "swapped_to": when((_on("WEAPON_SWAP"), "dst")),
        "guid": when((_on("EFFECT"), "guid")),
        "is_around_dst": when((_on("EFFECT"), "dst <> 0")),
        "kind": when(
            (_on("BOON_APPLY", "EMPTY_APPLY"), "'apply'"), (_on("BOON_REMOVE"), "CASE buffremove WHEN 1 THEN 'remove_all' WHEN 2 THEN 'remove_single' ELSE 'remove_manual' END")
        ),
        "duration_ms": when(
            (_on("BUFF_APPLY", "BOON_REMOVE", "BOON_APPLY"), "size"), (_on("EMPTY_APPLY", "BARRIER"), "0"), (_on("SKILL_ACTIVATION"), "greatest(value, 0)"),
            (_on("EFFECT"), f"if(statechange = 51, {effect_ms}, 0)"),
        ),
        "original_duration_ms": when((_on("BUFF_APPLY"), "if(strip <> 0, strip, size)")),
        "stacks": when((f"{_on('BOON_REMOVE')} AND buffremove = 1", "greatest(result, 1)"), (_on("BOON_REMOVE", "BOON_APPLY", "EMPTY_APPLY", "BUFF_APPLY"), "1")),
        "stack_id": when((_on("BUFF_STACK_ACTIVE"), "dst"), (_on("BUFF_APPLY", "BUFF_EXTENSION", "EXTEND", "BOON_REMOVE", "BOON_APPLY"), "pad")),
        "added_active": when((_on("BUFF_APPLY", "BOON_APPLY"), "shields <> 0")),
        "extended_duration_ms": when((_on("BUFF_EXTENSION"), "greatest(value, 0)"), (_on("EXTEND"), "size")),
        "new_duration_ms": when((_on("BUFF_EXTENSION"), "greatest(overstack, 0)"), (_on("EXTEND"), f"if(overstack >= {L.MAGNITUDE_CEILING}, 0, greatest(overstack, 0))")),
        "max_stacks": when((_on("BUFF_INFO"), "src_master")),
        "duration_cap": when((_on("BUFF_INFO"), "overstack")),
    }


def classify(raw: DataFrame) -> DataFrame:
    """Typed events of decoded records; one row per event, payload columns null where unused."""
    bits = F.lit(4294967296)
    at_place = F.col("statechange") == 19
    rows = with_context(raw).withColumns(
        {
            "pos_x": F.when(at_place, float32_from_bits(F.pmod(F.col("dst").cast("bigint"), bits))),
            "pos_y": F.when(at_place, float32_from_bits(F.shiftrightunsigned(F.col("dst").cast("bigint"), 32))),
            "pos_z": F.when(at_place, float32_from_bits(F.pmod(F.col("value"), bits))),
        }
    )
    rows = rows.selectExpr("*", *[f"{sql} AS {name}" for name, sql in RECORD_FACTS.items()])
    rows = rows.selectExpr("*", f"explode({emitted_tags()}) AS tag")
    kinds = ", ".join(f"'{kind}'" for kind in TAG_KINDS.values())
    return rows.selectExpr(
        FIGHT, "seq", "time AS time_ms", f"element_at(array({kinds}), tag + 1) AS event_type",
        *[f"{sql} AS {name}" for name, sql in (_ids() | _payload()).items()],
    )
