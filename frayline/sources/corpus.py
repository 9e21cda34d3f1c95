"""The driver tables seen as a combat corpus.

One calendar day of ``events`` is one fight. Every column is a plain expression
over the stored columns, so filters on the stored event type and column pruning
still reach the parquet scan; :meth:`Corpus.events` adds that stored-type filter
itself for the kinds asked for.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frayline.session import Stage

# combat kind -> (stored event type, condition on k)
KIND_RULES: dict[str, tuple[str, int, int]] = {
    "DAMAGE": ("purchase", 0, 99),
    "HEALING": ("click", 0, 69),
    "STUN_BREAK": ("click", 70, 79),
    "DODGE": ("click", 80, 89),
    "BLOCK": ("click", 90, 94),
    "INTERRUPT": ("click", 95, 99),
    "BUFF_REMOVAL": ("view", 0, 39),
    "SKILL_ACTIVATION": ("view", 40, 89),
    "WEAPON_SWAP": ("view", 90, 99),
    "BOON_APPLY": ("signup", 0, 79),
    "BUFF_APPLY": ("signup", 80, 84),
    "BUFF_EXTENSION": ("signup", 85, 89),
    "EFFECT": ("signup", 90, 94),
    "MISSILE": ("signup", 95, 99),
    "DOWN": ("error", 0, 14),
    "UP": ("error", 15, 29),
    "DEATH": ("error", 30, 39),
    "CC": ("error", 40, 54),
    "HEALTH_UPDATE": ("error", 55, 74),
    "COMBAT_OUTCOME": ("error", 75, 79),
    "SPAWN": ("error", 80, 83),
    "DESPAWN": ("error", 84, 85),
    "POSITION": ("error", 86, 99),
}
BUFF_KINDS = ["BOON_APPLY", "BUFF_APPLY", "BUFF_EXTENSION"]
BUFF_CHOICES = [740, 1122, 1187, 718, 725, 50001]
REMOVED_BUFFS = [740, 736, 727, 1122, 733, 5974]
STATECHANGES = [0] * 16 + [18, 27, 70, 30, 49, 6, 7, 57, 11, 45, 51, 46, 19, 3, 5, 4, 8, 56, 38, 67, 68, 69, 71, 22]
ELITES = [0, 62, 61, 43, 5, 71, 48, 40, 60, 52]


_CLOCK = [
    "date_format(cast(ts AS timestamp), 'yyyyMMdd') AS fight_id",
    "unix_millis(cast(ts AS timestamp)) - unix_millis(date_trunc('day', cast(ts AS timestamp))) AS time_ms",
]


def pick_sql(values: list, index: str) -> str:
    """SQL: the value at a zero-based index."""
    items = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"element_at(array({items}), cast(({index}) + 1 AS int))"


_BUFFS = "event_type IN ('BOON_APPLY', 'BUFF_APPLY', 'BUFF_EXTENSION')"


def _for(kind: str, sql: str) -> str:
    return f"CASE WHEN event_type = '{kind}' THEN {sql} END"


EVENT_COLUMNS = {
    "source_agent_id": """CASE WHEN stored_type = 'view' AND k >= 40 THEN user_id % 4
        WHEN stored_type = 'error' THEN user_id % 5 ELSE user_id END""",
    "target_agent_id": """CASE WHEN stored_type = 'signup' THEN k % 3
        WHEN stored_type = 'purchase' AND k < 50 THEN k % 5 ELSE k % 50 END""",
    "skill_id": f"""CASE WHEN {_BUFFS} THEN cast({pick_sql(BUFF_CHOICES, 'm % 6')} AS bigint)
        WHEN event_type = 'SKILL_ACTIVATION' THEN 100 + k % 4 ELSE k END""",
    "damage": _for("DAMAGE", "m"),
    "buff_dmg": _for("DAMAGE", "if(k % 3 = 0, m div 2, 0)"),
    "result": _for("DAMAGE", "k % 13"),
    "is_condition": _for("DAMAGE", "k % 7 = 0"),
    "shield_damage": _for("DAMAGE", "m div 10"),
    "connected": _for("DAMAGE", "k % 13 IN (0, 1, 2, 8, 10)"),
    "absorbed": _for("DAMAGE", "k % 13 = 6"),
    "against_downed": _for("DAMAGE", "k % 11 = 0"),
    "is_life_leech": _for("DAMAGE", "k % 17 = 0"),
    "healing": _for("HEALING", "m"),
    "barrier": _for("HEALING", "k % 20 * 10"),
    "buff_removal": _for("BUFF_REMOVAL", "1 + m % 5"),
    "buff_id": _for("BUFF_REMOVAL", pick_sql(REMOVED_BUFFS, "k % 6")),
    "cc_value": _for("CC", "m"),
    "killed_by_agent_id": "CASE WHEN event_type = 'DEATH' AND k % 2 = 0 THEN m % 50 END",
    "downtime_ms": _for("DOWN", "m * 10"),
    "health_percent": _for("HEALTH_UPDATE", "m * 37 % 10001 / 100.0D"),
    "outcome": _for("COMBAT_OUTCOME", "if(k % 2 = 0, 'downed', 'killed')"),
    "x": _for("POSITION", "cast(m % 1000 AS double)"),
    "y": _for("POSITION", "cast(k * 10 AS double)"),
    "activation": _for("SKILL_ACTIVATION", "m % 5 + 1"),
    "expected_duration_ms": _for("SKILL_ACTIVATION", "m * 1000"),
    "swapped_from": _for("WEAPON_SWAP", "k % 4"),
    "swapped_to": _for("WEAPON_SWAP", "m % 4"),
    "guid": _for("EFFECT", "concat('G', k % 5)"),
    "kind": _for(
        "BOON_APPLY", "CASE m % 10 WHEN 7 THEN 'remove_single' WHEN 8 THEN 'remove_all' WHEN 9 THEN 'remove_manual' ELSE 'apply' END"
    ),
    "stacks": "CASE WHEN event_type IN ('BOON_APPLY', 'BUFF_APPLY') THEN 1 + k % 3 END",
    "stack_id": f"CASE WHEN {_BUFFS} THEN k % 7 END",
    "duration_ms": """CASE WHEN event_type IN ('BOON_APPLY', 'BUFF_APPLY') THEN (1 + m % 50) * 200000
        WHEN event_type = 'SKILL_ACTIVATION' THEN m % 500 + 1 END""",
    "extended_duration_ms": _for("BUFF_EXTENSION", "(1 + m % 50) * 200000"),
    "new_duration_ms": _for("BUFF_EXTENSION", "(1 + m % 50) * 200000 + k * 1000"),
}


def pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


class Corpus:
    """Lazy DataFrames over one folder of driver tables."""

    def __init__(self, spark: SparkSession, folder: str, timestamps: bool = False):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._tables: dict[str, DataFrame] = {}
        self._events: dict[tuple[str, ...] | None, DataFrame] = {}
        self._extra = ["cast(ts AS timestamp) AS ts"] if timestamps else []
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        """One stored table; its schema is read once per corpus."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    # -- combat events -------------------------------------------------------
    def base(self, kinds: Iterable[str] | None = None) -> DataFrame:
        """fight_id, seq, time_ms, user_id, k, m, stored_type and the combat kind of every stored event.

        For chosen kinds their rules become a filter on stored columns.
        """
        wanted = list(KIND_RULES) if kinds is None else list(kinds)
        hits = {n: "stored_type = '%s' AND k BETWEEN %d AND %d" % KIND_RULES[n] for n in wanted}
        df = self.table("events")
        if kinds is not None:
            df = df.filter(F.col("event_type").isin(sorted({KIND_RULES[n][0] for n in wanted})))
        df = df.selectExpr(
            *_CLOCK,
            "event_id AS seq",
            "user_id",
            # generated, not projected: filters on k and what follows from it stay above, so the text is searched once a row
            r"""explode(array(cast(regexp_extract(props, '"k":\\s*(\\d+)', 1) AS bigint))) AS k""",
            "cast(round(value * 100) AS bigint) AS m",
            "event_type AS stored_type",
            *self._extra,
        )
        if kinds is not None:
            df = df.filter(" OR ".join(f"({h})" for h in hits.values()))
        # the last kind needs no test of its own: the rules (or the filter) cover every row
        cases = " ".join(f"WHEN {hits[n]} THEN '{n}'" for n in wanted[:-1])
        kind = f"CASE {cases} ELSE '{wanted[-1]}' END" if cases else f"'{wanted[-1]}'"
        return df.selectExpr("*", f"{kind} AS event_type")

    def events(self, kinds: Iterable[str] | None = None) -> DataFrame:
        """Combat events; ids come from stored columns only, so predicates inferred on them stay small at the scan."""
        wanted = None if kinds is None else tuple(sorted(kinds))
        if wanted in self._events:
            return self._events[wanted]
        df = self.base(wanted)
        columns = [f"{sql} AS {name}" for name, sql in EVENT_COLUMNS.items()]
        kept = ["ts"] if self._extra else []
        self._events[wanted] = df.selectExpr("fight_id", "seq", "time_ms", "event_type", *kept, *columns)
        return self._events[wanted]

    def clock(self) -> DataFrame:
        """fight_id and time_ms of every event, from the stored time alone."""
        return self.table("events").selectExpr(*_CLOCK)

    # -- dimensions ----------------------------------------------------------
    def agents(self) -> DataFrame:
        """Every (fight, agent) mentioned by an event, with identity attributes."""
        ids = self.events().selectExpr("fight_id", "explode(array(source_agent_id, target_agent_id)) AS agent_id").distinct()
        return ids.selectExpr(
            "fight_id",
            "agent_id",
            "concat('Agent ', agent_id, if(agent_id % 10 = 1, ' [CMDR]', '')) AS name",
            "agent_id % 3 < 2 AS is_player",
            "if(agent_id % 3 < 2 AND agent_id % 11 <> 10, concat(if(agent_id % 7 = 0, ':', ''), 'acct.', agent_id div 2), NULL) AS account_name",
            "if(agent_id % 3 < 2, concat(if(agent_id % 2 = 0, 'Subgroup ', ''), agent_id % 5), NULL) AS subgroup",
            "cast(agent_id % 10 AS int) AS profession",
            f"{pick_sql(ELITES, 'agent_id % 10')} AS elite",
            "cast(agent_id % 40 AS int) AS instance_id",
        )

    def players(self) -> DataFrame:
        """Agents with a usable account, bare account names."""
        return (
            self.agents()
            .filter("is_player and account_name is not null")
            .withColumn("account_name", F.ltrim(F.col("account_name"), F.lit(":")))
        )

    def skills(self) -> DataFrame:
        name = (
            F.when(F.col("p_name").startswith("red "), "Burning")
            .when(F.col("p_name").startswith("old "), "Bleeding")
            .otherwise(F.col("p_name"))
        )
        return self.table("part").select(F.col("p_partkey").alias("skill_id"), name.alias("skill_name"))

    def fights(self) -> DataFrame:
        """One row per day; even days carry an older build than odd ones."""
        ts = F.col("ts").cast("timestamp")
        days = self.table("events").select(F.date_trunc("day", ts).alias("day")).distinct()
        dom = F.dayofmonth("day")
        return days.select(
            F.date_format("day", "yyyyMMdd").alias("fight_id"),
            (F.col("day") + F.make_dt_interval(hours=dom % 24)).alias("started_at"),
            F.when(dom % 2 == 0, "20240301").when(dom % 5 == 0, "dev").otherwise("20240701").alias("build_version"),
        )

    # -- decoded records -----------------------------------------------------
    def raw_records(self) -> DataFrame:
        """Every stored event as one decoded record; code fields cycle through all record kinds."""
        df = self.base().selectExpr(
            "fight_id", "seq", "time_ms div 14400000 * 14400000 + 1 AS time", "user_id", "k", "m",
            "CASE WHEN substring(fight_id, 7, 2) % 2 = 0 THEN 20240301 WHEN substring(fight_id, 7, 2) % 4 = 1 THEN 20250315 ELSE 20260601 END AS build",
            f"{pick_sql(STATECHANGES, '(seq * 31 + k * 7 + m) % 40')} AS statechange",
        )
        df = df.selectExpr(
            "*", "user_id % 12 AS src", "CASE WHEN k % 20 = 7 AND m % 2 = 0 THEN 0 ELSE (k + seq) % 12 END AS plain_dst",
            "build >= 20250000 AS modern", "statechange = 19 AS at_place",
        )
        x_bits = "CASE WHEN k % 17 = 0 THEN 2139095040 WHEN k % 19 = 0 THEN 1232348160 ELSE 1065353216 + (m % 1000) * 4096 END"
        return df.selectExpr(
            "fight_id", "seq", "build", "time", "src",
            f"cast(if(at_place, (1073741824 + k * 8192) * 4294967296 + {x_bits}, plain_dst) AS bigint) AS dst",
            """cast(CASE WHEN at_place THEN 1092616192 WHEN m % 50 = 0 THEN 2147483647 WHEN m % 9 = 0 THEN -m
               WHEN m % 9 = 1 THEN 0 ELSE m END AS bigint) AS value""",
            "cast(CASE k % 4 WHEN 0 THEN m div 3 WHEN 1 THEN -m ELSE 0 END AS bigint) AS buff_dmg",
            "if(modern, m div 5, 0) AS overstack",
            "cast(if(k % 20 = 7, 718, k % 20) AS bigint) AS skill",
            "cast(if(modern, 1 + user_id % 7, 0) AS int) AS src_inst",
            "cast(if(modern AND plain_dst <> 0, 1 + k * 3 % 7, 0) AS int) AS dst_inst",
            "cast(if(modern AND k % 5 = 0, 1 + (k + m) % 7, 0) AS int) AS src_master",
            "0 AS dst_master",
            "cast((k + m) % 3 AS int) AS iff", "cast(m % 2 AS int) AS buff", "cast((k + m) % 16 AS int) AS result",
            "cast(if(k % 10 = 9, 1 + m % 6, 0) AS int) AS activation",
            "cast(if(k % 20 = 7 OR (m + k) % 7 = 0, 1 + m % 3, 0) AS int) AS buffremove",
            "cast(statechange AS int) AS statechange",
            "cast(if(modern, m % 3, 0) AS int) AS shields",
            f"cast(if(modern, {pick_sql([0, 128, 3, 0], 'm % 4')}, 0) AS int) AS offcycle",
            "cast(if(modern, if(statechange = 49 AND k % 2 = 0, 2627419289, k % 9), 0) AS bigint) AS pad",
            "cast(if(modern, 0, k % 2) AS int) AS nondamage",
        )


class StagedCorpus(Corpus):
    """A corpus whose events of chosen kinds are staged once, laid out by kind, and whose agents are staged too."""

    def __init__(self, corpus: Corpus, stage: Stage, kinds: Iterable[str], columns: Iterable[str]):
        super().__init__(corpus.spark, corpus.folder)
        self.kinds = frozenset(kinds)
        head = ["fight_id", "seq", "time_ms", "event_type", "source_agent_id", "target_agent_id", "skill_id"]
        self._staged = stage(corpus.events(self.kinds).select(*head, *columns), "events", "event_type")
        self._agents = stage(corpus.agents(), "agents")

    def events(self, kinds: Iterable[str] | None = None) -> DataFrame:
        """The staged events when they hold all kinds asked for, else those of the stored table."""
        if kinds is None or not self.kinds.issuperset(kinds):
            return super().events(kinds)
        return self._staged.filter(F.col("event_type").isin(sorted(kinds)))

    def agents(self) -> DataFrame:
        return self._agents


class StreamCorpus(Corpus):
    """The same corpus with its event table read as a stream of files."""

    def table(self, name: str) -> DataFrame:
        stored = super().table(name)
        if name != "events":
            return stored
        return self.spark.readStream.schema(stored.schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)
