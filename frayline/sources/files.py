"""File sources and sinks for event streams, catalogues, sidecars and summaries."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frayline.schema import CATALOGUE_DDL, EVENT_DDL, EVENT_KINDS, SIDECAR_DDL
from frayline.functions.names import profession_label

# defaults that keep older streams readable
PAYLOAD_DEFAULTS = {"stacks": 1, "barrier": 0, "buff_dmg": 0, "shield_damage": 0, "kind": "apply"}


def parse_event_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed events of JSON lines; blank lines are skipped, unreadable ones keep their text in ``_corrupt``."""
    schema = f"{EVENT_DDL}, _corrupt STRING"
    parsed = F.from_json(F.col(column), schema, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    rows = lines.filter(F.trim(F.col(column)) != "")
    others = [c for c in lines.columns if c != column]
    return rows.select(*others, parsed.alias("e")).select(*others, "e.*")


def valid_event() -> Column:
    return F.col("_corrupt").isNull() & F.coalesce(F.col("event_type").isin(EVENT_KINDS), F.lit(False))


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed events, quarantine): unknown kinds and unreadable lines are rejected, not dropped."""
    return events.filter(valid_event()).drop("_corrupt"), events.filter(~valid_event())


def with_defaults(events: DataFrame) -> DataFrame:
    """Missing payload fields of a kind take their defaults."""
    owners = {"stacks": ["BOON_APPLY", "BUFF_APPLY"], "kind": ["BOON_APPLY"], "barrier": ["HEALING"], "buff_dmg": ["DAMAGE"], "shield_damage": ["DAMAGE"]}
    filled = {
        c: F.when(F.col("event_type").isin(owners[c]), F.coalesce(F.col(c), F.lit(v))).otherwise(F.col(c))
        for c, v in PAYLOAD_DEFAULTS.items() if c in events.columns
    }
    return events.withColumns(filled)


def read_event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Gzip JSON-lines event files; ``split_valid`` separates what does not fit."""
    return parse_event_lines(spark.read.text(path))


def write_event_stream(events: DataFrame, path: str, as_json: bool = False, rows_per_file: int = 5_000_000) -> None:
    """One folder per fight. Rows are spread by (fight, time slice), so a huge fight becomes many files.

    A fight without events writes nothing. Inside a file rows are sorted for
    pruning on kind and time.
    """
    slice_ = F.floor(F.col("time_ms") / 60_000)
    rows = events.repartition("fight_id", slice_).sortWithinPartitions("fight_id", "event_type", "time_ms", "seq")
    writer = rows.write.mode("overwrite").partitionBy("fight_id").option("maxRecordsPerFile", rows_per_file)
    if as_json:
        writer.option("compression", "gzip").json(path)
    else:
        writer.parquet(path)


# -- catalogue -----------------------------------------------------------------------
def parse_catalogue(lines: DataFrame, order: Column) -> DataFrame:
    """Catalogue entries of NDJSON lines (column ``value``): malformed lines skipped, the later duplicate wins."""
    rows = lines.select(F.from_json("value", CATALOGUE_DDL).alias("e"), order.alias("_at")).filter("e.id is not null")
    return rows.groupBy(F.col("e.id").alias("_id")).agg(F.max_by("e", "_at").alias("e")).select("e.*")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON catalogue; a missing file is an empty catalogue."""
    try:
        stored = spark.read.text(path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CATALOGUE_DDL)
    lines = stored.select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))
    return parse_catalogue(lines, F.struct("_f", "_b", F.monotonically_increasing_id()))


def catalogue_view(catalogue: DataFrame) -> DataFrame:
    """Projection with defaults and the profession's label; unknown codes have none."""
    label = profession_label(F.col("profession"))
    return catalogue.select(
        "id", "name", F.when(F.col("profession").between(0, 9), F.upper(label)).alias("profession"),
        F.coalesce("is_elite", F.lit(False)).alias("is_elite"), F.coalesce("skill_type", F.lit("utility")).alias("skill_type"),
        "icon_url", "description",
    )


def age_days(rows: DataFrame, keys: list[str], changed: str, now: Column) -> DataFrame:
    """Days from the newest change of every key to ``now``.

    For files, ``changed`` is Spark's ``_metadata.file_modification_time``.
    """
    newest = rows.groupBy(*keys).agg(F.max(changed).alias("_changed"))
    return newest.select(*keys, ((now.cast("double") - F.col("_changed").cast("double")) / 86400).alias("age_days"))


# -- sidecars ------------------------------------------------------------------------
def parse_sidecars(documents: DataFrame, column: str = "value") -> DataFrame:
    """Adds ``players`` and ``valid``: an object with a ``players`` object in it."""
    text = F.col(column)
    players = F.get_json_object(text, "$.players")
    valid = F.json_object_keys(text).isNotNull() & players.isNotNull() & F.json_object_keys(players).isNotNull()
    rows = documents.withColumn("valid", F.coalesce(valid, F.lit(False)))
    return rows.withColumn("players", F.when(F.col("valid"), F.from_json(text, SIDECAR_DDL)["players"]))


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return parse_sidecars(files)


def sidecar_counts(sidecars: DataFrame) -> DataFrame:
    return sidecars.agg(F.count(F.lit(1)).alias("attempts"), F.count(F.when(~F.col("valid"), 1)).alias("failures"))


# -- summary tables ------------------------------------------------------------------
def upserted(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with those of ``rows`` replacing all non-key columns of equal keys."""
    return stored.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def replace_fights(rows: DataFrame, path: str) -> None:
    """Rewrite exactly the fights present in ``rows`` (delete-and-rewrite per fight)."""
    rows.repartition("fight_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fight_id").parquet(path)


def upsert_summaries(spark: SparkSession, path: str, rows: DataFrame, keys: list[str] = ("fight_id", "account_name")) -> None:
    """Key-level upsert into a table partitioned by fight; untouched fights are not rewritten.

    Dynamic overwrite stages its files before swapping partitions, so reading the
    touched partitions of the same table is safe.
    """
    # an empty append makes the table where it is not there yet
    rows.limit(0).write.mode("append").partitionBy("fight_id").parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path).withColumn("fight_id", F.col("fight_id").cast("string"))
    touched = stored.join(rows.select("fight_id").distinct(), "fight_id", "left_semi")
    replace_fights(upserted(touched.select(*rows.columns), rows, list(keys)), path)
