"""Operational, document, role, quality, catalogue and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frayline.functions import documents, roles
from frayline.functions import lookups as L
from frayline.operators import ops, profiles, quality, rollups, summaries, timelines
from frayline.plans.buff_queries import HISTORY
from frayline.plans.registry import query
from frayline.plans.rollup_queries import rounded
from frayline.plans.timeline_queries import CONTRIB, contributions
from frayline.sources import files
from frayline.sources.corpus import Corpus, StreamCorpus
from frayline.streaming import live

# -- orders as uploads, nations as subscriptions, line items as deliveries ------------------
_UP = """up AS (SELECT o_orderkey AS id, 'h' || o_custkey AS sha256, 'f' || (o_orderkey % 900) AS fight_id, o_orderdate AS uploaded_at,
      CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
      CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'ParseError: bad' ELSE 'Duplicate fight: f' || o_orderkey END END AS error_message FROM orders)"""
_SUB = """sb AS (SELECT n_nationkey AS id, '{"kind":"' || CASE WHEN n_nationkey % 3 = 0 THEN 'other' ELSE 'upload_completed' END || '"}' AS filter, n_nationkey % 4 = 1 AS revoked FROM nation)"""
_DEL = """de AS (SELECT (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey AS id, l_suppkey % 25 AS subscription_id, l_orderkey AS upload_id, CAST(l_partkey % 4 AS INTEGER) AS attempt,
      CASE l_returnflag WHEN 'A' THEN 200 WHEN 'R' THEN 500 END AS status_code, CASE WHEN l_returnflag = 'R' THEN 'HTTP 500' END AS error,
      CASE WHEN l_returnflag = 'A' THEN l_shipdate END AS delivered_at, CASE WHEN l_linestatus = 'O' THEN l_shipdate END AS next_attempt_at FROM lineitem)"""
_NOW = "TIMESTAMP '1998-06-01 00:00:00'"


def now():
    return F.lit("1998-06-01 00:00:00").cast("timestamp")


def uploads(c: Corpus) -> DataFrame:
    return c.table("orders").selectExpr(
        "o_orderkey AS id", "concat('h', o_custkey) AS sha256", "concat('f', o_orderkey % 900) AS fight_id", "cast(o_orderdate AS timestamp) AS uploaded_at",
        "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status",
        "CASE WHEN o_orderstatus = 'P' THEN if(o_orderkey % 3 = 0, 'ParseError: bad', concat('Duplicate fight: f', o_orderkey)) END AS error_message",
    )


def subscriptions(c: Corpus) -> DataFrame:
    return c.table("nation").selectExpr(
        "cast(n_nationkey AS bigint) AS id",
        """concat('{"kind":"', if(n_nationkey % 3 = 0, 'other', 'upload_completed'), '"}') AS filter""",
        "if(n_nationkey % 4 = 1, timestamp'1998-01-01', NULL) AS revoked_at",
    )


def deliveries(c: Corpus) -> DataFrame:
    return as_deliveries(c.table("lineitem"))


def as_deliveries(lines: DataFrame) -> DataFrame:
    return lines.selectExpr(
        "(l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey AS id", "l_suppkey % 25 AS subscription_id", "l_orderkey AS upload_id", "cast(l_partkey % 4 AS int) AS attempt",
        "CASE l_returnflag WHEN 'A' THEN 200 WHEN 'R' THEN 500 END AS status_code", "if(l_returnflag = 'R', 'HTTP 500', NULL) AS error",
        "if(l_returnflag = 'A', cast(l_shipdate AS timestamp), NULL) AS delivered_at", "if(l_linestatus = 'O', cast(l_shipdate AS timestamp), NULL) AS next_attempt_at",
        "cast(concat('p', l_orderkey) AS binary) AS payload",
    )


def day(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})


def _fmt(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {column}"


@query("S9", f"""
    WITH {_UP}, rc AS (SELECT * FROM up WHERE status <> 'failed'), st AS (SELECT * FROM up WHERE status = 'failed')
    SELECT sha256, min_by(id, (uploaded_at, id)) AS id, 'pending' AS status FROM rc WHERE sha256 NOT IN (SELECT sha256 FROM st) GROUP BY 1""")
def new_uploads(c: Corpus) -> DataFrame:
    """Failed orders are the stored uploads, the others arrive."""
    rows = uploads(c)
    received = rows.filter("status <> 'failed'").drop("status", "error_message")
    return ops.new_uploads(received, rows.filter("status = 'failed'")).select("sha256", "id", "status")


@query("S9", f"""
    WITH {_UP} SELECT id, CASE WHEN status = 'failed' AND sha256 IN (SELECT sha256 FROM up WHERE status = 'pending') THEN 'pending' ELSE status END AS status FROM up""")
def retried_uploads(c: Corpus) -> DataFrame:
    rows = uploads(c)
    return ops.retried_uploads(rows, rows.filter("status = 'pending'")).select("id", "status")


@query("S10 C19", """
    SELECT fight_id, skill_id AS item, min_by(source_agent_id, seq) AS agent, min(seq) AS seq, substring('skill ' || skill_id, 1, 7) AS name FROM ev GROUP BY 1, 2""")
def saved_skills(c: Corpus) -> DataFrame:
    from frayline.functions.names import sanitise_name

    rows = c.events().select("fight_id", F.col("skill_id").alias("item"), F.col("source_agent_id").alias("agent"), "seq")
    out = ops.saved_rows(rows, "item", "seq")
    return out.withColumn("name", sanitise_name(F.concat(F.lit("ski\x00ll "), F.col("item").cast("string")), 7))


@query("S11", f"""
    WITH {_UP}, fi AS (SELECT fight_id, min(id) AS upload_id FROM up WHERE status = 'completed' GROUP BY 1)
    SELECT up.id, up.fight_id, 'failed' AS status, 'The content is already analyzed as fight ' || up.fight_id AS error_message FROM up JOIN fi ON up.fight_id = fi.fight_id WHERE up.id <> fi.upload_id""")
def content_collisions(c: Corpus) -> DataFrame:
    rows = uploads(c)
    owners = rows.filter("status = 'completed'").groupBy("fight_id").agg(F.min("id").alias("upload_id"))
    return ops.collisions(rows.select("id", "fight_id"), owners)


@query("S12", """
    WITH fr AS (SELECT l_orderkey AS upload_id, count(*) - 1 AS ignored_fights, min(l_linenumber) AS n FROM lineitem GROUP BY 1),
    f AS (SELECT DISTINCT ON (l_orderkey) l_orderkey AS upload_id, l_linenumber, l_partkey, l_suppkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey),
    x AS (SELECT fr.upload_id, ignored_fights, 'f' || l_partkey AS fight_id, CASE WHEN l_partkey % 11 = 0 THEN 'ParseError: truncated' WHEN l_partkey % 7 = 0 THEN 'parser yielded fight without header'
        WHEN l_partkey % 5 = 0 THEN 'The content is already analyzed as fight f' || l_partkey END AS error_message FROM fr JOIN f ON fr.upload_id = f.upload_id)
    SELECT upload_id, fight_id, ignored_fights, CASE WHEN error_message IS NULL THEN 'completed' ELSE 'failed' END AS status, error_message, CASE WHEN error_message IS NULL THEN 'v1' END AS parser_version FROM x""")
def parse_outcomes(c: Corpus) -> DataFrame:
    """Line items of an order are the fights its parse yielded."""
    line = "struct(l_linenumber, l_partkey, l_suppkey)"
    attempts = c.table("lineitem").selectExpr(
        "l_orderkey AS upload_id", "if(l_partkey % 11 = 0, 'ParseError', NULL) AS error_class", "if(l_partkey % 11 = 0, 'truncated', NULL) AS error_text",
        f"{line} AS fight_no", "concat('f', l_partkey) AS fight_id", "l_partkey % 7 <> 0 AS has_header", "l_partkey % 5 = 0 AS collides",
    )
    return ops.parse_outcomes(attempts, "v1")


_LACKING = f"contrib AS ({CONTRIB}), st AS (SELECT * FROM contrib WHERE CAST(fight_id AS BIGINT) % 3 = 0)"


def _partly_stored(c: Corpus) -> DataFrame:
    return contributions(c).filter(F.col("fight_id").cast("bigint") % 3 == 0)


@query("S13", f"""
    WITH {_LACKING}, lk AS (SELECT fight_id, CAST(fight_id AS BIGINT) % 3 = 1 AS has_events FROM fights WHERE fight_id NOT IN (SELECT fight_id FROM st))
    SELECT contrib.fight_id, account_name, total_damage, total_healing, total_buff_removal FROM contrib JOIN lk ON contrib.fight_id = lk.fight_id WHERE has_events
    UNION ALL SELECT DISTINCT p.fight_id, account_name, 0, 0, 0 FROM players p JOIN lk ON p.fight_id = lk.fight_id WHERE NOT has_events""")
def summary_backfill(c: Corpus) -> DataFrame:
    fights = c.fights().withColumn("has_events", F.col("fight_id").cast("bigint") % 3 == 1)
    return ops.backfill(fights, _partly_stored(c), c.players(), contributions(c))


@query("S13", f"""
    WITH {_LACKING} SELECT count(*) AS backfilled, 0 AS skipped FROM fights WHERE fight_id NOT IN (SELECT fight_id FROM st)""")
def summary_backfill_counts(c: Corpus) -> DataFrame:
    return ops.backfill_counts(c.fights(), _partly_stored(c), c.players())


@query("S7", f"""
    WITH contrib AS ({CONTRIB}), old AS (SELECT fight_id, account_name, total_damage + 1 AS total_damage FROM contrib WHERE seq % 2 = 0),
    nw AS (SELECT fight_id, account_name, total_damage FROM contrib WHERE seq % 3 = 0)
    SELECT * FROM nw UNION ALL SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM nw WHERE nw.fight_id = old.fight_id AND nw.account_name = old.account_name)""")
def upserted_summaries(c: Corpus) -> DataFrame:
    rows = contributions(c).select("fight_id", "account_name", "seq", "total_damage")
    old = rows.filter("seq % 2 = 0").withColumn("total_damage", F.col("total_damage") + 1).drop("seq")
    return files.upserted(old, rows.filter("seq % 3 = 0").drop("seq"), ["fight_id", "account_name"])


@query("S1 S3", """
    SELECT fight_id, event_type, count(*) AS events, CAST(coalesce(sum(damage), 0) AS BIGINT) AS damage, CAST(coalesce(sum(stacks), 0) AS BIGINT) AS stacks FROM ev
    WHERE seq % 10 <> 3 AND seq % 10 <> 4 GROUP BY 1, 2""")
def parsed_event_lines(c: Corpus) -> DataFrame:
    """Events written as JSON lines and read back; one in ten broken, one in ten of an unknown kind."""
    rows = c.events().withColumn("event_type", F.when(F.col("seq") % 10 == 4, "MYSTERY").otherwise(F.col("event_type")))
    text = F.to_json(F.struct("fight_id", "seq", "time_ms", "event_type", "source_agent_id", "target_agent_id", "skill_id", "damage", "healing", "kind", "stacks"))
    lines = rows.select(F.when(F.col("seq") % 10 == 3, F.concat(text, F.lit("}{"))).otherwise(text).alias("value"))
    broken = F.when(F.col("value").endswith("}{"), F.expr("substring(value, 5)")).otherwise(F.col("value"))
    good, _ = files.split_valid(files.parse_event_lines(lines.select(broken.alias("value"))))
    return good.groupBy("fight_id", "event_type").agg(
        F.count(F.lit(1)).alias("events"), F.coalesce(F.sum("damage"), F.lit(0)).alias("damage"), F.coalesce(F.sum("stacks"), F.lit(0)).alias("stacks")
    )


@query("S4 S5", """
    WITH r AS (SELECT p_partkey % 500 AS id, max(p_partkey) AS k FROM part WHERE p_partkey % 9 <> 5 GROUP BY 1)
    SELECT r.id, p_name AS name, CASE WHEN k % 13 = 0 THEN NULL WHEN k % 13 > 9 THEN NULL ELSE (['GUARDIAN', 'WARRIOR', 'ENGINEER', 'RANGER', 'THIEF', 'ELEMENTALIST', 'MESMER', 'NECROMANCER', 'REVENANT'])[k % 13] END AS profession,
      k % 4 = 0 AS is_elite, CASE WHEN k % 2 = 0 THEN p_type ELSE 'utility' END AS skill_type FROM r JOIN part ON p_partkey = k""")
def skill_catalogue(c: Corpus) -> DataFrame:
    """Parts as catalogue lines: every ninth malformed, later duplicates win, fields missing here and there."""
    line = """concat('{"id": ', p_partkey % 500, ', "name": "', p_name, '"', if(p_partkey % 13 = 0, '', concat(', "profession": ', p_partkey % 13)),
        if(p_partkey % 4 = 0, ', "is_elite": true', ''), if(p_partkey % 2 = 0, concat(', "skill_type": "', p_type, '"'), ''), if(p_partkey % 9 = 5, '', '}'))"""
    lines = c.table("part").selectExpr(f"{line} AS value", "p_partkey")
    return files.catalogue_view(files.parse_catalogue(lines, F.col("p_partkey"))).drop("icon_url", "description")


@query("O12", f"""
    SELECT o_orderpriority AS catalogue, round(date_diff('second', max(o_orderdate)::TIMESTAMP, {_NOW}) / 86400.0, 6) AS age_days FROM orders GROUP BY 1""")
def catalogue_age(c: Corpus) -> DataFrame:
    """Age of every catalogue (order priority) at a given time, by the newest stored change."""
    rows = c.table("orders").select(F.col("o_orderpriority").alias("catalogue"), F.col("o_orderdate").cast("timestamp").alias("changed"))
    return rounded(files.age_days(rows, ["catalogue"], "changed", now()), "age_days")


@query("S2", "SELECT fight_id, event_type, count(*) AS events, CAST(coalesce(sum(damage), 0) AS BIGINT) AS damage FROM ev GROUP BY 1, 2")
def rewritten_events(c: Corpus) -> DataFrame:
    """All events written as gzip JSON lines per fight and read back."""
    folder = live.work_folder(c.spark, "event-files")
    files.write_event_stream(c.events().select("fight_id", "seq", "time_ms", "event_type", "source_agent_id", "target_agent_id", "skill_id", "damage"), folder, as_json=True)
    lines = c.spark.read.text(folder).select("value", F.regexp_extract(F.col("_metadata.file_path"), "fight_id=([^/]+)", 1).alias("fight"))
    good, _ = files.split_valid(files.parse_event_lines(lines))
    return good.groupBy(F.col("fight").alias("fight_id"), "event_type").agg(
        F.count(F.lit(1)).alias("events"), F.coalesce(F.sum("damage"), F.lit(0)).alias("damage"))


_SIDE = """concat(if(c_custkey % 7 = 0, '[1', concat('{"', if(c_custkey % 5 = 0, 'people', 'players'), '": {"', if(c_custkey % 2 = 0, upper(c_name), c_name),
    '": {"healingBySkill": {"1": "', c_custkey % 100, '", "', 2 + c_custkey % 3, '": "', if(c_custkey % 4 = 0, 'x', '7'), '"}}}')), if(c_custkey % 7 = 0, '', '}'))"""


def sidecars(c: Corpus) -> DataFrame:
    return files.parse_sidecars(c.table("customer").selectExpr("c_custkey", "c_name", f"{_SIDE} AS value"))


@query("S6", "SELECT count(*) AS attempts, count(*) FILTER (c_custkey % 7 = 0 OR c_custkey % 5 = 0) AS failures FROM customer")
def sidecar_counts(c: Corpus) -> DataFrame:
    return files.sidecar_counts(sidecars(c))


@query("M1 M2", """
    WITH m AS (SELECT c_custkey AS id, c_custkey % 100 AS one, 2 + c_custkey % 3 AS k, c_custkey % 4 = 0 AS bad FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0)
    SELECT id, CASE WHEN bad THEN '1=' || (one + 10) || CASE WHEN k = 2 THEN ',2=20' ELSE ',2=20' END
      ELSE '1=' || (one + 10) || CASE WHEN k = 2 THEN ',2=27' ELSE ',2=20,' || k || '=7' END END AS merged, CAST(bad AS INTEGER) AS skipped FROM m""")
def merged_skill_maps(c: Corpus) -> DataFrame:
    """Stored map {1: 10, 2: 20} of every customer merged with its sidecar entry (found ignoring case)."""
    rows = sidecars(c).filter("valid").withColumn("p", documents.case_insensitive(F.col("players"), F.col("c_name")))
    stored = F.expr("map('1', 10L, '2', 20L)")
    rows = rows.select(
        F.col("c_custkey").alias("id"), documents.merge_amounts(stored, F.col("p.healingBySkill")).alias("m"),
        documents.skipped_amounts(F.col("p.healingBySkill")).alias("skipped"),
    )
    text = F.transform(F.sort_array(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return rows.select("id", F.array_join(text, ",").alias("merged"), "skipped")


# -- sweeps and deliveries ------------------------------------------------------------------
@query("O1", f"""
    WITH {_UP} SELECT id, CASE WHEN status = 'pending' AND uploaded_at < {_NOW} - INTERVAL 86400 SECOND THEN 'failed' ELSE status END AS status,
      CASE WHEN status = 'pending' AND uploaded_at < {_NOW} - INTERVAL 86400 SECOND THEN 'stuck-pending-sweeper: no completion signal within 86400s (worker died or Redis lost the job)' ELSE error_message END AS error_message FROM up""")
def swept_uploads(c: Corpus) -> DataFrame:
    return ops.sweep_stuck(uploads(c), now(), 86400).select("id", "status", "error_message")


@query("O1", f"""
    WITH {_UP} SELECT count(*) AS pending FROM up WHERE status = 'pending' AND uploaded_at >= {_NOW} - INTERVAL 86400 SECOND""")
def pending_after_sweep(c: Corpus) -> DataFrame:
    return ops.sweep_stuck(uploads(c), now(), 86400).filter("status = 'pending'").agg(F.count(F.lit(1)).alias("pending"))


@query("O2", f"""
    WITH {_UP} SELECT id FROM up WHERE status = 'failed' AND uploaded_at < {_NOW} - INTERVAL 90 DAY AND error_message LIKE 'Duplicate fight:%'
      AND id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def expired_failures(c: Corpus) -> DataFrame:
    fights = c.table("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("upload_id"))
    return ops.expired_failures(uploads(c), fights, now(), 90, "Duplicate fight:").select("id")


@query("O3 M3", f"""
    WITH {_UP}, {_SUB} SELECT up.id, sb.id AS subscription_id FROM up CROSS JOIN sb WHERE status = 'completed' AND NOT revoked AND filter = '{{"kind":"upload_completed"}}'""")
def matched_subscriptions(c: Corpus) -> DataFrame:
    return ops.matched_subscriptions(uploads(c), subscriptions(c)).select("id", "subscription_id")


@query("M3", f"""
    WITH {_UP} SELECT id, '{{"kind":"upload_completed","upload_id":"' || id || '","fight_id":"' || fight_id || '","sha256":"' || sha256 || '"}}' AS payload FROM up WHERE status = 'completed'""")
def upload_payloads(c: Corpus) -> DataFrame:
    return uploads(c).filter("status = 'completed'").select("id", ops.upload_payload().alias("payload"))


@query("O4 O5 O11", f"""
    WITH {_DEL} SELECT id, subscription_id, attempt, strftime({_NOW} + to_seconds(CASE attempt WHEN 1 THEN 1 WHEN 2 THEN 10 ELSE 100 END), '%Y-%m-%d %H:%M:%S') AS retry_at FROM de
    WHERE attempt < 3 AND delivered_at IS NULL AND (next_attempt_at IS NULL OR next_attempt_at <= {_NOW}) AND (status_code IS NULL OR status_code >= 300)""")
def due_retries(c: Corpus) -> DataFrame:
    rows = ops.due_retries(deliveries(c), now()).withColumn("retry_at", ops.next_attempt_at(now(), F.col("attempt")))
    return day(rows.select("id", "subscription_id", "attempt", "retry_at"), "retry_at")


@query("O6", f"""
    WITH {_DEL} SELECT id, subscription_id, upload_id, error AS last_error FROM de WHERE attempt >= 3 AND delivered_at IS NULL""")
def dead_letters(c: Corpus) -> DataFrame:
    return ops.dead_letters(deliveries(c), now()).select("id", "subscription_id", "upload_id", "last_error")


@query("O6", f"WITH {_DEL} SELECT attempt, count(*) AS deliveries FROM de WHERE NOT (attempt >= 3 AND delivered_at IS NULL) GROUP BY 1")
def remaining_deliveries(c: Corpus) -> DataFrame:
    return ops.remaining_deliveries(deliveries(c)).groupBy("attempt").agg(F.count(F.lit(1)).alias("deliveries"))


@query("O7", f"""
    WITH {_DEL} SELECT id, CASE WHEN status_code = 500 THEN 204 ELSE status_code END AS status_code, CASE WHEN status_code = 500 THEN NULL ELSE error END AS error FROM de""")
def applied_outcomes(c: Corpus) -> DataFrame:
    rows = deliveries(c)
    outcomes = rows.filter("status_code = 500").select("id", F.lit(204).alias("status_code"), F.lit(None).cast("string").alias("error"), now().alias("delivered_at"))
    return ops.apply_outcomes(rows, outcomes).select("id", "status_code", "error")


@query("O8", """
    WITH o AS (SELECT o_orderpriority AS label, o_totalprice / 4000 AS s FROM orders), b AS (SELECT unnest([0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0]::DOUBLE[]) AS bound)
    SELECT label, CAST(bound AS VARCHAR) AS bound, count(*) FILTER (s <= bound) AS cumulative, count(*) AS total FROM o CROSS JOIN b GROUP BY 1, 2
    UNION ALL SELECT label, 'inf', count(*), count(*) FROM o GROUP BY 1""")
def latency_histogram(c: Corpus) -> DataFrame:
    rows = c.table("orders").select(F.col("o_orderpriority").alias("label"), (F.col("o_totalprice") / 4000).alias("s"))
    out = ops.latency_histogram(rows, "label", "s")
    return out.withColumn("bound", F.when(F.col("bound") == float("inf"), "inf").otherwise(F.col("bound").cast("string")))


@query("O8", """
    WITH o AS (SELECT o_orderpriority AS label, o_totalprice / 4000 AS s FROM orders), b AS (SELECT unnest([0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 1e300]::DOUBLE[]) AS bound),
    h AS (SELECT label, bound, count(*) FILTER (s <= bound) AS c, count(*) AS total FROM o CROSS JOIN b GROUP BY 1, 2),
    g AS (SELECT *, coalesce(lag(bound) OVER w, 0.0) AS lo, coalesce(lag(c) OVER w, 0) AS lc FROM h WINDOW w AS (PARTITION BY label ORDER BY bound)),
    r AS (SELECT label, q, min_by(CASE WHEN bound > 1e200 THEN lo ELSE lo + (bound - lo) * (total * q - lc) / (c - lc) END, bound) AS v FROM g CROSS JOIN (SELECT unnest([0.5, 0.95, 0.99]::DOUBLE[]) AS q) z WHERE c >= total * q GROUP BY 1, 2)
    SELECT label, round(max(v) FILTER (q = 0.5), 6) AS p50, round(max(v) FILTER (q = 0.95), 6) AS p95, round(max(v) FILTER (q = 0.99), 6) AS p99 FROM r GROUP BY 1""")
def latency_quantiles(c: Corpus) -> DataFrame:
    rows = c.table("orders").select(F.col("o_orderpriority").alias("label"), (F.col("o_totalprice") / 4000).alias("s"))
    return rounded(ops.histogram_quantiles(ops.latency_histogram(rows, "label", "s"), "label"), "p50", "p95", "p99")


@query("O8", """
    SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS label, count(*) AS n, round(count(*) / 300.0::DOUBLE, 6) AS per_second FROM events GROUP BY 1, 2""")
def five_minute_rates(c: Corpus) -> DataFrame:
    rows = c.table("events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("label"))
    return day(rounded(ops.five_minute_rates(rows, "ts", "label"), "per_second"), "window_start")


@query("O9", """
    SELECT c_custkey AS id, c_name AS name, c_nationkey AS world_id, n_name AS world_name, CASE WHEN n_regionkey < 2 THEN 'Full' WHEN n_regionkey >= 2 THEN 'Medium' END AS population
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20""")
def accounts_with_worlds(c: Corpus) -> DataFrame:
    worlds = c.table("nation").filter("n_nationkey < 20").selectExpr("n_nationkey AS id", "n_name AS name", "if(n_regionkey < 2, 'Full', 'Medium') AS population")
    return ops.world_of_accounts(c.table("customer").selectExpr("c_custkey AS id", "c_name AS name", "c_nationkey AS world_id"), worlds)


@query("O10", f"""
    WITH {_DEL}, {_SUB}, {_UP}, dl AS (SELECT * FROM de WHERE attempt >= 3 AND delivered_at IS NULL)
    SELECT dl.id, subscription_id, upload_id, 1 AS attempt FROM dl WHERE status_code = 500 AND subscription_id IN (SELECT id FROM sb WHERE NOT revoked) AND upload_id IN (SELECT id FROM up)""")
def replayed_dead_letters(c: Corpus) -> DataFrame:
    rows = deliveries(c)
    dlq = ops.dead_letters(rows, now())
    ids = rows.filter("status_code = 500").select("id")
    return ops.replayed(dlq, ids, subscriptions(c), uploads(c), now()).select("id", "subscription_id", "upload_id", "attempt")


@query("O11 T1", f"""
    WITH {_DEL} SELECT id, subscription_id, upload_id FROM de WHERE attempt >= 3 AND delivered_at IS NULL ORDER BY id DESC LIMIT 50 OFFSET 25""")
def dead_letter_page(c: Corpus) -> DataFrame:
    return profiles.page(ops.dead_letters(deliveries(c), now()).select("id", "subscription_id", "upload_id"), [F.col("id").desc()], 50, 25)


@query("O11", f"""
    WITH {_DEL} SELECT id, upload_id, row_number() OVER (ORDER BY id DESC) AS position FROM de WHERE attempt >= 3 AND delivered_at IS NULL AND subscription_id = 7 QUALIFY position <= 50""")
def subscription_dead_letters(c: Corpus) -> DataFrame:
    """The newest 50 dead letters of one subscription."""
    rows = ops.dead_letters(deliveries(c).filter("subscription_id = 7"), now()).select("id", "upload_id", F.lit(0).alias("page"))
    return profiles.top_per_key(rows, ["page"], "id", "upload_id", 50).select("id", "upload_id", F.col("rank").alias("position"))


@query("O11", f"""
    WITH {_DEL} SELECT id, row_number() OVER (ORDER BY coalesce(next_attempt_at, DATE '1970-01-01'), id) AS position FROM de
    WHERE attempt < 3 AND delivered_at IS NULL AND (next_attempt_at IS NULL OR next_attempt_at <= {_NOW}) AND (status_code IS NULL OR status_code >= 300) QUALIFY position <= 100""")
def oldest_due_deliveries(c: Corpus) -> DataFrame:
    """The 100 deliveries that are due longest."""
    rows = ops.due_retries(deliveries(c), now()).withColumn("age", -F.unix_seconds(F.coalesce("next_attempt_at", F.timestamp_seconds(F.lit(0)))))
    rows = profiles.top_per_key(rows.withColumn("page", F.lit(0)), ["page"], "age", "id", 100)
    return rows.select("id", F.col("rank").alias("position"))


@query("O11", f"WITH {_UP} SELECT sha256, id, status FROM up WHERE sha256 IN ('h7', 'h11', 'h1000000')")
def uploads_by_hash(c: Corpus) -> DataFrame:
    return uploads(c).filter(F.col("sha256").isin("h7", "h11", "h1000000")).select("sha256", "id", "status")


@query("M2", """
    SELECT CASE WHEN c_custkey % 7 = 0 OR c_custkey % 5 = 0 THEN 'invalid' WHEN c_custkey % 6 = 0 THEN 'unresolved' ELSE 'resolved' END AS outcome, count(*) AS players FROM customer GROUP BY 1""")
def resolved_sidecar_players(c: Corpus) -> DataFrame:
    """Sidecar players by outcome; every sixth is asked for under a name that no document holds."""
    name = F.when(F.col("c_custkey") % 6 == 0, F.concat(F.lit("nobody "), F.col("c_name"))).otherwise(F.col("c_name"))
    rows = sidecars(c).withColumn("found", documents.case_insensitive(F.col("players"), name).isNotNull())
    outcome = F.when(~F.col("valid"), "invalid").when(F.col("found"), "resolved").otherwise("unresolved")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("players"))


@query("O11", f"WITH {_SUB} SELECT id, filter FROM sb WHERE NOT revoked")
def active_subscriptions(c: Corpus) -> DataFrame:
    return subscriptions(c).filter("revoked_at is null").select("id", "filter")


# -- roles -----------------------------------------------------------------------------------
_CAP = "CASE spec " + " ".join(f"WHEN '{n}' THEN [{', '.join(repr(r) for r in rs)}]" for n, rs in L.SPEC_CAPABILITIES.items()) + " END"
_SPEC = "CASE elite " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in L.SPEC_NAMES.items()) + " END"
_HINT = "CASE spec " + " ".join(f"WHEN '{n}' THEN '{h}'" for n, h in L.SPEC_HINT.items()) + " END"
_PROF_HINT = "CASE profession " + " ".join(f"WHEN {i} THEN '{L.PROFESSION_HINT[n]}'" for i, n in L.PROFESSIONS.items()) + " END"
_ROLE = f"""r0 AS (SELECT *, {_SPEC} AS spec, greatest(total_damage, 0) * 1.0::DOUBLE AS ed, greatest(total_healing, 0) * 2.5::DOUBLE AS eh, greatest(total_buff_removal, 0) * 5000.0::DOUBLE AS es FROM src),
    r1 AS (SELECT *, {_CAP} AS caps, coalesce({_HINT}, {_PROF_HINT}) AS hint, CASE WHEN ed + eh + es > 0 THEN ed / (ed + eh + es) ELSE 0.0 END AS rd,
      CASE WHEN ed + eh + es > 0 THEN eh / (ed + eh + es) ELSE 0.0 END AS rh, CASE WHEN ed + eh + es > 0 THEN es / (ed + eh + es) ELSE 0.0 END AS rs FROM r0),
    r2 AS (SELECT *, list_filter([CASE WHEN rd >= 0.65 THEN 'DPS' END, CASE WHEN rh >= 0.5 THEN 'HEAL' END, CASE WHEN rs >= 0.35 THEN 'STRIP' END], lambda x: x IS NOT NULL) AS b1 FROM r1),
    r3 AS (SELECT *, CASE WHEN hint = 'HEAL' AND rh >= 0.2 AND len(b1) > 0 AND b1[1] = 'DPS' AND NOT list_contains(b1, 'HEAL') THEN list_prepend('HEAL', b1) ELSE b1 END AS b2 FROM r2),
    r4 AS (SELECT *, CASE WHEN len(b2) > 0 THEN b2 WHEN hint = 'DPS' AND rd >= 0.3 THEN ['DPS'] WHEN hint = 'HEAL' AND rh >= 0.3 THEN ['HEAL'] WHEN hint = 'STRIP' AND rs >= 0.3 THEN ['STRIP']
      WHEN hint = 'BOON' AND list_contains(caps, 'BOON') AND ((NOT list_contains(caps, 'DPS') AND NOT list_contains(caps, 'HEAL')) OR rh + rs > rd) THEN ['BOON'] ELSE [] END AS b3 FROM r3),
    r5 AS (SELECT *, CASE WHEN boon_score >= 150000 AND coalesce(list_contains(caps, 'BOON'), false) AND NOT list_contains(b3, 'BOON')
      THEN CASE WHEN hint = 'BOON' AND coalesce(b3[1], '') <> 'HEAL' THEN list_prepend('BOON', b3) ELSE list_append(b3, 'BOON') END ELSE b3 END AS b4 FROM r4),
    r6 AS (SELECT *, CASE WHEN len(b4) > 0 THEN b4[1] WHEN ed + eh + es = 0 THEN 'UNKNOWN' ELSE 'MIXED' END AS role, CASE WHEN caps IS NULL THEN [] ELSE list_filter(b4, lambda x: NOT list_contains(caps, x)) END AS fo FROM r5),
    r7 AS (SELECT *, CASE WHEN len(b4) = 0 THEN CASE WHEN ed + eh + es = 0 THEN ['zero_output'] ELSE [] END ELSE list_filter([CASE WHEN len(fo) > 0 THEN 'foreign_badges:' || array_to_string(fo, ',') END,
      CASE WHEN hint IS NOT NULL AND role <> hint AND len(fo) = 0 THEN 'off_meta' END, CASE WHEN rd >= 0.85 THEN 'high_dps' END, CASE WHEN rh >= 0.75 THEN 'high_healing' END, CASE WHEN rs >= 0.6 THEN 'high_strips' END,
      CASE WHEN total_damage > 0 THEN CASE WHEN power / total_damage >= 0.8 THEN 'high_power' WHEN power / total_damage <= 0.2 THEN 'high_condi' END END], lambda x: x IS NOT NULL) END AS tags FROM r6)"""


@query("R1 R2 R3 R4 R5 R6 S14", f"""
    WITH src AS (SELECT c_custkey AS id, CAST(c_custkey % 11 AS INTEGER) AS profession, CAST(c_custkey % 83 AS INTEGER) AS elite, c_custkey * 37 % 1000 * 1000 AS total_damage, c_custkey * 53 % 700 * 300 AS total_healing,
      c_custkey * 29 % 90 AS total_buff_removal, c_custkey * 37 % 1000 * (c_custkey % 5) * 250 AS power, (c_custkey % 4) * 60000 * 1.5::DOUBLE AS boon_score FROM customer), {_ROLE}
    SELECT id, role AS detected_role, array_to_string(tags, ';') AS detected_tags FROM r7""")
def detected_roles(c: Corpus) -> DataFrame:
    """Role and tags over magnitudes spread by customer key."""
    rows = c.table("customer").selectExpr(
        "c_custkey AS id", "cast(c_custkey % 11 AS int) AS profession", "cast(c_custkey % 83 AS int) AS elite", "c_custkey * 37 % 1000 * 1000 AS total_damage",
        "c_custkey * 53 % 700 * 300 AS total_healing", "c_custkey * 29 % 90 AS total_buff_removal", "c_custkey * 37 % 1000 * (c_custkey % 5) * 250 AS power",
        "c_custkey % 4 * 60000 AS out_quickness",
    )
    rows = rows.withColumn("condi", F.col("total_damage") - F.col("power"))
    rows = rows.withColumns({f"out_{b}": F.lit(None).cast("bigint") for b in L.BOON_WEIGHTS if b != "quickness"})
    rows = roles.with_role(rows, power="power", condi="condi", outgoing_prefix="out_")
    return rows.select("id", "detected_role", F.array_join("detected_tags", ";").alias("detected_tags"))


# -- quality: violations found in the operators' own output -----------------------------------
# each check reads the operator's output with known faults put in, so that it has something to find
@query("V1", """
    SELECT fight_id, CASE WHEN CAST(fight_id AS BIGINT) % 3 = 0 AND CAST(fight_id AS BIGINT) % 2 = 0 THEN 'players + npcs = agents,subgroups add up,skills = catalogue'
      WHEN CAST(fight_id AS BIGINT) % 3 = 0 THEN 'players + npcs = agents,subgroups add up' ELSE 'skills = catalogue' END AS broken
    FROM fights WHERE fight_id IN (SELECT fight_id FROM ev) AND (CAST(fight_id AS BIGINT) % 3 = 0 OR CAST(fight_id AS BIGINT) % 2 = 0)""")
def roster_violations(c: Corpus) -> DataFrame:
    """Fights divisible by 3 lack a player, even ones a skill."""
    skills, number = c.events().select("fight_id", "skill_id").distinct(), F.col("fight_id").cast("bigint")
    roster = rollups.fight_roster(c.agents(), skills)
    roster = roster.withColumn("player_count", F.col("player_count") - F.when(number % 3 == 0, 1).otherwise(0))
    catalogue = skills.unionByName(skills.filter(number % 2 == 0).withColumn("skill_id", F.lit(-1).cast("bigint")).distinct())
    rows = quality.roster_checks(roster, rollups.subgroup_members(c.agents()), catalogue)
    return rows.select("fight_id", F.array_join("broken", ",").alias("broken"))


@query("V2", """
    SELECT account_name, CASE WHEN account_name LIKE '%1' THEN 'attendance within fights,attendance = own fights' ELSE 'attendance = own fights' END AS broken
    FROM players WHERE fight_id IN (SELECT fight_id FROM fights) AND (account_name LIKE '%1' OR account_name LIKE '%2') GROUP BY 1""")
def attendance_violations(c: Corpus) -> DataFrame:
    """Accounts that end with 1 have too many fights altogether, those with 2 one too few."""
    rows = rollups.attendance(c.players(), c.fights())
    change = F.when(F.col("account_name").endswith("1"), 1_000_000).when(F.col("account_name").endswith("2"), -1).otherwise(0)
    rows = quality.attendance_checks(rows.withColumn("fights_attended", F.col("fights_attended") + change), c.players().join(c.fights().select("fight_id"), "fight_id", "left_semi"))
    return rows.select("account_name", F.array_join("broken", ",").alias("broken"))


@query("V2", "SELECT fight_id, CAST(agent_id AS BIGINT) AS agent_id FROM agents WHERE agent_id > 0 AND (agent_id - 1) % 5 = 0 AND EXISTS (SELECT 1 FROM agents b WHERE b.fight_id = agents.fight_id AND b.agent_id = agents.agent_id - 1)")
def repeated_ids(c: Corpus) -> DataFrame:
    """Agents listed by id; the one after every fifth id repeats it."""
    rows = c.agents().select("fight_id", "agent_id", F.col("agent_id").alias("position"))
    rows = rows.withColumn("listed", F.when((F.col("agent_id") - 1) % 5 == 0, F.col("agent_id") - 1).otherwise(F.col("agent_id")))
    found = quality.out_of_order(rows, ["fight_id"], "position", "listed")
    return found.select("fight_id", F.col("agent_id").cast("bigint").alias("agent_id"))


@query("V3", """
    SELECT fight_id, CAST(sum(damage) AS BIGINT) AS part_total_damage FROM ev WHERE event_type IN ('DAMAGE', 'HEALING', 'BUFF_REMOVAL')
    GROUP BY 1 HAVING CAST(fight_id AS BIGINT) % 2 = 0""")
def rollup_sum_violations(c: Corpus) -> DataFrame:
    """Skill totals against an input that holds one more damage in even fights."""
    events = c.events(rollups.ACTION_KINDS)
    whole = events.groupBy("fight_id").agg(F.sum("damage").alias("total_damage"), F.sum("healing").alias("total_healing"))
    whole = whole.withColumn("total_damage", F.col("total_damage") + F.when(F.col("fight_id").cast("bigint") % 2 == 0, 1).otherwise(0))
    return quality.sums_preserved(rollups.skill_usage(events, c.skills()), whole, ["fight_id"], ["total_damage", "total_healing"]).select("fight_id", "part_total_damage")


@query("V5", """
    WITH b AS (SELECT fight_id, CAST(sum(damage) AS BIGINT) AS d, CAST(coalesce(sum(damage) FILTER (time_ms < 3600000), 0) AS BIGINT) AS f FROM ev GROUP BY 1)
    SELECT fight_id, d - f AS part_total_damage, d AS whole_total_damage FROM b WHERE f <> 0""")
def bucket_sum_violations(c: Corpus) -> DataFrame:
    """Hour windows with the first one lost, against the input's sums."""
    windows = timelines.event_windows(c.events(), 3600).filter("bucket > 0")
    whole = c.events().select("fight_id", F.col("damage").alias("total_damage"))
    return quality.sums_preserved(windows, whole, ["fight_id"], ["total_damage"]).select("fight_id", "part_total_damage", "whole_total_damage")


@query("V6", f"""
    WITH contrib AS ({CONTRIB}) SELECT fight_id, account_name, total_damage + 1 AS part_total_damage, total_damage AS whole_total_damage FROM contrib WHERE account_name LIKE '%3'""")
def account_sum_violations(c: Corpus) -> DataFrame:
    """Series sums per account against contributions; accounts that end with 3 have one damage too many."""
    series = timelines.player_timelines(c.events(rollups.ACTION_KINDS), c.players(), 3600)
    parts = series.groupBy("fight_id", "account_name").agg(F.sum("total_damage").alias("total_damage"))
    parts = parts.withColumn("total_damage", F.col("total_damage") + F.col("account_name").endswith("3").cast("int"))
    return quality.sums_preserved(parts, contributions(c), ["fight_id", "account_name"], ["total_damage"]).select("fight_id", "account_name", "part_total_damage", "whole_total_damage")


@query("V4 N6", """
    WITH r AS (SELECT fight_id, target_agent_id, sum(damage) AS d FROM ev WHERE event_type = 'DAMAGE' GROUP BY 1, 2),
    x AS (SELECT fight_id, target_agent_id, d, lag(d) OVER (PARTITION BY fight_id ORDER BY target_agent_id) AS pd FROM r)
    SELECT fight_id, target_agent_id FROM x WHERE pd < d""")
def order_violations(c: Corpus) -> DataFrame:
    """Per-target damage presented by agent id instead of by damage: every rise is a violation."""
    rows = c.events(["DAMAGE"]).groupBy("fight_id", "target_agent_id").agg(F.sum("damage").alias("d"))
    return quality.order_violations(rows, ["fight_id"], "target_agent_id", "d", "target_agent_id").select("fight_id", "target_agent_id")


@query("V5 N6", """
    WITH b AS (SELECT fight_id, time_ms // 600000 AS bucket FROM ev WHERE event_type = 'DAMAGE' GROUP BY 1, 2)
    SELECT fight_id, count(*) AS n, max(bucket) AS high FROM b GROUP BY 1 HAVING min(bucket) <> 0 OR count(*) <> max(bucket) + 1""")
def bucket_gap_violations(c: Corpus) -> DataFrame:
    """Ten-minute buckets before zero-fill."""
    rows = c.events(["DAMAGE"]).select("fight_id", F.floor(F.col("time_ms") / 600_000).alias("bucket")).distinct()
    return quality.bucket_gaps(rows, ["fight_id"]).select("fight_id", "n", "high")


@query("V6", """
    WITH l AS (SELECT fight_id, source_agent_id, count(DISTINCT time_ms // 3600000) AS n FROM ev WHERE event_type = 'DAMAGE' GROUP BY 1, 2)
    SELECT fight_id, min(n) AS shortest, max(n) AS longest FROM l GROUP BY 1 HAVING min(n) <> max(n)""")
def series_length_violations(c: Corpus) -> DataFrame:
    rows = c.events(["DAMAGE"]).select("fight_id", "source_agent_id", F.floor(F.col("time_ms") / 3_600_000).alias("bucket")).distinct()
    return quality.unequal_series(rows, ["fight_id"], "source_agent_id")


@query("V9", """
    WITH h AS (SELECT fight_id, target_agent_id, skill_id, seq, CASE WHEN seq % 11 = 0 THEN time_ms - 7200000 ELSE time_ms END AS t
      FROM ev WHERE event_type = 'BOON_APPLY' AND kind <> 'remove_manual'),
    x AS (SELECT *, lag(t) OVER (PARTITION BY fight_id, target_agent_id, skill_id ORDER BY seq) AS before FROM h)
    SELECT fight_id, seq FROM x WHERE seq % 7 = 0 OR t < 0 OR t < before""")
def history_violations(c: Corpus) -> DataFrame:
    """A history whose every 7th record has lost its level and every 11th comes two hours early."""
    from frayline.operators import buffs

    rows = buffs.stack_history(c.events(["BOON_APPLY"]), 3_600_000)
    rows = rows.withColumns({"stacks": F.when(F.col("seq") % 7 == 0, -1).otherwise(F.col("stacks")), "time_ms": F.col("time_ms") - F.when(F.col("seq") % 11 == 0, 7_200_000).otherwise(0)})
    return quality.bad_history(rows, buffs.KEYS).select("fight_id", "seq")


@query("V10", f"""
    WITH {_DEL} SELECT id, 'status_code range' AS broken FROM de WHERE status_code NOT BETWEEN 100 AND 499""")
def domain_violations(c: Corpus) -> DataFrame:
    rows = quality.domain_violations(deliveries(c), ["attempt"], {}, {"status_code": (100, 499)})
    return rows.select("id", F.array_join("broken", ",").alias("broken"))


@query("V11", f"WITH {_UP} SELECT sha256, count(*) AS copies FROM up GROUP BY 1 HAVING count(*) > 1")
def duplicate_hashes(c: Corpus) -> DataFrame:
    return quality.duplicate_keys(uploads(c), ["sha256"])


@query("V8", f"""
    WITH contrib AS ({CONTRIB}) SELECT account_name, count(*) AS fights FROM contrib WHERE account_name LIKE '%2' GROUP BY 1""")
def profile_violations(c: Corpus) -> DataFrame:
    """Attendance of every profile against its distinct fights; accounts that end with 2 have one too many."""
    rows = contributions(c)
    attended = profiles.attended_fights(rows).withColumn("fights_attended", F.lit(1))
    made = profiles.profiles(rows).withColumn("fights_attended", F.col("fights_attended") + F.col("account_name").endswith("2").cast("int"))
    found = quality.sums_preserved(made, attended, ["account_name"], ["fights_attended"])
    return found.select("account_name", F.col("whole_fights_attended").alias("fights"))


@query("V8", f"""
    WITH contrib AS ({CONTRIB}), pts AS (SELECT account_name, cc.fight_id, started_at FROM contrib cc JOIN fights f ON cc.fight_id = f.fight_id),
    n AS (SELECT *, lag(started_at) OVER (PARTITION BY account_name ORDER BY fight_id) AS before FROM pts)
    SELECT account_name, fight_id FROM n WHERE before <= started_at""")
def newest_first_violations(c: Corpus) -> DataFrame:
    """Points of every account presented oldest first: each one after a newer position is a violation."""
    rows = contributions(c).join(c.fights().select("fight_id", "started_at"), "fight_id")
    rows = rows.select("account_name", "fight_id", "started_at", F.col("fight_id").cast("bigint").alias("position"))
    return quality.out_of_order(rows, ["account_name"], "position", "started_at", descending=True, chunk=1_000).select("account_name", "fight_id")


# -- streaming --------------------------------------------------------------------------------
_WINDOW_SUMS = """CAST(coalesce(sum(damage), 0) AS BIGINT) AS total_damage, CAST(coalesce(sum(healing), 0) AS BIGINT) AS total_healing, CAST(coalesce(sum(buff_removal), 0) AS BIGINT) AS total_buff_removal"""


@query("X1", f"""
    WITH b AS (SELECT ev.fight_id, date_trunc('hour', ts) AS w, count(*) AS event_count, {_WINDOW_SUMS} FROM ev JOIN events ON event_id = seq GROUP BY 1, 2)
    SELECT fight_id, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_count, total_damage, total_healing, total_buff_removal FROM b""")
def live_timeline(c: Corpus) -> DataFrame:
    """All windows of the drained stream, open ones with their newest state."""
    stream = live.live_timeline(StreamCorpus(c.spark, c.folder, timestamps=True).events())
    folder = live.work_folder(c.spark, "live-timeline")
    live.drain(stream, folder, live.batch_sink(f"{folder}/windows"), "update")
    schema = "fight_id STRING, window_start TIMESTAMP, event_count BIGINT, total_damage BIGINT, total_healing BIGINT, total_buff_removal BIGINT"
    return day(live.newest_rows(live.batch_table(c.spark, f"{folder}/windows", schema), ["fight_id", "window_start"]), "window_start")


@query("X2", f"WITH {_UP} SELECT DISTINCT sha256 FROM up")
def live_ingest(c: Corpus) -> DataFrame:
    stream = live.stream_table(c.spark, c.folder, "orders").selectExpr("concat('h', o_custkey) AS sha256", "cast(o_orderdate AS timestamp) AS uploaded_at")
    folder = live.work_folder(c.spark, "live-ingest")
    live.drain(live.first_uploads(stream).select("sha256"), folder, live.ingest_batch(f"{folder}/uploads"))
    return live.hash_store(c.spark, f"{folder}/uploads").rows()


@query("X3", f"WITH contrib AS ({CONTRIB}) SELECT fight_id, account_name, total_damage, total_healing, total_buff_removal FROM contrib")
def live_summaries(c: Corpus) -> DataFrame:
    folder = live.work_folder(c.spark, "live-summaries")
    players = c.players()
    keys = ["fight_id", "account_name"]
    sink = live.batch_sink(f"{folder}/summaries", lambda batch: summaries.contributions(batch, players).select(*keys, *timelines.TOTALS))
    live.drain(StreamCorpus(c.spark, c.folder).events(rollups.ACTION_KINDS), folder, sink)
    return live.merged_summaries(c.spark, f"{folder}/summaries", keys, timelines.TOTALS)


@query("X4", f"WITH {HISTORY} SELECT * FROM hist")
def live_stack_history(c: Corpus) -> DataFrame:
    """All rows: once the stored events are read, a closing row moves the watermark past the last of them."""
    corpus = StreamCorpus(c.spark, c.folder, timestamps=True)
    folder = live.work_folder(c.spark, "live-stacks")
    events = corpus.events(["BOON_APPLY"])
    last = Corpus(c.spark, c.folder, timestamps=True).events(["BOON_APPLY"]).agg(F.max(F.struct("ts", "fight_id")).alias("m"))
    live.closing_rows(last.select("m.*"), events.schema, "ts", "1 day").write.parquet(f"{folder}/closing")
    closing = c.spark.readStream.schema(events.schema).parquet(f"{folder}/closing")
    live.drain(live.live_stack_history(events.unionByName(closing)), folder)
    return c.spark.read.parquet(f"{folder}/rows").filter(F.col("agent_id") != live.CLOSING_ID)
