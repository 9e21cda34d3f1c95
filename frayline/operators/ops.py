"""Operational tables: ingest, parse outcomes, sweeps, deliveries, latency histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frayline.operators.rollups import count_where

MAX_ATTEMPTS = 3
# --- fixed values: seconds to wait before the next attempt ----------------
BACKOFF_S = {1: 1, 2: 10, 3: 100}
# --- fixed value: message of a swept upload --------------------------------
STUCK_MESSAGE = "stuck-pending-sweeper: no completion signal within {seconds}s (worker died or Redis lost the job)"
# --- fixed values: upper bounds of the job duration histogram -------------
DURATION_BOUNDS = [0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0]


# -- ingest ----------------------------------------------------------------------
def new_uploads(received: DataFrame, stored: DataFrame) -> DataFrame:
    """First upload per content hash that is not stored yet; starts pending.

    The first one is an aggregate (arrival, id), so copies of one file reduce
    map-side however many there are.
    """
    columns = [c for c in received.columns if c != "sha256"]
    first = received.groupBy("sha256").agg(F.min_by(F.struct(*columns), F.struct("uploaded_at", "id")).alias("u"))
    rows = first.join(stored.select("sha256"), "sha256", "left_anti").select("sha256", "u.*")
    return rows.withColumn("status", F.lit("pending")).select(*received.columns, "status")


def retried_uploads(stored: DataFrame, received: DataFrame) -> DataFrame:
    """Stored uploads after the batch: a failed one that came again is pending."""
    again = received.select("sha256").distinct().withColumn("_again", F.lit(True))
    rows = stored.join(again, "sha256", "left")
    back = F.col("_again").isNotNull() & (F.col("status") == "failed")
    return rows.withColumn("status", F.when(back, "pending").otherwise(F.col("status"))).select(*stored.columns)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def collisions(uploads: DataFrame, fights: DataFrame) -> DataFrame:
    """Uploads whose fight is already stored under another upload: failed, with a pointer.

    ``uploads``: id, fight_id; ``fights``: fight_id, upload_id.
    """
    rows = uploads.join(fights.select("fight_id", F.col("upload_id").alias("_owner")), "fight_id")
    rows = rows.filter(F.col("_owner") != F.col("id")).drop("_owner")
    message = F.concat(F.lit("The content is already analyzed as fight "), F.col("fight_id"))
    return rows.withColumns({"status": F.lit("failed"), "error_message": message})


def parse_outcomes(attempts: DataFrame, parser_version: str) -> DataFrame:
    """Final state of each parse: ``attempts``: upload_id, error_class, error_text, fight_no, fight_id, has_header, collides.

    One row per fight a parse yielded (fight_no null when none); only the first counts. ``fight_no`` is anything that orders
    the fights of an upload, a number or a struct.
    """
    first = attempts.groupBy("upload_id").agg(
        F.min_by(F.struct("error_class", "error_text", "fight_id", "has_header", "collides"), F.struct("fight_no")).alias("f"),
        F.greatest(F.count("fight_no") - 1, F.lit(0)).alias("ignored_fights"),
    ).select("upload_id", "f.*", "ignored_fights")
    error = (
        F.when(F.col("error_class").isNotNull(), F.concat_ws(": ", "error_class", "error_text"))
        .when(F.col("fight_id").isNull(), "parser yielded no fights")
        .when(~F.col("has_header"), "parser yielded fight without header")
        .when(F.col("collides"), F.concat(F.lit("The content is already analyzed as fight "), F.col("fight_id")))
    )
    done = error.isNull()
    return first.select(
        "upload_id", "fight_id", "ignored_fights", F.when(done, "completed").otherwise("failed").alias("status"),
        error.alias("error_message"), F.when(done, F.lit(parser_version)).alias("parser_version"),
    )


def saved_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per (fight, key): the first seen."""
    columns = [c for c in rows.columns if c not in ("fight_id", key)]
    first = rows.groupBy("fight_id", key).agg(F.min_by(F.struct(*columns), order).alias("r"))
    return first.select("fight_id", key, "r.*")


def backfill(fights: DataFrame, summaries: DataFrame, agents: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rows for fights lacking summaries: rebuilt ones, zero rows for the players of event-less fights.

    ``rebuilt`` holds recomputed contributions; ``fights`` carries ``has_events``.
    """
    lacking = fights.join(summaries.select("fight_id").distinct(), "fight_id", "left_anti").select("fight_id", "has_events")
    values = [c for c in rebuilt.columns if c.startswith("total_")]
    full = rebuilt.join(lacking.filter("has_events"), "fight_id", "left_semi").select("fight_id", "account_name", *values)
    empty = agents.join(lacking.filter("not has_events"), "fight_id", "left_semi").select("fight_id", "account_name").distinct()
    return full.unionByName(empty.withColumns({v: F.lit(0).cast("bigint") for v in values}))


def backfill_counts(fights: DataFrame, summaries: DataFrame, agents: DataFrame) -> DataFrame:
    """(backfilled, skipped) fights: skipped are those without any player account."""
    lacking = fights.join(summaries.select("fight_id").distinct(), "fight_id", "left_anti")
    known = agents.filter("account_name is not null").select("fight_id").distinct().withColumn("_p", F.lit(True))
    rows = lacking.join(known, "fight_id", "left")
    return rows.agg(count_where(F.col("_p").isNotNull()).alias("backfilled"), count_where(F.col("_p").isNull()).alias("skipped"))


# -- sweeps ------------------------------------------------------------------------
def sweep_stuck(uploads: DataFrame, now: Column, threshold_s: int) -> DataFrame:
    """Pending uploads older than the threshold become failed, with a message."""
    stuck = (F.col("status") == "pending") & (F.col("uploaded_at") < now - F.make_dt_interval(secs=F.lit(threshold_s)))
    message = STUCK_MESSAGE.format(seconds=threshold_s)
    return uploads.withColumns(
        {
            "error_message": F.when(stuck, message).otherwise(F.col("error_message")),
            "status": F.when(stuck, "failed").otherwise(F.col("status")),
        }
    )


def expired_failures(uploads: DataFrame, fights: DataFrame, now: Column, retention_days: int, prefix: str) -> DataFrame:
    """All expired failed uploads without a dependent fight."""
    old = (F.col("status") == "failed") & (F.col("uploaded_at") < now - F.make_dt_interval(days=F.lit(retention_days)))
    rows = uploads.filter(old & F.col("error_message").startswith(prefix))
    return rows.join(fights.select(F.col("upload_id").alias("id")), "id", "left_anti")


def without(rows: DataFrame, removed: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(removed.select(key), key, "left_anti")


# -- deliveries ----------------------------------------------------------------------
def filter_kind(document: Column) -> Column:
    return F.get_json_object(document, "$.kind")


def upload_payload() -> Column:
    """Compact JSON body of a completed upload."""
    return F.to_json(
        F.struct(F.lit("upload_completed").alias("kind"), F.col("id").cast("string").alias("upload_id"), F.col("fight_id"), F.col("sha256"))
    )


def matched_subscriptions(uploads: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Delivery requests: completed uploads for every live subscription of their kind."""
    done = uploads.filter("status = 'completed'").withColumn("_kind", F.lit("upload_completed"))
    live = subscriptions.filter("revoked_at is null").select(F.col("id").alias("subscription_id"), filter_kind(F.col("filter")).alias("_kind"))
    return done.join(live, "_kind").drop("_kind")


def due_retries(deliveries: DataFrame, now: Column) -> DataFrame:
    return deliveries.filter(
        (F.col("attempt") < MAX_ATTEMPTS)
        & F.col("delivered_at").isNull()
        & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))
        & (F.col("status_code").isNull() | (F.col("status_code") >= 300))
    )


def next_attempt_at(now: Column, attempt: Column) -> Column:
    wait = F.when(attempt == 1, BACKOFF_S[1]).when(attempt == 2, BACKOFF_S[2]).otherwise(BACKOFF_S[3])
    return now + F.make_dt_interval(secs=wait)


def exhausted(deliveries: DataFrame) -> Column:
    return (F.col("attempt") >= MAX_ATTEMPTS) & F.col("delivered_at").isNull()


def dead_letters(deliveries: DataFrame, now: Column) -> DataFrame:
    rows = deliveries.filter(exhausted(deliveries))
    return rows.select("id", "subscription_id", "upload_id", "payload", F.col("error").alias("last_error"), now.alias("moved_to_dlq_at"))


def remaining_deliveries(deliveries: DataFrame) -> DataFrame:
    return deliveries.filter(~exhausted(deliveries))


def apply_outcomes(deliveries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Status, error and delivery time replaced for the ids that have an outcome."""
    changed = outcomes.select("id", F.struct("status_code", "error", "delivered_at").alias("_o"))
    rows = deliveries.join(changed, "id", "left")
    picked = {c: F.when(F.col("_o").isNotNull(), F.col(f"_o.{c}")).otherwise(F.col(c)) for c in ("status_code", "error", "delivered_at")}
    return rows.withColumns(picked).drop("_o")


def replayed(dlq: DataFrame, ids: DataFrame, subscriptions: DataFrame, uploads: DataFrame, now: Column) -> DataFrame:
    """New deliveries for replayed dead letters whose subscription is live and whose upload exists."""
    rows = dlq.join(ids.select("id"), "id", "left_semi")
    rows = rows.join(subscriptions.filter("revoked_at is null").select(F.col("id").alias("subscription_id")), "subscription_id", "left_semi")
    rows = rows.join(uploads.select(F.col("id").alias("upload_id")), "upload_id", "left_semi")
    return rows.select(
        "id", "subscription_id", "upload_id", "payload", F.lit(1).alias("attempt"), now.alias("next_attempt_at")
    )


# -- latency ---------------------------------------------------------------------------
def latency_histogram(durations: DataFrame, label: str, value: str, bounds: list[float] = DURATION_BOUNDS) -> DataFrame:
    """Cumulative counts per fixed bound and label, in long form; the last bound is infinity."""
    cumulative = [count_where(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    rows = durations.groupBy(label).agg(*cumulative, F.count(F.lit(1)).alias("total"))
    entries = [F.struct(F.lit(float(b)).alias("bound"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(bounds)]
    entries.append(F.struct(F.lit(float("inf")).alias("bound"), F.col("total").alias("cumulative")))
    return rows.select(label, "total", F.inline(F.array(*entries)))


def histogram_quantiles(histogram: DataFrame, label: str, quantiles: list[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Quantiles interpolated inside the bucket that holds the rank (a label has one row per bound)."""
    buckets = histogram.groupBy(label, "total").agg(F.sort_array(F.collect_list(F.struct("bound", "cumulative"))).alias("bs"))
    out = [label]
    for q in quantiles:
        rank = F.col("total") * q
        at = F.array_min(F.filter("bs", lambda b: b["cumulative"] >= rank))
        below = F.array_max(F.filter("bs", lambda b: b["cumulative"] < rank))
        low, low_n = F.coalesce(below["bound"], F.lit(0.0)), F.coalesce(below["cumulative"], F.lit(0))
        inside = low + (at["bound"] - low) * (rank - low_n) / (at["cumulative"] - low_n)
        value = F.when(at["bound"] == float("inf"), low).otherwise(inside)
        out.append(value.alias(f"p{int(q * 100)}"))
    return buckets.select(*out)


def five_minute_rates(rows: DataFrame, time: str, label: str) -> DataFrame:
    per = rows.groupBy(F.window(time, "5 minutes").alias("w"), label).agg(F.count(F.lit(1)).alias("n"))
    return per.select(F.col("w.start").alias("window_start"), label, "n", (F.col("n") / 300.0).alias("per_second"))


def world_of_accounts(accounts: DataFrame, worlds: DataFrame) -> DataFrame:
    return accounts.join(worlds.select(F.col("id").alias("world_id"), F.col("name").alias("world_name"), "population"), "world_id", "left")
