import gzip
import json

import pytest
from pyspark.sql import functions as F

from frayline.functions import documents
from frayline.operators import ops
from frayline.sources import files
from frayline.streaming import live
from tests.rows import boon, event_frame, hit


def test_event_stream_round_trip_and_quarantine(spark, tmp_path):
    lines = [
        {"fight_id": "f1", "seq": 1, "time_ms": 5, "event_type": "DAMAGE", "source_agent_id": 18446744073709551615, "damage": 7}, {"event_type": "NOPE", "seq": 2},
    ]
    text = "\n".join([json.dumps(lines[0]), "", "  ", json.dumps(lines[1]), "{broken"])
    (tmp_path / "e.jsonl.gz").write_bytes(gzip.compress(text.encode()))
    good, bad = files.split_valid(files.read_event_stream(spark, str(tmp_path / "e.jsonl.gz")))
    row = good.first()
    assert good.count() == 1 and bad.count() == 2 and int(row.source_agent_id) == 2**64 - 1
    assert files.with_defaults(good).first().buff_dmg == 0
    out = str(tmp_path / "out")
    files.write_event_stream(event_frame(spark, [hit(t, 1, 9, t) for t in range(5)]), out)
    assert spark.read.parquet(out).agg(F.sum("damage")).first()[0] == 10


def test_catalogue_skips_bad_lines_later_wins_missing_is_empty(spark, tmp_path):
    path = tmp_path / "skills.jsonl"
    path.write_text('{"id": 1, "name": "old"}\n\n{bad\n{"id": 1, "name": "new", "profession": 7}\n{"id": 2, "name": "x", "is_elite": true, "skill_type": "heal"}\n')
    rows = {r.id: r for r in files.catalogue_view(files.read_catalogue(spark, str(path))).collect()}
    assert (rows[1].name, rows[1].profession, rows[1].is_elite, rows[1].skill_type) == ("new", "MESMER", False, "utility")
    assert rows[2].is_elite and rows[2].profession is None and rows[2].skill_type == "heal"
    assert files.read_catalogue(spark, str(tmp_path / "none")).count() == 0
    stored = spark.read.text(str(path)).select(F.lit("c").alias("catalogue"), F.col("_metadata.file_modification_time").alias("changed"))
    assert files.age_days(stored, ["catalogue"], "changed", F.current_timestamp()).first().age_days < 1


def test_sidecars_validity_lookup_and_merge(spark, tmp_path):
    for i, body in enumerate(['{"players": {"Acc.1": {"healingBySkill": {"5": "10", "6": "x"}}}}', '{"nobody": 1}', "[1]", '{"players": 3}']):
        (tmp_path / f"{i}.json").write_text(body)
    docs = files.read_sidecars(spark, str(tmp_path))
    assert files.sidecar_counts(docs).first()[:] == (4, 3)
    row = docs.filter("valid").select(documents.case_insensitive(F.col("players"), F.lit("ACC.1")).alias("p"))
    row = row.select(
        documents.merge_amounts(F.expr("map('5', 1L, '7', 2L)"), F.col("p.healingBySkill")).alias("m"), documents.skipped_amounts(F.col("p.healingBySkill")).alias("s")
    ).first()
    assert row.m == {"5": 11, "7": 2} and row.s == 1


def test_summary_upsert_replaces_keys_and_leaves_other_fights(spark, tmp_path):
    path = str(tmp_path / "summaries")
    rows = lambda data: spark.createDataFrame(data, "fight_id STRING, account_name STRING, total BIGINT")
    files.upsert_summaries(spark, path, rows([("f1", "a", 1), ("f1", "b", 2), ("f2", "a", 3)]))
    files.upsert_summaries(spark, path, rows([("f1", "a", 10), ("f1", "c", 4)]))
    got = {(r.fight_id, r.account_name): r.total for r in spark.read.parquet(path).collect()}
    assert got == {("f1", "a"): 10, ("f1", "b"): 2, ("f1", "c"): 4, ("f2", "a"): 3}


def test_sweeps(spark):
    ddl = "id BIGINT, status STRING, age INT, error_message STRING"
    data = [(1, "pending", 10, None), (2, "pending", 100, None), (3, "failed", 200, "Duplicate fight: x"), (4, "failed", 200, "other"), (5, "failed", 300, "Duplicate fight: y"), (6, "failed", 300, "Duplicate fight: z")]
    now = F.lit("2026-01-01").cast("timestamp")
    df = spark.createDataFrame(data, ddl).withColumn("uploaded_at", now - F.make_dt_interval(days=F.col("age")))
    swept = {r.id: r.status for r in ops.sweep_stuck(df, now, 50 * 86400).collect()}
    assert swept == {1: "pending", 2: "failed", 3: "failed", 4: "failed", 5: "failed", 6: "failed"}
    fights = spark.createDataFrame([(6,)], "upload_id BIGINT")
    gone = ops.expired_failures(df, fights, now, 90, "Duplicate fight:")
    assert sorted(r.id for r in ops.without(df, gone).collect()) == [1, 2, 4, 6]


def write_stream(spark, events, path, day="2026-01-01"):
    df = event_frame(spark, events).withColumn("fight_id", F.lit(day.replace("-", "")))
    df = df.withColumn("ts", F.timestamp_millis(F.unix_millis(F.lit(day).cast("timestamp")) + F.col("time_ms")))
    df.coalesce(1).write.mode("append").parquet(path)


def test_stream_of_two_batches_equals_batch_and_counts_late_rows(spark, tmp_path):
    source, hour = str(tmp_path / "in"), 3_600_000
    write_stream(spark, [hit(0, 1, 9, 1), hit(hour, 1, 9, 2), hit(5 * hour, 1, 9, 4)], source)
    schema = spark.read.parquet(source).schema
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    work = str(tmp_path / "work")
    live.drain(live.live_timeline(stream()), work)
    write_stream(spark, [hit(10, 1, 9, 100), hit(5 * hour + 1, 1, 9, 8), hit(9 * hour, 1, 9, 16)], source)
    query = live.live_timeline(stream()).writeStream.trigger(availableNow=True).outputMode("append").option("checkpointLocation", f"{work}/progress").format("parquet").option("path", f"{work}/rows").start()
    query.awaitTermination()
    got = sorted((r.window_start.hour, r.total_damage) for r in spark.read.parquet(f"{work}/rows").collect())
    assert got == [(0, 1), (1, 2), (5, 12)]  # the late hit of 100 is gone
    assert live.late_rows(query) == 1


def test_stateful_history_over_unordered_batches(spark, tmp_path):
    source, hour = str(tmp_path / "in"), 3_600_000
    write_stream(spark, [boon(0, 1, 2, 740, stacks=3), boon(2000, 1, 2, 740, stacks=2)], source)
    schema = spark.read.parquet(source).schema
    work = str(tmp_path / "work")
    run = lambda: live.drain(live.live_stack_history(spark.readStream.schema(schema).parquet(source)), work)
    run()
    write_stream(spark, [boon(1000, 1, 2, 740, kind="remove_single", stacks=5), boon(3 * hour, 1, 2, 740, stacks=1), boon(3 * hour, 1, 7, 740, stacks=1)], source)
    run()
    got = sorted((r.time_ms, r.stacks) for r in spark.read.parquet(f"{work}/rows").collect())
    assert got == [(0, 3), (1000, 0), (2000, 2)]


def test_ingest_is_exactly_once_over_replayed_batches(spark, tmp_path):
    sink = live.ingest_batch(str(tmp_path / "u"))
    df = lambda *h: spark.createDataFrame([(x,) for x in h], "sha256 STRING")
    sink(df("a", "b"), 0)
    sink(df("b", "c"), 1)
    sink(df("b", "c"), 1)
    assert sorted(r.sha256 for r in live.hash_store(spark, str(tmp_path / "u")).stored().collect()) == ["a", "b", "c"]


def test_summaries_over_several_and_replayed_batches(spark, tmp_path):
    path = str(tmp_path / "s")
    sink = live.batch_sink(path)
    df = lambda *rows: spark.createDataFrame(rows, "fight_id STRING, account_name STRING, damage BIGINT")
    sink(df(("f", "a", 100), ("f", "b", 1)), 0)
    sink(df(("f", "a", 7)), 1)
    sink(df(("f", "a", 7)), 1)
    got = live.merged_summaries(spark, path, ["fight_id", "account_name"], ["damage"]).collect()
    assert sorted(tuple(r) for r in got) == [("f", "a", 107), ("f", "b", 1)]


def test_open_windows_come_out_with_their_newest_state(spark, tmp_path):
    source, hour = str(tmp_path / "in"), 3_600_000
    write_stream(spark, [hit(0, 1, 9, 1), hit(hour, 1, 9, 2)], source)
    schema, work, path = spark.read.parquet(source).schema, str(tmp_path / "work"), str(tmp_path / "w")
    run = lambda: live.drain(live.live_timeline(spark.readStream.schema(schema).parquet(source)), work, live.batch_sink(path), "update")
    run()
    write_stream(spark, [hit(hour + 1, 1, 9, 8)], source)
    run()
    rows = live.batch_table(spark, path, "fight_id STRING, window_start TIMESTAMP, event_count BIGINT, total_damage BIGINT, total_healing BIGINT, total_buff_removal BIGINT")
    got = sorted((r.window_start.hour, r.total_damage) for r in live.newest_rows(rows, ["fight_id", "window_start"]).collect())
    assert got == [(0, 1), (1, 10)]


def test_content_hash_and_backoff(spark):
    row = spark.range(1).select(ops.content_hash(F.lit(b"x")).alias("h"), (ops.next_attempt_at(F.lit("2026-01-01").cast("timestamp"), F.lit(2)).cast("long") - F.lit("2026-01-01").cast("timestamp").cast("long")).alias("d")).first()
    assert row.d == 10 and len(row.h) == 64


@pytest.mark.parametrize("received,stored,expected", [(["a", "a", "b"], [], ["a", "b"]), (["a"], ["a"], [])])
def test_first_upload_wins(spark, received, stored, expected):
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(received)], "id BIGINT, sha256 STRING").withColumn("uploaded_at", F.lit("2026-01-01").cast("timestamp"))
    kept = spark.createDataFrame([(h,) for h in stored], "sha256 STRING")
    out = ops.new_uploads(rows, kept).orderBy("sha256").collect()
    assert [r.sha256 for r in out] == expected and all(r.status == "pending" for r in out)
    assert [r.id for r in out][:1] in ([0], [])
