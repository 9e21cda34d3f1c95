"""Streams with state: timers, lifetimes, partial states, merged stores, late rows."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from frayline.operators import ops, records, rollups, summaries
from frayline.streaming import live, sweeps
from frayline.streaming.partials import LiveSummaries
from frayline.streaming.store import BatchStore
from tests.rows import boon, event_frame, hit, state
from tests.test_files_and_streams import write_stream

UPLOADS = "id BIGINT, uploaded_at TIMESTAMP, status STRING, error_message STRING, at TIMESTAMP"
ANSWERS = "id BIGINT, attempt INT, status_code INT, error STRING, at TIMESTAMP"
DELIVERIES = (
    "id BIGINT, subscription_id BIGINT, upload_id BIGINT, payload BINARY, attempt INT, status_code INT, error STRING, "
    "delivered_at TIMESTAMP, next_attempt_at TIMESTAMP, at TIMESTAMP"
)


def at(seconds):
    return f"2026-01-01 {seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"


def rows_of(spark, rows, ddl):
    """Rows whose timestamps are given as text."""
    text = ddl.replace("TIMESTAMP", "STRING")
    df = spark.createDataFrame(rows, text)
    return df.select(*[F.col(f.name).cast(f.dataType) for f in spark.createDataFrame([], ddl).schema])


def append(spark, rows, ddl, path):
    rows_of(spark, rows, ddl).coalesce(1).write.mode("append").parquet(path)


def source(spark, path, ddl):
    spark.createDataFrame([], ddl).write.mode("append").parquet(path)
    return spark.readStream.schema(ddl).parquet(path)


def test_uploads_grow_stale_after_their_batch(spark, tmp_path):
    path, work = str(tmp_path / "in"), str(tmp_path / "work")
    data = [(1, at(0), "pending", None), (2, at(100), "pending", None), (3, at(10), "completed", None), (4, at(20), "pending", None), (5, at(0), "pending", None)]

    def run(*rows):
        append(spark, rows, UPLOADS, path)
        live.drain(sweeps.upload_changes(source(spark, path, UPLOADS).withWatermark("at", "0 seconds"), 60, sweeps.EVENT), work)
        found = sweeps.newest_status(spark.read.parquet(f"{work}/rows"))
        return {r.id: r.status for r in found.collect() if r.id < 9}

    def swept(now, signals=()):
        known = {i: (i, u, s, None) for i, u, s, _ in data} | {i: (i, at(0), s, None) for i, s in signals}
        df = rows_of(spark, [v for v in known.values()], "id BIGINT, uploaded_at TIMESTAMP, status STRING, error_message STRING")
        return {r.id: r.status for r in ops.sweep_stuck(df, F.lit(now).cast("timestamp"), 60).collect()}

    tick = lambda s: (9, at(s), "completed", None, at(s))
    assert run(*[(*r, r[1] if r[0] != 5 else at(30)) for r in data if r[0] != 2]) | {2: "pending"} == swept(at(30))
    assert run((*data[1], at(100)), (4, at(20), "completed", None, at(70))) == swept(at(100), [(4, "completed")])  # the others fail by the clock alone
    assert run(tick(160)) == swept(at(160), [(4, "completed")])  # 60 seconds old is not yet older than 60 seconds
    assert run(tick(161)) == swept(at(161), [(4, "completed")]) == {1: "failed", 2: "failed", 3: "completed", 4: "completed", 5: "failed"}
    messages = {r.error_message for r in sweeps.newest_status(spark.read.parquet(f"{work}/rows")).collect() if r.status == "failed"}
    assert messages == {ops.STUCK_MESSAGE.format(seconds=60)}


def test_the_wall_clock_alone_fails_uploads_and_moves_deliveries(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    now = spark.range(1).select(F.current_timestamp().cast("string")).first()[0]
    append(spark, [(1, now, "pending", None, now), (2, now, "completed", None, now)], UPLOADS, str(tmp_path / "u"))
    append(spark, [(7, 1, 1, b"x", 2, 500, "HTTP 500", None, None, now), (8, 1, 1, b"y", 3, None, "gone", None, None, now)], DELIVERIES, str(tmp_path / "d"))
    uploads = sweeps.upload_changes(source(spark, str(tmp_path / "u"), UPLOADS), 2)
    deliveries = sweeps.delivery_changes(sweeps.delivery_rows(source(spark, str(tmp_path / "d"), DELIVERIES)), 1)
    queries = [live.started(df, str(tmp_path / n), processingTime="1 second") for df, n in ((uploads, "uw"), (deliveries, "dw"))]
    try:
        read = lambda n: [r for r in spark.read.schema(sweeps.UPLOAD_CHANGES if n == "uw" else sweeps.DELIVERY_CHANGES).parquet(f"{tmp_path}/{n}/rows").collect()]
        end = time.time() + 90
        while time.time() < end and not ((tmp_path / "uw" / "rows").exists() and (tmp_path / "dw" / "rows").exists() and any(r.status == "failed" for r in read("uw")) and sum(r.change == "dead" for r in read("dw")) == 2):
            time.sleep(1)
    finally:
        for q in queries:
            q.stop()
    assert [(r.id, r.status) for r in sorted(read("uw"), key=lambda r: (r.id, r.changed_ms))] == [(1, "pending"), (1, "failed"), (2, "completed")]
    course = [(r.id, r.change, r.attempt, r.error) for r in sorted(read("dw"), key=lambda r: (r.id, r.at_ms))]
    assert course == [(7, "retry", 3, "HTTP 500"), (7, "dead", 3, sweeps.TIMEOUT_ERROR.format(seconds=1)), (8, "dead", 3, "gone")]


def test_answers_end_or_prolong_a_delivery(spark, tmp_path):
    work, rows, answers = str(tmp_path / "work"), str(tmp_path / "d"), str(tmp_path / "a")
    append(spark, [
        (1, 1, 1, b"a", 0, None, None, None, None, at(0)), (2, 1, 1, b"b", 1, 500, "HTTP 500", None, at(5), at(0)), (3, 1, 1, b"c", 0, 200, None, at(0), None, at(0)),
        (4, 1, 1, b"d", 1, 204, None, None, None, at(0)), (5, 1, 1, b"e", 2, 301, None, None, None, at(0)),
    ], DELIVERIES, rows)

    def run(*given):
        append(spark, given, ANSWERS, answers)
        stream = sweeps.delivery_rows(source(spark, rows, DELIVERIES)).unionByName(sweeps.answer_rows(source(spark, answers, ANSWERS)))
        live.drain(sweeps.delivery_changes(stream.withWatermark("at", "0 seconds"), 60, sweeps.EVENT), work)
        return {(r.id, r.change, r.attempt, r.error, r.at_ms // 1000 % 86_400) for r in spark.read.parquet(f"{work}/rows").collect()}

    seen = run()
    assert seen == {(1, "retry", 1, None, 0), (3, "delivered", 0, None, 0), (5, "retry", 3, None, 0)}
    new = run((1, 1, 500, "HTTP 500", at(2)), (5, 3, 500, "HTTP 500", at(3)), (1, 9, 200, None, at(3)), (77, 1, 200, None, at(4))) - seen
    assert new == {(1, "retry", 2, "HTTP 500", 4), (5, "dead", 3, "HTTP 500", 3)}  # the wait of a second has passed at the batch's clock
    seen |= new
    new = run((1, 2, 200, None, at(20))) - seen
    assert new == {(1, "delivered", 2, None, 20), (2, "retry", 2, "HTTP 500", 20)}
    seen |= new
    assert run((2, 2, 503, "HTTP 503", at(30))) - seen == set()  # ten seconds to wait
    new = run((99, 1, 200, None, at(41))) - seen
    assert new == {(2, "retry", 3, "HTTP 503", 41)}
    assert run((99, 1, 200, None, at(200))) - seen - new == {(2, "dead", 3, sweeps.TIMEOUT_ERROR.format(seconds=60), 200)}


def test_stack_state_goes_with_the_fight_and_late_rows_are_counted(spark, tmp_path):
    path, work, hour = str(tmp_path / "in"), str(tmp_path / "work"), 3_600_000
    total = lambda q: [s for p in q.recentProgress for s in p.stateOperators]

    def run(events, day="2026-01-01"):
        write_stream(spark, events, path, day)
        return live.drain(live.live_stack_history(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)), work)

    rows = [boon(t * hour, 1, t % 3, 740, stacks=t, kind=("apply", "apply", "remove_single")[t % 2]) for t in range(12)]
    first = run(rows[:8])
    assert total(first)[-1].numRowsTotal > 0
    second = run([rows[0], *rows[8:]])  # the repeated row is behind the watermark
    assert sum(s.numRowsDroppedByWatermark for s in total(second)) == 1
    last = run([boon(2 * hour, 1, 99, 740, stacks=1)], "2026-01-03")
    kept = total(last)[-1].numRowsTotal
    assert kept <= 4  # nothing of the first fight: level, waiting row and timer of the one row after it
    got = sorted((r.agent_id, r.time_ms, r.stacks) for r in spark.read.parquet(f"{work}/rows").collect())
    want, level = [], {}
    for t in range(12):
        a = t % 3
        level[a] = level.get(a, 0) + t  # every row applies: only even positions do
        want.append((a, t * hour, level[a]))
    assert got == sorted(want)


def live_states(spark, tmp_path, batches, skills, compact=None):
    states = LiveSummaries(spark, str(tmp_path / "states"))
    for i, rows in enumerate(batches):
        states.put(event_frame(spark, rows), skills, i)
        if i == compact:
            states.compact(i)
    return states


@pytest.mark.parametrize("compact", [None, 0, 1])
def test_partial_states_over_batches_and_replays_equal_the_batch(spark, tmp_path, compact):
    rng = random.Random(compact)
    rows = []
    for t in range(240):
        who, whom, when = rng.randrange(4), rng.randrange(5), rng.randrange(400_000)
        rows += [rng.choice([
            hit(when, who, whom, t, skill=rng.choice([1, 2])), boon(when, who, whom, rng.choice([740, 50001]), kind=rng.choice(["apply", "remove_single"])),
            state(when, "DOWN", who, downtime_ms=rng.choice([-5, 70])), state(when, "CC", who, cc_value=3), state(when, "HEALING", who, healing=9),
            state(when, "BUFF_REMOVAL", who, buff_removal=2, buff_id=rng.choice([736, 740])),
        ])]
    rows = [r | {"seq": i, "fight_id": f"f{i % 2}"} for i, r in enumerate(rows)]
    skills = spark.createDataFrame([(1, "Burning"), (2, "Axe")], "skill_id BIGINT, skill_name STRING")
    players = spark.createDataFrame([(f, a, f"n{a}", f"acc{a // 2}", 1, 2) for f in ("f0", "f1") for a in range(4)], "fight_id STRING, agent_id BIGINT, name STRING, account_name STRING, profession INT, elite INT")
    states = live_states(spark, tmp_path, [rows[:90], rows[90:100], rows[100:]], skills, compact)
    for i in (0, 1, 2):  # replays, of merged batches too
        states.put(event_frame(spark, [rows[:90], rows[90:100], rows[100:]][i]), skills, i)
    everything = event_frame(spark, rows)
    text = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert text(states.counters()) == text(rollups.combat_counters(everything))
    seconds = records.fight_durations(everything)
    assert text(states.durations()) == text(seconds) and text(states.event_spans()) == text(records.event_spans(everything))
    assert text(states.presence_pct(players)) == text(rollups.presence(everything, players, seconds))
    assert text(states.account_buckets(players)) == text(summaries.account_buckets(everything, players, skills))


def files_read(df):
    """Files the scans of a finished query have opened."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node = node.executedPlan()
        if node.metrics().contains("numFiles"):
            found += node.metrics().apply("numFiles").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_what_a_batch_reads_does_not_grow_with_the_store(spark, tmp_path):
    path = str(tmp_path / "hashes")
    sink = live.ingest_batch(path, compact_every=4)
    sha = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    batch = lambda n: spark.createDataFrame([(sha(i),) for i in range(n * 40, n * 40 + 60)], "sha256 STRING").coalesce(1)  # noqa: E731  20 of them come again
    opened = {}
    for n in range(10):
        sink(batch(n), n)
        store = live.hash_store(spark, path)
        prefixes = [sha(n * 40 + 5)[:2], sha(n * 40 + 6)[:2]]
        opened[n] = files_read(store.stored(prefixes, before=n + 1))
    sink(batch(9), 9)
    assert sorted(r.sha256 for r in store.rows().collect()) == sorted({sha(i) for i in range(420)}) and store.stored().count() == 420
    assert store.mark() == 7 and opened[9] <= 2 * 5 and max(opened.values()) <= 2 * 5  # merged folder and at most four batches, for two prefixes


def test_a_store_merges_and_takes_replays(spark, tmp_path):
    store = BatchStore(spark, str(tmp_path / "s"), "k STRING, n BIGINT", lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n")))
    df = lambda *rows: spark.createDataFrame(rows, "k STRING, n BIGINT")
    read = lambda: sorted(tuple(r) for r in store.rows().collect())
    assert read() == []
    store.put(df(("a", 1)), 0)
    store.put(df(("a", 2), ("b", 5)), 1)
    store.put(df(("a", 2), ("b", 5)), 1)
    assert read() == [("a", 3), ("b", 5)]
    store.compact(1)
    store.compact(1)
    store.put(df(("a", 2), ("b", 5)), 1)  # merged already
    store.put(df(("a", 10)), 2)
    assert read() == [("a", 13), ("b", 5)]
    store.compact(2)
    assert read() == [("a", 13), ("b", 5)] and store.mark() == 2


def test_late_rows_by_window_over_three_files(spark, tmp_path):
    path, hour = str(tmp_path / "in"), 3_600_000
    files = [[hit(0, 1, 9, 1), hit(5 * hour, 1, 9, 2)], [hit(10, 1, 9, 4), hit(20, 1, 9, 8), hit(5 * hour + 9, 1, 9, 16), hit(8 * hour, 1, 9, 32)], [hit(30, 1, 9, 64), hit(6 * hour, 1, 9, 128), hit(8 * hour + 1, 1, 9, 256)]]
    dropped = 0
    for events in files:
        write_stream(spark, events, path)
        stream = lambda: spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
        live.drain(stream(), str(tmp_path / "l"), live.late_ledger(str(tmp_path / "ledger")))
        query = live.drain(live.live_timeline(stream()), str(tmp_path / "t"), live.batch_sink(str(tmp_path / "w")), "update")
        dropped += live.late_rows(query)
    found = {(r.window_start.hour, r.late_rows) for r in live.late_windows(spark, str(tmp_path / "ledger")).collect()}
    assert found == {(0, 3), (6, 1)}
    ddl = "fight_id STRING, window_start TIMESTAMP, event_count BIGINT, total_damage BIGINT, total_healing BIGINT, total_buff_removal BIGINT"
    kept = live.newest_rows(live.batch_table(spark, str(tmp_path / "w"), ddl), ["fight_id", "window_start"]).agg(F.sum("event_count")).first()[0]
    assert kept + 4 == sum(map(len, files)) and dropped == 3  # Spark counts a batch's late rows of one window once
    sink = live.late_ledger(str(tmp_path / "ledger"))
    sink(spark.read.parquet(path).filter("damage >= 64"), 2)  # a replay counts nothing twice
    assert {(r.window_start.hour, r.late_rows) for r in live.late_windows(spark, str(tmp_path / "ledger")).collect()} == found
