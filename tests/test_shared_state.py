"""Steps whose cost must not follow the number of ids or the few addresses of rules."""

from pyspark.sql import functions as F

from frayline.operators import reconcile
from frayline.streaming import live, sweeps
from tests.test_live_state import DELIVERIES, append, at, source


def test_ids_share_state_and_keep_their_own_course(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sweeps, "GROUPS", 3, raising=False)
    big = 2**60
    rows = [(big + i, big + 1, 7, b"x", i % 3, None, None, None, at(10 * (i % 2)), at(0)) for i in range(90)]
    append(spark, rows, DELIVERIES, str(tmp_path / "d"))
    stream = sweeps.delivery_rows(source(spark, str(tmp_path / "d"), DELIVERIES)).withWatermark("at", "0 seconds")
    query = live.drain(sweeps.delivery_changes(stream, 60, sweeps.EVENT), str(tmp_path / "work"))
    kept = max(s.numRowsTotal for p in query.recentProgress for s in p.stateOperators)
    assert kept <= 9  # a value and the timers of three groups, not of ninety ids
    got = {(r.id, r.subscription_id, bytes(r.payload), r.change, r.attempt) for r in spark.read.parquet(f"{tmp_path}/work/rows").collect()}
    assert got == {(big + i, big + 1, b"x", "retry", i % 3 + 1) for i in range(0, 90, 2)}


def test_rules_meet_fails_by_shares(spark):
    fails = spark.range(500).selectExpr(
        "'s' AS stem", "cast(id AS string) AS key", "'a' AS account", "'b' AS bucket", "'1' AS skill_id", "'FAIL' AS status", "cast(id AS double) AS delta"
    )
    rules = spark.createDataFrame(
        [(2, "any", None, None, None, None, None, None, "r"), (1, "near", None, None, None, None, "1", 9.0, "r")],
        "ord INT, rule_id STRING, sel_stem STRING, sel_key STRING, sel_account STRING, sel_bucket STRING, sel_skill_id STRING, max_abs_delta DOUBLE, reason STRING",
    )
    found = reconcile.classify_known(fails, rules, [["skill_id"], []])
    assert {(r.rule_id, r["count"]) for r in found.groupBy("rule_id").count().collect()} == {("near", 10), ("any", 490)}
    assert found.filter(F.col("status") != "KNOWN_DELTA").count() == 0
    assert "_share" in found._jdf.queryExecution().optimizedPlan().toString()
