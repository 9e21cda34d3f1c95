import pytest
from pyspark.sql import functions as F

from frayline.functions import combat, names
from frayline.operators import profiles, quality, rollups, timelines
from tests.rows import boon, event_frame, hit, state


def seconds(spark, s):
    return spark.createDataFrame([("f1", s)], "fight_id STRING, duration_s DOUBLE")


def agents(spark, rows):
    ddl = "fight_id STRING, agent_id BIGINT, name STRING, is_player BOOLEAN, account_name STRING, subgroup STRING, profession INT, elite INT"
    return spark.createDataFrame([("f1", *r) for r in rows], ddl)


PLAYERS = [(1, "A", True, "a.1", "1", 1, 62), (2, "B", True, "b.2", None, 2, 0), (9, "Npc", False, None, None, 0, 0)]


def test_target_damage_totals_order_and_null_name(spark):
    df = event_frame(spark, [hit(0, 1, 9, 10), hit(1, 2, 9, 5), hit(2, 1, 8, 15)])
    rows = rollups.ordered(rollups.target_damage(df, seconds(spark, 5.0), agents(spark, PLAYERS)), "total_damage", "target_agent_id").collect()
    assert [(r.target_agent_id, r.total_damage, r.hit_count, r.dps, r.name) for r in rows] == [(8, 15, 1, 3.0, None), (9, 15, 2, 3.0, "Npc")]


@pytest.mark.parametrize("s,expected", [(0.0, 0.0), (None, 0.0)])
def test_zero_or_missing_duration_gives_rate_zero(spark, s, expected):
    df = event_frame(spark, [hit(0, 1, 9, 10)])
    assert rollups.target_damage(df, seconds(spark, s)).first().dps == expected


def test_negative_duration_is_an_error_and_empty_stays_empty(spark):
    with pytest.raises(Exception, match="duration"):
        rollups.target_damage(event_frame(spark, [hit(0, 1, 9, 10)]), seconds(spark, -1.0)).collect()
    assert rollups.target_damage(event_frame(spark, []), seconds(spark, 1.0)).count() == 0


def test_stun_break_only_source_has_heal_count_one(spark):
    df = event_frame(spark, [state(0, "STUN_BREAK", 1)])
    row = rollups.player_healing(df, seconds(spark, 1.0)).first()
    assert (row.total_healing, row.heal_count, row.stun_breaks) == (0, 1, 1)


def test_boons_fixed_columns_and_map(spark):
    df = event_frame(spark, [boon(0, 1, 2, 1122), boon(1, 1, 1, 743), boon(2, 1, 2, 5), boon(3, 1, 2, 6), boon(4, 1, 2, 6), boon(5, 1, 2, 1122, kind="remove_all")])
    rows = {r.agent_id: r for r in rollups.player_boons(df, seconds(spark, 10.0)).collect()}
    assert (rows[1].boons_out, rows[1].boons_in, rows[1].stability_out, rows[1].aegis_out) == (5, 1, 1, 1)
    assert (rows[2].boons_in, rows[2].boons_out_rate) == (4, 0.0)
    named = spark.createDataFrame([(5, "Fury")], "skill_id BIGINT, skill_name STRING")
    assert rollups.other_boons(df, named).first().other_boons_out == {"Fury": 1, "Unknown (6)": 2}


def test_squad_keeps_unmapped_sources(spark):
    df = event_frame(spark, [hit(0, 1, 9, 10), hit(0, 2, 9, 5), hit(0, 77, 9, 1)])
    rows = {r.subgroup: r.total_damage for r in rollups.squad_rollup(df, agents(spark, PLAYERS), seconds(spark, 1.0)).collect()}
    assert rows == {"1": 10, "": 6}


def test_kill_participation_and_presence(spark):
    df = event_frame(spark, [hit(0, 1, 9, 1), hit(1, 1, 9, 1), hit(2, 2, 9, 1), state(3, "DEATH", 9), state(6000, "DEATH", 9)])
    assert {r.agent_id: r.kill_participation for r in rollups.kill_participation(df).collect()} == {1: 2, 2: 2}
    players = agents(spark, PLAYERS).filter("is_player")
    got = {r.agent_id: r.presence_pct for r in rollups.presence(df, players, seconds(spark, 10.0)).collect()}
    assert got == {1: 50.0, 2: 50.0}


def test_windows_fill_gaps_and_respect_edges(spark):
    df = event_frame(spark, [hit(0, 1, 9, 1), hit(4999, 1, 9, 2), hit(5000, 1, 9, 4), hit(16000, 1, 9, 8)])
    rows = timelines.event_windows(df, 5).orderBy("bucket").collect()
    assert [(r.start_ms, r.end_ms, r.total_damage, r.event_count) for r in rows] == [(0, 5000, 3, 2), (5000, 10000, 4, 1), (10000, 15000, 0, 0), (15000, 20000, 8, 1)]
    assert quality.bucket_gaps(timelines.event_windows(df, 5), ["fight_id"]).count() == 0
    assert timelines.event_windows(df, 1).count() == 17  # reported, not refused
    assert [tuple(r) for r in timelines.oversized(df, 1, 10).collect()] == [("f1", 17)] and timelines.oversized(df, 1, 17).count() == 0
    with pytest.raises(ValueError):
        timelines.event_windows(df, 0)


def test_local_days_and_zone_shift(spark):
    ddl = "account_name STRING, fight_id STRING, started_at TIMESTAMP, name STRING, total_damage BIGINT, total_healing BIGINT, total_buff_removal BIGINT"
    df = spark.createDataFrame([("a", "f1", None, "x", 1, 0, 0), ("a", "f2", None, "x", 2, 0, 0)], ddl)
    df = df.withColumn("started_at", F.when(F.col("fight_id") == "f1", F.lit("2026-01-02 03:00:00")).otherwise(F.lit("2026-01-02 12:00:00")).cast("timestamp"))
    assert timelines.day_points(df, "UTC").select("total_damage", "fight_id").collect() == [(3, "f2")]
    rows = timelines.day_points(df, "America/New_York").withColumn("s", F.date_format("started_at", "yyyy-MM-dd HH:mm")).orderBy("local_day").collect()
    assert [(str(r.local_day), r.total_damage, r.s) for r in rows] == [("2026-01-01", 1, "2026-01-01 05:00"), ("2026-01-02", 2, "2026-01-02 05:00")]


def test_requested_accounts_rules(spark):
    assert [r.account_name for r in timelines.requested_accounts(spark, ["b", ":a", "b"]).orderBy("position").collect()] == ["b", "a"]
    for bad in (["a"], ["a", ":a"], list("abcde")):
        with pytest.raises(ValueError):
            timelines.requested_accounts(spark, bad)


def test_modal_value_and_full_keyset_walk(spark):
    rows = [("a", 1), ("a", 2), ("a", 2), ("b", 3), ("b", 1)]
    df = spark.createDataFrame(rows, "account_name STRING, profession INT")
    assert {r[0]: r[1] for r in profiles.modal_value(df, "account_name", "profession").collect()} == {"a": 2, "b": 1}
    data = [(f"p.{i:02d}", i % 5) for i in range(23)]
    listing = spark.createDataFrame(data, "account_name STRING, total_damage BIGINT")
    seen, cursor = [], None
    while True:
        found = profiles.keyset_page(listing, 4, cursor).collect()
        seen += [(r.account_name, r.total_damage) for r in found[:4]]
        if len(found) <= 4:
            break
        cursor = found[3].next_cursor
    assert seen == sorted(data, key=lambda r: (-r[1], r[0]))
    assert profiles.decode_cursor("garbage") is None and profiles.decode_cursor(None) is None


def test_name_and_code_helpers(spark):
    assert names.profession_code("mesmer") == 7 and names.profession_code("7") == 7 and names.profession_code("") is None
    with pytest.raises(ValueError):
        names.profession_code("bard")
    one = spark.range(1)
    assert one.select(names.tick_label(F.lit(1500)), names.tick_label(F.lit(2000)), names.tick_label(F.lit(7))).first()[:] == ("1.5k", "2k", "7")
    assert one.select(names.clock_label(F.lit(125_999)), names.bare_account(F.lit("::a")), names.strip_one_colon(F.lit("::a"))).first()[:] == ("2:05", "a", ":a")
    assert one.select(names.sanitise_name(F.lit("a\x00b")), names.sanitise_name(F.lit(None).cast("string"))).first()[:] == ("ab", "")
    with pytest.raises(Exception, match="negative"):
        one.select(combat.buff_change_kind(F.lit(-1))).collect()


def test_splitting_a_fight_into_files_or_shuffling_it_changes_nothing(spark):
    events = [hit(i * 7 % 500, i % 3, i % 5, i) for i in range(60)]
    a = event_frame(spark, events)
    b = a.repartition(7).orderBy(F.rand(1))
    for op in (lambda d: rollups.target_damage(d, seconds(spark, 3.0)), lambda d: timelines.event_windows(d, 1), rollups.combat_counters):
        assert sorted(map(str, op(a).collect())) == sorted(map(str, op(b).collect()))
