"""Boon columns and tallies whose rows grew with the boons or the events instead of the agents."""

from pyspark.sql import functions as F

from frayline.functions import lookups as L
from frayline.operators import buffs, readout, summaries
from tests.rows import boon, event_frame, hit, state
from tests.test_sizes_r03 import _join_rows

MIGHT, QUICKNESS = 740, 1187


def _ends(spark):
    return spark.createDataFrame([("f1", 1000, 1000)], "fight_id STRING, end_ms BIGINT, length_ms BIGINT")


def test_agents_are_not_repeated_for_every_boon(spark):
    events = event_frame(spark, [boon(0, 1, 2, QUICKNESS, 500), boon(0, 1, 3, MIGHT, 1000, stacks=2)])
    segments = buffs.stack_segments(buffs.stack_events(events), _ends(spark), 50)
    agents = spark.createDataFrame([("f1", a) for a in range(100)], "fight_id STRING, agent_id BIGINT")
    found = buffs.boon_uptimes(segments, agents, _ends(spark))
    rows = {(r.agent_id, r.boon): r.uptime for r in found.collect()}
    assert len(rows) == 100 * len(L.TRACKED_BOONS)
    assert {k: v for k, v in rows.items() if v} == {(2, "quickness"): 50.0, (3, "might"): 2.0}
    assert max(_join_rows(found)) <= 100  # 1,400 before


def test_summaries_of_accounts_with_idle_agents(spark):
    # agents 2 and 3 are one account: 2 only receives; 4 is idle beside 5, who hits; 6 alone is idle and has no row
    events = event_frame(spark, [
        boon(0, 3, 2, QUICKNESS, 500), boon(0, 3, 3, MIGHT, 1000), hit(10, 5, 9, 7, skill=5), state(20, "HEALING", 5, healing=30), state(1000, "CC", 9, target_agent_id=5),
    ])
    names = [(2, "a", "two"), (3, "a", "three"), (4, "b", "four"), (5, "b", "five"), (6, "c", "six")]
    players = spark.createDataFrame([("f1", i, acc, n, 1, i) for i, acc, n in names], "fight_id STRING, agent_id BIGINT, account_name STRING, name STRING, profession INT, elite INT")
    skills = spark.createDataFrame([(5, "Burning")], "skill_id BIGINT, skill_name STRING")
    segments = buffs.stack_segments(buffs.stack_events(events), _ends(spark), 50)
    accounts = summaries.account_summaries(buffs.with_uptimes(players, segments, _ends(spark)), summaries.agent_buckets(events, skills))
    seconds = spark.createDataFrame([("f1", 1.0)], "fight_id STRING, duration_s DOUBLE")
    found = summaries.fight_player_summaries(accounts, seconds)
    rows = {r.account_name: r for r in found.collect()}
    a, b = rows["a"], rows["b"]
    assert sorted(rows) == ["a", "b"]
    assert (a.name, a.quickness_uptime, a.might_uptime, a.fury_uptime, a.outgoing_quickness, a.outgoing_might) == ("two", 25.0, 0.5, 0.0, 500, None)
    assert (b.name, b.elite, b.total_damage, b.condi_damage, b.total_healing, b.quickness_uptime, b.outgoing_quickness) == ("five", 5, 7, 7, 30, 0.0, None)
    assert "Heal" in b.roles and "Heal" not in a.roles
    assert max(_join_rows(found)) <= 6  # rows by agent and skill; every agent came once for each of 14 boons before
    long = summaries.long_boons(accounts).filter(F.col("account_name") == "a")
    assert long.count() == len(L.TRACKED_BOONS)


def test_seen_buckets_are_bits_of_few_rows(spark):
    events = event_frame(spark, [hit(t * 5000, 1, 2, 5) for t in range(200)] + [hit(0, 1, 2, 5), hit(199 * 5000 + 4999, 1, 1, 5)])
    tallied = readout.tallies(events)
    assert tallied.filter("metric = 'seen'").count() == 2 * 4  # a row for each of 400 buckets before
    skills = spark.createDataFrame([(5, "Burning")], "skill_id BIGINT, skill_name STRING")
    assert {r.agent_id: r.active_buckets for r in readout.agent_columns(tallied, skills).collect()} == {1: 200, 2: 200}
