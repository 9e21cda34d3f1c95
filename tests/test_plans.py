"""Bounds on plans, and fused forms against the plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from frayline.operators import downs, readout
from frayline.operators.scan import covered_by_any
from frayline.plans import load_queries
from tests.rows import event_frame, hit, state
from tests.test_contract import FOLDER, pytestmark  # noqa: F401

# most scans and hash exchanges of the plan before anything runs
BOUNDS = {"classified_events": (8, 14), "combat_readout": (5, 8), "down_contribution": (6, 10), "complete_rotation": (20, 60), "full_readout": (30, 52)}


@pytest.mark.parametrize("name", sorted(BOUNDS))
def test_initial_plans_stay_small(spark, name):
    plan = load_queries()[name].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    scans, exchanges = plan.count("FileScan parquet"), plan.count("Exchange hashpartitioning")
    assert (scans <= BOUNDS[name][0], exchanges <= BOUNDS[name][1]) == (True, True), (scans, exchanges)


@pytest.mark.parametrize("seed", range(4))
def test_acts_before_downs_equal_the_windows(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(500):
        t, agent = rng.randrange(120), rng.randrange(3)
        rows.append(rng.choice([
            hit(t, 9, agent, 5), hit(t, 9, agent, 5), state(t, "CC", 9, target_agent_id=agent, cc_value=1), state(t, "HEALTH_UPDATE", agent, health_percent=rng.choice([95.0, 90.0, 40.0])),
            state(t, rng.choice(["DOWN", "UP", "DEATH"] if i % 4 == 0 else ["HEALTH_UPDATE"]), agent, health_percent=rng.choice([99.0, 10.0])),
        ]) | {"seq": i})
    events = event_frame(spark, rows)
    for chunk in (16, 1000):
        got = {(r.seq, r.in_window) for r in downs.acts_before_downs(events, chunk).collect()}
        windows = downs.pre_down_windows(events, chunk).withColumnRenamed("agent_id", "target_agent_id")
        acts = events.filter(F.col("event_type").isin("DAMAGE", "CC"))
        want = {(r.seq, r.inside) for r in covered_by_any(acts, windows, ["fight_id", "target_agent_id"], "inside", chunk).collect()}
        assert got == want and {x for _, x in want} == {True, False}


def test_tallies_add_up_over_any_order_of_rows(spark):
    events = event_frame(spark, [
        hit(0, 1, 9, 10, skill=5, shield_damage=3), hit(1, 1, 9, 20, skill=6), hit(2, 2, 9, 1, skill=5), state(3, "DEATH", 9), state(4, "DOWN", 1, downtime_ms=70), state(5, "DOWN", 1, downtime_ms=-1),
    ])
    skills = spark.createDataFrame([(5, "Burning"), (6, "Axe")], "skill_id BIGINT, skill_name STRING")
    rows = {r.agent_id: r for r in readout.agent_columns(readout.tallies(events), skills).collect()}
    one, two, victim = rows[1], rows[2], rows[9]
    assert (one.total_damage, one.hit_count, one.condi_named, one.kill_participation, one.cleave_targets, one.downtime_ms) == (30, 2, 10, 1, 1, 70)
    assert (two.kill_participation, two.condi_named, victim.deaths, victim.damage_taken, victim.barrier_absorbed, victim.kill_participation) == (1, 1, 1, 31, 3, 0)
    assert one.member and victim.member and not rows[0].member  # agent 0 is only named as the other side
