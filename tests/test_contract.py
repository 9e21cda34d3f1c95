import os

import duckdb
import pytest

import __spark_entry__ as driver
from frayline.plans import load_queries
from tools.check_oracles import TABLES, normal

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables absent")
# one query per operator family; tools/check_oracles.py runs them all
SAMPLE = [
    "target_damage", "player_boons", "event_windows", "account_days", "modal_profiles", "stack_history", "plain_queue_uptime",
    "classified_events", "down_contribution", "owner_at_event", "final_casts", "spacing_metrics", "detected_roles", "classified_results",
    "due_retries", "parsed_event_lines", "live_timeline",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def test_entry_and_keys(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_every_oracle_statement_binds(duck):
    for name, sql in driver.oracle_sql().items():
        assert duck.execute(f"SELECT * FROM ({sql}) AS q LIMIT 0").description, name


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_oracle(spark, duck, name):
    q = load_queries()[name]
    got, want = q.run(spark, FOLDER).toPandas(), duck.execute(q.sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
