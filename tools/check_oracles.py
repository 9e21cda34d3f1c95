"""Compare registered queries with their SQL twins: ``check_oracles.py FOLDER [name ...]``."""

from __future__ import annotations

import os
import sys
import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from frayline.plans import load_queries  # noqa: E402
from frayline.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(frame):
    frame = frame[sorted(frame.columns)]
    rows = [tuple(cell(v) for v in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


def cell(v):
    if v is None or str(v) in ("NaT", "<NA>", "nan"):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(v)
    return str(v)


def check(spark, con, folder: str, q) -> int:
    """Print one line for a query; 1 when it fails."""
    start = time.time()
    try:
        got = q.run(spark, folder).toPandas()
    except Exception as err:  # noqa: BLE001
        print(f"ERROR {q.name}: {str(err)[:900]}", flush=True)
        return 1
    took = time.time() - start
    if q.sql is None:
        print(f"rows  {q.name}: {len(got)} rows {took:.1f}s", flush=True)
        return 0
    try:
        want = con.execute(q.sql).df()
    except Exception as err:  # noqa: BLE001
        print(f"SQLERR {q.name}: {str(err)[:700]}", flush=True)
        return 1
    if sorted(got.columns) != sorted(want.columns):
        print(f"COLS  {q.name}: {sorted(got.columns)} vs {sorted(want.columns)}", flush=True)
        return 1
    a, b = normal(got), normal(want)
    if a == b:
        print(f"ok    {q.name}: {len(a)} rows {took:.1f}s", flush=True)
        return 0
    diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
    print(f"DIFF  {q.name}: {len(a)} vs {len(b)} rows; cols {sorted(got.columns)}; {diff}", flush=True)
    return 1


def main() -> int:
    folder, names = sys.argv[1], sys.argv[2:]
    registry = load_queries()
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.log.level": "ERROR",
    })
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    with ThreadPoolExecutor(int(os.environ.get("CHECK_THREADS", "1"))) as pool:
        bad = sum(pool.map(lambda name: check(spark, con.cursor(), folder, registry[name]), names or list(registry)))
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
