"""Headline benchmark: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores.

The seconds are those of one cold pass. A second, warm pass over this folder and the sf0.01 folder beside, if there is
one, tells what added events cost, apart from planning and scheduling, which dominate at these sizes.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from frayline.plans import load_queries  # noqa: E402
from frayline.session import build_session  # noqa: E402

HEADLINE = [
    "classified_events", "target_damage", "player_damage", "player_boons", "squad_rollup", "skill_usage", "event_windows",
    "player_timelines", "stack_history", "boon_uptimes", "down_contribution", "final_casts", "spacing_metrics",
    "fight_player_summaries", "combat_readout", "modal_profiles", "account_days", "compared_fields",
    "full_readout", "complete_rotation",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.log.level": "ERROR"},
    )
    registry = load_queries()
    registry["events_by_kind"].run(spark, folder).write.format("noop").mode("overwrite").save()  # starts the JVM paths

    def timed(name: str, where: str) -> float:
        start = time.perf_counter()
        registry[name].run(spark, where).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    seconds = {name: timed(name, folder) for name in names}
    count = lambda where: spark.read.parquet(f"{where}/events.parquet").count()
    events, small = count(folder), str(Path(folder).parent / "sf0.01")
    added = {}
    if Path(small).is_dir() and Path(small) != Path(folder):
        more = events - count(small)
        warm = {name: (timed(name, small), timed(name, folder)) for name in names}
        added = {name: round((large - less) / more * 1e6, 2) for name, (less, large) in warm.items()}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "events": events, "microseconds_per_added_event": added,
                "classified_events_per_sec": round(events / seconds["classified_events"]) if "classified_events" in seconds else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
