"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     warm runs per query, the median counts (default 2)
BENCH_QUERIES  names to run, separated by commas (default: the headline list)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fleetledger.plans.registry import registered  # noqa: E402
from fleetledger.session import build_session  # noqa: E402

HEADLINE = (
    "ids_event_time ids_compose ids_decode ids_bulk_count "
    "rollout_next rollout_pick rollout_claim rollout_beats rollout_done rollout_oplog rollout_outcome rollout_plan "
    "links_status links_parse links_rank links_best links_leader links_reconcile links_gaps "
    "log_headers log_parse log_sql log_replay log_replay_moves archive_compact archive_stream archive_rewrite "
    "log_script log_rejoin log_replay_text log_replay_stream links_gaps_stream"
).split()


def timed(query, spark, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="16g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    every, cold, warm = registered(), {}, {}
    for name in names:
        query = every[name][0]
        cold[name] = round(timed(query, spark, folder), 3)
        warm[name] = round(statistics.median(timed(query, spark, folder) for _ in range(runs)), 3)
        print(f"{name:24} cold {cold[name]:7.3f}  warm {warm[name]:7.3f}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of warm medians of the headline queries",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
