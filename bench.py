"""Time the headline queries; one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3 warm runs).
Each value is the median of the warm runs; the first, cold run is reported under "cold".
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from settlelens.plans import registered
from settlelens.session import build_session

HEADLINE = [
    "a1_str_daily",
    "a1_str_daily_vendor",
    "a3_grouping_sets",
    "a5_onchain_daily_costs",
    "a6_l1_decomposition",
    "a8_blob_fee_state",
    "a14_blob_fee_distribution",
    "a16_attribution_coverage",
    "a25_new_senders",
    "j5_sender_match",
    "j8_panel_assembly",
    "p15_candidates",
    "q9_monthly_reconciliation",
    "t3_top_unattributed",
    "w1_smoothing",
    "w2_floor_runs",
    "w4_missing_blocks",
    "w5_latest_version",
    "x2_newey_west",
    "x3_mann_kendall",
    "x11_fee_floor",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    keys = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.log.level": "ERROR",
            "spark.checkpoint.dir": os.environ.get("BENCH_SCRATCH", f"file://{os.getcwd()}/spark-warehouse/scratch"),
        },
    )
    entries = registered()
    warm, cold = {}, {}
    for key in keys:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            entries[key].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        cold[key], warm[key] = round(times[0], 3), round(statistics.median(times[1:]), 3)
        print(f"{key} {warm[key]} (cold {cold[key]})", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of medians",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": sf_dir.rsplit("sf", 1)[-1],
                "cpus": int(cpus),
                "runs": runs,
                "spark": spark.version,
            }
        )
    )


if __name__ == "__main__":
    main()
