"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scoremart.session import build_session  # noqa: E402
from workloads.catalog import QUERIES, runner  # noqa: E402

HEADLINE = [
    "dedup_latest",
    "diff_summary",
    "diff_changed_values",
    "parse_results_long",
    "completed_on_disk",
    "compact_results",
    "rollup_levels",
    "assemble_scores",
    "covered_in_scores",
    "coverage_counts",
    "plan_batches",
    "job_state",
    "expand_suites",
    "group_levels",
    "latest_file_per_dir",
    "sync_dimension",
    "drop_rows",
    "scan_job_queue",
    "stream_merge_scores",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not measured
    times: dict[str, float] = {}
    for name in names:
        run = runner(QUERIES[name].build)
        taken = []
        for _ in range(repeats):
            begin = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - begin)
        times[name] = round(min(taken) if repeats < 3 else statistics.median(taken), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
