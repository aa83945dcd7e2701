"""Time the main queries; prints one JSON line.

BENCH_SF_DIR is the folder of the tables, BENCH_CPUS the number of local cores. Every query runs once
untimed, so that compilation is not measured, and then once timed, from reading to the last result row.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from samerow.plans.queries import queries  # noqa: E402

HEADLINE = [
    "dup_report",
    "dup_report_texts",
    "dup_report_orders",
    "dup_report_events_day",
    "key_file_counts_lineitem",
    "key_totals_lineitem",
    "table_dups",
    "duplicate_rows",
    "dedupe_all",
    "dedupe_all_orders",
    "dedupe_all_texts",
    "dedupe_within",
    "row_fate",
    "row_fate_orders",
    "deletion_stats",
    "report_text",
    "report_after_delete",
    "line_numbers",
    "avg_line_length",
    "line_counts",
    "run_summary",
    "rewrite_files",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("samerow-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="samerow-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = queries()
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            registry[name](spark, sf).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of the main duplicate-row queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
