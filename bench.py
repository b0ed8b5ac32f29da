"""Headline queries, timed; prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the local threads, BENCH_QUERIES an
optional comma-separated choice. Each query runs to its last row into a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from workload import all_queries  # noqa: E402

HEADLINE = (
    "member_summary",
    "member_encounter_claim",
    "panel_condition_evidence",
    "claim_evidence",
    "child_counts",
    "population_row",
    "event_spine",
    "score_buckets",
    "last_value_per_member",
    "orphan_gates",
    "document_gates",
    "metrics_of_several_tables",
    "reconcile_match",
    "cell_parse_roundtrip",
    "csv_typed_load",
    "question_intents",
    "evidence_match",
    "cited_list_answers",
    "question_answers",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # Skips the per-expression call-site lookups of interactive debugging.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _sql = all_queries()
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderpriority").count().collect()
    times: dict[str, float] = {}
    for name in chosen:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
