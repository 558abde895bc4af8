"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from strata import plans  # noqa: E402
from strata.session import build_session  # noqa: E402

HEADLINE = [
    "aggregate", "aggregate_filters_having", "aggregate_first_last", "pivot_prefixed", "unpivot_columns", "window_rank_lag_lead", "window_running",
    "exact_median", "topk_values", "dedup_first", "dedup_texts", "duplicate_rows", "cleanse", "enrich", "chain", "rule_engine", "rule_report",
    "profile_columns", "drift", "upsert", "scd2", "star_finance", "star_university", "mart_patient_summary", "mart_account_summary",
    "kpi_finance", "kpi_university", "report_tech", "record_summary", "advisee_lists", "csv_roundtrip", "partitioned_roundtrip", "incremental_scan",
    "stream_tumbling", "stream_sliding", "stream_dlq",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("strata-bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    plans.load_all()
    for table in ("orders", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").groupBy().count().collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_wall_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
