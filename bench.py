"""Times the headline queries and the batch pipeline; prints one JSON line.

BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from spindlewatch.plans import pipeline
from spindlewatch.plans.catalog import queries
from spindlewatch.plans.pipeline import Warehouse
from spindlewatch.session import build_session
from spindlewatch.sources.feed import read_feed

HEADLINE = [
    "curated_features", "workload_adaptive", "rolling_baseline", "rolling_zscore_events",
    "iqr_events", "combined_events", "severity_union", "isolation_forest_events",
    "device_overview", "root_cause_summary", "device_run_summary", "device_health", "run_summary",
    "fact_timeseries", "fact_hourly", "fact_percentiles", "q01_critical_devices", "q08_top_causes",
    "q14_score_p95", "q20_saturation_slope", "q24_performance_with_cause", "profile_describe",
    "profile_nulls", "profile_corr", "profile_histogram", "profile_above_p99",
    "summary_recommendations", "quality_checks",
]


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "spindlewatch-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
           "spark.sql.execution.arrow.pyspark.enabled": "true",
           "spark.python.sql.dataFrameDebugging.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    read_feed(spark, folder).write.format("noop").mode("overwrite").save()  # start-up cost

    named = queries()
    seconds = {}
    for name in HEADLINE:
        # Every row and column is produced; none is collected.
        seconds[name] = timed(
            lambda: named[name](spark, folder).write.format("noop").mode("overwrite").save())
    with tempfile.TemporaryDirectory(prefix="spindlewatch-bench-") as root:
        house = Warehouse(spark, f"{root}/warehouse")
        samples = read_feed(spark, folder).drop("ingest_run_id")
        seconds["batch_pipeline"] = timed(
            lambda: pipeline.run_pipeline(house, samples, f"{root}/exports"))
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
