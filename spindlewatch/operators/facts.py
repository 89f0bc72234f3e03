"""Fact tables over curated samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spindlewatch.functions.quantiles import grouped_statistics
from spindlewatch.functions.rolling import rolling

SERIES_COLUMNS = [
    "device", "timestamp", "total_iops", "total_throughput_mb_s", "avg_latency_ms", "util_pct",
    "aqu_sz", "saturation_score", "latency_pressure", "read_ratio", "write_ratio",
]
SERIES_WINDOW = 10


def device_timeseries(curated: DataFrame) -> DataFrame:
    """Samples with the mean and sample deviation of latency over ten rows of their device."""
    def columns(frame):
        return {"latency_rolling_mean": F.avg("avg_latency_ms").over(frame),
                "latency_rolling_std": F.stddev_samp("avg_latency_ms").over(frame)}

    series = curated.select(*SERIES_COLUMNS)
    order = ["timestamp", *[c for c in SERIES_COLUMNS[2:]]]
    return rolling(series, "device", order, SERIES_WINDOW - 1, columns)


def device_hourly(curated: DataFrame) -> DataFrame:
    """Hourly means and maximum latency per device."""
    return curated.groupBy("device", F.date_trunc("hour", "timestamp").alias("hour")).agg(
        F.avg("avg_latency_ms").alias("latency_mean"),
        F.max("avg_latency_ms").alias("latency_max"),
        F.avg("total_iops").alias("iops_mean"),
        F.avg("util_pct").alias("util_pct_mean"),
        F.avg("aqu_sz").alias("aqu_sz_mean"),
    )


def device_percentiles(curated: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Median, p95 and p99 latency per device; `accuracy` switches to approximate values."""
    if accuracy is not None:
        approx = F.percentile_approx("avg_latency_ms", [0.5, 0.95, 0.99], accuracy)
        q, frame = F.col("q"), curated.groupBy("device").agg(approx.alias("q"))
    else:
        frame = grouped_statistics(
            curated, ["device"], ["avg_latency_ms"], [0.5, 0.95, 0.99])
        q = F.col("avg_latency_ms").q
    return frame.select("device", q[0].alias("p50"), q[1].alias("p95"), q[2].alias("p99"))
