"""Dashboard tables built from curated samples and events.

Every table aggregates first and joins afterwards, so joins see one row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spindlewatch.functions.quantiles import grouped_statistics
from spindlewatch.functions.rounding import reported
from spindlewatch.operators.runs import count_where
from spindlewatch.schema import NO_ANOMALIES, UNKNOWN_WORKLOAD

TIMELINE_COLUMNS = [
    "device", "timestamp", "metric_name", "detector_type", "severity", "anomaly_score",
    "workload_pattern", "root_cause_hint", "util_pct", "aqu_sz", "avg_latency_ms",
    "total_iops", "saturation_score",
]
PROJECTION_COLUMNS = [
    "device", "timestamp", "total_iops", "total_throughput_mb_s", "avg_latency_ms",
    "read_ratio", "write_ratio", "avg_request_size_kb", "saturation_score", "io_intensity",
    "latency_pressure", "hour_of_day", "day_of_week", "util_pct", "aqu_sz",
]
HEALTH_COLUMNS = [
    "device", "timestamp", "total_iops", "total_throughput_mb_s", "avg_latency_ms",
    "util_pct", "aqu_sz", "saturation_score", "latency_pressure",
]


def _severity_is(name: str) -> Column:
    return F.col("severity") == name


def dominant_workload() -> Column:
    """Most frequent label, the smallest on a tie."""
    return F.coalesce(F.mode("workload_pattern", True), F.lit(UNKNOWN_WORKLOAD))


def _null_safe_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_{k}"]) for k in keys]
    return left.join(renamed, on, "left").drop(*[f"_{k}" for k in keys])


def _zero_when_absent(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in names})


def device_overview(curated: DataFrame, events: DataFrame) -> DataFrame:
    """One row per device: means, tail latencies, dominant workload and event counts."""
    return _with_event_counts(_null_safe_left(
        _device_means(curated), _tail_latency(curated), ["device"]), events)


def device_overview_basic(curated: DataFrame, events: DataFrame) -> DataFrame:
    """The overview without tail latencies."""
    return _with_event_counts(_device_means(curated), events)


def _device_means(curated: DataFrame) -> DataFrame:
    return curated.groupBy("device").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.avg("total_iops").alias("avg_total_iops"),
        F.avg("total_throughput_mb_s").alias("avg_throughput_mb_s"),
        F.avg("avg_latency_ms").alias("avg_latency_ms"),
        F.avg("util_pct").alias("avg_util_pct"),
        F.avg("aqu_sz").alias("avg_queue_depth"),
        dominant_workload().alias("dominant_workload_pattern"),
    )


def _tail_latency(curated: DataFrame) -> DataFrame:
    stats = grouped_statistics(curated, ["device"], ["avg_latency_ms"], [0.95, 0.99])
    q = F.col("avg_latency_ms").q
    return stats.select("device", q[0].alias("p95_latency_ms"), q[1].alias("p99_latency_ms"))


def _with_event_counts(overview: DataFrame, events: DataFrame) -> DataFrame:
    counts = events.groupBy("device").agg(
        F.count(F.lit(1)).alias("anomaly_count"),
        count_where(_severity_is("critical")).alias("critical_anomaly_count"),
        count_where(_severity_is("high")).alias("high_anomaly_count"),
    )
    return _zero_when_absent(
        _null_safe_left(overview, counts, ["device"]),
        ["anomaly_count", "critical_anomaly_count", "high_anomaly_count"])


def anomaly_timeline(events: DataFrame) -> DataFrame:
    """Events reduced to the dashboard's columns; absent ones are skipped."""
    return events.select(*[c for c in TIMELINE_COLUMNS if c in events.columns])


def root_cause_summary(events: DataFrame, rounded: bool = False) -> DataFrame:
    """Event counts per run, cause and workload, worst first."""
    score = F.avg("anomaly_score")
    return events.groupBy("ingest_run_id", "root_cause_hint", "workload_pattern").agg(
        F.count(F.lit(1)).alias("anomaly_count"),
        count_where(_severity_is("critical")).alias("critical_count"),
        count_where(_severity_is("high")).alias("high_count"),
        F.count_distinct("device").alias("affected_devices"),
        (reported(score, 3) if rounded else score).alias("avg_anomaly_score"),
    ).orderBy(F.desc("critical_count"), F.desc("anomaly_count"),
              "ingest_run_id", "root_cause_hint", "workload_pattern")


# Digits kept in the rounded form of the device-run summary.
RUN_SUMMARY_DIGITS = {
    "avg_latency_ms": 2, "max_latency_ms": 2, "avg_util_pct": 2, "max_util_pct": 2,
    "avg_iops": 0, "avg_throughput_mb_s": 2, "avg_saturation_score": 3, "avg_aqu_sz": 3,
}


def device_run_summary(curated: DataFrame, events: DataFrame, rounded: bool = False) -> DataFrame:
    """One row per device and run: performance, dominant workload, event counts, top cause."""
    keys = ["device", "ingest_run_id"]
    perf = curated.groupBy(*keys).agg(
        F.min("timestamp").alias("run_time"),
        F.avg("avg_latency_ms").alias("avg_latency_ms"),
        F.max("avg_latency_ms").alias("max_latency_ms"),
        F.avg("util_pct").alias("avg_util_pct"),
        F.max("util_pct").alias("max_util_pct"),
        F.avg("total_iops").alias("avg_iops"),
        F.avg("total_throughput_mb_s").alias("avg_throughput_mb_s"),
        F.avg("saturation_score").alias("avg_saturation_score"),
        F.avg("aqu_sz").alias("avg_aqu_sz"),
        dominant_workload().alias("dominant_workload_pattern"),
    )
    if rounded:
        perf = perf.withColumns({c: reported(c, d) for c, d in RUN_SUMMARY_DIGITS.items()})
    # Counted per cause first: the second step is then a handful of rows per device and run.
    per_cause = events.groupBy(*keys, "root_cause_hint").agg(
        F.count(F.lit(1)).alias("n"),
        count_where(_severity_is("critical")).alias("critical"),
        count_where(_severity_is("high")).alias("high"),
    )
    incidents = per_cause.groupBy(*keys).agg(
        F.sum("n").alias("total_anomalies"),
        F.sum("critical").alias("critical_count"),
        F.sum("high").alias("high_count"),
        F.min_by("root_cause_hint", F.struct(
            -F.col("n"), F.col("root_cause_hint").isNull(), "root_cause_hint")).alias("top_root_cause"),
    )
    joined = _zero_when_absent(_null_safe_left(perf, incidents, keys),
                               ["total_anomalies", "critical_count", "high_count"])
    return joined.withColumn("top_root_cause", F.coalesce("top_root_cause", F.lit(NO_ANOMALIES)))


def device_health(curated: DataFrame, events: DataFrame) -> DataFrame:
    """Curated samples with flags telling whether, and how badly, they were flagged.

    The key is device and timestamp, so no single device concentrates the join.
    """
    flags = events.groupBy("device", "timestamp").agg(
        F.max("is_anomaly").alias("anomaly_flag"),
        F.max(F.when(_severity_is("critical"), 1).otherwise(0)).alias("critical_flag"),
        F.max(F.when(_severity_is("high"), 1).otherwise(0)).alias("high_flag"),
    )
    return _zero_when_absent(
        curated.select(*HEALTH_COLUMNS).join(flags, ["device", "timestamp"], "left"),
        ["anomaly_flag", "critical_flag", "high_flag"])


def curated_projection(curated: DataFrame) -> DataFrame:
    """The dashboard's view of curated samples."""
    return curated.select(*PROJECTION_COLUMNS)


def run_summary(raw: DataFrame, curated: DataFrame, events: DataFrame) -> DataFrame:
    """One row per run that has both curated samples and events: counts and worst score."""
    def known(df: DataFrame) -> DataFrame:
        return df.where(F.col("ingest_run_id").isNotNull()).groupBy("ingest_run_id")

    incidents = known(events).agg(
        F.count(F.lit(1)).alias("anomaly_rows"),
        F.count_distinct("device").alias("affected_devices"),
        count_where(_severity_is("critical")).alias("critical_anomalies"),
        count_where(_severity_is("high")).alias("high_anomalies"),
        F.max("anomaly_score").alias("max_anomaly_score"),
    )
    samples = known(curated).agg(F.count(F.lit(1)).alias("curated_rows"))
    source = known(raw).agg(F.count(F.lit(1)).alias("raw_rows"))
    joined = samples.join(incidents, "ingest_run_id").join(source, "ingest_run_id", "left")
    return _zero_when_absent(joined, ["raw_rows"]).select(
        "ingest_run_id", "raw_rows", "curated_rows", "anomaly_rows", "affected_devices",
        "critical_anomalies", "high_anomalies", "max_anomaly_score")
