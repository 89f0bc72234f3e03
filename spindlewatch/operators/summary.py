"""Report figures. Rendering them is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spindlewatch.functions.rounding import reported
from spindlewatch.operators.runs import count_where

# --- Fixed values: report sizes and sentences ---
REPORT_ROWS = 5
BUSY_UTILIZATION = 80
REVIEW_CRITICAL = (
    "Review critical anomaly windows first, prioritizing devices with repeated latency and "
    "saturation signals.")
INVESTIGATE_UTILIZATION = (
    "Investigate sustained high utilization periods to determine whether capacity pressure or "
    "burst traffic is driving stress.")
CORRELATE_SATURATION = (
    "Correlate high-utilization and queue-depth periods with latency spikes to validate "
    "saturation-driven degradation.")
INSPECT_WRITES = (
    "Inspect write-heavy windows for flush pressure, burst ingestion patterns, or "
    "checkpoint-like activity.")
REVIEW_DISTRIBUTION = (
    "Review anomaly distribution by device and time to confirm whether flagged behavior "
    "reflects isolated spikes or recurring degradation.")
# --- End of fixed values ---


def key_figures(overview: DataFrame, timeline: DataFrame) -> DataFrame:
    """One row: devices, events, critical and high events, mean latency and utilization."""
    devices = overview.agg(F.struct(
        F.count_distinct("device").alias("total_devices"),
        reported(F.coalesce(F.avg("avg_latency_ms"), F.lit(0.0)), 2).alias("avg_latency_ms"),
        reported(F.coalesce(F.avg("avg_util_pct"), F.lit(0.0)), 2).alias("avg_util_pct")))
    return timeline.agg(
        F.count(F.lit(1)).alias("total_anomalies"),
        count_where(F.col("severity") == "critical").alias("critical_anomalies"),
        count_where(F.col("severity") == "high").alias("high_anomalies"),
    ).withColumn("_d", devices.scalar()).select(
        "_d.total_devices", "total_anomalies", "critical_anomalies", "high_anomalies",
        "_d.avg_latency_ms", "_d.avg_util_pct")


def most_affected_devices(overview: DataFrame, n: int = REPORT_ROWS) -> DataFrame:
    return overview.orderBy(
        F.desc("critical_anomaly_count"), F.desc("anomaly_count"), "device").limit(n).select(
        "device", "anomaly_count", "critical_anomaly_count", "dominant_workload_pattern", "avg_latency_ms")


def top_root_causes(causes: DataFrame, n: int = REPORT_ROWS) -> DataFrame:
    return causes.orderBy(
        F.desc("critical_count"), F.desc("anomaly_count"), "ingest_run_id", "root_cause_hint",
        "workload_pattern").limit(n).select(
        "root_cause_hint", "workload_pattern", "anomaly_count", "critical_count")


def dominant_workloads(overview: DataFrame, n: int = REPORT_ROWS) -> DataFrame:
    return overview.where(F.col("dominant_workload_pattern").isNotNull()).groupBy(
        "dominant_workload_pattern").agg(F.count(F.lit(1)).alias("devices")).orderBy(
        F.desc("devices"), "dominant_workload_pattern").limit(n)


def recommendations(figures: DataFrame, causes: DataFrame) -> DataFrame:
    """Numbered sentences that follow from the key figures and the top causes."""
    def mentioned(text: str) -> Column:
        return F.coalesce(F.bool_or(F.lower("root_cause_hint").contains(text)), F.lit(False))

    named = causes.agg(F.struct(
        mentioned("saturation").alias("saturation"), mentioned("write-heavy").alias("writes")))
    rules = [
        (F.col("critical_anomalies") > 0, REVIEW_CRITICAL),
        (F.col("avg_util_pct") >= BUSY_UTILIZATION, INVESTIGATE_UTILIZATION),
        (F.col("_c.saturation"), CORRELATE_SATURATION),
        (F.col("_c.writes"), INSPECT_WRITES),
    ]
    hit = F.array_compact(F.array(*[F.when(condition, F.lit(text)) for condition, text in rules]))
    return figures.withColumn("_c", named.scalar()).withColumn("_hit", hit).select(
        F.posexplode(F.when(F.size("_hit") > 0, F.col("_hit")).otherwise(
            F.array(F.lit(REVIEW_DISTRIBUTION)))).alias("position", "recommendation")
    ).select((F.col("position") + 1).alias("position"), "recommendation")
