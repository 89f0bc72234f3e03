"""Data quality checks.

Every check of a table is a count of violations, and all of a table's counts come from one
aggregation. The result is a frame (dataset, check_name, violations); `enforce` raises on any.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from spindlewatch.schema import WORKLOAD_PATTERNS

# --- Fixed values: columns each dataset must have ---
REQUIRED = {
    "raw": [
        "device", "timestamp", "r_s", "w_s", "rmb_s", "wmb_s", "r_await", "w_await",
        "aqu_sz", "util_pct",
    ],
    "curated": [
        "device", "timestamp", "total_iops", "total_throughput_mb_s", "avg_latency_ms",
        "saturation_score", "workload_pattern",
    ],
    "events": [
        "device", "timestamp", "metric_name", "detector_type", "anomaly_score", "severity",
        "is_anomaly", "workload_pattern", "root_cause_hint",
    ],
    "device_overview": [
        "device", "sample_count", "avg_total_iops", "avg_latency_ms", "p95_latency_ms",
        "p99_latency_ms", "dominant_workload_pattern",
    ],
    "anomaly_timeline": ["device", "timestamp", "metric_name", "severity", "root_cause_hint"],
    "root_cause_summary": ["ingest_run_id", "root_cause_hint", "workload_pattern", "anomaly_count"],
    "device_run_summary": [
        "device", "ingest_run_id", "run_time", "avg_latency_ms", "avg_util_pct", "avg_iops",
        "avg_throughput_mb_s", "avg_saturation_score", "dominant_workload_pattern",
        "total_anomalies", "critical_count", "high_count", "top_root_cause",
    ],
    "device_health": [
        "device", "timestamp", "avg_latency_ms", "util_pct", "aqu_sz", "anomaly_flag",
    ],
}
REPORT_INPUTS = {
    "device_overview": ["device", "avg_latency_ms", "anomaly_count"],
    "anomaly_timeline": ["device", "timestamp", "severity"],
    "root_cause_summary": ["root_cause_hint", "workload_pattern", "anomaly_count"],
}
NON_NEGATIVE = ["r_s", "w_s", "rmb_s", "wmb_s", "aqu_sz"]
# --- End of fixed values ---


class QualityError(ValueError):
    """Raised by `enforce` when a check counted violations."""


def _has(df: DataFrame, column: str, condition: Column) -> Column:
    """Count of rows meeting `condition`; 0 when the column itself is absent."""
    return F.count_if(condition) if column in df.columns else F.lit(0)


def _report(df: DataFrame, dataset: str, required: list[str], counts: dict[str, Column]) -> DataFrame:
    checks = {f"column {c}": F.lit(0 if c in df.columns else 1) for c in required}
    checks.update(counts)
    one = df.agg(*[c.cast("long").alias(f"c{i}") for i, c in enumerate(checks.values())])
    return one.select(F.inline(F.array(*[F.struct(
        F.lit(dataset).alias("dataset"), F.lit(name).alias("check_name"), F.col(f"c{i}").alias("violations"))
        for i, name in enumerate(checks)])))


def _out_of_range(df: DataFrame) -> Column:
    return _has(df, "util_pct", (F.col("util_pct") < 0) | (F.col("util_pct") > 100))


def check_raw(raw: DataFrame) -> DataFrame:
    """Raw rows: required columns."""
    return _report(raw, "raw", REQUIRED["raw"], {})


def check_parsed(raw: DataFrame) -> DataFrame:
    """Rows parsed from logs: keys present, utilization in range, rates not negative."""
    counts = {f"{c} not null": _has(raw, c, F.col(c).isNull()) for c in ("device", "timestamp")}
    counts["util_pct in range"] = _out_of_range(raw)
    counts.update({f"{c} not negative": _has(raw, c, F.col(c) < 0) for c in NON_NEGATIVE})
    return _report(raw, "parsed", REQUIRED["raw"], counts)


def check_curated(curated: DataFrame) -> DataFrame:
    """Curated rows: required columns, totals present, utilization in range, known labels."""
    label = F.col("workload_pattern")
    return _report(curated, "curated", REQUIRED["curated"], {
        "total_iops not null": _has(curated, "total_iops", F.col("total_iops").isNull()),
        "util_pct in range": _out_of_range(curated),
        "workload_pattern known": _has(
            curated, "workload_pattern", label.isNotNull() & ~label.isin(*WORKLOAD_PATTERNS)),
    })


def check_events(events: DataFrame) -> DataFrame:
    """Events: required columns, every event explained."""
    return _report(events, "events", REQUIRED["events"], {
        "root_cause_hint not null": _has(events, "root_cause_hint", F.col("root_cause_hint").isNull()),
    })


def check_mart(mart: DataFrame, name: str) -> DataFrame:
    """Dashboard table: required columns."""
    return _report(mart, name, REQUIRED[name], {})


def check_report_inputs(overview: DataFrame, timeline: DataFrame, causes: DataFrame) -> DataFrame:
    """Report inputs: an overview with rows, and the columns the report reads."""
    empty = (F.count(F.lit(1)) == 0).cast("int")
    return union_checks(
        _report(overview, "report device_overview", REPORT_INPUTS["device_overview"], {"has rows": empty}),
        _report(timeline, "report anomaly_timeline", REPORT_INPUTS["anomaly_timeline"], {}),
        _report(causes, "report root_cause_summary", REPORT_INPUTS["root_cause_summary"], {}),
    )


def check_published(datasets: dict[str, DataFrame]) -> DataFrame:
    """Published datasets: each has rows."""
    return union_checks(*[
        _report(df, name, [], {"has rows": (F.count(F.lit(1)) == 0).cast("int")})
        for name, df in datasets.items()])


def row_counts(datasets: dict[str, DataFrame]) -> DataFrame:
    """Rows per dataset."""
    return reduce(DataFrame.union, [
        df.agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("n")) for name, df in datasets.items()])


def union_checks(*reports: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, reports)


def enforce(report: DataFrame) -> None:
    """Raise with the failed checks; a report has a few dozen rows at most."""
    failed = report.where(F.col("violations") > 0).collect()
    if failed:
        raise QualityError("; ".join(f"{r.dataset}: {r.check_name} ({r.violations})" for r in failed))
