"""Workload labels. First matching rule wins; a null input never matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spindlewatch.functions.quantiles import grouped_statistics


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def first_match(rules: list[tuple[str, str]], default: str) -> str:
    """CASE expression from (condition, label) pairs."""
    arms = " ".join(f"WHEN {condition} THEN {quoted(label)}" for condition, label in rules)
    return f"CASE {arms} ELSE {quoted(default)} END"


OVERLOADED = "util_pct > 80 OR aqu_sz > 5"

# Five labels from fixed thresholds; the pipeline's classifier.
FIXED_THRESHOLD_PATTERN = first_match([
    (OVERLOADED, "saturated"),
    ("total_iops > 1200", "burst_io"),
    ("avg_request_size_kb < 16", "small_io_pressure"),
    ("avg_latency_ms > 5", "latency_sensitive"),
], "balanced")

# Eight labels that also separate read-heavy and write-heavy samples.
EIGHT_CLASS_INPUTS = [
    "read_ratio", "write_ratio", "avg_request_size_kb", "util_pct", "aqu_sz",
    "avg_latency_ms", "total_iops", "total_throughput_mb_s",
]
EIGHT_CLASS_PATTERN = first_match([
    ("util_pct >= 85 OR aqu_sz >= 3", "saturated"),
    ("avg_latency_ms >= 10 AND aqu_sz >= 1", "latency_sensitive"),
    ("write_ratio >= 0.7D", "write_heavy"),
    ("read_ratio >= 0.7D", "read_heavy"),
    ("avg_request_size_kb <= 16 AND total_iops > 0", "small_io_pressure"),
    ("total_throughput_mb_s >= 50 AND avg_latency_ms < 5", "high_throughput"),
    ("total_iops >= 500", "burst_io"),
], "balanced")


def add_workload_patterns(df: DataFrame) -> DataFrame:
    """Label rows with the eight-class rules; absent inputs count as 0."""
    absent = [c for c in EIGHT_CLASS_INPUTS if c not in df.columns]
    if absent:
        df = df.withColumns({c: F.lit(0.0) for c in absent})
    return df.withColumn("workload_pattern", F.expr(EIGHT_CLASS_PATTERN)).drop(*absent)


def add_adaptive_patterns(df: DataFrame) -> DataFrame:
    """Label rows against the data's own 90th percentiles of r_s, w_s and latency.

    The three percentiles are one row, read as a scalar subquery.
    """
    stats = grouped_statistics(df, [], ["r_s", "w_s", "avg_latency_ms"], [0.9])
    cut = stats.select(F.struct("r_s", "w_s", "avg_latency_ms")).scalar()
    return df.withColumn("_p90", cut).withColumn("workload_pattern", F.expr(first_match([
        (OVERLOADED, "saturated"),
        ("r_s > _p90.r_s.q[0] OR w_s > _p90.w_s.q[0]", "burst_io"),
        ("avg_request_size_kb < 16", "small_io_pressure"),
        ("avg_latency_ms > _p90.avg_latency_ms.q[0]", "latency_sensitive"),
    ], "balanced"))).drop("_p90")
