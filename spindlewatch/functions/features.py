"""Per-row features. Pure projections: they add no shuffle and stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from spindlewatch.functions.workload import FIXED_THRESHOLD_PATTERN


def share(part: str, whole: str, default: float) -> str:
    """part / whole where whole is positive, else the default (also for a null whole)."""
    return f"CASE WHEN {whole} > 0 THEN ({part}) / ({whole}) ELSE {default}D END"


def share_or_default(part: str, whole: str, default: float) -> str:
    """part / whole for any non-zero whole; a null outcome becomes the default as well."""
    return f"coalesce(({part}) / nullif({whole}, 0D), {default}D)"


# Columns derived from raw ones alone; every profile starts with these.
TOTALS = {
    "total_iops": "r_s + w_s",
    "total_throughput_mb_s": "rmb_s + wmb_s",
}
CLOCK = {
    "hour_of_day": "hour(timestamp)",
    "day_of_week": "weekday(timestamp)",  # Monday is 0
}
WEIGHTED_WAIT = "r_await * r_s + w_await * w_s"
MERGES = "rrqm_s + wrqm_s"
SAMPLE_PRODUCTS = {
    "iops_total": "total_iops",
    "throughput_mb_s": "total_throughput_mb_s",
    "saturation_score": "util_pct * aqu_sz",
    "merge_rate_total": MERGES,
    "iowait_pressure": "iowait_pct * util_pct / 100D",
    **CLOCK,
}
LATENCY_PRODUCTS = {
    "weighted_avg_latency": "avg_latency_ms",
    "io_intensity": "total_iops * avg_request_size_kb",
    "latency_pressure": "avg_latency_ms * aqu_sz",
}

# Per profile: steps of column -> expression, each step reading the columns of earlier ones.
PROFILES: dict[str, list[dict[str, str]]] = {
    "product": [
        TOTALS,
        {
            **SAMPLE_PRODUCTS,
            "avg_latency_ms": share(WEIGHTED_WAIT, "total_iops", 0.0),
            "read_ratio": share("r_s", "total_iops", 0.5),
            "write_ratio": share("w_s", "total_iops", 0.5),
            "avg_request_size_kb": share("total_throughput_mb_s * 1024D", "total_iops", 0.0),
            "merge_efficiency": share(MERGES, f"total_iops + ({MERGES})", 0.0),
            "await_ratio": share("w_await", "r_await", 1.0),
            "queue_efficiency": share("total_iops", "aqu_sz", 0.0),
            "write_amplification": share("w_s", "r_s", 1.0),
        },
        {
            **LATENCY_PRODUCTS,
            "svctm_await_ratio": share("svctm", "avg_latency_ms", 1.0),
            "workload_pattern": FIXED_THRESHOLD_PATTERN,
        },
    ],
    "additive": [
        TOTALS,
        {
            **CLOCK,
            "avg_latency_ms": share(WEIGHTED_WAIT, "total_iops", 0.0),
            "read_ratio": share("r_s", "total_iops", 0.0),
            "write_ratio": share("w_s", "total_iops", 0.0),
            "avg_request_size_kb": share("total_throughput_mb_s * 1024D", "total_iops", 0.0),
            "io_intensity": "total_iops * total_throughput_mb_s",
        },
        {
            "saturation_score": "util_pct * 0.5D + aqu_sz * 30D + avg_latency_ms * 2D",
            "latency_pressure": "avg_latency_ms * (aqu_sz + 1D)",
        },
    ],
    "clipped": [
        TOTALS,
        {
            **SAMPLE_PRODUCTS,
            "avg_latency_ms": share_or_default(WEIGHTED_WAIT, "total_iops", 0.0),
            # An idle sample divides by one half here, so its ratios follow r_s and w_s.
            "read_ratio": "r_s / coalesce(nullif(total_iops, 0D), 0.5D)",
            "write_ratio": "w_s / coalesce(nullif(total_iops, 0D), 0.5D)",
            "avg_request_size_kb": share_or_default(
                "rmb_s * 1024D + wmb_s * 1024D", "total_iops", 0.0),
            "merge_efficiency": "greatest(0D, least(1D, {}))".format(
                share_or_default(MERGES, f"total_iops + ({MERGES})", 0.0)),
            "await_ratio": share_or_default("w_await", "r_await", 1.0),
            "queue_efficiency": share_or_default("total_iops", "aqu_sz", 0.0),
            "write_amplification": share_or_default("w_s", "r_s", 1.0),
        },
        {
            **LATENCY_PRODUCTS,
            "svctm_await_ratio": "greatest(0D, least(10D, {}))".format(
                share_or_default("svctm", "avg_latency_ms", 1.0)),
        },
    ],
}


def parsed_timestamp(df: DataFrame) -> Column:
    """Timestamps given as text become null when malformed instead of failing the job."""
    if isinstance(df.schema["timestamp"].dataType, T.StringType):
        return F.try_to_timestamp(F.col("timestamp"))
    return F.col("timestamp").cast("timestamp")


def derive_features(df: DataFrame, profile: str = "product") -> DataFrame:
    """Add the derived columns to raw rows, replacing any of the same name.

    product   the pipeline's definitions, with a workload label
    additive  ratios default to 0; additive saturation and pressure; no label
    clipped   bounded merge efficiency and service-time ratio; no label, see
              `workload.add_adaptive_patterns`
    """
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {sorted(PROFILES)}")
    steps = PROFILES[profile]
    stale = [name for step in steps for name in step if name in df.columns]
    df = df.withColumn("timestamp", parsed_timestamp(df)).drop(*stale)
    for step in steps:
        df = df.selectExpr("*", *[f"{expression} AS {name}" for name, expression in step.items()])
    return df
