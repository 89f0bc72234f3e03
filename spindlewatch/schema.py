"""Table schemas and the fixed values every stage shares."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: column names, labels, thresholds and sentences that results depend on ---

RAW_METRICS = [
    "r_s", "w_s", "rmb_s", "wmb_s", "r_await", "w_await", "aqu_sz", "util_pct",
    "rrqm_s", "wrqm_s", "rareq_sz", "wareq_sz", "svctm", "iowait_pct",
]

LEGACY_NAMES = {
    "r/s": "r_s",
    "w/s": "w_s",
    "rMB/s": "rmb_s",
    "wMB/s": "wmb_s",
    "rrqm/s": "rrqm_s",
    "wrqm/s": "wrqm_s",
}

LOG_METRICS = ["r_s", "w_s", "rmb_s", "wmb_s", "r_await", "w_await", "aqu_sz", "util_pct"]

DERIVED_COLUMNS = [
    "total_iops", "iops_total", "total_throughput_mb_s", "throughput_mb_s",
    "avg_latency_ms", "weighted_avg_latency", "read_ratio", "write_ratio",
    "avg_request_size_kb", "saturation_score", "io_intensity", "latency_pressure",
    "merge_rate_total", "merge_efficiency", "await_ratio", "svctm_await_ratio",
    "queue_efficiency", "write_amplification", "iowait_pressure",
    "workload_pattern", "hour_of_day", "day_of_week",
]

WORKLOAD_PATTERNS = [
    "read_heavy", "write_heavy", "balanced", "high_throughput",
    "small_io_pressure", "saturated", "latency_sensitive", "burst_io",
]

COMBINED_METRICS = [
    "avg_latency_ms", "saturation_score", "merge_efficiency", "queue_efficiency",
    "iowait_pressure", "total_iops", "total_throughput_mb_s",
]

# Context copied from the curated row onto each event, with the value used when the
# column is absent.
EVENT_CONTEXT = {
    "util_pct": 0.0,
    "aqu_sz": 0.0,
    "avg_latency_ms": 0.0,
    "read_ratio": 0.5,
    "write_ratio": 0.5,
    "avg_request_size_kb": 0.0,
    "total_iops": 0.0,
    "total_throughput_mb_s": 0.0,
    "saturation_score": 0.0,
    "latency_pressure": 0.0,
}

ROLLING_WINDOW = 5
ZSCORE_THRESHOLD = 3.0
IQR_MULTIPLIER = 1.5
MIN_GROUP_VALUES = 5
CONTAMINATION = 0.05
FOREST_SEED = 42
FOREST_MIN_ROWS = 10

SEVERITIES = ["critical", "high", "medium", "low"]
NO_ANOMALIES = "No anomalies detected"
UNKNOWN_WORKLOAD = "unknown"

# --- End of fixed values ---

_KEYS = [
    T.StructField("device", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
]
_LINEAGE = [
    T.StructField("source_file", T.StringType()),
    T.StructField("ingest_run_id", T.StringType()),
]


def _doubles(names):
    return [T.StructField(name, T.DoubleType()) for name in names]


RAW_SCHEMA = T.StructType(_KEYS + _doubles(RAW_METRICS) + _LINEAGE)

_DERIVED_TYPES = {
    "workload_pattern": T.StringType(),
    "hour_of_day": T.IntegerType(),
    "day_of_week": T.IntegerType(),
}
CURATED_SCHEMA = T.StructType(
    RAW_SCHEMA.fields
    + [T.StructField(name, _DERIVED_TYPES.get(name, T.DoubleType())) for name in DERIVED_COLUMNS]
)

# What a detector emits before context is added.
DETECTION_SCHEMA = T.StructType(
    _KEYS
    + [
        T.StructField("metric_name", T.StringType()),
        T.StructField("metric_value", T.DoubleType()),
        T.StructField("detector_type", T.StringType()),
        T.StructField("anomaly_score", T.DoubleType()),
        T.StructField("severity", T.StringType()),
        T.StructField("is_anomaly", T.IntegerType()),
        T.StructField("details", T.StringType()),
    ]
    + _LINEAGE
)

EVENT_SCHEMA = T.StructType(
    DETECTION_SCHEMA.fields
    + [
        T.StructField("workload_pattern", T.StringType()),
        T.StructField("root_cause_hint", T.StringType()),
    ]
    + _doubles(EVENT_CONTEXT)
)

# Shape of the evidence object kept as JSON text in the events table.
EVIDENCE_SCHEMA = T.StructType(
    _doubles(["mean", "std", "q1", "q3", "iqr", "lower_bound", "upper_bound", "z_score"])
)
