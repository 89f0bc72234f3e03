"""Severity and root-cause rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spindlewatch.functions.workload import first_match
from spindlewatch.schema import EVENT_CONTEXT

# --- Fixed values: severity floors by detector, and the root-cause sentences ---

SEVERITY_FLOORS = {
    "rolling_zscore": ([(5, "critical"), (4, "high")], "medium"),
    "iqr": ([(5, "critical"), (3, "high"), (1.5, "medium")], "low"),
    "isolation_forest": ([(0.3, "critical"), (0.15, "high"), (0.05, "medium")], "low"),
}
SEVERITY_OTHERWISE = "low"

SATURATION_LATENCY = "Latency spike likely driven by saturation and queue buildup"
WRITE_LATENCY = "Latency degradation likely under write-heavy pressure"
READ_LATENCY = "Latency spike observed during read-heavy demand"
PLAIN_LATENCY = "Latency anomaly detected without clear saturation signal"
FULL_UTILIZATION = "Device operating near full utilization"
PLAIN_UTILIZATION = "Utilization anomaly detected"
QUEUE_LATENCY = "Queue buildup likely contributing to latency pressure"
PLAIN_QUEUE = "Queue depth anomaly detected"
SATURATION = "Composite saturation signal indicates elevated device stress"
LATENCY_PRESSURE = "Joint increase in latency and queue depth suggests pressure buildup"
SMALL_IOPS = "High IOPS with small requests suggests random IO pressure"
PLAIN_IOPS = "IOPS anomaly indicates bursty load increase"
JOINT_SATURATED = "Multivariate anomaly aligned with saturation pattern"
JOINT_WRITE = "Multivariate anomaly aligned with write-heavy stress"
JOINT_READ = "Multivariate anomaly aligned with read-heavy load"
PLAIN_JOINT = "Multivariate anomaly indicates unusual joint metric behavior"
UNEXPLAINED = "Anomalous behavior detected"

# --- End of fixed values ---


def severity_of(detector: str, score: str = "anomaly_score") -> str:
    """Severity ladder of one detector over the absolute score; a null score counts as 0."""
    floors, lowest = SEVERITY_FLOORS[detector]
    return first_match(
        [(f"coalesce(abs({score}), 0D) >= {floor}D", label) for floor, label in floors], lowest)


def assign_severity(events: DataFrame) -> DataFrame:
    """Grade each event by its own detector's ladder; unknown detectors grade low."""
    ladders = " ".join(f"WHEN '{name}' THEN {severity_of(name)}" for name in SEVERITY_FLOORS)
    return events.withColumn("severity", F.expr(
        f"CASE detector_type {ladders} ELSE '{SEVERITY_OTHERWISE}' END"))


def severity_rank(severity: Column) -> Column:
    """critical 4, high 3, medium 2, anything else 1."""
    name = F.lower(severity)
    return F.when(name == "critical", 4).when(name == "high", 3).when(name == "medium", 2).otherwise(1)


# Per metric: sentences with the condition on the sample's context under which they apply,
# and the sentence when none does.
HINTS: dict[str, tuple[list[tuple[str, str]], str]] = {
    "avg_latency_ms": ([
        ("{aqu_sz} >= 2 AND {util_pct} >= 80", SATURATION_LATENCY),
        ("{write_ratio} >= 0.7D", WRITE_LATENCY),
        ("{read_ratio} >= 0.7D", READ_LATENCY),
    ], PLAIN_LATENCY),
    "util_pct": ([("{util_pct} >= 90", FULL_UTILIZATION)], PLAIN_UTILIZATION),
    "aqu_sz": ([("{avg_latency_ms} >= 10", QUEUE_LATENCY)], PLAIN_QUEUE),
    "saturation_score": ([("true", SATURATION)], SATURATION),
    "latency_pressure": ([("true", LATENCY_PRESSURE)], LATENCY_PRESSURE),
    "total_iops": ([("{avg_request_size_kb} <= 16", SMALL_IOPS)], PLAIN_IOPS),
    "multivariate": ([
        ("{workload_pattern} = 'saturated'", JOINT_SATURATED),
        ("{workload_pattern} = 'write_heavy'", JOINT_WRITE),
        ("{workload_pattern} = 'read_heavy'", JOINT_READ),
    ], PLAIN_JOINT),
}
# Context a hint looks at, with what an absent column counts as.
HINT_INPUTS = {
    "workload_pattern": "'unknown'",
    "util_pct": "0D",
    "aqu_sz": "0D",
    "avg_latency_ms": "0D",
    "read_ratio": "0D",
    "write_ratio": "0D",
    "avg_request_size_kb": "0D",
}


def root_cause_hint(columns: list[str], prefix: str = "") -> str:
    """Sentence explaining an event from `metric_name` and the sample's context.

    `columns` are the names available; `prefix` is put before context names.
    """
    inputs = {name: prefix + name if prefix + name in columns else absent
              for name, absent in HINT_INPUTS.items()}
    arms = " ".join(
        f"WHEN '{metric}' THEN "
        + first_match([(condition.format(**inputs), text) for condition, text in rules], otherwise)
        for metric, (rules, otherwise) in HINTS.items())
    return f"CASE metric_name {arms} ELSE '{UNEXPLAINED}' END"


def event_context(columns: list[str]) -> dict[str, str]:
    """Context columns as stored on an event.

    A ratio of exactly 0 is stored as 0.5; other values, nulls included, are kept.
    """
    context = {}
    for name, absent in EVENT_CONTEXT.items():
        if name not in columns:
            context[name] = f"{absent}D"
        elif absent:
            context[name] = f"CASE WHEN {name} = 0 THEN {absent}D ELSE {name} END"
        else:
            context[name] = name
    return context
