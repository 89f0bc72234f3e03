"""Partial states of the dashboard tables: per device and run, stored, and merged for all runs.

A batch computes the states of its own runs. Counts, sums and extremes merge by adding up; the tail
latencies merge exactly because a state holds how often each latency occurs, not a percentile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spindlewatch.functions.quantiles import search_quantiles
from spindlewatch.operators.runs import count_where
from spindlewatch.schema import NO_ANOMALIES, UNKNOWN_WORKLOAD

RUN = "ingest_run_id"
SUMMED = ["total_iops", "total_throughput_mb_s", "avg_latency_ms", "util_pct", "aqu_sz", "saturation_score"]
LARGEST = ["avg_latency_ms", "util_pct"]


def sample_states(curated: DataFrame) -> DataFrame:
    """Rows, first timestamp, sums with their counts, and maxima."""
    made = [F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("run_time")]
    for m in SUMMED:
        made += [F.sum(m).alias(f"{m}_sum"), F.count(m).alias(f"{m}_n")]
    made += [F.max(m).alias(f"{m}_max") for m in LARGEST]
    return curated.groupBy("device", RUN).agg(*made)


def label_states(curated: DataFrame) -> DataFrame:
    """Samples per workload label."""
    return curated.where("workload_pattern is not null").groupBy("device", RUN, "workload_pattern").agg(
        F.count(F.lit(1)).alias("n"))


def latency_states(curated: DataFrame) -> DataFrame:
    """Samples per latency; NaN counts as missing."""
    known = curated.where("avg_latency_ms is not null and not isnan(avg_latency_ms)")
    return known.groupBy("device", RUN, "avg_latency_ms").agg(F.count(F.lit(1)).alias("n"))


def event_states(events: DataFrame) -> DataFrame:
    """Events per cause and workload: counts by severity, sum and maximum of the scores."""
    return events.groupBy("device", RUN, "root_cause_hint", "workload_pattern").agg(
        F.count(F.lit(1)).alias("n"),
        count_where(F.col("severity") == "critical").alias("critical"),
        count_where(F.col("severity") == "high").alias("high"),
        F.sum("anomaly_score").alias("score_sum"), F.count("anomaly_score").alias("score_n"),
        F.max("anomaly_score").alias("score_max"))


# Name of each state, what it is made from, and how.
STATES = {
    "sample_states": ("curated", sample_states),
    "label_states": ("curated", label_states),
    "latency_states": ("curated", latency_states),
    "event_states": ("events", event_states),
}


def _mean(m: str, name: str) -> Column:
    return (F.sum(f"{m}_sum") / F.nullif(F.sum(f"{m}_n"), F.lit(0))).alias(name)


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be null."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [left[k].eqNullSafe(other[f"_{k}"]) for k in keys]
    return left.join(other, on, "left").drop(*[f"_{k}" for k in keys])


def _dominant(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Most frequent label per key, the smallest on a tie: counts of labels, never the rows."""
    counts = labels.groupBy(*keys, "workload_pattern").agg(F.sum("n").alias("n"))
    return counts.groupBy(*keys).agg(F.min_by("workload_pattern", F.struct(-F.col("n"), "workload_pattern"))
                                     .alias("dominant_workload_pattern"))


def _filled(df: DataFrame, zero: list[str], texts: dict[str, str]) -> DataFrame:
    return df.withColumns({**{c: F.coalesce(c, F.lit(0)) for c in zero},
                           **{c: F.coalesce(c, F.lit(t)) for c, t in texts.items()}})


def device_overview(states: dict[str, DataFrame]) -> DataFrame:
    """The table of `marts.device_overview` for all runs of the states."""
    means = states["sample_states"].groupBy("device").agg(
        F.sum("n").alias("sample_count"), _mean("total_iops", "avg_total_iops"),
        _mean("total_throughput_mb_s", "avg_throughput_mb_s"), _mean("avg_latency_ms", "avg_latency_ms"),
        _mean("util_pct", "avg_util_pct"), _mean("aqu_sz", "avg_queue_depth"))
    tails = search_quantiles(states["latency_states"].select("device", F.col("avg_latency_ms").alias("metric_value"), "n"),
                             ["device"], [0.95, 0.99], "n")
    tails = tails.select("device", F.col("q")[0].alias("p95_latency_ms"), F.col("q")[1].alias("p99_latency_ms"))
    counts = states["event_states"].groupBy("device").agg(
        F.sum("n").alias("anomaly_count"), F.sum("critical").alias("critical_anomaly_count"),
        F.sum("high").alias("high_anomaly_count"))
    made = _joined(means, _dominant(states["label_states"], ["device"]), ["device"])
    made = _joined(_joined(made, tails, ["device"]), counts, ["device"])
    return _filled(made, ["anomaly_count", "critical_anomaly_count", "high_anomaly_count"],
                   {"dominant_workload_pattern": UNKNOWN_WORKLOAD})


def root_cause_summary(states: dict[str, DataFrame]) -> DataFrame:
    """The table of `marts.root_cause_summary`."""
    return states["event_states"].groupBy(RUN, "root_cause_hint", "workload_pattern").agg(
        F.sum("n").alias("anomaly_count"), F.sum("critical").alias("critical_count"),
        F.sum("high").alias("high_count"), F.count("device").alias("affected_devices"),
        (F.sum("score_sum") / F.nullif(F.sum("score_n"), F.lit(0))).alias("avg_anomaly_score"),
    ).orderBy(F.desc("critical_count"), F.desc("anomaly_count"), RUN, "root_cause_hint", "workload_pattern")


def device_run_summary(states: dict[str, DataFrame]) -> DataFrame:
    """The table of `marts.device_run_summary`."""
    keys = ["device", RUN]
    perf = states["sample_states"].groupBy(*keys).agg(
        F.min("run_time").alias("run_time"), _mean("avg_latency_ms", "avg_latency_ms"),
        F.max("avg_latency_ms_max").alias("max_latency_ms"), _mean("util_pct", "avg_util_pct"),
        F.max("util_pct_max").alias("max_util_pct"), _mean("total_iops", "avg_iops"),
        _mean("total_throughput_mb_s", "avg_throughput_mb_s"), _mean("saturation_score", "avg_saturation_score"),
        _mean("aqu_sz", "avg_aqu_sz"))
    per_cause = states["event_states"].groupBy(*keys, "root_cause_hint").agg(
        F.sum("n").alias("n"), F.sum("critical").alias("critical"), F.sum("high").alias("high"))
    incidents = per_cause.groupBy(*keys).agg(
        F.sum("n").alias("total_anomalies"), F.sum("critical").alias("critical_count"),
        F.sum("high").alias("high_count"),
        F.min_by("root_cause_hint", F.struct(-F.col("n"), F.col("root_cause_hint").isNull(), "root_cause_hint"))
        .alias("top_root_cause"))
    made = _joined(_joined(perf, _dominant(states["label_states"], keys), keys), incidents, keys)
    return _filled(made, ["total_anomalies", "critical_count", "high_count"],
                   {"dominant_workload_pattern": UNKNOWN_WORKLOAD, "top_root_cause": NO_ANOMALIES})


def run_summary(states: dict[str, DataFrame], raw_runs: DataFrame) -> DataFrame:
    """The table of `marts.run_summary`; raw rows come from the register of the raw table."""
    samples = states["sample_states"].where(F.col(RUN).isNotNull()).groupBy(RUN).agg(F.sum("n").alias("curated_rows"))
    incidents = states["event_states"].where(F.col(RUN).isNotNull()).groupBy(RUN).agg(
        F.sum("n").alias("anomaly_rows"), F.count_distinct("device").alias("affected_devices"),
        F.sum("critical").alias("critical_anomalies"), F.sum("high").alias("high_anomalies"),
        F.max("score_max").alias("max_anomaly_score"))
    source = raw_runs.select(RUN, F.col("n_rows").alias("raw_rows"))
    return _filled(samples.join(incidents, RUN).join(source, RUN, "left"), ["raw_rows"], {}).select(
        RUN, "raw_rows", "curated_rows", "anomaly_rows", "affected_devices", "critical_anomalies",
        "high_anomalies", "max_anomaly_score")
