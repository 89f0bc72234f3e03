"""Rolling baselines and outlier detectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from spindlewatch.functions.quantiles import grouped_statistics, without_nan
from spindlewatch.functions.rolling import rolling
from spindlewatch.functions.rules import (
    HINT_INPUTS, assign_severity, event_context, root_cause_hint, severity_of,
)
from spindlewatch.schema import (
    COMBINED_METRICS, DETECTION_SCHEMA, EVENT_CONTEXT, EVENT_SCHEMA, IQR_MULTIPLIER,
    MIN_GROUP_VALUES, ROLLING_WINDOW, ZSCORE_THRESHOLD,
)
from spindlewatch.session import stage


def _present(df: DataFrame, names: list[str]) -> list[str]:
    return [name for name in names if name in df.columns]


def lineage(df: DataFrame) -> list[str]:
    """Source file and run id, null when the frame has none."""
    return [f"{c if c in df.columns else 'CAST(NULL AS STRING)'} AS {c}"
            for c in ("source_file", "ingest_run_id")]


def add_rolling_baselines(df: DataFrame, metrics: list[str], window: int = ROLLING_WINDOW,
                          chunks: int | None = None) -> DataFrame:
    """Rolling mean and sample deviation per device over the last `window` rows.

    Null until two values are present. Rows with equal timestamps are ordered by run, then
    by the metrics, so the result does not depend on partitioning.
    """
    def columns(frame):
        added = {}
        for metric in metrics:
            enough = F.count(metric).over(frame) >= 2
            added[f"{metric}_rolling_mean"] = F.when(enough, F.avg(metric).over(frame))
            added[f"{metric}_rolling_std"] = F.when(enough, F.stddev_samp(metric).over(frame))
        return added

    order = ["timestamp", *_present(df, ["ingest_run_id"]), *metrics]
    return rolling(without_nan(df, metrics), "device", order, window - 1, columns, chunks)


def _one_row_per_metric(df: DataFrame, carried: list[str], per_metric: list[str]) -> DataFrame:
    """Turn candidate rows into one row per metric that passed; `keep` marks those."""
    return (
        df.selectExpr(*carried, f"explode(array({', '.join(per_metric)})) AS _m")
        .where("_m.keep")
        .select("*", "_m.*").drop("_m", "keep")
    )


def _as_detections(long: DataFrame, detector: str, details: str) -> DataFrame:
    made = {"detector_type": f"'{detector}'", "details": details,
            "severity": "CAST(NULL AS STRING)", "is_anomaly": "1"}
    return long.selectExpr(*[
        f"{made.get(name, name)} AS {name}" for name in DETECTION_SCHEMA.fieldNames()])


def detect_rolling_zscore(df: DataFrame, metrics: list[str],
                          threshold: float = ZSCORE_THRESHOLD) -> DataFrame:
    """Events where a value is `threshold` rolling deviations from its rolling mean.

    Needs the columns of `add_rolling_baselines`. The score keeps its sign. A window of w
    rows that contains the value itself cannot exceed (w - 1) / sqrt(w) deviations.
    """
    def score(m: str) -> str:
        return f"(({m} - {m}_rolling_mean) / nullif({m}_rolling_std, 0D))"

    def flagged(m: str) -> str:
        return f"coalesce(abs({score(m)}) >= {threshold}D, false)"

    inputs = [c for m in metrics for c in (m, f"{m}_rolling_mean", f"{m}_rolling_std")]
    rows = without_nan(df, inputs).where(" OR ".join(flagged(m) for m in metrics))
    long = _one_row_per_metric(rows, ["device", "timestamp", *lineage(df)], [
        f"named_struct('metric_name', '{m}', 'metric_value', {m}, "
        f"'anomaly_score', {score(m)}, 'keep', {flagged(m)})" for m in metrics])
    return _as_detections(long, "rolling_zscore", "format_string('zscore=%.2f', anomaly_score)")


def _with_fences(df: DataFrame, metrics: list[str], multiplier: float, threshold: float | None,
                 min_values: int) -> DataFrame:
    """Rows that may be outliers, each with its device's statistics as `_<metric>`.

    Per device and metric the statistics include the fences, and `low` and `high`: values
    between them cannot be flagged by either test. The z-score limits are taken a hair
    inside so that rounding cannot hide a row; the exact tests come later, on few rows.
    The statistics are one row per device, so a sample is probed once for all its metrics.
    Rows without a device belong to no group and drop out.
    """
    stats = grouped_statistics(df, ["device"], metrics, [0.25, 0.75])

    def fenced(m: str) -> str:
        iqr = f"({m}.q[1] - {m}.q[0])"
        lower, upper = f"({m}.q[0] - {multiplier}D * {iqr})", f"({m}.q[1] + {multiplier}D * {iqr})"
        low, high = lower, upper
        if threshold is not None:
            reach = f"nullif({m}.std, 0D) * {threshold * (1 - 1e-9)!r}D"
            low, high = f"greatest({lower}, {m}.mean - {reach})", f"least({upper}, {m}.mean + {reach})"
        enough = f"{m}.n >= {min_values}"
        return (f"named_struct('mean', {m}.mean, 'std', {m}.std, 'q1', {m}.q[0], 'q3', {m}.q[1], "
                f"'iqr', {iqr}, 'lower', {lower}, 'upper', {upper}, "
                f"'low', CASE WHEN {enough} THEN {low} END, "
                f"'high', CASE WHEN {enough} THEN {high} END) AS _{m}")

    fences = stats.selectExpr("device", *[fenced(m) for m in metrics])
    joined = without_nan(df, metrics).join(fences, "device")
    return joined.where(" OR ".join(
        f"coalesce({m} < _{m}.low OR {m} > _{m}.high, false)" for m in metrics))


def detect_iqr(df: DataFrame, metrics: list[str], multiplier: float = IQR_MULTIPLIER) -> DataFrame:
    """Events outside the interquartile fences of their device and metric.

    The score is the distance past the fence in interquartile units, 0 when that unit is 0.
    """
    def evidence(m: str) -> str:
        s = f"_{m}"
        past = f"CASE WHEN {m} > {s}.upper THEN {m} - {s}.upper ELSE {s}.lower - {m} END"
        return (f"named_struct('metric_name', '{m}', 'metric_value', {m}, "
                f"'anomaly_score', coalesce(({past}) / nullif({s}.iqr, 0D), 0D), "
                f"'lower', {s}.lower, 'upper', {s}.upper, "
                f"'keep', {m} < {s}.lower OR {m} > {s}.upper)")

    rows = _with_fences(df, metrics, multiplier, None, 1)
    long = _one_row_per_metric(rows, ["device", "timestamp", *lineage(df)],
                               [evidence(m) for m in metrics])
    return _as_detections(long, "iqr", "format_string('lower=%.2f, upper=%.2f', lower, upper)")


def detect_combined(df: DataFrame, metrics: list[str] | None = None,
                    threshold: float = ZSCORE_THRESHOLD, multiplier: float = IQR_MULTIPLIER,
                    min_values: int = MIN_GROUP_VALUES) -> DataFrame:
    """The pipeline's detector: device-wide z-score and interquartile fences together.

    Returns complete events: graded, explained and with the sample's context. Samples with
    no outlying metric are dropped before rows are made per metric.
    """
    metrics = _present(df, COMBINED_METRICS) if metrics is None else metrics
    rows = _with_fences(df, metrics, multiplier, threshold, min_values)
    context = [f"{e} AS {name}" for name, e in event_context(df.columns).items()]
    inputs = [f"{name} AS hint_{name}" for name in _present(df, list(HINT_INPUTS))]
    pattern = "workload_pattern" if "workload_pattern" in df.columns else "'balanced'"
    long = _one_row_per_metric(
        rows, ["device", "timestamp", *lineage(df), f"{pattern} AS workload_pattern", *context, *inputs],
        [f"named_struct('metric_name', '{m}', 'metric_value', {m}, 'stats', _{m}, "
         f"'keep', coalesce({m} < _{m}.low OR {m} > _{m}.high, false))" for m in metrics])
    tested = long.selectExpr(
        "*", "coalesce((metric_value - stats.mean) / nullif(stats.std, 0D), 0D) AS z_score"
    ).selectExpr(
        "*", "abs(z_score) AS anomaly_score", f"abs(z_score) >= {threshold}D AS by_z",
        "metric_value < stats.lower OR metric_value > stats.upper AS by_iqr"
    ).where("by_z OR by_iqr")
    made = {
        "detector_type": "CASE WHEN by_z AND by_iqr THEN 'zscore+iqr' WHEN by_z THEN 'zscore' ELSE 'iqr' END",
        "severity": severity_of("rolling_zscore"),
        "is_anomaly": "1",
        "details": "to_json(named_struct('mean', stats.mean, 'std', stats.std, 'q1', stats.q1, "
                   "'q3', stats.q3, 'iqr', stats.iqr, 'lower_bound', stats.lower, "
                   "'upper_bound', stats.upper, 'z_score', z_score))",
        "root_cause_hint": root_cause_hint(tested.columns, "hint_"),
    }
    return tested.selectExpr(*[f"{made.get(name, name)} AS {name}" for name in EVENT_SCHEMA.fieldNames()])


def with_sample_context(events: DataFrame, curated: DataFrame, columns: list[str],
                        rename: dict[str, str] | None = None) -> DataFrame:
    """Events with `columns` of the sample they were found in, null when it is unknown.

    Matched on device and timestamp, and on the run when both sides carry one. Each sample
    gives one context, the smallest if it is stored repeatedly, so overlapping runs and
    copies never multiply events. Samples are first reduced to those that share a key with an
    event, and only these are folded. The events are staged, so that the reduction broadcasts
    their keys while they are small.
    """
    keys = {"_device": "device", "_timestamp": "timestamp"}
    if "ingest_run_id" in events.columns and "ingest_run_id" in curated.columns:
        keys["_run"] = "coalesce(ingest_run_id, '')"
    events = stage(events, "detections")
    named = [f"{expression} AS {name}" for name, expression in keys.items()]
    wanted = stage(events.selectExpr(*named).distinct(), "event-keys")
    context = curated.selectExpr(
        *named, f"struct({', '.join(columns)}) AS _context"
    ).join(wanted, list(keys), "left_semi").groupBy(*keys).agg(F.min("_context").alias("_context"))
    match = " AND ".join(f"{expression} = {name}" for name, expression in keys.items())
    rename = rename or {}
    return events.join(context, F.expr(match), "left").select(
        *events.columns, *[F.col(f"_context.{c}").alias(rename.get(c, c)) for c in columns])


def enrich_events(events: DataFrame, curated: DataFrame) -> DataFrame:
    """Add the sample's context to bare detections and explain them."""
    bare = events.drop("workload_pattern", "root_cause_hint", *EVENT_CONTEXT)
    joined = with_sample_context(bare, curated, ["workload_pattern", *EVENT_CONTEXT])
    return joined.withColumn("root_cause_hint", F.expr(root_cause_hint(joined.columns)))


def graded(detections: DataFrame, curated: DataFrame) -> DataFrame:
    """Bare detections as complete events: graded by their detector and enriched."""
    return enrich_events(assign_severity(detections), curated).select(*EVENT_SCHEMA.fieldNames())


def union_events(*parts: DataFrame) -> DataFrame:
    """One events table from several detectors; columns a detector lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
