"""Data profiles of curated samples and events."""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, functions as F, types as T

from spindlewatch.functions.quantiles import grouped_statistics, without_nan
from spindlewatch.functions.rounding import reported
from spindlewatch.operators.detect import with_sample_context
from spindlewatch.operators.runs import count_where

# --- Fixed values: the columns each profile looks at ---
DESCRIBED = [
    "total_iops", "avg_latency_ms", "util_pct", "aqu_sz", "saturation_score", "read_ratio",
    "write_ratio", "throughput_mb_s", "iops_total", "merge_rate_total", "merge_efficiency",
    "await_ratio", "svctm_await_ratio", "queue_efficiency", "write_amplification",
    "iowait_pressure",
]
EXPLORED = [
    "total_iops", "avg_latency_ms", "util_pct", "aqu_sz", "saturation_score", "merge_efficiency",
    "queue_efficiency", "iowait_pressure", "svctm_await_ratio", "write_amplification",
]
QUANTILES = [0.5, 0.9, 0.95, 0.99]
QUANTILE_METRICS = [
    "avg_latency_ms", "total_iops", "merge_efficiency", "queue_efficiency", "iowait_pressure",
]
DEVICE_MEANS = [
    "total_iops", "avg_latency_ms", "util_pct", "merge_efficiency", "queue_efficiency",
    "iowait_pressure", "svctm_await_ratio", "write_amplification",
]
HOUR_MEANS = [
    "total_iops", "avg_latency_ms", "iowait_pressure", "merge_efficiency", "queue_efficiency",
]
WORKLOAD_MEANS = [
    "total_iops", "avg_latency_ms", "saturation_score", "merge_efficiency", "queue_efficiency",
    "iowait_pressure", "svctm_await_ratio", "write_amplification",
]
CORRELATED = [
    "total_iops", "avg_latency_ms", "util_pct", "aqu_sz", "saturation_score",
    "merge_efficiency", "queue_efficiency", "iowait_pressure", "svctm_await_ratio",
]
SLOWEST_COLUMNS = [
    "device", "timestamp", "avg_latency_ms", "aqu_sz", "util_pct", "merge_efficiency",
    "queue_efficiency", "iowait_pressure", "workload_pattern",
]
CONTEXT_COLUMNS = [
    "merge_efficiency", "queue_efficiency", "iowait_pressure", "svctm_await_ratio",
    "write_amplification", "workload_pattern", "saturation_score",
]
FOCUS_METRICS = [
    "iowait_pressure", "merge_efficiency", "queue_efficiency", "avg_latency_ms",
    "saturation_score",
]
HISTOGRAM_BINS = 50
# --- End of fixed values ---


def _rows(df: DataFrame, structs: list[str]) -> DataFrame:
    """Turn a one-row frame into one row per struct expression."""
    return df.selectExpr(f"inline(array({', '.join(structs)}))")


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and upper percentiles, one row per column."""
    columns = [c for c in (columns or DESCRIBED) if c in df.columns]
    # The extremes are the percentiles 0 and 1, and the sample deviation follows from the
    # population one, so one set of statistics serves every figure.
    stats = grouped_statistics(df, [], columns, [0.0, *QUANTILES, 1.0])
    last = len(QUANTILES) + 1
    return _rows(stats, [
        f"named_struct('metric_name', '{c}', 'count', {c}.n, 'mean', {c}.mean, "
        f"'std', {c}.std * sqrt({c}.n / nullif({c}.n - 1, 0)), 'min', {c}.q[0], "
        + ", ".join(f"'p{int(p * 100)}', {c}.q[{i}]" for i, p in enumerate(QUANTILES, 1))
        + f", 'max', {c}.q[{last}])" for c in columns])


def null_and_distinct(df: DataFrame, error: float | None = None) -> DataFrame:
    """Percent of nulls and number of distinct values per column.

    Exact by default: distinct values are counted from (column, value) pairs, deduplicated
    map-side and spread over all tasks, since counting each column apart would copy every
    row once per column. That still shuffles every different value; with `error`, the
    allowed relative deviation, one pass without that shuffle estimates the counts.
    """
    numbers = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    others = [f.name for f in df.schema if f.name not in numbers]
    missing = {c: f"{c} IS NULL OR isnan({c})" if c in numbers else f"{c} IS NULL" for c in df.columns}
    figures = "'null_pct', round(round(count_if({test}) * 100D / count(1), 9), 2)"
    if error is not None:
        figures += f", 'n_distinct', approx_count_distinct(IF({{test}}, NULL, {{c}}), {error})"
    nulls = _rows(
        df.agg(*[F.expr(f"named_struct('column_name', '{c}', {figures.format(c=c, test=test)})").alias(c)
                 for c, test in missing.items()]), df.columns)
    if error is not None:
        return nulls.orderBy(F.desc("null_pct"), "column_name")

    def pairs(names: list[str], value: str) -> DataFrame:
        return df.selectExpr(*[f"{value.format(c=c)} AS {c}" for c in names]).unpivot([], names, "column_name", "value").where(
            F.col("value").isNotNull()).distinct().groupBy("column_name").agg(
            F.count(F.lit(1)).alias("n_distinct"))

    parts = []
    if others:
        parts.append(pairs(others, "CAST({c} AS STRING)"))
    if numbers:
        parts.append(pairs(numbers, "nullif(CAST({c} AS DOUBLE), double('NaN'))"))
    distinct = reduce(DataFrame.union, parts)
    return nulls.join(distinct, "column_name", "left").withColumn(
        "n_distinct", F.coalesce("n_distinct", F.lit(0))).orderBy(F.desc("null_pct"), "column_name")


def quantile_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per quantile, one column per metric."""
    columns = columns or QUANTILE_METRICS
    stats = grouped_statistics(df, [], columns, QUANTILES)
    return _rows(stats, [
        f"named_struct('quantile', {p}D, " + ", ".join(f"'{c}', {c}.q[{i}]" for c in columns) + ")"
        for i, p in enumerate(QUANTILES)])


def means_by(df: DataFrame, key: str, columns: list[str], digits: int) -> DataFrame:
    """Rounded metric means per value of `key`, slowest first."""
    return df.groupBy(key).agg(*[reported(F.avg(c), digits).alias(c) for c in columns]).orderBy(
        F.desc("avg_latency_ms"), key)


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Correlation matrix in long form, both halves and the diagonal, from one pass.

    Each row is stacked into its pairs and folded into one running correlation per pair
    before anything is shuffled.
    """
    columns = columns or CORRELATED
    pairs = list(combinations_with_replacement(columns, 2))
    stacked = ", ".join(f"'{a}', '{b}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)" for a, b in pairs)
    half = df.selectExpr(f"stack({len(pairs)}, {stacked}) AS (metric_a, metric_b, x, y)").groupBy(
        "metric_a", "metric_b").agg(F.corr("x", "y").alias("correlation"))
    mirrored = ("CASE WHEN metric_a = metric_b THEN array(struct(metric_a, metric_b)) ELSE "
                "array(struct(metric_a, metric_b), struct(metric_b AS metric_a, metric_a AS metric_b)) END")
    return half.selectExpr("correlation", f"inline({mirrored})").select(
        "metric_a", "metric_b", "correlation")


def histogram(df: DataFrame, column: str = "avg_latency_ms", bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts in equal bins from the minimum to the maximum, empty bins included."""
    values = without_nan(df.select(column), [column])
    # A constant column gets a unit-wide range around its value.
    ends = values.selectExpr(f"min({column}) AS low", f"max({column}) AS high").selectExpr(
        "struct(low - IF(low = high, 0.5D, 0D) AS low, high + IF(low = high, 0.5D, 0D) AS high) AS e")
    counts = values.withColumn("e", ends.scalar()).selectExpr(
        column, f"CAST(least(floor(({column} - e.low) / (e.high - e.low) * {bins}), {bins - 1}) AS INT) AS bin"
    ).groupBy("bin").agg(F.count(column).alias("n"))
    # At most one entry per bin, so the counts fit in one map.
    by_bin = counts.agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))))
    return ends.withColumn("counts", by_bin.scalar()).selectExpr(
        "e", "counts", f"explode(sequence(0, {bins - 1})) AS bin"
    ).selectExpr(
        "bin", f"e.low + bin * ((e.high - e.low) / {bins}) AS lower_edge",
        f"e.low + (bin + 1) * ((e.high - e.low) / {bins}) AS upper_edge",
        "coalesce(counts[bin], 0L) AS n").orderBy("bin")


def above_p99(df: DataFrame, column: str = "avg_latency_ms") -> DataFrame:
    """Rows above the column's overall 99th percentile; NaN counts as missing."""
    stats = grouped_statistics(df, [], [column], [0.99])
    high = F.col(column) > stats.select(F.col(column).q[0]).scalar()
    return df.where(high & ~F.isnan(F.col(column))).select(*SLOWEST_COLUMNS)


def top_rows(df: DataFrame, by: str, n: int, *tie_break: str) -> DataFrame:
    """The `n` rows with the largest value of `by`."""
    return df.orderBy(F.desc(by), *tie_break).limit(n)


def frequencies(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per value, or combination of values, nulls included, most frequent first."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *columns)


def frequency_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Frequencies of several columns in long form, from one pass over the rows."""
    named = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return named.unpivot([], columns, "column_name", "value").groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("n"))


def severity_pivot(events: DataFrame, severities: list[str], metrics: list[str] | None = None) -> DataFrame:
    """Events per metric, one column per severity, absent cells 0."""
    chosen = events.where(F.col("metric_name").isin(*(metrics or FOCUS_METRICS)))
    return chosen.groupBy("metric_name").pivot("severity", severities).count().fillna(0).orderBy("metric_name")


def device_coverage(datasets: dict[str, DataFrame], reference: str) -> DataFrame:
    """Per dataset: how many devices it has and how many of the reference's it misses."""
    def devices(name: str) -> DataFrame:
        return datasets[name].where(F.col("device").isNotNull()).select(
            F.lit(name).alias("dataset"), "device").distinct()

    present = reduce(DataFrame.union, [devices(name) for name in datasets])
    expected = devices(reference).select(
        F.explode(F.array(*map(F.lit, datasets))).alias("dataset"), "device")
    counted = present.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_devices"))
    absent = expected.join(present, ["dataset", "device"], "left_anti").groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_missing"))
    return counted.join(absent, "dataset", "left").withColumn(
        "n_missing", F.coalesce("n_missing", F.lit(0))).orderBy("dataset")


def missing_devices(datasets: dict[str, DataFrame], reference: str) -> DataFrame:
    """The reference's devices that other datasets lack."""
    expected = datasets[reference].where(F.col("device").isNotNull()).select("device").distinct()
    return reduce(DataFrame.union, [
        expected.join(frame.select("device"), "device", "left_anti").select(
            F.lit(name).alias("dataset"), "device")
        for name, frame in datasets.items() if name != reference])


def events_in_context(events: DataFrame, curated: DataFrame) -> DataFrame:
    """Events beside the sample's other metrics, worst first.

    Columns both sides have keep the event's value; the sample's gets the suffix `_sample`.
    """
    shared = {c: f"{c}_sample" for c in CONTEXT_COLUMNS if c in events.columns}
    return with_sample_context(events, curated, CONTEXT_COLUMNS, shared).orderBy(
        F.desc("anomaly_score"), "device", "timestamp", "metric_name")


def event_series(events: DataFrame, unit: str = "hour") -> DataFrame:
    """Events and critical events over time."""
    return events.groupBy(F.date_trunc(unit, "timestamp").alias("period")).agg(
        F.count(F.lit(1)).alias("events"),
        count_where(F.col("severity") == "critical").alias("critical_events"),
        F.count_distinct("device").alias("devices"),
    ).orderBy("period")


def critical_events(events: DataFrame) -> DataFrame:
    """Critical events in time order."""
    return events.where(F.col("severity") == "critical").select(
        "device", "timestamp", "metric_name", "severity", "workload_pattern", "root_cause_hint"
    ).orderBy("timestamp", "device", "metric_name")


def latest_events(events: DataFrame, n: int = 50) -> DataFrame:
    """The newest events."""
    return events.orderBy(F.desc("timestamp"), "device", "metric_name").limit(n)
