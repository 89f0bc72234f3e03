"""Ready-made questions over curated samples, events and the dashboard tables.

`runs` is the device-run summary and `causes` the root-cause summary of `marts`. Questions about
the latest run find it in `register`, the register of the table's runs, or else in the table. Every
ordering that precedes a limit is total, so answers are repeatable.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from spindlewatch.functions.quantiles import grouped_statistics
from spindlewatch.functions.rounding import reported
from spindlewatch.functions.rules import severity_rank
from spindlewatch.operators.runs import count_where, only_latest

# --- Fixed values: words used in answers ---
BUSINESS_HOURS = (9, 17)
INCREASED, DECREASED, UNCHANGED, FLAT = "increased", "decreased", "unchanged", "stayed flat"
UP, DOWN = "up", "down"
WORSE = "Yes, it is getting worse"
NOT_WORSE = "No, it is not getting worse"
NO_TREND = "No clear worsening trend"
# --- End of fixed values ---


def _named(column: str, text: str) -> Column:
    return F.col(column).ilike(text)


def _is_critical() -> Column:
    return _named("severity", "critical")


def _of_latest(table: DataFrame, source: DataFrame | None) -> DataFrame:
    return only_latest(table, table if source is None else source)


def critical_devices(events: DataFrame, register: DataFrame | None = None) -> DataFrame:
    """Devices with critical events in the latest run."""
    return _of_latest(events, register).where(_is_critical()).select("device").distinct()


def utilization_ranking(runs: DataFrame, curated: DataFrame) -> DataFrame:
    """Devices by mean utilization in the latest run."""
    return _of_latest(runs, curated).select("device", "avg_util_pct").orderBy(
        F.desc("avg_util_pct"), "device")


def device_history(runs: DataFrame, device: str) -> DataFrame:
    """One device over all runs."""
    return runs.where(_named("device", device)).select(
        "device", "ingest_run_id", "run_time", "avg_latency_ms", "avg_util_pct", "avg_iops",
        "avg_throughput_mb_s", "avg_saturation_score", "top_root_cause").orderBy("run_time", "ingest_run_id")


def compare_devices(runs: DataFrame, first: str, second: str) -> DataFrame:
    """Latency and utilization of two devices over all runs."""
    return runs.where(_named("device", first) | _named("device", second)).select(
        "device", "ingest_run_id", "run_time", "avg_latency_ms", "avg_util_pct"
    ).orderBy("device", "run_time", "ingest_run_id")


def best_devices(runs: DataFrame, n: int = 5) -> DataFrame:
    """Devices with the fewest events over all runs."""
    return runs.groupBy("device").agg(
        F.sum("total_anomalies").alias("total_anomalies"),
        reported(F.avg("avg_latency_ms"), 2).alias("avg_latency"),
    ).orderBy("total_anomalies", "device").limit(n)


def device_trend(runs: DataFrame, device: str) -> DataFrame:
    """Events, latency and saturation of one device, run by run."""
    return runs.where(_named("device", device)).select(
        "ingest_run_id", "run_time", "total_anomalies", "critical_count", "avg_latency_ms",
        "avg_saturation_score").orderBy("run_time", "ingest_run_id")


def explain_device(runs: DataFrame, curated: DataFrame, device: str) -> DataFrame:
    """Why a device is slow in the latest run: its performance and top cause."""
    return _of_latest(runs, curated).where(_named("device", device)).select(
        "device", "avg_latency_ms", "avg_util_pct", "avg_iops", "avg_saturation_score",
        "avg_aqu_sz", "top_root_cause", "dominant_workload_pattern")


def _cause_order() -> list[Column | str]:
    return [F.desc("critical_count"), F.desc("anomaly_count"), "root_cause_hint", "workload_pattern"]


def top_causes(causes: DataFrame, events: DataFrame, n: int = 10) -> DataFrame:
    """Worst causes of the latest run."""
    return _of_latest(causes, events).select(
        "root_cause_hint", "workload_pattern", "anomaly_count", "critical_count", "affected_devices"
    ).orderBy(*_cause_order()).limit(n)


def cause_trend(causes: DataFrame) -> DataFrame:
    """Causes of every run."""
    return causes.select(
        "ingest_run_id", "root_cause_hint", "workload_pattern", "anomaly_count", "critical_count"
    ).orderBy("ingest_run_id", *_cause_order())


def slow_and_queued(curated: DataFrame, latency: float = 10, queue: float = 2, register: DataFrame | None = None) -> DataFrame:
    """Samples of the latest run with high latency and a deep queue at once."""
    return _of_latest(curated, register).where(
        (F.col("avg_latency_ms") > latency) & (F.col("aqu_sz") > queue)
    ).select("device", "timestamp", "avg_latency_ms", "aqu_sz").orderBy(
        F.desc("avg_latency_ms"), "device", "timestamp")


def multi_detector_devices(events: DataFrame, at_least: int = 3, register: DataFrame | None = None) -> DataFrame:
    """Devices flagged under several detector labels in the latest run."""
    return _of_latest(events, register).groupBy("device").agg(
        F.count_distinct("detector_type").alias("detector_count")
    ).where(F.col("detector_count") >= at_least)


def business_hours(events: DataFrame, device: str) -> DataFrame:
    """Events of one device within and outside business hours."""
    period = F.when(F.hour("timestamp").between(*BUSINESS_HOURS), "business_hours").otherwise("off_hours")
    return events.where(_named("device", device)).groupBy(period.alias("period")).agg(
        F.count(F.lit(1)).alias("anomaly_count")).orderBy(F.desc("anomaly_count"), "period")


def critical_share(events: DataFrame, patterns: tuple[str, ...] = ("write_heavy", "read_heavy")) -> DataFrame:
    """Share of critical events per workload, in percent."""
    critical, total = count_where(_is_critical()), F.count(F.lit(1))
    return events.where(F.col("workload_pattern").isin(*patterns)).groupBy("workload_pattern").agg(
        total.alias("total"),
        critical.alias("critical_count"),
        reported(critical * 100.0 / total, 1).alias("critical_pct"),
    ).orderBy(F.desc("critical_pct"), "workload_pattern")


def score_p95(events: DataFrame) -> DataFrame:
    """95th percentile of the event score per device."""
    stats = grouped_statistics(events, ["device"], ["anomaly_score"], [0.95])
    return stats.select(
        "device", reported(F.col("anomaly_score").q[0], 3).alias("p95_score")
    ).orderBy(F.desc("p95_score"), "device")


def last_two_runs(runs: DataFrame) -> DataFrame:
    """Critical events of the two newest runs, older first."""
    per_run = runs.groupBy("ingest_run_id").agg(
        F.min("run_time").alias("run_time"), F.sum("critical_count").alias("critical_count"))
    return per_run.orderBy(F.desc("run_time"), "ingest_run_id").limit(2).orderBy(
        "run_time", "ingest_run_id")


def worst_sample(curated: DataFrame) -> DataFrame:
    """The sample with the worst mix of latency, queue and utilization."""
    stress = reported(
        F.col("avg_latency_ms") * 0.4 + F.col("aqu_sz") * 30.0 + F.col("util_pct") * 0.3, 2)
    return curated.select(
        "device", "timestamp", "avg_latency_ms", "aqu_sz", "util_pct", stress.alias("composite_stress")
    ).orderBy(F.desc("composite_stress"), "timestamp", "device").limit(1)


def worst_events(events: DataFrame, n: int = 25, register: DataFrame | None = None) -> DataFrame:
    """Most severe events of the latest run, by rank and then score."""
    return _of_latest(events, register).orderBy(
        severity_rank(F.col("severity")).desc(), F.desc("anomaly_score"),
        "device", "timestamp", "metric_name"
    ).limit(n).select("device", "timestamp", "metric_name", "severity", "anomaly_score", "root_cause_hint")


def severity_breakdown(events: DataFrame, register: DataFrame | None = None) -> DataFrame:
    """Events per device and severity in the latest run."""
    return _of_latest(events, register).groupBy("device", "severity").agg(
        F.count(F.lit(1)).alias("count")).orderBy("device", F.desc("count"), "severity")


def causes_matching(causes: DataFrame, events: DataFrame, text: str, n: int = 10) -> DataFrame:
    """Causes of the latest run whose sentence contains `text`."""
    return _of_latest(causes, events).where(_named("root_cause_hint", f"%{text}%")).select(
        "ingest_run_id", "workload_pattern", "root_cause_hint", "anomaly_count", "critical_count"
    ).orderBy(F.desc("anomaly_count"), F.desc("critical_count"), "root_cause_hint", "workload_pattern").limit(n)


def saturation_slope(curated: DataFrame) -> DataFrame:
    """Slope of mean saturation over the run number, per device."""
    per_run = curated.groupBy("device", "ingest_run_id").agg(
        F.min("timestamp").alias("run_time"), F.avg("saturation_score").alias("avg_saturation"))
    # One row per run, so the window holds a device's runs, not its samples.
    numbered = per_run.withColumn("run_num", F.row_number().over(
        Window.partitionBy("device").orderBy("run_time", "ingest_run_id")))
    return numbered.groupBy("device").agg(
        reported(F.regr_slope("avg_saturation", "run_num"), 4).alias("saturation_slope")
    ).orderBy(F.desc("saturation_slope"), "device")


def queued_but_not_busy(events: DataFrame, below: float = 70, register: DataFrame | None = None) -> DataFrame:
    """Queue-caused events of the latest run on devices that were not busy."""
    return _of_latest(events, register).where(
        _named("root_cause_hint", "%queue%") & (F.col("util_pct") < below)
    ).select("device", "timestamp", "metric_name", "severity", "util_pct", "root_cause_hint",
             "anomaly_score").orderBy(F.desc("anomaly_score"), "device", "timestamp", "metric_name"
                                      ).drop("anomaly_score")


def saturation_hours(events: DataFrame, n: int = 5) -> DataFrame:
    """Hours of the day with most saturation events."""
    return events.where(_named("metric_name", "%saturation%")).groupBy(
        F.hour("timestamp").alias("hour_of_day")).agg(F.count(F.lit(1)).alias("event_count")
    ).orderBy(F.desc("event_count"), "hour_of_day").limit(n)


def top_causes_per_run(causes: DataFrame, n: int = 3) -> DataFrame:
    """Worst causes of each run; a run has at most a few dozen cause and workload pairs."""
    rank = F.row_number().over(Window.partitionBy("ingest_run_id").orderBy(*_cause_order()))
    return causes.withColumn("rank_in_run", rank).where(F.col("rank_in_run") <= n).select(
        "ingest_run_id", "root_cause_hint", "workload_pattern", "anomaly_count", "critical_count",
        "affected_devices", reported("avg_anomaly_score", 3).alias("avg_anomaly_score"), "rank_in_run"
    ).orderBy("ingest_run_id", "rank_in_run")


def performance_with_cause(curated: DataFrame, events: DataFrame, devices: list[str] | None = None,
                           per_run: bool = True, register: DataFrame | None = None,
                           event_register: DataFrame | None = None) -> DataFrame:
    """Performance per device, and per run unless only the latest is wanted, with its top cause."""
    keys = ["device", "ingest_run_id"] if per_run else ["device"]
    if not per_run:
        curated, events = _of_latest(curated, register), _of_latest(events, event_register)
    if devices:
        wanted = F.lower("device").isin(*[d.lower() for d in devices])
        curated, events = curated.where(wanted), events.where(wanted)
    perf = curated.groupBy(*keys).agg(
        F.min("timestamp").alias("run_time"),
        reported(F.avg("avg_latency_ms"), 2).alias("avg_latency_ms"),
        reported(F.avg("util_pct"), 2).alias("avg_util_pct"),
        reported(F.avg("total_iops"), 0).alias("avg_iops"),
        reported(F.avg("total_throughput_mb_s"), 2).alias("avg_throughput_mb_s"),
        reported(F.avg("saturation_score"), 3).alias("avg_saturation"),
    )
    per_cause = events.groupBy(*keys, "root_cause_hint", "workload_pattern").agg(
        F.count(F.lit(1)).alias("n"), count_where(_is_critical()).alias("critical"))
    top = per_cause.groupBy(*keys).agg(F.min_by(
        F.struct("root_cause_hint", "workload_pattern", "n"),
        F.struct(-F.col("n"), -F.col("critical"), "root_cause_hint", "workload_pattern")).alias("top"))
    return perf.join(top, keys, "left").select(
        *keys, "run_time", "avg_latency_ms", "avg_util_pct", "avg_iops", "avg_throughput_mb_s",
        "avg_saturation", F.col("top.root_cause_hint").alias("top_root_cause"),
        F.col("top.workload_pattern").alias("root_cause_workload"),
        F.col("top.n").alias("root_cause_events"))


def causes_this_month(events: DataFrame, as_of: datetime, n: int = 10) -> DataFrame:
    """Causes since the start of the month of `as_of`."""
    start = F.date_trunc("month", F.lit(as_of).cast("timestamp"))
    return events.where(F.col("timestamp") >= start).groupBy("root_cause_hint").agg(
        F.count(F.lit(1)).alias("occurrences")).orderBy(F.desc("occurrences"), "root_cause_hint").limit(n)


def events_per_run(events: DataFrame) -> DataFrame:
    """Event count per run in time order."""
    return events.groupBy("ingest_run_id").agg(
        F.min("timestamp").alias("run_time"), F.count(F.lit(1)).alias("anomaly_count")
    ).orderBy("run_time", "ingest_run_id")


def read_write_ratios(curated: DataFrame, register: DataFrame | None = None) -> DataFrame:
    """Mean read and write ratio per device in the latest run."""
    return _of_latest(curated, register).groupBy("device").agg(
        reported(F.avg("read_ratio"), 3).alias("avg_read_ratio"),
        reported(F.avg("write_ratio"), 3).alias("avg_write_ratio"),
    ).orderBy(F.desc("avg_read_ratio"), "device")


def saturation_by_device(curated: DataFrame, register: DataFrame | None = None) -> DataFrame:
    """Mean and maximum saturation per device in the latest run."""
    return _of_latest(curated, register).groupBy("device").agg(
        reported(F.avg("saturation_score"), 3).alias("avg_saturation"),
        reported(F.max("saturation_score"), 3).alias("max_saturation"),
    ).orderBy(F.desc("avg_saturation"), "device")


def _direction(first: Column, last: Column, rising: str, falling: str, level: str) -> Column:
    return F.when(last > first, rising).when(last < first, falling).otherwise(level)


def device_change(runs: DataFrame) -> DataFrame:
    """First-to-last change per device over its runs."""
    measures = ["avg_latency_ms", "avg_util_pct", "avg_throughput_mb_s", "avg_saturation_score",
                "top_root_cause"]
    when = F.struct("run_time", "ingest_run_id")
    ends = runs.groupBy("device").agg(
        F.count(F.lit(1)).alias("run_count"),
        *[F.min_by(m, when).alias(f"first_{m}") for m in measures],
        *[F.max_by(m, when).alias(f"last_{m}") for m in measures],
    )

    def direction(measure: str, *words: str) -> Column:
        return _direction(F.col(f"first_{measure}"), F.col(f"last_{measure}"), *words)

    return ends.withColumns({
        "latency_direction": direction("avg_latency_ms", INCREASED, DECREASED, UNCHANGED),
        "util_direction": direction("avg_util_pct", INCREASED, DECREASED, DECREASED),
        "throughput_direction": direction("avg_throughput_mb_s", UP, DOWN, DOWN),
        "saturation_direction": direction("avg_saturation_score", UP, DOWN, DOWN),
        "cause_shifted": F.col("first_top_root_cause") != F.col("last_top_root_cause"),
    })


def run_change(per_run: DataFrame) -> DataFrame:
    """Change of the event count from the first to the last run, with the best and worst run.

    Takes the rows of `events_per_run`; of equal counts the earlier run is named.
    """
    when = F.struct("run_time", "ingest_run_id")
    count = F.col("anomaly_count")
    ends = per_run.agg(
        F.count(F.lit(1)).alias("run_count"),
        F.min_by("anomaly_count", when).alias("first_count"),
        F.max_by("anomaly_count", when).alias("last_count"),
        F.min_by("ingest_run_id", F.struct(count, when)).alias("best_run"),
        F.min("anomaly_count").alias("best_count"),
        F.min_by("ingest_run_id", F.struct(-count, when)).alias("worst_run"),
        F.max("anomaly_count").alias("worst_count"),
    )
    first, last = F.col("first_count"), F.col("last_count")
    return ends.withColumns({
        "change": last - first,
        "direction": _direction(first, last, INCREASED, DECREASED, FLAT),
        "verdict": _direction(first, last, WORSE, NOT_WORSE, NO_TREND),
    })
