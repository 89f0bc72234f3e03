"""Every operator as a named query over the given `events` table."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from spindlewatch.functions.features import derive_features, parsed_timestamp
from spindlewatch.functions.rounding import reported
from spindlewatch.functions.rules import HINTS, SEVERITY_FLOORS, assign_severity, root_cause_hint
from spindlewatch.functions.workload import add_adaptive_patterns, add_workload_patterns
from spindlewatch.operators import facts, marts, profile, quality, questions, summary
from spindlewatch.operators.detect import (
    add_rolling_baselines, detect_combined, detect_iqr, detect_rolling_zscore, enrich_events,
    graded, union_events,
)
from spindlewatch.operators.forest import detect_isolation_forest
from spindlewatch.operators.runs import latest_runs
from spindlewatch.plans.pipeline import Warehouse, curate, detect, load, publish, publish_batch, validate
from spindlewatch.schema import (
    COMBINED_METRICS, CURATED_SCHEMA, EVENT_SCHEMA, EVIDENCE_SCHEMA, LEGACY_NAMES, LOG_METRICS, RAW_METRICS,
    RAW_SCHEMA, SEVERITIES,
)
from spindlewatch.session import scratch_path, stage
from spindlewatch.sources import logs, tables
from spindlewatch.sources.feed import BAD_LABEL, BAD_LABEL_MINUTE, SILENT_DEVICE, read_dirty_feed, read_feed

DIGITS = 6
BASELINE_METRICS = ["avg_latency_ms", "total_iops"]
# Five rows cannot contain a three-deviation outlier, so events use a longer baseline.
EVENT_WINDOW = 60
# Metrics whose events are explained by the queue.
QUEUE_METRICS = ["aqu_sz", "latency_pressure"]
FOREST_METRICS = ["avg_latency_ms", "saturation_score", "total_iops"]
AS_OF = datetime(2024, 1, 31)


def settled(df: DataFrame, *names: str) -> DataFrame:
    """Round the named doubles, or all, so that summation order does not show.

    Adding 0 turns -0.0 into 0.0.
    """
    chosen = names or [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({n: reported(n, DIGITS) + 0.0 for n in chosen})


class Feed:
    """Frames of one given folder, derived when first used by a query."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @cached_property
    def raw(self) -> DataFrame:
        return read_feed(self.spark, self.folder)

    @cached_property
    def curated(self) -> DataFrame:
        return derive_features(self.raw).select(*CURATED_SCHEMA.fieldNames())

    @cached_property
    def found(self) -> DataFrame:
        """Events, for a query that looks at them once."""
        return detect_combined(self.curated)

    @cached_property
    def house(self) -> Warehouse:
        return Warehouse(self.spark, scratch_path(self.spark, "warehouse"))

    @cached_property
    def events(self) -> DataFrame:
        """Events as a stored table, for a query that looks at them several times or at one run."""
        tables.write_runs(self.found, self.house.path("anomaly_events"))
        return self.house.events()

    @cached_property
    def event_runs(self) -> DataFrame:
        self.events  # stored first
        return self.house.runs("anomaly_events")

    @cached_property
    def stored(self) -> DataFrame:
        """Curated samples as a stored table, for a query that looks at one run."""
        tables.write_runs(self.curated, self.house.path("curated_device_metrics"))
        return self.house.curated()

    @cached_property
    def curated_runs(self) -> DataFrame:
        self.stored  # stored first
        return self.house.runs("curated_device_metrics")

    @cached_property
    def stored_runs(self) -> DataFrame:
        return marts.device_run_summary(self.stored, self.events)

    @cached_property
    def rolling_events(self) -> DataFrame:
        baselines = add_rolling_baselines(self.curated, BASELINE_METRICS, EVENT_WINDOW)
        return detect_rolling_zscore(baselines, BASELINE_METRICS)

    @cached_property
    def all_events(self) -> DataFrame:
        """Events of three detectors in one stored table."""
        tables.write_runs(union_events(
            graded(self.rolling_events, self.curated),
            graded(detect_iqr(self.curated, BASELINE_METRICS), self.curated),
            self.found), self.house.path("all_events"))
        return tables.read_table(self.spark, self.house.path("all_events"), EVENT_SCHEMA)

    @cached_property
    def runs(self) -> DataFrame:
        return marts.device_run_summary(self.curated, self.events)

    @cached_property
    def causes(self) -> DataFrame:
        return marts.root_cause_summary(self.events)

    @cached_property
    def overview(self) -> DataFrame:
        return marts.device_overview(self.curated, self.events)

    @cached_property
    def datasets(self) -> dict[str, DataFrame]:
        return {
            "device_overview": self.overview,
            "anomaly_timeline": marts.anomaly_timeline(self.events),
            "device_health": marts.device_health(self.curated, self.events),
        }


    @cached_property
    def dirty_raw(self) -> DataFrame:
        """Faulty samples after the loader's repair."""
        return logs.raw_rows(read_dirty_feed(self.spark, self.folder))

    @cached_property
    def dirty_curated(self) -> DataFrame:
        """Faulty samples with features, some under a label that does not exist."""
        label = F.when(F.minute("timestamp") == BAD_LABEL_MINUTE, BAD_LABEL).otherwise(F.col("workload_pattern"))
        return derive_features(self.dirty_raw).withColumn("workload_pattern", label).select(
            *CURATED_SCHEMA.fieldNames())


def _details(feed: Feed) -> DataFrame:
    parsed = feed.found.select(
        "device", "timestamp", "metric_name", F.from_json("details", EVIDENCE_SCHEMA).alias("d"))
    return settled(parsed.select("device", "timestamp", "metric_name", "d.*"))


LOG_TIME = "2025-01-01 00:00:00"
LOG_HEADER = "Device r/s w/s rMB/s wMB/s r_await w_await aqu-sz %util"
CSV_DROPPED = ["svctm", "iowait_pct"]


def _iostat_logs(feed: Feed) -> DataFrame:
    """Samples written as iostat logs and read back.

    Idle samples are written as lines that are too short, so the reader drops them. Every
    file starts with a line that precedes its header, and then the header.
    """
    folder = scratch_path(feed.spark, "iostat")
    idle = "r_s = 0 AND w_s = 0"
    fields = ", ".join(["device", *[f"CAST({m} AS STRING)" for m in LOG_METRICS]])
    files = feed.spark.sparkContext.defaultParallelism
    samples = feed.raw.selectExpr(
        f"CAST(pmod(xxhash64(device, timestamp), {files}) AS INT) AS file", "2 AS place",
        f"IF({idle}, concat_ws('  ', device, r_s, w_s), concat_ws('   ', {fields})) AS line")
    openings = feed.spark.range(files).selectExpr(
        "CAST(id AS INT) AS file",
        f"inline(array(struct(0 AS place, 'early 1 2 3 4 5 6 7 8' AS line), "
        f"struct(1 AS place, '{LOG_HEADER}' AS line)))")
    lines = samples.unionByName(openings)
    # A task writes the numbers that hash to it as one file: early lines, headers, samples.
    (lines.repartition(files, "file").sortWithinPartitions("place")
     .select("line").write.text(folder))
    return logs.read_iostat(feed.spark, folder, LOG_TIME).drop("source_file")


def _csv_files(feed: Feed) -> DataFrame:
    """Samples written as CSV under old column names, some columns left out, and read back."""
    folder = scratch_path(feed.spark, "csv")
    old = {new: legacy for legacy, new in LEGACY_NAMES.items()}
    feed.raw.drop("source_file", "ingest_run_id", *CSV_DROPPED).withColumnsRenamed(old).withColumn(
        "timestamp", F.col("timestamp").cast("string")).write.option("header", True).csv(folder)
    rows = logs.raw_rows(logs.with_lineage(logs.read_csv(feed.spark, folder), "loaded", "samples.csv"))
    return rows.withColumn("timestamp", parsed_timestamp(rows))


# How the files of `source_csv_mixed` differ: minute of the sample modulo 3 -> columns left out.
MIXED_DROPPED = {0: ["svctm", "iowait_pct"], 1: [], 2: ["rrqm_s", "wrqm_s"]}


def _csv_mixed(feed: Feed) -> DataFrame:
    """Samples in CSV files with old names, new names, and new names backwards, read back as one load."""
    folder = scratch_path(feed.spark, "csv-mixed")
    old = {new: legacy for legacy, new in LEGACY_NAMES.items()}
    samples = feed.raw.drop("source_file", "ingest_run_id")
    kinds = {
        0: lambda df: df.withColumnsRenamed(old),
        1: lambda df: df,
        2: lambda df: df.select(*reversed(df.columns)),
    }
    for kind, shaped in kinds.items():
        part = samples.where(F.minute("timestamp") % len(kinds) == kind).drop(*MIXED_DROPPED[kind])
        shaped(part.withColumn("timestamp", F.col("timestamp").cast("string"))).write.option(
            "header", True).csv(f"{folder}/kind={kind}")
    paths = [f"{folder}/kind={kind}" for kind in kinds]
    return logs.read_csv_mixed(feed.spark, paths, "loaded").drop("source_file")


def _dirty_quality(feed: Feed) -> DataFrame:
    """Checks of faulty samples, and of events of which those of one device have lost their cause."""
    cause = F.when(F.col("device") != SILENT_DEVICE, F.col("root_cause_hint"))
    return quality.union_checks(
        quality.check_raw(feed.dirty_raw.drop("w_s")),
        quality.check_parsed(feed.dirty_raw),
        quality.check_curated(feed.dirty_curated),
        quality.check_events(feed.found.withColumn("root_cause_hint", cause)),
        quality.check_published({"idle at full speed": feed.curated.where("total_iops = 0 AND r_s > 0")}),
    )


# Metrics and detectors dealt to samples by hour and second, one unknown name among each.
HINT_METRICS = [*HINTS, "r_await"]
HINT_DETECTORS = [*SEVERITY_FLOORS, "manual"]
# A sample's score as a detector would scale it: the forest's scores are below one.
HINT_SCORE = {"isolation_forest": "util_pct / 200D"}


def _graded_hints(feed: Feed) -> DataFrame:
    """Severity and cause of every metric and detector, over faulty samples with the eight labels."""
    def pick(names: list[str], part: str) -> str:
        # element_at passes for never null where its array has no nulls, so a null place is kept from it.
        return (f"IF(timestamp IS NULL, NULL, element_at(array({', '.join(map(repr, names))}), "
                f"{part}(timestamp) % {len(names)} + 1))")

    samples = add_workload_patterns(feed.dirty_curated).selectExpr(
        "*", f"{pick(HINT_METRICS, 'hour')} AS metric_name", f"{pick(HINT_DETECTORS, 'second')} AS detector_type")
    scores = " ".join(f"WHEN '{name}' THEN {score}" for name, score in HINT_SCORE.items())
    scored = samples.selectExpr("*", f"CASE detector_type {scores} ELSE util_pct / 12D END AS anomaly_score")
    return assign_severity(scored).withColumn(
        "root_cause_hint", F.expr(root_cause_hint(scored.columns))).groupBy(
        "metric_name", "detector_type", "severity", "root_cause_hint").agg(F.count(F.lit(1)).alias("n"))


def _coverage_with_gaps(feed: Feed) -> DataFrame:
    """Coverage when one table lacks a device, and another lacks two and holds rows without a device."""
    health = marts.device_health(feed.dirty_curated, feed.found)
    return profile.device_coverage({
        **feed.datasets,
        "anomaly_timeline": marts.anomaly_timeline(feed.events).where(F.col("device") != SILENT_DEVICE),
        "device_health": health.where("device IS NULL OR device NOT LIKE 'nvme%'"),
    }, "device_overview")


def _stored_runs(feed: Feed) -> DataFrame:
    """All runs stored, one of them twice; rows per run and what one run's folder holds."""
    path = scratch_path(feed.spark, "runs")
    tables.write_runs(feed.raw, path, arrange=True)
    tables.write_runs(tables.read_run(feed.spark, path, "run-01", RAW_SCHEMA).transform(
        lambda df: stage(df, "run")), path)
    return tables.read_table(feed.spark, path, RAW_SCHEMA).groupBy("ingest_run_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def _replaced_table(feed: Feed) -> DataFrame:
    """A table replaced by one with more columns keeps its own and gains the new ones."""
    path = scratch_path(feed.spark, "overview")
    tables.replace_table(marts.device_overview_basic(feed.curated, feed.events), path)
    tables.replace_table(feed.overview.drop("avg_queue_depth"), path)
    return settled(tables.read_table(feed.spark, path))


def _exported_csv(feed: Feed) -> DataFrame:
    """A dashboard table exported, and its CSV copy under the stable name read back."""
    folder = scratch_path(feed.spark, "exports")
    causes = stage(marts.root_cause_summary(feed.found, rounded=True), "causes")
    tables.export_dataset(causes, folder, "root_cause_summary")
    return feed.spark.read.schema(causes.schema).option("header", True).csv(
        f"{folder}/root_cause_summary.csv")


def _published_row_counts(feed: Feed) -> DataFrame:
    """Every step from loading to validation, and the rows of what was published."""
    house = Warehouse(feed.spark, scratch_path(feed.spark, "warehouse"))
    run = load(house, feed.raw, "batch-1")
    curate(house, run)
    detect(house, run)
    publish(house, house.path("exports"))
    return validate(house)


def _published_tables(feed: Feed) -> DataFrame:
    """The aggregated tables after publishing the runs in two batches, in one frame."""
    house, folder = feed.house, scratch_path(feed.spark, "exports")
    tables.write_runs(feed.raw, house.path("raw_device_metrics"))
    runs = [r[0] for r in feed.curated_runs.select("ingest_run_id").orderBy("ingest_run_id").collect()]
    feed.events  # stored as well
    for batch in (runs[:len(runs) // 2], runs[len(runs) // 2:]):
        publish_batch(house, folder, batch)
    parts = [house.mart(name).selectExpr(f"'{name}' AS dataset", *chosen) for name, chosen in PUBLISHED.items()]
    return settled(reduce(DataFrame.union, parts), *[f"v{i}" for i in range(1, 7)])


# What `published_tables` shows of each table: device, run, two labels, three counts, six figures.
PUBLISHED = {
    "device_overview": [
        "device", "CAST(NULL AS STRING) AS run", "dominant_workload_pattern AS label", "CAST(NULL AS STRING) AS cause",
        "sample_count AS n1", "anomaly_count AS n2", "critical_anomaly_count AS n3", "avg_total_iops AS v1",
        "avg_throughput_mb_s AS v2", "avg_latency_ms AS v3", "avg_util_pct AS v4", "p95_latency_ms AS v5", "p99_latency_ms AS v6"],
    "root_cause_summary": [
        "CAST(NULL AS STRING) AS device", "ingest_run_id AS run", "workload_pattern AS label", "root_cause_hint AS cause",
        "anomaly_count AS n1", "critical_count AS n2", "affected_devices AS n3", "avg_anomaly_score AS v1",
        *[f"CAST(NULL AS DOUBLE) AS v{i}" for i in range(2, 7)]],
    "device_run_summary": [
        "device", "ingest_run_id AS run", "dominant_workload_pattern AS label", "top_root_cause AS cause",
        "total_anomalies AS n1", "critical_count AS n2", "high_count AS n3", "avg_latency_ms AS v1", "max_latency_ms AS v2",
        "avg_util_pct AS v3", "avg_iops AS v4", "avg_saturation_score AS v5", "avg_aqu_sz AS v6"],
    "run_summary": [
        "CAST(NULL AS STRING) AS device", "ingest_run_id AS run", "CAST(NULL AS STRING) AS label", "CAST(NULL AS STRING) AS cause",
        "raw_rows AS n1", "curated_rows AS n2", "anomaly_rows AS n3", "max_anomaly_score AS v1",
        "CAST(affected_devices AS DOUBLE) AS v2", "CAST(critical_anomalies AS DOUBLE) AS v3",
        "CAST(high_anomalies AS DOUBLE) AS v4", "CAST(NULL AS DOUBLE) AS v5", "CAST(NULL AS DOUBLE) AS v6"],
}


def _frequencies(feed: Feed) -> DataFrame:
    return profile.frequency_table(feed.found, [
        "detector_type", "severity", "metric_name", "device", "root_cause_hint", "workload_pattern"])


def _quality(feed: Feed) -> DataFrame:
    built = {
        **feed.datasets,
        "root_cause_summary": feed.causes,
        "device_run_summary": feed.runs,
    }
    run_summary = marts.run_summary(feed.raw, feed.curated, feed.events)
    latest = latest_runs(feed.curated, feed.events)
    return quality.union_checks(
        quality.check_raw(feed.raw),
        quality.check_parsed(feed.raw),
        quality.check_curated(feed.curated),
        quality.check_events(feed.events),
        *[quality.check_mart(table.limit(0), name) for name, table in built.items()],
        quality.check_report_inputs(
            feed.overview, built["anomaly_timeline"], feed.causes),
        quality.check_published({**built, "run_summary": run_summary, "latest_run": latest}),
    )


def _iqr(feed: Feed) -> DataFrame:
    return settled(detect_iqr(feed.curated, COMBINED_METRICS), "anomaly_score")


_FEED_QUERIES: dict[str, Callable[[Feed], DataFrame]] = {
    # rows
    "raw_view": lambda f: f.raw,
    "curated_features": lambda f: f.curated,
    "features_additive": lambda f: derive_features(f.raw, "additive"),
    "features_clipped": lambda f: derive_features(f.raw, "clipped"),
    "workload_rules": lambda f: add_workload_patterns(f.curated).select(
        "device", "timestamp", "workload_pattern"),
    "workload_adaptive": lambda f: add_adaptive_patterns(derive_features(f.raw, "clipped")).select(
        "device", "timestamp", "workload_pattern"),
    # files and stored tables
    "source_iostat_logs": _iostat_logs,
    "source_csv": _csv_files,
    "source_csv_mixed": _csv_mixed,
    "stored_runs": _stored_runs,
    "replaced_table": _replaced_table,
    "exported_csv": _exported_csv,
    "published_row_counts": _published_row_counts,
    "published_tables": _published_tables,
    # detectors
    "rolling_baseline": lambda f: settled(add_rolling_baselines(f.curated, BASELINE_METRICS).select(
        "device", "timestamp", *[f"{m}_rolling_{s}" for m in BASELINE_METRICS for s in ("mean", "std")])),
    "rolling_zscore_events": lambda f: settled(f.rolling_events, "anomaly_score"),
    "iqr_events": _iqr,
    "combined_events": lambda f: settled(f.found, "anomaly_score").drop("details"),
    "event_details": _details,
    "severity_union": lambda f: settled(f.all_events, "anomaly_score").drop("details"),
    "enriched_events": lambda f: settled(
        enrich_events(detect_iqr(f.curated, COMBINED_METRICS), f.curated), "anomaly_score"),
    "isolation_forest_events": lambda f: detect_isolation_forest(f.curated, FOREST_METRICS),
    # dashboard tables
    "device_overview": lambda f: settled(marts.device_overview(f.curated, f.found)),
    "device_overview_basic": lambda f: settled(marts.device_overview_basic(f.curated, f.found)),
    "anomaly_timeline": lambda f: settled(marts.anomaly_timeline(f.found), "anomaly_score"),
    "root_cause_summary": lambda f: settled(marts.root_cause_summary(f.found)),
    "root_cause_summary_rounded": lambda f: marts.root_cause_summary(f.found, rounded=True),
    "device_run_summary": lambda f: settled(marts.device_run_summary(f.curated, f.found)),
    "device_run_summary_rounded": lambda f: marts.device_run_summary(f.curated, f.found, rounded=True),
    "device_health": lambda f: marts.device_health(f.curated, f.found),
    "run_summary": lambda f: settled(marts.run_summary(f.raw, f.curated, f.found)),
    "curated_projection": lambda f: marts.curated_projection(f.curated),
    "fact_timeseries": lambda f: settled(
        facts.device_timeseries(f.curated), "latency_rolling_mean", "latency_rolling_std"),
    "fact_hourly": lambda f: settled(facts.device_hourly(f.curated)),
    "fact_percentiles": lambda f: settled(facts.device_percentiles(f.curated)),
    "latest_run": lambda f: latest_runs(f.curated_runs, f.event_runs),
    # questions
    "q01_critical_devices": lambda f: questions.critical_devices(f.events, f.event_runs),
    "q02_utilization_ranking": lambda f: settled(questions.utilization_ranking(f.stored_runs, f.curated_runs)),
    "q03_device_history": lambda f: settled(questions.device_history(f.runs, "sda")),
    "q04_compare_devices": lambda f: settled(questions.compare_devices(f.runs, "sda", "sdb")),
    "q05_best_devices": lambda f: questions.best_devices(f.runs),
    "q06_device_trend": lambda f: settled(questions.device_trend(f.runs, "sda")),
    "q07_explain_device": lambda f: settled(questions.explain_device(f.stored_runs, f.curated_runs, "sdb")),
    "q08_top_causes": lambda f: questions.top_causes(f.causes, f.event_runs),
    "q09_cause_trend": lambda f: questions.cause_trend(f.causes),
    "q10_slow_and_queued": lambda f: questions.slow_and_queued(f.stored, register=f.curated_runs),
    "q11_multi_detector_devices": lambda f: questions.multi_detector_devices(
        f.all_events, register=f.house.runs("all_events")),
    "q12_business_hours": lambda f: questions.business_hours(f.found, "sdb"),
    "q13_critical_share": lambda f: questions.critical_share(
        detect_combined(add_workload_patterns(f.curated))),
    "q14_score_p95": lambda f: questions.score_p95(f.events),
    "q15_last_two_runs": lambda f: questions.last_two_runs(f.runs),
    "q16_worst_sample": lambda f: questions.worst_sample(f.curated),
    "q17_worst_events": lambda f: settled(questions.worst_events(f.events, register=f.event_runs), "anomaly_score"),
    "q18_severity_breakdown": lambda f: questions.severity_breakdown(f.events, f.event_runs),
    "q19_causes_matching": lambda f: questions.causes_matching(f.causes, f.event_runs, "queue"),
    "q20_saturation_slope": lambda f: questions.saturation_slope(f.curated),
    "q21_queued_but_not_busy": lambda f: questions.queued_but_not_busy(f.events, register=f.event_runs),
    "q21_queue_metrics": lambda f: questions.queued_but_not_busy(
        graded(detect_iqr(f.curated, QUEUE_METRICS), f.curated)),
    "q22_saturation_hours": lambda f: questions.saturation_hours(f.found),
    "q23_top_causes_per_run": lambda f: questions.top_causes_per_run(f.causes),
    "q24_performance_with_cause": lambda f: questions.performance_with_cause(f.curated, f.found),
    "q24_latest_run_with_cause": lambda f: questions.performance_with_cause(
        f.stored, f.events, ["sda", "sdb"], per_run=False, register=f.curated_runs, event_register=f.event_runs),
    "q25_causes_this_month": lambda f: questions.causes_this_month(f.found, AS_OF),
    "q26_events_per_run": lambda f: questions.events_per_run(f.found),
    "q27_read_write_ratios": lambda f: questions.read_write_ratios(f.stored, f.curated_runs),
    "q28_saturation_by_device": lambda f: questions.saturation_by_device(f.stored, f.curated_runs),
    "q29_device_change": lambda f: settled(questions.device_change(f.runs)),
    "q29_run_change": lambda f: questions.run_change(questions.events_per_run(f.found)),
    # profiles
    "profile_describe": lambda f: settled(profile.describe(f.curated)),
    "profile_nulls": lambda f: profile.null_and_distinct(f.curated),
    "profile_nulls_dirty": lambda f: profile.null_and_distinct(f.dirty_curated),
    "profile_describe_ten": lambda f: settled(profile.describe(f.curated, profile.EXPLORED)),
    "profile_describe_raw": lambda f: settled(profile.describe(f.raw, RAW_METRICS)),
    "profile_nulls_raw": lambda f: profile.null_and_distinct(f.raw),
    "profile_quantiles": lambda f: settled(profile.quantile_table(f.curated)),
    "profile_means_by_device": lambda f: profile.means_by(f.curated, "device", profile.DEVICE_MEANS, 4),
    "profile_means_by_hour": lambda f: profile.means_by(f.curated, "hour_of_day", profile.HOUR_MEANS, 3),
    "profile_means_by_workload": lambda f: profile.means_by(
        f.curated, "workload_pattern", profile.WORKLOAD_MEANS, 4),
    "profile_corr": lambda f: settled(profile.correlations(f.curated)),
    "profile_histogram": lambda f: settled(profile.histogram(f.curated)),
    "profile_above_p99": lambda f: profile.above_p99(f.curated),
    "profile_top_saturation": lambda f: profile.top_rows(
        f.curated, "saturation_score", 10, "device", "timestamp"),
    "profile_top_health": lambda f: profile.top_rows(
        marts.device_health(f.curated, f.found).select(
            "device", "timestamp", "avg_latency_ms", "util_pct", "aqu_sz", "saturation_score",
            "anomaly_flag"), "saturation_score", 25, "device", "timestamp"),
    "profile_frequencies": _frequencies,
    "profile_cause_pairs": lambda f: profile.frequencies(f.found, "device", "root_cause_hint"),
    "profile_pivot": lambda f: profile.severity_pivot(f.found, SEVERITIES),
    "profile_coverage": lambda f: profile.device_coverage(f.datasets, "device_overview"),
    "profile_coverage_with_gaps": _coverage_with_gaps,
    "profile_event_context": lambda f: settled(
        profile.events_in_context(f.found, f.curated), "anomaly_score").drop("details"),
    "profile_critical_events": lambda f: profile.critical_events(f.found),
    "profile_event_series": lambda f: profile.event_series(f.found),
    "profile_latest_events": lambda f: settled(profile.latest_events(f.found), "anomaly_score").drop("details"),
    # report
    "summary_kpis": lambda f: summary.key_figures(f.overview, f.events),
    "summary_affected": lambda f: settled(summary.most_affected_devices(f.overview)),
    "summary_causes": lambda f: summary.top_root_causes(f.causes),
    "summary_workloads": lambda f: summary.dominant_workloads(f.overview),
    "summary_recommendations": lambda f: summary.recommendations(
        summary.key_figures(f.overview, f.events), summary.top_root_causes(f.causes)),
    # quality
    "quality_checks": _quality,
    "quality_of_dirty_rows": _dirty_quality,
    "hints_all_metrics": _graded_hints,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build: Callable[[Feed], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: build(Feed(spark, folder))

    return {name: bind(build) for name, build in _FEED_QUERIES.items()}
