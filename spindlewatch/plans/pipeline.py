"""The batch pipeline: load, curate, detect, publish, summarize.

Each step reads and writes stored tables, so a step can be repeated for a run, lost
executors cost only the tasks they held, and later steps see real table sizes.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from spindlewatch.functions.features import derive_features, parsed_timestamp
from spindlewatch.operators import marts, quality, states, summary
from spindlewatch.operators.detect import detect_combined
from spindlewatch.operators.runs import latest_run, latest_runs
from spindlewatch.schema import CURATED_SCHEMA, EVENT_SCHEMA, RAW_SCHEMA
from spindlewatch.sources.logs import raw_rows, with_lineage
from spindlewatch.sources.register import read_register
from spindlewatch.sources.tables import (
    export_dataset, read_run, read_table, replace_table, write_runs,
)

MART_NAMES = ["device_overview", "anomaly_timeline", "root_cause_summary", "device_run_summary",
              "device_health"]
STORED_MARTS = MART_NAMES[:4]


@dataclass(frozen=True)
class Warehouse:
    """Folders of the stored tables under one root."""

    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def raw(self, run: str | None = None) -> DataFrame:
        return read_run(self.spark, self.path("raw_device_metrics"), run, RAW_SCHEMA)

    def curated(self, run: str | None = None) -> DataFrame:
        return read_run(self.spark, self.path("curated_device_metrics"), run, CURATED_SCHEMA)

    def events(self, run: str | None = None) -> DataFrame:
        return read_run(self.spark, self.path("anomaly_events"), run, EVENT_SCHEMA)

    def mart(self, name: str) -> DataFrame:
        return read_table(self.spark, self.path(name))

    def runs(self, name: str) -> DataFrame:
        """Register of the runs of a stored table."""
        return read_register(self.spark, self.path(name))

    def latest(self) -> DataFrame:
        """Latest run of the events and of the curated samples, from their registers."""
        return latest_runs(self.runs("curated_device_metrics"), self.runs("anomaly_events"))

    def states(self) -> dict[str, DataFrame]:
        """Partial states of all published runs."""
        return {name: read_table(self.spark, self.path(name)) for name in states.STATES}


def _newest(register: DataFrame) -> str | None:
    return latest_run(register).first()[0]


def load(warehouse: Warehouse, samples: DataFrame, run: str | None = None,
         source_file: str | None = None) -> str:
    """Store samples under a run id, a new one unless given. Returns the run id."""
    run = run or str(uuid.uuid4())
    rows = raw_rows(with_lineage(samples, run, source_file)).withColumn(
        "timestamp", parsed_timestamp(samples))
    write_runs(rows, warehouse.path("raw_device_metrics"), arrange=True)
    return run


def curate(warehouse: Warehouse, run: str | None = None) -> str | None:
    """Derive features for a run, the newest unless given; all rows when none has a run."""
    run = run or _newest(warehouse.runs("raw_device_metrics"))
    curated = derive_features(warehouse.raw(run)).select(*CURATED_SCHEMA.fieldNames())
    write_runs(curated, warehouse.path("curated_device_metrics"))
    return run


def detect(warehouse: Warehouse, run: str | None = None) -> str | None:
    """Find events for a run, the newest unless given."""
    run = run or _newest(warehouse.runs("curated_device_metrics"))
    events = detect_combined(warehouse.curated(run))
    write_runs(events, warehouse.path("anomaly_events"))
    return run


def build_marts(curated: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """The five dashboard tables."""
    return {
        "device_overview": marts.device_overview(curated, events),
        "anomaly_timeline": marts.anomaly_timeline(events),
        "root_cause_summary": marts.root_cause_summary(events),
        "device_run_summary": marts.device_run_summary(curated, events),
        "device_health": marts.device_health(curated, events),
    }


def publish(warehouse: Warehouse, export_folder: str, run: str | None = None) -> None:
    """Build, check, store and export the dashboard tables for one run or for all."""
    curated, events = warehouse.curated(run), warehouse.events(run)
    if curated.isEmpty() or events.isEmpty():
        raise ValueError(f"no curated samples or no events for run {run}")
    built = build_marts(curated, events)
    quality.enforce(quality.union_checks(*[
        quality.check_mart(built[name].limit(0), name) for name in MART_NAMES]))
    for name in MART_NAMES:
        table = built[name]
        if name in STORED_MARTS:
            replace_table(table, warehouse.path(name))
            table = warehouse.mart(name)
        export_dataset(table, export_folder, name, run)
    per_run = marts.run_summary(warehouse.raw(run), curated, events)
    write_runs(per_run.withColumn("run_ts", F.current_timestamp()), warehouse.path("run_summary"))


def publish_batch(warehouse: Warehouse, export_folder: str, runs: list[str]) -> None:
    """Store the partial states of `runs` and renew the aggregated dashboard tables for all published runs.

    Of samples and events only those of `runs` are read; other runs enter by their stored states. What
    has a row per sample or event is exported for `runs` alone. Publishing runs again changes nothing.
    """
    of = F.col("ingest_run_id").isin(runs)
    sources = {"curated": warehouse.curated().where(of), "events": warehouse.events().where(of)}
    if sources["curated"].isEmpty():
        raise ValueError(f"no curated samples for runs {runs}")
    for name, (source, make) in states.STATES.items():
        write_runs(make(sources[source]), warehouse.path(name))
    held = warehouse.states()
    built = {"device_overview": states.device_overview(held), "root_cause_summary": states.root_cause_summary(held),
             "device_run_summary": states.device_run_summary(held)}
    for name, table in built.items():
        replace_table(table, warehouse.path(name))
        export_dataset(warehouse.mart(name), export_folder, name)
    # Flags join samples by device and time, so events of other runs count as well.
    batch = "_".join(runs)
    export_dataset(marts.anomaly_timeline(sources["events"]), export_folder, "anomaly_timeline", batch)
    export_dataset(marts.device_health(sources["curated"], warehouse.events()), export_folder, "device_health", batch)
    per_run = states.run_summary(held, warehouse.runs("raw_device_metrics")).where(of)
    write_runs(per_run.withColumn("run_ts", F.current_timestamp()), warehouse.path("run_summary"))


def validate(warehouse: Warehouse) -> DataFrame:
    """Row check of the seven published datasets; raises when one is empty."""
    datasets = {name: warehouse.mart(name) for name in [*STORED_MARTS, "run_summary"]}
    datasets["device_health"] = marts.device_health(warehouse.curated(), warehouse.events())
    datasets["latest_run"] = warehouse.latest()
    quality.enforce(quality.check_published(datasets))
    return quality.row_counts(datasets)


def report(warehouse: Warehouse) -> dict[str, DataFrame]:
    """The report's figures from the stored tables."""
    overview, timeline, causes = (
        warehouse.mart(n) for n in ("device_overview", "anomaly_timeline", "root_cause_summary"))
    quality.enforce(quality.check_report_inputs(overview, timeline, causes))
    figures, top = summary.key_figures(overview, timeline), summary.top_root_causes(causes)
    return {
        "figures": figures,
        "affected_devices": summary.most_affected_devices(overview),
        "root_causes": top,
        "workloads": summary.dominant_workloads(overview),
        "recommendations": summary.recommendations(figures, top),
    }


def run_pipeline(warehouse: Warehouse, samples: DataFrame, export_folder: str,
                 run: str | None = None) -> dict[str, DataFrame]:
    """All steps for one batch of samples; returns the report's figures."""
    run = load(warehouse, samples, run)
    curate(warehouse, run)
    detect(warehouse, run)
    publish(warehouse, export_folder)
    validate(warehouse)
    return report(warehouse)
