import pytest
from pyspark.sql import functions as F

from helpers import same
from spindlewatch.operators import quality
from spindlewatch.plans import pipeline
from spindlewatch.plans.pipeline import Warehouse


@pytest.fixture(scope="module")
def warehouse(spark, raw, tmp_path_factory):
    root = tmp_path_factory.mktemp("warehouse")
    house = Warehouse(spark, str(root))
    samples = raw.drop("ingest_run_id")
    early = F.dayofmonth("timestamp") <= 15
    for run, part in (("first", samples.where(early)), ("second", samples.where(~early))):
        pipeline.load(house, part, run)
        pipeline.curate(house, run)
        pipeline.detect(house, run)
    pipeline.publish(house, str(root / "exports"))
    return house


def test_tables_hold_both_runs(warehouse, raw):
    assert warehouse.raw().count() == warehouse.curated().count() == raw.count()
    assert warehouse.raw("first").count() + warehouse.raw("second").count() == raw.count()
    assert {r[0] for r in warehouse.events().select("ingest_run_id").distinct().collect()} == {"first", "second"}
    assert warehouse.latest().first().asDict() == {"anomaly_run_id": "second", "curated_run_id": "second"}


def test_steps_default_to_the_newest_run(warehouse):
    before = warehouse.events().count()
    assert pipeline.curate(warehouse) == "second"
    assert pipeline.detect(warehouse) == "second"
    assert warehouse.events().count() == before


def test_published_tables(warehouse):
    counts = {r.dataset: r.n for r in pipeline.validate(warehouse).collect()}
    assert counts["device_overview"] == 5 and counts["device_run_summary"] == 10
    assert counts["run_summary"] == 2 and counts["device_health"] == warehouse.curated().count()


def test_publishing_one_run_again_keeps_the_other(warehouse, tmp_path):
    pipeline.publish(warehouse, str(tmp_path), "first")
    runs = warehouse.spark.read.parquet(warehouse.path("run_summary"))
    assert runs.count() == 2 and "run_ts" in runs.columns
    assert warehouse.spark.read.parquet(f"{tmp_path}/device_overview_first.parquet").count() == 5
    pipeline.publish(warehouse, str(tmp_path))


def test_publishing_an_unknown_run_fails(warehouse, tmp_path):
    with pytest.raises(ValueError):
        pipeline.publish(warehouse, str(tmp_path), "no such run")


def test_report(warehouse):
    figures = pipeline.report(warehouse)
    row = figures["figures"].first()
    assert row.total_devices == 5 and row.total_anomalies == warehouse.events().count()
    assert figures["affected_devices"].count() == 5
    assert 1 <= figures["recommendations"].count() <= 4


def test_whole_run_in_one_call(spark, raw, tmp_path):
    house = Warehouse(spark, str(tmp_path / "w"))
    figures = pipeline.run_pipeline(house, raw.drop("ingest_run_id", "source_file"), str(tmp_path / "e"))
    assert figures["figures"].first().total_devices == 5


def test_curated_rows_survive_storage(warehouse, spark):
    from spindlewatch.functions.features import derive_features

    again = derive_features(warehouse.raw("first"))
    same(again.select("device", "timestamp", "avg_latency_ms", "workload_pattern"),
         warehouse.curated("first").select("device", "timestamp", "avg_latency_ms", "workload_pattern"),
         "device", "timestamp")


def test_quality_reports_violations(spark):
    df = spark.createDataFrame(
        [(None, 150.0, "idle"), (1.0, -1.0, None)], "total_iops double, util_pct double, workload_pattern string")
    report = {r.check_name: r.violations for r in quality.check_curated(df).collect()}
    assert report["column device"] == 1 and report["column total_iops"] == 0
    assert report["total_iops not null"] == 1
    assert report["util_pct in range"] == 2 and report["workload_pattern known"] == 1
    with pytest.raises(quality.QualityError, match="util_pct in range"):
        quality.enforce(quality.check_curated(df))


def test_quality_of_events(spark, events):
    quality.enforce(quality.check_events(events))
    broken = events.withColumn("root_cause_hint", F.lit(None).cast("string"))
    with pytest.raises(quality.QualityError, match="root_cause_hint not null"):
        quality.enforce(quality.check_events(broken))


def test_quality_of_report_inputs(spark, events):
    empty = spark.createDataFrame([], "device string, avg_latency_ms double, anomaly_count long")
    with pytest.raises(quality.QualityError, match="has rows"):
        quality.enforce(quality.check_report_inputs(empty, events, spark.createDataFrame(
            [], "root_cause_hint string, workload_pattern string, anomaly_count long")))
