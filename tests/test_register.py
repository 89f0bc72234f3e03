"""The register of runs, and publishing by batches from partial states."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helpers import frame, same
from spindlewatch.functions.quantiles import search_quantiles
from spindlewatch.operators import marts, questions
from spindlewatch.operators.runs import latest_run, latest_runs
from spindlewatch.plans import pipeline
from spindlewatch.plans.pipeline import Warehouse
from spindlewatch.schema import CURATED_SCHEMA
from spindlewatch.sources.register import read_register, rebuild_register, register_path
from spindlewatch.sources.tables import read_table, write_runs


@pytest.fixture(scope="module")
def house(spark, raw, curated, events, tmp_path_factory):
    house = Warehouse(spark, str(tmp_path_factory.mktemp("register")))
    write_runs(raw, house.path("raw_device_metrics"))
    write_runs(curated, house.path("curated_device_metrics"))
    write_runs(events, house.path("anomaly_events"))
    return house


def rows(df):
    return {r["ingest_run_id"]: (r["newest"], r["n_rows"]) for r in df.collect()}


def test_register_follows_every_write(spark, curated, tmp_path):
    path = str(tmp_path / "samples")
    early, late = curated.where("ingest_run_id = 'run-00'"), curated.where("ingest_run_id = 'run-01'")
    write_runs(early, path)
    assert set(rows(read_register(spark, path))) == {"run-00"}
    write_runs(late, path)
    want = {r[0]: (r[1], r[2]) for r in early.union(late).groupBy("ingest_run_id").agg(
        F.max("timestamp"), F.count(F.lit(1))).collect()}
    assert rows(read_register(spark, path)) == want
    write_runs(late.where("device = 'sda'"), path)  # replaced, not added
    assert rows(read_register(spark, path))["run-01"][1] == late.where("device = 'sda'").count()
    write_runs(early.withColumn("ingest_run_id", F.lit(None).cast("string")), path)
    assert set(rows(read_register(spark, path))) == {"run-00", "run-01"}


def test_register_is_made_for_tables_without_one(spark, curated, tmp_path):
    path = str(tmp_path / "old")
    curated.write.partitionBy("ingest_run_id").parquet(path)
    assert latest_run(read_register(spark, path)).first() == latest_run(curated).first()
    assert Path(register_path(path)).exists()
    rebuild_register(spark, path)
    assert sum(n for _, n in rows(read_register(spark, path)).values()) == curated.count()


def test_latest_runs_agree_with_the_tables(house, curated, events):
    assert house.latest().first() == latest_runs(curated, events).first()


def test_a_question_reads_no_file_outside_the_newest_run(spark, curated, tmp_path):
    path = str(tmp_path / "samples")
    write_runs(curated, path)
    want = frame(questions.saturation_by_device(curated))
    for file in Path(path).rglob("part-*.parquet"):
        if "ingest_run_id=run-05" not in str(file):
            file.write_bytes(b"not a table")  # a task that opens it fails
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    table, register = read_table(spark, path, CURATED_SCHEMA), read_register(spark, path)
    assert frame(questions.saturation_by_device(table, register)).equals(want)
    with pytest.raises(Exception):
        questions.saturation_by_device(table).collect()


def test_batches_publish_what_one_pass_does(house, raw, curated, events, tmp_path):
    for runs in (["run-03", "run-01"], ["run-00", "run-02", "run-04"], ["run-05"], ["run-01"]):
        pipeline.publish_batch(house, str(tmp_path), runs)
    same(house.mart("device_overview"), marts.device_overview(curated, events), "device")
    same(house.mart("device_run_summary"), marts.device_run_summary(curated, events), "device", "ingest_run_id")
    keys = ["ingest_run_id", "root_cause_hint", "workload_pattern"]
    same(house.mart("root_cause_summary"), marts.root_cause_summary(events), *keys)
    same(house.mart("run_summary").drop("run_ts"), marts.run_summary(raw, curated, events), "ingest_run_id")


def test_a_batch_reads_only_its_own_samples(house, spark, tmp_path):
    before = frame(house.mart("device_overview"), "device")
    for name in ("curated_device_metrics", "raw_device_metrics"):
        for file in Path(house.path(name)).rglob("part-*.parquet"):
            if "ingest_run_id=run-05" not in str(file):
                file.write_bytes(b"not a table")
                (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    pipeline.publish_batch(house, str(tmp_path), ["run-05"])
    assert frame(house.mart("device_overview"), "device").round(9).equals(before.round(9))


def test_an_unknown_batch_fails(house, tmp_path):
    with pytest.raises(ValueError):
        pipeline.publish_batch(house, str(tmp_path), ["no such run"])


def test_counted_values_have_the_percentiles_of_their_rows(spark):
    counted = [("a", float(v * v % 97), 1 + v % 5) for v in range(300)] + [("b", 2.5, 1000), ("b", None, 7)]
    df = spark.createDataFrame(counted, "k string, metric_value double, times long")
    long = df.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("k", "metric_value")
    probs = [0.0, 0.25, 0.5, 0.95, 1.0]
    same(search_quantiles(df, ["k"], probs, "times"), search_quantiles(long, ["k"], probs), "k")
