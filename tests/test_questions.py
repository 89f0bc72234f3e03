from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spindlewatch.operators import profile, questions, summary


@pytest.fixture
def runs(spark):
    rows = [("sda", "r1", datetime(2025, 1, 1), 2.0, 50.0, 5.0, 1.0, "a", 3, 1),
            ("sda", "r2", datetime(2025, 1, 2), 4.0, 40.0, 5.0, 2.0, "b", 1, 0),
            ("sdb", "r1", datetime(2025, 1, 1), 1.0, 60.0, 5.0, 1.0, "a", 0, 0)]
    return spark.createDataFrame(
        rows, "device string, ingest_run_id string, run_time timestamp, avg_latency_ms double, "
              "avg_util_pct double, avg_throughput_mb_s double, avg_saturation_score double, "
              "top_root_cause string, total_anomalies long, critical_count long")


def test_device_names_ignore_case(runs):
    assert questions.device_trend(runs, "SDA").count() == 2
    assert questions.compare_devices(runs, "SDA", "sdB").count() == 3


def test_best_devices(runs):
    assert [r.device for r in questions.best_devices(runs, 1).collect()] == ["sdb"]


def test_last_two_runs(runs):
    assert [(r.ingest_run_id, r.critical_count) for r in questions.last_two_runs(runs).collect()] == [
        ("r1", 1), ("r2", 0)]


def test_device_change(runs):
    rows = {r.device: r for r in questions.device_change(runs).collect()}
    assert rows["sda"].latency_direction == "increased" and rows["sda"].util_direction == "decreased"
    assert rows["sda"].cause_shifted and rows["sda"].saturation_direction == "up"
    assert rows["sdb"].run_count == 1 and rows["sdb"].latency_direction == "unchanged"


@pytest.mark.parametrize("counts, verdict, best, worst", [
    ([1, 3], questions.WORSE, "r0", "r1"), ([3, 1, 3], questions.NO_TREND, "r1", "r0"),
    ([5, 5, 2], questions.NOT_WORSE, "r2", "r0")])
def test_run_change(spark, counts, verdict, best, worst):
    rows = [(f"r{i}", datetime(2025, 1, 1 + i), n) for i, n in enumerate(counts)]
    row = questions.run_change(spark.createDataFrame(
        rows, "ingest_run_id string, run_time timestamp, anomaly_count long")).first()
    assert (row.verdict, row.best_run, row.worst_run) == (verdict, best, worst)
    assert row.change == counts[-1] - counts[0]


def test_latest_run_question_reads_one_partition(spark, events, tmp_path):
    path = str(tmp_path / "events")
    events.write.partitionBy("ingest_run_id").parquet(path)
    stored = spark.read.schema(events.schema).parquet(path)
    plan = questions.severity_breakdown(stored)._jdf.queryExecution().executedPlan().toString()
    assert any("PartitionFilters" in line and "ingest_run_id" in line and "Subquery" in line
               for line in plan.splitlines())


def test_month_filter(events):
    assert questions.causes_this_month(events, datetime(2024, 2, 10)).isEmpty()
    assert not questions.causes_this_month(events, datetime(2024, 1, 10)).isEmpty()


def test_recommendations(spark):
    def sentences(critical, util, *hints):
        figures = spark.createDataFrame([(critical, util)], "critical_anomalies long, avg_util_pct double")
        causes = spark.createDataFrame([(h,) for h in hints], "root_cause_hint string")
        return [r.recommendation for r in summary.recommendations(figures, causes).collect()]

    assert sentences(0, 10.0) == [summary.REVIEW_DISTRIBUTION]
    assert sentences(1, 80.0, "Saturation signal", "write-heavy pressure") == [
        summary.REVIEW_CRITICAL, summary.INVESTIGATE_UTILIZATION, summary.CORRELATE_SATURATION,
        summary.INSPECT_WRITES]
    assert sentences(0, 79.9, None, "WRITE-HEAVY") == [summary.INSPECT_WRITES]


def test_key_figures_of_nothing(spark):
    empty = spark.createDataFrame([], "device string, avg_latency_ms double, avg_util_pct double")
    row = summary.key_figures(empty, spark.createDataFrame([], "severity string")).first()
    assert (row.total_devices, row.total_anomalies, row.avg_latency_ms) == (0, 0, 0.0)


def test_profile_matches_pandas(curated):
    pdf = curated.toPandas()
    for row in profile.quantile_table(curated).collect():
        found = row.asDict()
        q = found.pop(list(found)[0])
        assert found == pytest.approx({c: pdf[c].quantile(q) for c in found})
    assert profile.above_p99(curated).count() == 10


def test_describe_matches_pandas(curated):
    want = curated.toPandas()[profile.DESCRIBED].describe(percentiles=profile.QUANTILES).T
    for row in profile.describe(curated).collect():
        expected = want.loc[row.metric_name]
        assert [row["count"], row["mean"], row["std"], row["min"], row.p50, row.p90, row.p95, row.p99,
                row["max"]] == pytest.approx(list(expected[["count", "mean", "std", "min", "50%", "90%",
                                                            "95%", "99%", "max"]]))


def test_nulls_and_distinct(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 1), ("a", float("nan"), 2), (None, None, 2), ("b", -0.0, 2), ("b", 0.0, 2)],
        "s string, x double, n int")
    rows = {r.column_name: (r.null_pct, r.n_distinct) for r in profile.null_and_distinct(df).collect()}
    assert rows == {"s": (20.0, 2), "x": (40.0, 2), "n": (0.0, 2)}
    near = {r.column_name: (r.null_pct, r.n_distinct) for r in profile.null_and_distinct(df, 0.02).collect()}
    assert near == rows


def test_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 1, 10, None or 5]], "v double")
    out = profile.histogram(df, "v", 10).collect()
    assert [r.n for r in out] == [1, 2, 0, 0, 0, 1, 0, 0, 0, 1]
    assert out[0].lower_edge == 0.0 and out[-1].upper_edge == 10.0
    same = profile.histogram(spark.createDataFrame([(3.0,)] * 4, "v double"), "v", 10)
    assert same.agg(F.sum("n")).first()[0] == 4


def test_coverage(spark):
    def devices(*names):
        return spark.createDataFrame([(n,) for n in names], "device string")

    sets = {"all": devices("a", "b", "c", None), "some": devices("a", "a"), "none": devices("z").limit(0)}
    rows = {r.dataset: (r.n_devices, r.n_missing) for r in profile.device_coverage(sets, "all").collect()}
    assert rows["all"] == (3, 0) and rows["some"] == (1, 2)
    missing = {(r.dataset, r.device) for r in profile.missing_devices(sets, "all").collect()}
    assert missing == {("some", "b"), ("some", "c"), ("none", "a"), ("none", "b"), ("none", "c")}


def test_pivot_fills_absent_cells(events):
    out = profile.severity_pivot(events, ["critical", "high", "medium", "low"])
    assert out.columns == ["metric_name", "critical", "high", "medium", "low"]
    assert all(r.low == 0 for r in out.collect())


def test_frequencies_count_nulls(spark):
    df = spark.createDataFrame([("x",), (None,), (None,)], "severity string")
    assert [(r.severity, r.n) for r in profile.frequencies(df, "severity").collect()] == [(None, 2), ("x", 1)]
