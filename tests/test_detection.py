import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import frame, same
from spindlewatch.functions import rules
from spindlewatch.functions.rules import assign_severity, root_cause_hint
from spindlewatch.operators.detect import (
    add_rolling_baselines, detect_combined, detect_iqr, detect_rolling_zscore, enrich_events,
    graded, union_events,
)
from spindlewatch.operators.forest import detect_isolation_forest, fit_forest, mean_path, score_rows
from spindlewatch.schema import COMBINED_METRICS, DETECTION_SCHEMA, EVENT_CONTEXT, EVENT_SCHEMA


def hourly(spark, values, device="sda", **columns):
    data = {"device": device, "timestamp": pd.date_range("2025-01-01", periods=len(values), freq="h"),
            "avg_latency_ms": values, **columns}
    return spark.createDataFrame(pd.DataFrame(data))


# Rolling z-score

@pytest.fixture
def zscored(spark):
    def build(spike):
        values = [1.0] * 10
        values[5] = spike
        return hourly(spark, values, avg_latency_ms_rolling_mean=1.0, avg_latency_ms_rolling_std=0.5)

    return build


def test_zscore_finds_a_spike(zscored):
    out = detect_rolling_zscore(zscored(20.0), ["avg_latency_ms"]).collect()
    assert len(out) == 1 and out[0].metric_name == "avg_latency_ms"
    assert out[0].anomaly_score == 38.0 and out[0].details == "zscore=38.00"


def test_zscore_is_silent_on_a_flat_signal(zscored):
    assert detect_rolling_zscore(zscored(1.0), ["avg_latency_ms"]).isEmpty()


def test_zscore_keeps_the_sign(zscored):
    assert detect_rolling_zscore(zscored(-9.0), ["avg_latency_ms"]).first().anomaly_score == -20.0


def test_zscore_threshold(zscored):
    assert detect_rolling_zscore(zscored(3.0), ["avg_latency_ms"], 3).count() == 1
    assert detect_rolling_zscore(zscored(3.0), ["avg_latency_ms"], 10).isEmpty()


def test_zscore_skips_missing_and_zero_deviation(spark):
    df = hourly(spark, [9.0, 9.0, np.nan], avg_latency_ms_rolling_mean=[1.0, np.nan, 1.0],
                avg_latency_ms_rolling_std=[0.0, 1.0, 1.0])
    assert detect_rolling_zscore(df, ["avg_latency_ms"]).isEmpty()


def test_events_fall_as_the_threshold_rises(curated):
    base = add_rolling_baselines(curated, ["avg_latency_ms"], 60)
    counts = [detect_rolling_zscore(base, ["avg_latency_ms"], t).count() for t in (1.5, 2, 3, 4)]
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[-1]


# Interquartile fences

def test_iqr_finds_an_outlier(spark):
    values = [10.0] * 20
    values[10] = 200.0
    out = detect_iqr(hourly(spark, values), ["avg_latency_ms"]).collect()
    assert [r.metric_value for r in out] == [200.0]
    assert out[0].anomaly_score == 0.0  # no spread to measure in


def test_iqr_is_silent_on_uniform_data(spark):
    assert detect_iqr(hourly(spark, [10.0] * 20), ["avg_latency_ms"]).isEmpty()


def test_iqr_score_and_details(spark):
    out = detect_iqr(hourly(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 20.0, -20.0]), ["avg_latency_ms"])
    q1, q3 = np.quantile([1, 2, 3, 4, 5, 20, -20], [0.25, 0.75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    rows = {r.metric_value: r for r in out.collect()}
    assert rows[20.0].anomaly_score == pytest.approx((20 - high) / (q3 - q1))
    assert rows[-20.0].anomaly_score == pytest.approx((low + 20) / (q3 - q1))
    assert rows[20.0].details == f"lower={low:.2f}, upper={high:.2f}"


def test_detectors_ignore_nan_and_null(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, float("nan"), 50.0]
    df = hourly(spark, values)
    for out in (detect_iqr(df, ["avg_latency_ms"]), detect_combined(df, ["avg_latency_ms"])):
        assert [r.metric_value for r in out.collect()] == [50.0]


# Combined detector

def brute_force(pdf):
    rows = []
    for device, group in pdf.groupby("device"):
        for metric in COMBINED_METRICS:
            values = group[metric].dropna()
            if len(values) < 5:
                continue
            q1, q3 = values.quantile([0.25, 0.75])
            z = (values - values.mean()) / values.std(ddof=0) if values.std(ddof=0) else values * 0
            outside = (values < q1 - 1.5 * (q3 - q1)) | (values > q3 + 1.5 * (q3 - q1))
            far = z.abs() >= 3
            for i in values.index[outside | far]:
                label = "zscore+iqr" if outside[i] and far[i] else "zscore" if far[i] else "iqr"
                rows.append((device, pdf.timestamp[i], metric, label, abs(z[i])))
    return pd.DataFrame(rows, columns=["device", "timestamp", "metric_name", "detector_type", "anomaly_score"])


def test_combined_matches_brute_force(curated, events):
    keys = ["device", "timestamp", "metric_name"]
    want = brute_force(curated.toPandas()).sort_values(keys).reset_index(drop=True)
    got = frame(events.select(*want.columns), *keys)
    assert len(want) > 100
    pd.testing.assert_frame_equal(got, want, rtol=1e-9)


def test_statistics_join_follows_the_optimizer(curated):
    """No broadcast is forced: with the threshold off the join is shuffled."""
    conf = curated.sparkSession.conf
    before = conf.get("spark.sql.autoBroadcastJoinThreshold")
    conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = detect_combined(curated)._jdf.queryExecution().executedPlan().toString()
    finally:
        conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_enrichment_folds_only_samples_of_events(curated, events):
    bare = events.drop("workload_pattern", "root_cause_hint", *EVENT_CONTEXT)
    plan = enrich_events(bare, curated)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")


def test_combined_needs_five_values(spark):
    assert detect_combined(hourly(spark, [1.0, 1.0, 1.0, 99.0]), ["avg_latency_ms"]).isEmpty()
    assert detect_combined(hourly(spark, [1.0, 1.0, 1.0, 1.0, 99.0]), ["avg_latency_ms"]).count() == 1


def test_combined_without_spread(spark):
    assert detect_combined(hourly(spark, [4.0] * 10), ["avg_latency_ms"]).isEmpty()


def test_combined_events_are_complete(events):
    assert events.columns == EVENT_SCHEMA.fieldNames()
    assert events.where("severity = 'low' OR is_anomaly <> 1 OR root_cause_hint IS NULL").isEmpty()
    row = events.first()
    details = json.loads(row.details)
    assert set(details) == {"mean", "std", "q1", "q3", "iqr", "lower_bound", "upper_bound", "z_score"}
    assert abs(details["z_score"]) == pytest.approx(row.anomaly_score)
    assert details["upper_bound"] == pytest.approx(details["q3"] + 1.5 * details["iqr"])


def test_zero_ratio_is_stored_as_half_but_explained_as_zero(spark):
    df = hourly(spark, [1.0] * 19 + [50.0], read_ratio=0.0, write_ratio=1.0, util_pct=None)
    row = detect_combined(df.withColumn("util_pct", F.lit(None).cast("double"))).first()
    assert (row.read_ratio, row.write_ratio) == (0.5, 1.0)
    assert row.util_pct is None  # a present but missing value stays missing
    assert row.aqu_sz == 0.0 and row.workload_pattern == "balanced"  # absent columns
    assert row.root_cause_hint == rules.WRITE_LATENCY


# Severity and hints

@pytest.mark.parametrize("detector, score, severity", [
    ("rolling_zscore", 6.0, "critical"), ("rolling_zscore", -6.0, "critical"),
    ("rolling_zscore", 4.5, "high"), ("rolling_zscore", 1.0, "medium"),
    ("rolling_zscore", None, "medium"),
    ("iqr", 5.5, "critical"), ("iqr", 4.0, "high"), ("iqr", 2.0, "medium"), ("iqr", 0.5, "low"),
    ("isolation_forest", 0.4, "critical"), ("isolation_forest", 0.2, "high"),
    ("isolation_forest", 0.1, "medium"), ("isolation_forest", 0.01, "low"),
    ("zscore+iqr", 9.0, "low"), (None, 9.0, "low"),
])
def test_severity(spark, detector, score, severity):
    df = spark.createDataFrame([(detector, score)], "detector_type string, anomaly_score double")
    assert assign_severity(df).first().severity == severity


@pytest.mark.parametrize("metric, values, text", [
    ("avg_latency_ms", dict(aqu_sz=3.0, util_pct=85.0, write_ratio=0.9), rules.SATURATION_LATENCY),
    ("avg_latency_ms", dict(write_ratio=0.9), rules.WRITE_LATENCY),
    ("avg_latency_ms", dict(read_ratio=0.7), rules.READ_LATENCY),
    ("avg_latency_ms", dict(aqu_sz=None, util_pct=85.0), rules.PLAIN_LATENCY),
    ("util_pct", dict(util_pct=90.0), rules.FULL_UTILIZATION),
    ("util_pct", {}, rules.PLAIN_UTILIZATION),
    ("aqu_sz", dict(avg_latency_ms=10.0), rules.QUEUE_LATENCY),
    ("aqu_sz", dict(avg_latency_ms=1.0), rules.PLAIN_QUEUE),
    ("saturation_score", {}, rules.SATURATION),
    ("latency_pressure", {}, rules.LATENCY_PRESSURE),
    ("total_iops", dict(avg_request_size_kb=16.0), rules.SMALL_IOPS),
    ("total_iops", {}, rules.PLAIN_IOPS),
    ("multivariate", dict(workload_pattern="saturated"), rules.JOINT_SATURATED),
    ("multivariate", dict(workload_pattern="write_heavy"), rules.JOINT_WRITE),
    ("multivariate", dict(workload_pattern="read_heavy"), rules.JOINT_READ),
    ("multivariate", {}, rules.PLAIN_JOINT),
    ("merge_efficiency", {}, rules.UNEXPLAINED),
    (None, {}, rules.UNEXPLAINED),
])
def test_hints(spark, metric, values, text):
    row = dict(workload_pattern="balanced", util_pct=50.0, aqu_sz=1.0, avg_latency_ms=15.0,
               read_ratio=0.5, write_ratio=0.5, avg_request_size_kb=32.0, metric_name=metric)
    row.update(values)
    types = {"workload_pattern": "string", "metric_name": "string"}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {types.get(k, 'double')}" for k in row))
    assert df.select(F.expr(root_cause_hint(df.columns)).alias("hint")).first().hint == text


def test_hint_without_context(spark):
    df = spark.createDataFrame([("avg_latency_ms",)], "metric_name string")
    assert df.select(F.expr(root_cause_hint(df.columns))).first()[0] == rules.PLAIN_LATENCY


# Enrichment and union

def test_enrichment_keeps_every_event(curated):
    bare = detect_iqr(curated, ["avg_latency_ms"])
    out = enrich_events(bare, curated)
    assert out.count() == bare.count() > 0
    assert out.where("workload_pattern IS NULL OR root_cause_hint IS NULL").isEmpty()


def test_enrichment_does_not_multiply_overlapping_runs(curated):
    one = curated.where("ingest_run_id = 'run-01'")
    twice = one.unionByName(one.withColumn("ingest_run_id", F.lit("run-xx")))
    bare = detect_iqr(one, ["avg_latency_ms"])
    assert enrich_events(bare, twice).count() == bare.count()


def test_enrichment_does_not_multiply_copies(curated):
    bare = detect_iqr(curated, ["avg_latency_ms"])
    copies = curated.unionByName(curated).unionByName(curated)
    same(enrich_events(bare, copies), enrich_events(bare, curated), "device", "timestamp")


def test_enrichment_matches_samples_without_a_run(curated):
    bare = detect_iqr(curated, ["avg_latency_ms"]).withColumn("ingest_run_id", F.lit(None).cast("string"))
    unnamed = curated.withColumn("ingest_run_id", F.lit(None).cast("string"))
    assert enrich_events(bare, unnamed).where("workload_pattern IS NULL").isEmpty()


def test_enrichment_of_an_unknown_sample(spark, curated):
    bare = detect_iqr(curated, ["avg_latency_ms"]).limit(1).withColumn("device", F.lit("other"))
    row = enrich_events(bare, curated).first()
    assert row.workload_pattern is None and row.root_cause_hint == rules.PLAIN_LATENCY


def test_union_of_detectors(curated, events):
    iqr = graded(detect_iqr(curated, ["avg_latency_ms"]), curated)
    both = union_events(events, iqr, detect_isolation_forest(curated, ["avg_latency_ms", "total_iops"]))
    assert both.columns == EVENT_SCHEMA.fieldNames()
    assert {r[0] for r in both.select("detector_type").distinct().collect()} >= {"iqr", "isolation_forest"}


# Isolation forest

@pytest.fixture
def isolated(spark):
    def build(n=50, planted=True):
        latency, iops = [2.0] * n, [100.0] * n
        if planted:
            latency[-1], iops[-1] = 500.0, 5000.0
        return hourly(spark, latency, "sdc", total_iops=iops)

    return build


METRICS = ["avg_latency_ms", "total_iops"]


def test_forest_event_columns(isolated):
    out = detect_isolation_forest(isolated(), METRICS)
    assert out.columns == DETECTION_SCHEMA.fieldNames()
    rows = out.collect()
    assert [r.metric_name for r in rows] == ["multivariate"]
    assert rows[0].metric_value > 0 and rows[0].details == "metrics=avg_latency_ms,total_iops"
    assert rows[0].timestamp == max(r.timestamp for r in isolated().select("timestamp").collect())


def test_forest_needs_ten_rows(isolated):
    out = detect_isolation_forest(isolated(5, planted=False), METRICS)
    assert out.isEmpty() and out.columns == DETECTION_SCHEMA.fieldNames()


def test_forest_flags_about_the_contamination(curated):
    metrics = ["avg_latency_ms", "total_iops", "saturation_score"]
    n = curated.count()
    flagged = detect_isolation_forest(curated, metrics, 0.05, 42).count()
    assert abs(flagged - 0.05 * n) <= 0.01 * n


def test_forest_does_not_depend_on_partitions(curated):
    keys = ["device", "timestamp"]
    first, *others = [frame(detect_isolation_forest(curated.repartition(n), METRICS), *keys) for n in (1, 3, 8)]
    for other in others:
        pd.testing.assert_frame_equal(first, other)


def test_forest_repeats_for_a_seed(curated):
    keys = ["device", "timestamp"]
    runs = [frame(detect_isolation_forest(curated, METRICS), *keys) for _ in range(2)]
    pd.testing.assert_frame_equal(*runs)


def test_forest_ranks_planted_rows_first(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.normal(size=3000), "b": rng.normal(size=3000)})
    pdf.loc[:3, ["a", "b"]] = [[9, 9], [-9, 9], [9, -9], [-9, -9]]
    df = spark.createDataFrame(pdf.reset_index(names="id"))
    scored = score_rows(df, ["a", "b"], fit_forest(df, ["a", "b"]))
    top = scored.orderBy(F.desc("isolation_score")).limit(4).collect()
    assert {r.id for r in top} == {0, 1, 2, 3}
    assert all(0 < r.isolation_score <= 1 for r in top)


def test_forest_with_mostly_copies(spark):
    """A third of all samples having one value must not gather in one tree; samples differ in time."""
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"a": np.where(np.arange(40_000) % 3 == 0, 0.5, rng.normal(size=40_000))})
    pdf["timestamp"] = pd.Timestamp("2025-01-01") + pd.to_timedelta(np.arange(len(pdf)), unit="s")
    df = spark.createDataFrame(pdf)
    scored = score_rows(df, ["a"], fit_forest(df, ["a"]))
    by_copy = scored.groupBy((F.col("a") == 0.5).alias("copy")).agg(F.avg("isolation_score").alias("s"))
    means = {r.copy: r.s for r in by_copy.collect()}
    assert means[True] < means[False]


def test_forest_counts_copies_of_a_whole_row_once(spark):
    one = spark.createDataFrame([(float(i),) for i in range(300)], "a double")
    many = one.unionByName(spark.range(5000).select(F.lit(7.0).alias("a")))
    scores = [{r.a: r.isolation_score for r in score_rows(one, ["a"], fit_forest(df, ["a"])).collect()}
              for df in (one, many)]
    assert scores[0] == scores[1]


def test_mean_path():
    assert (mean_path(1), mean_path(2)) == (0.0, 1.0)
    assert mean_path(256) == pytest.approx(10.244, abs=1e-3)
