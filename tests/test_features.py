import pandas as pd
import pytest

from spindlewatch.functions.features import derive_features
from spindlewatch.functions.workload import add_adaptive_patterns, add_workload_patterns
from spindlewatch.sources.logs import ensure_columns


@pytest.fixture
def derived(spark):
    def build(profile="additive", **overrides):
        row = dict(device="sda", timestamp="2025-01-01T00:00:00", r_s=10.0, w_s=5.0, rmb_s=1.0,
                   wmb_s=1.0, r_await=2.0, w_await=4.0, aqu_sz=1.0, util_pct=50.0)
        row.update(overrides)
        types = ", ".join(f"{k} {'string' if k in ('device', 'timestamp') else 'double'}" for k in row)
        df = spark.createDataFrame([tuple(row.values())], types)
        return derive_features(ensure_columns(df), profile).first()

    return build


def test_total_iops(derived):
    assert derived(r_s=10.0, w_s=5.0).total_iops == 15.0


def test_total_throughput(derived):
    assert derived(rmb_s=2.0, wmb_s=3.0).total_throughput_mb_s == 5.0


def test_latency_is_weighted(derived):
    assert derived().avg_latency_ms == pytest.approx(40 / 15)


def test_latency_of_an_idle_sample(derived):
    assert derived(r_s=0.0, w_s=0.0).avg_latency_ms == 0.0


def test_ratios_sum_to_one(derived):
    row = derived(r_s=10.0, w_s=10.0)
    assert row.read_ratio + row.write_ratio == pytest.approx(1.0)


@pytest.mark.parametrize("profile, ratio", [("additive", 0.0), ("product", 0.5), ("clipped", 0.0)])
def test_ratios_of_an_idle_sample(derived, profile, ratio):
    row = derived(profile, r_s=0.0, w_s=0.0)
    assert (row.read_ratio, row.write_ratio) == (ratio, ratio)


def test_request_size(derived):
    assert derived(r_s=10.0, w_s=10.0).avg_request_size_kb == pytest.approx(102.4)


def test_additive_saturation(derived):
    row = derived(util_pct=80.0, aqu_sz=2.0, r_await=5.0, w_await=5.0)
    assert row.saturation_score == pytest.approx(40 + 60 + 10)
    assert row.latency_pressure == pytest.approx(15.0)


def test_clock_columns(derived):
    row = derived(timestamp="2025-06-15T14:30:00")
    assert row.hour_of_day == 14
    assert row.day_of_week == pd.Timestamp("2025-06-15").dayofweek == 6


def test_product_profile(derived):
    row = derived("product", aqu_sz=2.0, rrqm_s=3.0, wrqm_s=2.0, svctm=1.0, iowait_pct=10.0)
    assert row.saturation_score == 100.0
    assert row.merge_efficiency == pytest.approx(5 / 20)
    assert row.await_ratio == 2.0 and row.queue_efficiency == 7.5
    assert row.write_amplification == 0.5 and row.iowait_pressure == 5.0
    assert row.svctm_await_ratio == pytest.approx(1 / (40 / 15))


def test_product_defaults(derived):
    row = derived("product", r_s=0.0, w_s=0.0, r_await=0.0, aqu_sz=0.0)
    assert (row.await_ratio, row.svctm_await_ratio, row.write_amplification) == (1.0, 1.0, 1.0)
    assert (row.merge_efficiency, row.queue_efficiency, row.avg_request_size_kb) == (0.0, 0.0, 0.0)


def test_clipped_bounds(derived):
    row = derived("clipped", svctm=1000.0, rrqm_s=-1.0)
    assert row.svctm_await_ratio == 10.0 and row.merge_efficiency == 0.0


def test_malformed_timestamp_becomes_null(derived):
    row = derived("product", timestamp="not a time")
    assert row.timestamp is None and row.hour_of_day is None and row.total_iops == 15.0


def test_unknown_profile(derived):
    with pytest.raises(ValueError):
        derived("other")


@pytest.mark.parametrize("values, label", [
    (dict(util_pct=81.0, w_s=2000.0), "saturated"),
    (dict(aqu_sz=5.1), "saturated"),
    (dict(w_s=1200.0), "burst_io"),
    (dict(rmb_s=0.1, wmb_s=0.1, r_await=50.0), "small_io_pressure"),
    (dict(r_await=20.0), "latency_sensitive"),
    ({}, "balanced"),
])
def test_fixed_thresholds_take_the_first_match(derived, values, label):
    assert derived("product", **values).workload_pattern == label


@pytest.mark.parametrize("values, label", [
    (dict(util_pct=85.0), "saturated"),
    (dict(util_pct=None, aqu_sz=3.0), "saturated"),
    (dict(avg_latency_ms=10.0), "latency_sensitive"),
    (dict(write_ratio=0.7, read_ratio=0.7), "write_heavy"),
    (dict(read_ratio=0.7), "read_heavy"),
    (dict(avg_request_size_kb=16.0), "small_io_pressure"),
    (dict(total_throughput_mb_s=50.0), "high_throughput"),
    (dict(total_throughput_mb_s=50.0, avg_latency_ms=5.0, total_iops=500.0), "burst_io"),
    (dict(avg_request_size_kb=8.0, total_iops=0.0), "balanced"),
    (dict(util_pct=None, aqu_sz=None, avg_latency_ms=None), "balanced"),
])
def test_eight_classes(spark, values, label):
    row = dict(read_ratio=0.5, write_ratio=0.5, avg_request_size_kb=64.0, util_pct=10.0, aqu_sz=1.0,
               avg_latency_ms=1.0, total_iops=100.0, total_throughput_mb_s=10.0)
    row.update(values)
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))
    assert add_workload_patterns(df).first().workload_pattern == label


def test_eight_classes_without_inputs(spark):
    out = add_workload_patterns(spark.createDataFrame([("sda",)], "device string"))
    assert out.columns == ["device", "workload_pattern"]
    assert out.first().workload_pattern == "balanced"


def test_adaptive_thresholds_are_exact_percentiles(raw):
    df = derive_features(raw, "clipped")
    got = {r.workload_pattern: r["count"] for r in add_adaptive_patterns(df).groupBy("workload_pattern").count().collect()}
    assert len(got) >= 4 and sum(got.values()) == df.count()
