import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import frame
from spindlewatch.functions.rolling import rolling, with_halo
from spindlewatch.operators.detect import add_rolling_baselines
from spindlewatch.operators.facts import device_timeseries


@pytest.fixture(scope="module")
def uneven(spark):
    """A dense device, one with bursts and long gaps, and a tiny one; some values missing."""
    rng = np.random.default_rng(3)
    t0 = pd.Timestamp("2025-01-01")
    parts = {
        "dense": np.arange(400),
        "bursts": np.concatenate([np.arange(90), 50_000 + np.arange(3), 90_000 + np.arange(1),
                                  150_000 + np.arange(2), 400_000 + np.arange(120)]),
        "tiny": np.array([5, 200_000]),
    }
    rows = pd.concat([pd.DataFrame({
        "device": d, "timestamp": t0 + pd.to_timedelta(s, unit="s"),
        "v": rng.normal(size=len(s))}) for d, s in parts.items()])
    rows.loc[rng.random(len(rows)) < 0.1, "v"] = np.nan
    return spark.createDataFrame(rows.sample(frac=1.0, random_state=2))


def expected(df, window):
    pdf = df.toPandas().sort_values(["device", "timestamp"]).reset_index(drop=True)
    groups = pdf.groupby("device")["v"]
    pdf["v_rolling_mean"] = groups.transform(lambda s: s.rolling(window, min_periods=2).mean())
    pdf["v_rolling_std"] = groups.transform(lambda s: s.rolling(window, min_periods=2).std())
    return pdf


@pytest.mark.parametrize("window", [2, 5, 60])
@pytest.mark.parametrize("chunks", [None, 1, 12, 80])
def test_rolling_matches_pandas(uneven, window, chunks):
    out = frame(add_rolling_baselines(uneven, ["v"], window, chunks), "device", "timestamp")
    pd.testing.assert_frame_equal(out, expected(uneven, window), check_like=True, rtol=1e-6, atol=1e-9)


def test_rows_without_timestamp_come_last(spark):
    rows = [("a", f"2025-01-01 00:00:{i:02d}", float(i)) for i in range(20)] + [("a", None, 100.0)]
    df = spark.createDataFrame(rows, "device string, t string, v double").select(
        "device", F.col("t").cast("timestamp").alias("timestamp"), "v")
    for chunks in (None, 4):
        out = rolling(df, "device", ["timestamp", "v"], 1, lambda w: {"s": F.sum("v").over(w)}, chunks)
        got = {r.v: r.s for r in out.collect()}
        assert got[100.0] == 119.0 and got[0.0] == 0.0 and got[19.0] == 37.0 and len(got) == 21


@pytest.mark.parametrize("window", [2, 60])
def test_ranges_follow_the_rows(spark, window):
    """A burst of one device is cut; sparse devices are not, and few rows are read twice."""
    burst = spark.range(6000).selectExpr("'dense' AS device", "timestamp_micros(id * 10) AS timestamp", "id AS v")
    sparse = spark.range(5000).selectExpr(
        "concat('sparse', id % 5) AS device", "timestamp_seconds(id * 300) AS timestamp", "id AS v")
    chunks = 20
    out = with_halo(burst.union(sparse), "device", ["timestamp", "v"], window - 1, chunks).toPandas()
    own = out[~out["_halo"]]
    cells = own.groupby(["device", "_chunk"]).size()
    assert len(own) == 11_000 and cells.max() < 3 * 11_000 / chunks
    assert len(out) - len(own) <= (window - 1) * len(cells)
    assert len(cells["dense"]) >= 8 and len(cells) <= chunks + 5


def test_equal_timestamps_are_split_by_the_other_columns(spark):
    df = spark.range(3000).selectExpr("'a' AS device", "timestamp_seconds(0) AS timestamp", "CAST(id AS DOUBLE) AS v")
    assert with_halo(df, "device", ["timestamp", "v"], 4, 10).select("_chunk").distinct().count() >= 8
    out = rolling(df, "device", ["timestamp", "v"], 1, lambda w: {"s": F.sum("v").over(w)}, 10)
    assert {r.v: r.s for r in out.collect()} == {float(i): float(max(2 * i - 1, 0)) for i in range(3000)}


def test_timeseries_first_row_has_no_deviation(curated):
    first = frame(device_timeseries(curated), "device", "timestamp").groupby("device").head(1)
    assert first["latency_rolling_std"].isna().all()
    assert (first["latency_rolling_mean"] == first["avg_latency_ms"]).all()
