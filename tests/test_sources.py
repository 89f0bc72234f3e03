import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import frame
from spindlewatch.operators.quality import check_parsed, check_raw, enforce
from spindlewatch.schema import LOG_METRICS, RAW_METRICS, RAW_SCHEMA
from spindlewatch.sources import logs, tables

LOG = """\
Linux 6.1.0 (host)     01/02/2025     _x86_64_
early 1 2 3 4 5 6 7 8

Device            r/s     w/s     rMB/s     wMB/s   r_await   w_await   aqu-sz  %util
nvme0n1        300.00  150.00     25.00     12.00      0.25      0.50      0.40  25.00
sda            200.00  175.00     15.00     11.00      1.00      1.50      1.00  44.00
short            1.00    2.00

Device            r/s     w/s     rMB/s     wMB/s   r_await   w_await   aqu-sz  %util
sdb             80.00  120.00      8.00     10.00      5.00      7.00      2.50  64.00  extra
broken            one  120.00      8.00     10.00      5.00      7.00      2.50  64.00
"""


@pytest.fixture
def log_folder(tmp_path):
    (tmp_path / "a.log").write_text(LOG)
    (tmp_path / "headless.log").write_text("sdz 1 2 3 4 5 6 7 8\n")
    return str(tmp_path)


@pytest.fixture
def parsed(spark, log_folder):
    return logs.read_iostat(spark, log_folder, "2025-01-02 00:00:00")


def test_log_rows_follow_a_header_of_their_own_file(parsed):
    assert frame(parsed, "device")["device"].tolist() == ["nvme0n1", "sda", "sdb"]


def test_log_columns_are_numeric(parsed):
    assert {"device", "timestamp", *LOG_METRICS} <= set(parsed.columns)
    assert all(dict(parsed.dtypes)[m] == "double" for m in LOG_METRICS)
    row = parsed.where("device = 'sda'").first()
    assert [row[m] for m in LOG_METRICS] == [200.0, 175.0, 15.0, 11.0, 1.0, 1.5, 1.0, 44.0]


def test_log_rows_pass_quality(parsed):
    enforce(check_parsed(parsed))
    enforce(check_raw(parsed))


def test_malformed_lines_are_reported(spark, log_folder):
    rejected = logs.read_iostat_rejects(spark, log_folder).collect()
    assert len(rejected) == 1 and rejected[0].line.startswith("broken")


def test_log_larger_than_a_block(spark, tmp_path):
    header = LOG.splitlines()[3]
    early = ["early 1 2 3 4 5 6 7 8"] * 400
    late = [f"sd{i} 1 2 3 4 5 6 7 {i % 100}" for i in range(600)]
    (tmp_path / "big.log").write_text("\n".join([*early, header, *late, header, *late]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        out = logs.read_iostat(spark, str(tmp_path), "2025-01-02 00:00:00")
        assert out.where("device = 'early'").count() == 0
        assert out.count() == 1200
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_with_legacy_names(spark, tmp_path):
    (tmp_path / "x.csv").write_text("device,timestamp,r/s,w/s,util_pct\nsda,2025-01-01 00:00:00,1,2,oops\nsdb,bad,3,,5\n")
    out = logs.raw_rows(logs.with_lineage(logs.read_csv(spark, str(tmp_path)), "run-1"))
    rows = frame(out, "device")
    assert rows["r_s"].tolist() == [1.0, 3.0]
    assert pd.isna(rows["w_s"][1]) and pd.isna(rows["util_pct"][0])
    assert (rows["aqu_sz"] == 0.0).all()  # absent column
    assert rows["source_file"].str.endswith("x.csv").all()
    assert (rows["ingest_run_id"] == "run-1").all()


def test_no_line_of_a_log_is_shuffled(spark, log_folder):
    plan = logs.read_iostat(spark, log_folder, "2025-01-02 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Sort" not in plan


def test_logs_without_any_header(spark, tmp_path):
    (tmp_path / "headless.log").write_text("sdz 1 2 3 4 5 6 7 8\n")
    (tmp_path / "empty.log").write_text("")
    assert logs.read_iostat(spark, str(tmp_path), "2025-01-02 00:00:00").count() == 0


def test_csv_files_with_different_headers(spark, tmp_path):
    (tmp_path / "old one.csv").write_text("device,timestamp,r/s,w/s\nsda,2025-01-01 00:00:00,1,2\n")
    (tmp_path / "new[1].csv").write_text("\ndevice,timestamp,r_s,w_s,svctm\nsdb,2025-01-01 00:00:00,3,4,5\nsdb,bad,3,,NaN\n")
    (tmp_path / "back.csv").write_text("w_s,r_s,timestamp,device,more\n6,5,2025-01-01 00:00:00,sdc,x\n")
    (tmp_path / "bare.csv").write_text("device,timestamp,r_s\n")
    (tmp_path / "empty.csv").write_text("")
    out = logs.read_csv_mixed(spark, str(tmp_path), "run-1")
    assert out.schema.names == RAW_SCHEMA.names and len(logs.files_by_header(spark, str(tmp_path))) == 4
    rows = sorted(out.select("device", "r_s", "w_s", "svctm", "timestamp").collect(), key=str)
    assert [tuple(r)[:4] for r in rows] == [
        ("sda", 1.0, 2.0, 0.0), ("sdb", 3.0, 4.0, 5.0), ("sdb", 3.0, None, None), ("sdc", 5.0, 6.0, 0.0)]
    assert [r.timestamp is None for r in rows] == [False, False, True, False]
    assert {r.ingest_run_id for r in out.collect()} == {"run-1"}


def test_mixed_csv_without_rows(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert logs.read_csv_mixed(spark, str(tmp_path), "run-1").collect() == []


def test_ensure_columns_turns_nan_into_null(spark):
    df = spark.createDataFrame([("sda", float("nan"))], "device string, r_s double")
    out = logs.ensure_columns(df)
    assert set(RAW_METRICS) <= set(out.columns)
    assert out.first().r_s is None
    assert out.first().ingest_run_id is None


def test_new_name_wins_over_legacy_name(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "`r/s` double, r_s double")
    assert logs.ensure_columns(df).first().r_s == 2.0


def test_writing_a_run_twice_changes_nothing(spark, raw, tmp_path):
    path = str(tmp_path / "raw")
    tables.write_runs(raw, path, arrange=True)
    tables.write_runs(raw.where("ingest_run_id = 'run-01'"), path)
    again = tables.read_table(spark, path, RAW_SCHEMA)
    assert again.count() == raw.count()
    tables.write_runs(raw.where("ingest_run_id = 'run-01'").limit(1), path)
    assert tables.read_run(spark, path, "run-01", RAW_SCHEMA).count() == 1
    assert tables.read_run(spark, path, "run-02", RAW_SCHEMA).count() == raw.where("ingest_run_id = 'run-02'").count()


def test_reading_a_run_touches_only_its_folder(spark, raw, tmp_path):
    path = str(tmp_path / "raw")
    tables.write_runs(raw, path)
    files = tables.read_run(spark, path, "run-03", RAW_SCHEMA).select(F.input_file_name()).distinct().collect()
    assert all("ingest_run_id=run-03" in f[0] for f in files)
    plan = tables.read_run(spark, path, "run-03", RAW_SCHEMA)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ingest_run_id" in plan


def test_run_ids_stay_text(spark, tmp_path):
    df = spark.createDataFrame([("sda", "007")], "device string, ingest_run_id string")
    tables.write_runs(df, str(tmp_path / "t"))
    assert tables.read_table(spark, str(tmp_path / "t")).first().ingest_run_id == "007"


def test_replacing_a_table_keeps_its_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.createDataFrame([(1, "x")], "a int, b string"), path)
    tables.replace_table(spark.createDataFrame([(2, 3.0)], "a int, c double"), path)
    out = tables.read_table(spark, path)
    assert out.columns == ["a", "b", "c"]
    assert [tuple(r) for r in out.collect()] == [(2, None, 3.0)]


def test_export_writes_both_names_and_formats(spark, tmp_path):
    df = spark.range(3).withColumn("x", F.col("id") * 0.5)
    tables.export_dataset(df, str(tmp_path), "mart", "run-9")
    for stem in ("mart_run-9", "mart"):
        assert spark.read.parquet(f"{tmp_path}/{stem}.parquet").count() == 3
        csv = spark.read.option("header", True).csv(f"{tmp_path}/{stem}.csv")
        assert csv.columns == ["id", "x"] and csv.count() == 3


def test_jdbc_options_reach_the_reader():
    class Reader:
        def jdbc(self, url, table, **options):
            self.seen = (url, table, options)
            return "frame"

    class Session:
        read = Reader()

    assert tables.read_jdbc(Session, "jdbc:x", "raw", {"user": "u"}) == "frame"
    tables.read_jdbc(Session, "jdbc:x", "raw", {"user": "u"}, column="timestamp",
                     lower="2025-01-01", upper="2025-02-01", partitions=16)
    assert Session.read.seen[2]["numPartitions"] == 16
