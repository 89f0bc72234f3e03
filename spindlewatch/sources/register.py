"""A register of the runs that a stored table holds, so that no history is read to find the newest.

It lies beside the table and has one row per run: the newest timestamp and the number of rows. It is
kept by every write of runs; a write of a run replaces that run's row. Rows without a run have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

RUN = "ingest_run_id"
SCHEMA = f"newest timestamp, n_rows long, {RUN} string"


def register_path(path: str) -> str:
    return f"{path.rstrip('/')}.runs"


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema
    except Exception as error:  # the reader has no other way to tell
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return False
        raise
    return True


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"timestamp timestamp, {RUN} string").parquet(path)


def _record(rows: DataFrame, path: str, mode: str) -> None:
    """One file per run; other runs keep theirs in mode dynamic."""
    counted = rows.where(F.col(RUN).isNotNull()).groupBy(RUN).agg(
        F.max("timestamp").alias("newest"), F.count(F.lit(1)).alias("n_rows"))
    (counted.select("newest", "n_rows", RUN).write.mode("overwrite").option("partitionOverwriteMode", mode)
     .partitionBy(RUN).parquet(register_path(path)))


def record_runs(spark: SparkSession, path: str, runs: list[str]) -> None:
    """Renew the rows of `runs` from the folders of these runs in the table at `path`."""
    if runs:
        _record(_stored(spark, path).where(F.col(RUN).isin(runs)), path, "dynamic")


def rebuild_register(spark: SparkSession, path: str) -> None:
    """Make the register anew from the whole table: for tables stored without one, and after deletions."""
    _record(_stored(spark, path), path, "static")


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """(newest, n_rows, ingest_run_id) of the table at `path`; made first if the table has none yet."""
    if not exists(spark, register_path(path)):
        rebuild_register(spark, path)
    return spark.read.schema(SCHEMA).parquet(register_path(path))
