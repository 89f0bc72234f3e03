"""Run selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def latest_run(table: DataFrame, name: str = "ingest_run_id") -> DataFrame:
    """One row: the run of the newest timestamp, ignoring rows without a run.

    `table` holds samples or events, or is the register of their runs, which has one row per run.
    Equal timestamps are settled by the larger run id.
    """
    known = table.where(F.col("ingest_run_id").isNotNull())
    when = "newest" if "newest" in table.columns else "timestamp"
    return known.agg(F.max_by("ingest_run_id", F.struct(when, "ingest_run_id")).alias(name))


def latest_runs(curated: DataFrame, events: DataFrame) -> DataFrame:
    """One row with the latest run of the events and of the curated samples, from these or their registers."""
    return latest_run(events, "anomaly_run_id").select(
        "anomaly_run_id", latest_run(curated, "curated_run_id").scalar().alias("curated_run_id"))


def only_latest(table: DataFrame, of: DataFrame) -> DataFrame:
    """Rows of `table` that belong to the latest run of `of`.

    The run id is a scalar subquery, so on a table partitioned by run only that
    partition is read; with the register of a table as `of`, nothing else is.
    """
    return table.where(F.col("ingest_run_id") == latest_run(of).scalar())


def only_run(table: DataFrame, run: str | None) -> DataFrame:
    """Rows of one run, or all rows when no run is given."""
    return table if run is None else table.where(F.col("ingest_run_id") == run)


def count_where(condition: Column) -> Column:
    return F.count_if(condition).cast("long")
