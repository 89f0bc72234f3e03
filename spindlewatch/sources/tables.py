"""Stored tables: Parquet folders partitioned by run, exports and JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from spindlewatch.operators.runs import only_run
from spindlewatch.sources.register import RUN, exists, record_runs

CSV_TIMESTAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"  # the default drops microseconds


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Whole table. Without a schema, columns added over time are merged from all files.

    Run ids are always read as text, also when they look like numbers or dates.
    """
    if schema is None:
        found = spark.read.option("mergeSchema", True).parquet(path).schema
        schema = T.StructType([
            T.StructField(RUN, T.StringType()) if f.name == RUN else f for f in found])
    return spark.read.schema(schema).parquet(path)


def read_run(spark: SparkSession, path: str, run: str | None = None,
             schema: T.StructType | None = None) -> DataFrame:
    """Rows of one run (only its folder is read), or the whole table."""
    return only_run(read_table(spark, path, schema), run)


def write_runs(df: DataFrame, path: str, arrange: bool = False) -> None:
    """Store the runs in `df`, replacing any earlier rows of the same runs.

    Writing a run twice changes nothing. `arrange` is meant for new samples: rows are
    gathered by run, a run larger than the advisory partition size being split over several
    tasks, and each file is sorted by device and timestamp so that file statistics can skip
    data. What is derived from stored rows keeps their order and needs no shuffle.

    A table with a column `timestamp` has its register of runs renewed for the runs written; their
    names, a few per batch, come to the driver with the write itself.
    """
    written = Observation()
    df = df.observe(written, F.collect_set(RUN).alias("runs"))
    if arrange:
        df = df.hint("rebalance", RUN).sortWithinPartitions(RUN, "device", "timestamp")
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(RUN).parquet(path))
    if "timestamp" in df.columns:
        record_runs(df.sparkSession, path, sorted(written.get["runs"]))


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a table's rows but keep its columns; columns only `df` has are added."""
    spark = df.sparkSession
    if exists(spark, path):
        known = spark.read.parquet(path).schema
        df = spark.createDataFrame([], known).unionByName(df, allowMissingColumns=True)
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def export_dataset(df: DataFrame, folder: str, name: str, run: str | None = None) -> None:
    """Write a dataset as Parquet and CSV under a name with the run and under a stable name.

    Computed once: the other three copies are made from the first file.
    """
    spark = df.sparkSession
    named = f"{name}_{run if run else 'latest'}"
    first = f"{folder}/{named}.parquet"
    df.write.mode("overwrite").parquet(first)
    written = spark.read.schema(df.schema).parquet(first)
    written.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    for stem in (named, name):
        (written.write.mode("overwrite").option("header", True)
         .option("timestampFormat", CSV_TIMESTAMP).csv(f"{folder}/{stem}.csv"))


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str],
              run: str | None = None, column: str | None = None, lower: str | None = None,
              upper: str | None = None, partitions: int = 1) -> DataFrame:
    """Table of a database; with `column` and bounds it is read by several tasks at once.

    The run filter is pushed into the database by the reader.
    """
    if column is None:
        table_df = spark.read.jdbc(url, table, properties=properties)
    else:
        table_df = spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper,
                                   numPartitions=partitions, properties=properties)
    return only_run(table_df, run)


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str],
               mode: str = "append") -> None:
    """Append to, or replace the rows of, a database table."""
    writer = df.write.mode(mode)
    if mode == "overwrite":
        writer = writer.option("truncate", True)
    writer.jdbc(url, table, properties=properties)
