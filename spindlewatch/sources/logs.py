"""Readers for device sample files: CSV and iostat text logs."""

from __future__ import annotations

import re
from datetime import datetime
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from spindlewatch.schema import LEGACY_NAMES, LOG_METRICS, RAW_METRICS, RAW_SCHEMA
from spindlewatch.session import stage

# --- Fixed values: what a log's header line contains, and the tokens of a sample line ---
HEADER_WORDS = ("Device", "r/s")
LOG_TOKENS = 9
# --- End of fixed values ---


def read_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Samples from CSV files with a header.

    Only the header's names are looked at; types come from the fixed schema, so no pass over
    the data is spent on inference. A number that does not parse becomes null.
    """
    header = spark.read.option("header", True).csv(paths).columns
    numeric = {*RAW_METRICS, *LEGACY_NAMES}
    return spark.read.schema(", ".join(
        f"`{c}` {'double' if c in numeric else 'string'}" for c in header
    )).option("header", True).option("enforceSchema", False).csv(paths)


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Headers and lines with enough tokens, staged once, with their place in their file.

    A place is the block of the file a line starts in and an id within it. A block is read by one
    task in file order, so the ids of its lines ascend. Staging turns places into data: whatever
    reads them later sees the same ones, however the files are split by then.
    """
    lines = spark.read.text(paths).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("position")).alias("place"),
    ).withColumn("is_header", F.contains("line", F.lit(HEADER_WORDS[0]))
                 & F.contains("line", F.lit(HEADER_WORDS[1])))
    return stage(lines.selectExpr(
        "*", r"split(trim(regexp_replace(line, '\\s+', ' ')), ' ') AS tokens"
    ).where(f"is_header OR size(tokens) >= {LOG_TOKENS}"), "log-lines")


def _sample_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines that follow a header of their own file and have enough tokens.

    A line counts if its place is after that of its file's first header. These places are one
    row per file, aggregated within tasks first, staged and joined back: lines stay in the tasks that
    read them while the places are under the session's broadcast threshold. Beyond it (hundreds
    of thousands of files) lines are shuffled by file, and AQE splits a large file's share.
    A file without a header gives no row, an empty one neither.
    """
    lines = _lines(spark, paths)
    first = stage(lines.where("is_header").groupBy("file").agg(F.min("place").alias("opened")), "log-headers")
    return (
        lines.where("NOT is_header").join(first, "file").where("place > opened")
        .selectExpr("file", "line", "tokens",
                    f"transform(slice(tokens, 2, {LOG_TOKENS - 1}), t -> try_cast(t AS DOUBLE)) AS numbers")
    )


def _malformed():
    return F.exists("numbers", lambda n: n.isNull())


def read_iostat(spark: SparkSession, paths: str | list[str],
                ingest_ts: datetime | str) -> DataFrame:
    """Samples from iostat text logs, all stamped `ingest_ts` (the logs carry no time per row).

    Lines whose numbers do not parse are left out; `read_iostat_rejects` returns them.
    """
    good = _sample_lines(spark, paths).where(~_malformed())
    return good.select(
        F.col("tokens")[0].alias("device"),
        F.lit(ingest_ts).cast("timestamp").alias("timestamp"),
        *[F.col("numbers")[i].alias(name) for i, name in enumerate(LOG_METRICS)],
        F.col("file").alias("source_file"),
    )


def read_iostat_rejects(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Sample lines left out because a number did not parse."""
    return _sample_lines(spark, paths).where(_malformed()).select(
        F.col("file").alias("source_file"), "line")


def with_lineage(df: DataFrame, run: str, source_file: str | None = None) -> DataFrame:
    """Stamp the run id, and the file each row came from unless one is named."""
    if source_file is not None:
        df = df.withColumn("source_file", F.lit(source_file))
    elif "source_file" not in df.columns:
        df = df.withColumn("source_file", F.input_file_name())
    return df.withColumn("ingest_run_id", F.lit(run))


def ensure_columns(df: DataFrame) -> DataFrame:
    """Repair drifted inputs: legacy names, absent metrics as 0.0, absent lineage as null.

    Values missing from a present column stay missing; NaN becomes null, since NaN would
    otherwise compare above every number.
    """
    df = df.withColumnsRenamed({
        old: new for old, new in LEGACY_NAMES.items() if old in df.columns and new not in df.columns})
    absent = {c: F.lit(0.0) for c in RAW_METRICS if c not in df.columns}
    absent.update({c: F.lit(None).cast("string")
                   for c in ("source_file", "ingest_run_id") if c not in df.columns})
    present = {c: F.nullif(F.col(c).cast("double"), F.lit(float("nan")))
               for c in RAW_METRICS if c in df.columns}
    return df.withColumns({**present, **absent})


def raw_rows(df: DataFrame) -> DataFrame:
    """Repaired rows in the order of the raw schema."""
    return ensure_columns(df).select(*RAW_SCHEMA.fieldNames())


def files_by_header(spark: SparkSession, paths: str | list[str]) -> dict[str, list[str]]:
    """Header line -> the CSV files that start with it.

    One pass over the text finds each file's first line; what reaches the driver is a line and the
    names of files, which any reader's file index holds there as well. Files without a line are absent.
    """
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"))
    firsts = lines.where((F.col("block") == 0) & (F.trim("value") != "")).groupBy("file").agg(
        F.min(F.struct("place", "value")).alias("first"))
    groups = firsts.groupBy(F.col("first.value").alias("header")).agg(F.array_sort(F.collect_list("file")).alias("files"))
    return {g.header: [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(f)) for f in g.files]
            for g in groups.orderBy("header").collect()}


def read_csv_mixed(spark: SparkSession, paths: str | list[str], run: str) -> DataFrame:
    """Raw rows of one run from CSV files whose headers differ in names, order or number of columns.

    Each kind of header is one scan with its own schema, repaired on its own: a legacy name, an absent
    metric or another order in one file does not touch the rows of another. There are as many
    scans as kinds of headers, not files. A header must end on its line. Without any file that has
    a header the result is empty.
    """
    parts = [raw_rows(with_lineage(read_csv(spark, files), run)) for files in files_by_header(spark, paths).values()]
    parts = [part.withColumn("timestamp", F.try_to_timestamp(F.col("timestamp").cast("string"))) for part in parts]
    return reduce(DataFrame.union, parts, spark.createDataFrame([], RAW_SCHEMA))
