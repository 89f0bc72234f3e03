"""Rolling row frames per device that do not gather a device in one task.

A window partitioned by device alone puts a device's whole history in one task. Here rows are
dealt into ranges of (device, order columns) of about equal size: a sparse device lies in one
range, two if it stands on a border, and a dense one in many, even if all its rows carry one
timestamp. Each range also receives the few rows of the device that precede it, so every frame
is complete and the result is that of the plain window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from spindlewatch.session import stage


def rolling(df: DataFrame, key: str, order: list[str], preceding: int,
            columns: Callable[[WindowSpec], dict[str, Column]],
            chunks: int | None = None) -> DataFrame:
    """Add `columns(window)` over the current row and the `preceding` ones of the same key.

    `order[0]` is the timestamp; the other order columns settle equal timestamps. Only rows equal
    in all of them always share a range. `chunks` is the number of ranges, by default that of the
    session's shuffle partitions.
    """
    frame = Window.partitionBy(key, "_chunk").orderBy(*_ascending(order)).rowsBetween(-preceding, 0)
    return (with_halo(df, key, order, preceding, chunks)
            .withColumns(columns(frame))
            .where(~F.col("_halo"))
            .drop("_chunk", "_halo"))


def with_halo(df: DataFrame, key: str, order: list[str], preceding: int,
              chunks: int | None = None) -> DataFrame:
    """Rows with the number of their range, `_chunk`, and again, as `_halo`, where a later one needs them."""
    places = [F.col(key), *_ascending(order)]
    ranged = df.repartitionByRange(chunks, *places) if chunks else df.repartitionByRange(*places)
    # Staged, as ranges come from a sample: a second evaluation may draw other borders.
    chunked = stage(ranged.withColumn("_chunk", F.spark_partition_id()), "chunks")
    counts = chunked.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    halo = _preceding_rows(chunked, counts, key, order, preceding)
    return chunked.withColumn("_halo", F.lit(False)).unionByName(halo)


def _ascending(order: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order]


def _preceding_rows(chunked: DataFrame, counts: DataFrame, key: str, order: list[str],
                    preceding: int) -> DataFrame:
    """Rows each chunk needs from before its start, labelled with that chunk.

    A row standing r-th from the end of its chunk is needed by a later chunk when r plus the
    rows of the chunks in between is at most `preceding`. No chunk is empty, so at most
    `preceding` following chunks can qualify.
    """
    sequence = Window.partitionBy(key).orderBy("_chunk")
    started = counts.withColumn("_end", F.sum("_n").over(
        sequence.rowsBetween(Window.unboundedPreceding, 0)))
    later = F.collect_list(F.struct(
        F.col("_chunk").alias("to"), (F.col("_end") - F.col("_n")).alias("start")))
    links = started.withColumn(
        "_later", later.over(sequence.rowsBetween(1, preceding))
    ).withColumn("_next", F.explode("_later")).select(key, "_chunk", F.col("_next.to").alias("_to"),
             (F.col("_next.start") - F.col("_end")).alias("_gap")
             ).where(F.col("_gap") < preceding)

    from_end = Window.partitionBy(key, "_chunk").orderBy(
        *[F.col(c).desc_nulls_first() for c in order])
    tails = chunked.withColumn("_back", F.row_number().over(from_end)).where(
        F.col("_back") <= preceding)
    linked = links.withColumnsRenamed({key: "_key", "_chunk": "_from"})
    return (
        tails.join(linked, tails[key].eqNullSafe(F.col("_key")) & (tails["_chunk"] == F.col("_from")))
        .where(F.col("_back") + F.col("_gap") <= preceding)
        .withColumn("_chunk", F.col("_to"))
        .drop("_key", "_from", "_to", "_gap", "_back")
        .withColumn("_halo", F.lit(True))
    )
