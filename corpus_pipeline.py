"""A training corpus from raw documents: five stages, each staged as Parquet.

language    documents whose language is not recognised go
lines       every line is kept once, fuzzy copies included; a document of which nothing but white
            space is left goes
copies      one document of each group of similar documents stays
benchmark   documents that hold a benchmark passage go
mixing      each document gets a rate and the copies an epoch takes; rate 0 goes
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spindlewatch.llm import decontaminate, jaccard, langid, lines, mixing
from spindlewatch.llm.common import table
from spindlewatch.llm.queries import TARGETS
from spindlewatch.session import stage

# Similar documents: five words, a similarity of 0.8.
NEAR = {"size": 5, "numerator": 80, "denominator": 100}
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of its input. Null texts and texts without a letter go."""
    return langid.keep_known(docs, langid.fit(docs, F.lit(True)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated lines, n_chars with them; documents that lost none are as before."""
    done = lines.dedup_lines(docs)
    left = F.length(F.regexp_replace("text", r"\s+", ""))
    kept = done.filter((F.col("n_gone") == 0) | (left > 0))
    length = F.when(F.col("n_gone") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", length).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, **NEAR)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = mixing.domains_of(table(spark, sf_dir, "labels"))
    return mixing.apply_rates(docs, mixing.mix(docs, labels, TARGETS)).filter("rate > 0")


STAGES = [("language", language), ("lines", line_dedup), ("copies", near_copies),
          ("benchmark", benchmark_free), ("mixing", mixture)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"corpus-{name}")
    return docs
