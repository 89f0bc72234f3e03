"""What operators hand around: ids, signatures only where they are needed, and large rows a few at a time."""

import math
import random

from pyspark.sql import functions as F

from spindlewatch.llm import components, lines, lm
from spindlewatch.session import stage


def staged_rows(monkeypatch, module):
    """Rows of the tables that `module` stages, by name."""
    rows = {}

    def counting(df, name, *more):
        out = stage(df, name, *more)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(module, "stage", counting)
    return rows


def test_size_bands_differ_by_one_at_most(spark):
    sizes = sorted({int(1.1 ** i) + j for i in range(60) for j in range(2)})
    for share in (0.85, 0.8, 0.5, 1.0):
        found = spark.createDataFrame([(n,) for n in sizes], "n long").select(
            "n", components.size_band(F.col("n"), share).alias("b")).collect()
        band = {r["n"]: r["b"] for r in found}
        for a in sizes:
            for b in sizes:
                if a <= b and a >= share * b:
                    assert 0 <= band[b] - band[a] <= 1


def test_keys_of_few_nodes_need_no_signatures(spark, monkeypatch):
    # Nodes 2i and 2i + 1 are linked and share two keys; all of a ten share one key, and no link.
    n = 60
    keys = [(i // 10, i) for i in range(n)] + [(100 + 10 * (i // 2) + j, i) for i in range(n) for j in range(2)]
    postings = spark.createDataFrame([(k, i, 3) for k, i in keys], "key long, node long, band long")
    needed = spark.range(n).select(F.col("id").alias("node"), F.lit(2).alias("least"))
    seen = []

    def verify(pairs):
        seen.extend((r["a"], r["b"]) for r in pairs.collect())
        return pairs.filter("a div 2 = b div 2")

    def signatures(nodes):
        return nodes.select("node", F.struct(F.array(F.lit(1)).alias("items")).alias("sig"))

    rows = staged_rows(monkeypatch, components)
    found, _ = components.link(postings, signatures, lambda a, b: F.lit(True), verify, needed)
    assert {(r["node"], r["component"]) for r in found.collect()} == {(i, i - i % 2) for i in range(n)}
    assert rows.get("blocks", 0) == 0
    assert len(seen) == len(set(seen))


def test_pairs_below_the_similarity_are_no_rows(spark, monkeypatch):
    # Lines that share most of their words in turn: many agree in a band, few are similar enough.
    rng = random.Random(5)
    base = [f"word{i:02d}xx" for i in range(24)]
    texts = [" ".join(w if rng.random() < 0.8 else f"other{rng.randrange(10 ** 6)}" for w in base) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = staged_rows(monkeypatch, components)
    signed = lines.signed_lines(docs)
    found, links = lines.line_classes(docs, signed)
    sets = {r["k"]: set(r["s"]) for r in docs.select(
        lines.line_key(F.col("text")).alias("k"), lines.shingles(F.col("text")).alias("s")).collect()}
    near = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(r["a"], r["b"]) for r in links.collect()} <= near
    assert rows.get("fresh", 0) <= len(near)
    assert math.isclose(found.count(), len({n for pair in near for n in pair}), abs_tol=2)


def test_groups_come_to_scoring_a_few_at_a_time(spark):
    binary = F.lit("x").cast("binary")
    groups = spark.range(200).select(
        F.col("id").alias("chunk"), F.array(F.lit(1)).alias("doc_ids"), F.array(F.lit(1)).alias("sizes"),
        binary.alias("ids"), binary.alias("words"))
    merged = spark.range(400).select(
        F.when(F.col("id") < 390, F.col("id") % 195).alias("chunk"), F.col("id").alias("bucket"), binary.alias("found"))
    rows = lm.with_counts(groups, merged).select(
        "chunk", F.spark_partition_id().alias("part"), F.size("merged").alias("n")).collect()
    assert {r["chunk"]: r["n"] for r in rows} == {i: 2 if i < 195 else None for i in range(200)}
    parts = [r["part"] for r in rows]
    assert max(map(parts.count, set(parts))) <= 8
