"""The toxicity classifier: held-out accuracy, thresholds by language, odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindlewatch.llm import queries, toxicity
from spindlewatch.llm.common import bucket_of

LARGER = "/root/testdata/sf0.1"


def made(rng, bad, lang):
    stems = {"en": ["the", "and", "thing", "over", "with"], "de": ["und", "der", "schung", "keit", "über"]}[lang]
    words = [rng.choice(stems) + rng.choice(["", "ly", "en", "er"]) for _ in range(rng.randrange(5, 80))]
    for _ in range(2 if bad else 0):
        words.insert(rng.randrange(len(words)), {"en": "vilest", "de": "pfuischl"}[lang] + rng.choice(["", "er", "ig", "s"]))
    return " ".join(words)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    rows = [(i, made(rng, i % 4 == 0, "de" if i % 3 == 0 else "en"), "de" if i % 3 == 0 else "en", 3)
            for i in range(1800)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(1800) if i % 9] + [(4, 1, 0), (None, 1, 1), (5, 0, None), (5000, 1, 1)]
    rows += [(1900, None, "en", 3), (1901, "", None, 3), (1902, " .\n", "en", 3), (None, rows[0][1], "en", 3), (0, rows[0][1], "en", 3)]
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, Toxic_Score int").repartition(3),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out_accuracy_and_thresholds(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels, bucket_of(F.col("doc_id"), 5) != 0)
    assert set(model.cuts) == {"en", "de"}
    scored = toxicity.score(docs, model)
    assert scored.columns == ["doc_id", "text", "lang", "toxic_score"]
    rows = scored.withColumn("held", bucket_of(F.col("doc_id"), 5) == 0).collect()
    held = [r for r in rows if r["held"] and (r["doc_id"] or 0) < 1800]
    right = [(r["toxic_score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in held]
    assert len(held) > 100 and sum(right) >= 0.97 * len(right)
    assert all(0 <= r["toxic_score"] <= 1 for r in rows) and len(rows) == 1805
    blank = {r["toxic_score"] for r in rows if r["doc_id"] in (1900, 1901, 1902)}
    assert len(blank) == 1 and blank.pop() < 0.5
    assert len({r["toxic_score"] for r in rows if r["text"] == rows[0]["text"]}) == 1


def test_scores_do_not_hang_on_batches_or_length(tables, spark):
    docs, labels = tables
    model = toxicity.fit(docs, labels, F.lit(True), lang=None, epochs=2)
    texts = [r["text"] for r in docs.collect()] + ["und der " * 300_000 + "vilester " + "und der " * 10_000]
    whole = model.scores(texts)
    for i in (0, 5, len(texts) - 1):
        assert np.isclose(model.scores([texts[i]])[0], whole[i])
    assert whole[-1] >= 0.5


def test_without_labels_nothing_is_learned(spark, tables):
    docs, labels = tables
    for few in (labels.limit(0), labels.filter("toxic = 0")):
        model = toxicity.fit(docs, few, F.lit(True))
        assert {r["toxic_score"] for r in toxicity.score(docs, model).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_unseen_terms_answer_like_none():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 50, (20, toxicity.PIECES)).astype(np.int32) for _ in range(30)]
    model = toxicity.train(texts, np.array([0, 1] * 15), 1)
    unseen = toxicity.term_rows(pa.array([b"never-seen-before"]))
    assert not model.embed[unseen[unseen > 50]].any()


def test_thresholds_have_the_fewest_errors():
    z, y = np.array([-2.0, -1, 0, 1, 2, 3]), np.array([0, 0, 1, 0, 1, 1])
    assert threshold_errors(z, y, toxicity.threshold(z, y, np.ones(6))) == 1
    assert toxicity.threshold(z, np.array([0, 0, 0, 1, 1, 1]), np.ones(6)) == 0.5


def threshold_errors(z, y, cut):
    return int(((z >= cut) != (y == 1)).sum())


def test_given_labels_are_predicted(spark):
    got = queries.op12_toxicity(spark, LARGER)
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").filter("toxic is not null")
    r = got.filter("held_out").join(labels, "doc_id").agg(
        F.sum("toxic").alias("n"), F.sum(F.col("toxic") * F.col("predicted")).alias("hit"),
        F.sum((1 - F.col("toxic")) * F.col("predicted")).alias("false"), F.sum(1 - F.col("toxic")).alias("clean")).first()
    assert r["n"] > 50 and r["hit"] >= 0.75 * r["n"] and r["false"] <= 0.02 * r["clean"]
