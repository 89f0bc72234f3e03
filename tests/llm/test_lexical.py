"""Ranked lexical search against brute force and SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from conftest import DATA
from spindlewatch.llm import lexical, queries

DOCS = "doc_id long, text string, Item_Id int, score string"
TERM = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def terms(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(TERM, lowered)


def brute(docs, items, k):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    total, out = sum(n for _, _, n in held), []
    for item, text in items:
        scored = []
        for d, c, n in held:
            m, score = 25 + 75 * n * len(held) // total, 0
            for term in terms(text):
                df = sum(term in other for _, other, _ in held)
                w = math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df + 1)))
                score += w * (1_000_000_000 * c[term] // (1000 * c[term] + 8 * m))
            if score > 0 and d is not None:
                scored.append((-score, d))
        out += [(item, rank, d, -s) for rank, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    names = ["Äpfel", "a1", "the", "of", "Zeta", "über", "naïve", "x"] + ["w%d" % i for i in range(60)]
    made = [" ".join(rng.choice(names) + rng.choice(["", ".", ",-", "\n"]) for _ in range(rng.choice([1, 5, 30, 90])))
            for _ in range(120)]
    return made + [made[3], made[3], None, "", " .,;\n", "the " * 4000]


def test_small_tables(spark, texts):
    docs = [(i if i != 7 else None, t) for i, t in enumerate(texts)]
    items = [(i, " ".join(t.split()[:12])) for i, t in enumerate(texts[:20])] + [(50, ""), (51, "nowhere"), (52, "THE the of")]
    frame = spark.createDataFrame([(*d, 1, "s") for d in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([*items, (60, None), (None, "the")], "item_id long, text string")
    got = lexical.search(frame, asked, 4)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(docs, items, 4)
    # One item in a block of its own, each with its own passes.
    few = spark.createDataFrame(items[:2], "item_id long, text string")
    assert sorted(map(tuple, lexical.search(frame, few, 4, item_chars=1).collect())) == brute(docs, items[:2], 4)


def test_empty_tables(spark, texts):
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(texts)], DOCS)
    asked = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical.search(docs.limit(0), asked).count() == 0
    assert lexical.search(docs, asked.limit(0)).count() == 0
    assert lexical.search(docs.filter("text is null or text = ''"), asked).count() == 0


def test_bounds_hold_and_spare_most_documents():
    rng = random.Random(9)
    made = [" ".join("w%d" % int(rng.paretovariate(0.6)) for _ in range(rng.choice([40, 200, 600]))) for _ in range(900)]
    asked = lexical.Queries.of([1, 2], [made[5], made[17]])
    group = lexical.Group.of(made, pa.array(asked.terms, pa.binary()))
    holding = np.bincount(group.place[group.place >= 0], minlength=len(asked.terms))
    asked.weigh(len(made), holding)
    m = 25 + 75 * group.n * len(made) // group.n.sum()
    best, done = lexical.Best(2, 10), 0
    for block in lexical._blocks(group, m, lexical.word_hashes(pa.array(asked.terms, pa.binary()))):
        for places, weights in zip(asked.places, asked.weights):
            exact = block.scores(np.arange(len(block.docs)), places, weights)
            assert (block.bounds(places, weights) >= exact).all()
        done += lexical.search_block(block, np.arange(len(made)), asked, best)
    assert best.ids[0, 0] == 5 and best.ids[1, 0] == 17
    assert done < 0.4 * 2 * len(made)


def test_the_query_equals_sql(spark):
    with duckdb.connect() as base:
        for name in ("documents", "benchmark"):
            base.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
        want = base.sql(queries.LEXICAL_SQL).select("item_id, rank, doc_id, score").fetchall()
    assert sorted(map(tuple, queries.op13_lexical_search(spark, DATA).collect())) == sorted(want) and want
