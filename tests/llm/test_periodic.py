"""Periodic runs against brute force."""

import random
import re
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from conftest import DATA
from spindlewatch.llm import periodic, queries


def brute(words, least=24, repeats=3):
    number, found = {}, {}
    codes = np.array([number.setdefault(w, len(number)) for w in words])
    for p in range(1, len(words) // repeats + 1):
        for a, b in zip(*periodic.stretches(codes[:-p] == codes[p:])):
            if b - a + p >= max(least, repeats * p):
                found.setdefault((int(a), int(b - a + p)), p)
    return sorted((a, n, p) for (a, n), p in found.items())


def dropped(n, runs):
    return {i for a, length, p in runs for i in range(a + p, a + length)}


@pytest.mark.parametrize("least,repeats", [(24, 3), (1, 2), (10, 3), (40, 4)])
def test_words_may_come_in_any_portions(least, repeats):
    rng = random.Random(least)
    for _ in range(300):
        n, k = rng.randrange(150), rng.choice([1, 2, 2, 3, 6])
        words = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(4) if n > 5 else 0):
            a, p = rng.randrange(n), rng.randrange(1, max(2, n // 3))
            for i in range(a, min(n, a + p * rng.randrange(2, 6))):
                words[i] = words[a + (i - a) % p]
        catchers, at = periodic.Catchers(least, repeats), 0
        while at < n:
            size = rng.choice([1, 3, 10, 50, 200])
            catchers.append(np.array(words[at:at + size], np.int64))
            at += size
        assert catchers.runs() == brute(words, least, repeats)


def test_the_query_equals_brute_force(spark):
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, DATA).collect()}
    planted = 0
    for doc, text in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
        n, h = len(words), crc32(str(doc).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = brute(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
        gone = dropped(n, runs)
        assert tuple(got[doc])[1:] == (
            len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
            sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())
    assert planted > 5 and sum(r["n_runs"] > 0 for r in got.values()) >= planted / 2


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, " \n\t ", 5), (4, "a " * 24, 5), (5, "a " * 23, 5), (4, "a " * 24, 5),
            (None, "x y z " * 12, 5), (6, "ä b C\n" * 9, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, RUNS int")
    found = periodic.find_runs(docs)
    assert found.columns == ["doc_id", "text", "runs", "collapsed"]
    got = sorted((r["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found.collect())
    assert got == [(0, [(0, 24, 2)], "x y z"), (1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 24, 1)], "a"),
                   (4, [(0, 24, 1)], "a"), (5, [], " ".join("a" * 23)), (6, [(0, 27, 3)], "ä b C")]
    assert periodic.find_runs(docs.limit(0)).count() == 0


def test_a_long_text(spark):
    rng = random.Random(2)
    words = ["w%d" % rng.randrange(50) for _ in range(400_000)]
    words[1000:300_000] = [words[1000 + i % 777] for i in range(299_000)]
    text = " ".join(words)
    assert len(text) > 1_500_000
    got = periodic.find_runs(spark.createDataFrame([(text,), ("b " * 500_000,)], "text string")).select("runs").collect()
    (start, length, period), = got[0][0]
    assert period == 777 and start <= 1000 and start + length >= 300_000
    assert [tuple(r) for r in got[1][0]] == [(0, 500_000, 1)]


def test_a_run_asks_for_two_periods_at_least():
    with pytest.raises(ValueError):
        periodic.Catchers(10, 1)
