"""Operators do the whole job: nothing is left out that the plain definition includes."""

import random
import re
from collections import Counter
from uuid import uuid4

import numpy as np
from pyspark.sql import functions as F

from spindlewatch.llm import jaccard, lines, lm, queries
from spindlewatch.llm.tokens import encoder

VOCAB = f"{queries.TOKENIZERS}/byte_bpe_multi_50k.tiktoken"


def test_line_dedup_keeps_the_last_copy_of_short_remainders(spark):
    import corpus_pipeline

    common = "\n".join(f"a long shared line number {i} with quite some words in it" for i in range(8))
    rows = [(1, common), (2, f"{common}\nonly here"), (3, common), (4, f"{common}\n \t"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {1: (common, len(common)), 2: ("only here", 9), 5: (None, None)}


def test_every_training_token_is_a_target_once():
    ids = np.arange(2, 302, dtype=np.int16)
    tokens, trains = np.array([1, 32, 33, 100, 134]), np.array([True, True, False, True, True])
    for most in (1, 3, 1 << 15):
        rows = np.concatenate(list(lm.consecutive(ids, tokens, trains, most)))
        ends = np.cumsum(tokens)
        want = np.concatenate([ids[e - n:e] for e, n, t in zip(ends, tokens, trains) if t])
        assert rows[:, 1:][rows[:, 1:] >= 0].tolist() == want.tolist()
        lead = {int(ids[e - n]): lm.END_ID for e, n in zip(ends, tokens)}
        assert all(r[0] == lead.get(int(r[1]), r[1] - 1) for r in rows)


def test_tuning_reads_every_training_token(spark, monkeypatch, tmp_path):
    plain, seen = lm.train, str(tmp_path)

    def noted(model, windows, steps, rate, *rest):
        if rate < 0.01:  # of the tuning pass; the workers get this function by value
            np.save(f"{seen}/{uuid4().hex}.npy", windows)
        return plain(model, windows, 1, rate, *rest)

    monkeypatch.setattr(lm, "train", noted)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "and", "of", "queue"]) for _ in range(n))) for i, n in enumerate((5, 700, 90, 40))]
    docs = spark.createDataFrame([*rows, (9, None)], "doc_id long, text string").repartition(2)
    groups = lm.tokenise(docs, F.col("doc_id") != 2, "doc_id", "text", 4)
    vocabulary = lm.fit_vocabulary(lm.merge_counts(groups, VOCAB, queries.word_pattern(), 4), VOCAB, queries.word_pattern())
    code = encoder(VOCAB, queries.word_pattern())
    want = Counter(x for i, t in rows if i != 2 for w in t.split()
                   for x in vocabulary.ids[code._encode_single_piece(b" " + w.encode())].tolist())
    want[lm.END_ID] = 4
    lm.fit(groups, vocabulary, steps=1)
    got = np.concatenate([np.load(f)[:, 1:].ravel() for f in tmp_path.glob("*.npy")])
    assert Counter(got[got >= 0].tolist()) == want


def test_shingles_start_at_words_and_at_every_character_of_long_ones(spark):
    texts = ["short", "exactly12chr", "a longer line of words", "see 0123456789abcdef twice", "漢字かな交じり文は空白なしで続く。😀🎉と絵文字も", "  ends in thirteenchars ", ""]

    def plain(text):
        line, out = text.strip(), []
        for word in re.finditer(r"\S+", line):
            starts = [word.start()] if len(word[0]) <= 12 else range(word.start(), word.end())
            out += [line[i:i + 12] for i in starts if i == word.start() or i + 12 <= len(line)]
        return out

    rows = [(i, t, plain(t)) for i, t in enumerate(texts)]
    for r in spark.createDataFrame(rows, "i int, t string, want array<string>").select(
            lines.shingles(F.col("t")).alias("got"), F.transform("want", lambda s: F.xxhash64(s)).alias("want")).collect():
        assert r["got"] == r["want"]


def test_near_lines_without_blanks_are_found(spark):
    rng = random.Random(6)
    rows, near = [], set()
    for pair in range(120):  # Chinese lines, long tokens and spaced lines; one character differs
        alphabet, n = [("".join(map(chr, range(0x4E00, 0x5200))), 86), ("0123456789abcdef", 300),
                       ("abcdefghij klmn op", 200)][pair % 3]
        line = "".join(rng.choices(alphabet, k=n)).replace("  ", " a").strip()
        at = rng.randrange(1, 12)
        other = line[:at] + "x" + line[at + pair % 2:]
        rows += [(2 * pair, line), (2 * pair + 1, other)]
        a, b = ({t[i:i + 12] for i in range(len(t) - 11)} for t in (line, other))
        if len(a & b) >= 0.8 * len(a | b):
            near.add(2 * pair + 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r["doc_id"] for r in lines.dedup_lines(df).filter("n_gone > 0").collect()}
    assert len(near) > 100 and gone <= near and len(gone) >= 0.97 * len(near)


def test_all_links_and_their_numbers_equal_brute_force(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(40):  # a component with pairs on both sides of the bound, over several parts
        words = list(base)
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    rows += [(50, rows[3][1]), (51, rows[3][1]), (51, rows[3][1]), (60, "all alone here in this text"), (61, None), (None, rows[3][1])]
    rows += [(70 + i, f"a pair of texts number {i // 2} " + " ".join(base[10 * i // 2:])) for i in range(4)]
    sets = {}
    for i, t in rows:
        words = (t or "").split()
        if i is not None:
            sets[i] = frozenset(tuple(words[k:k + 4]) for k in range(len(words) - 3))
    near = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 85 * len(a | b)
    reps = {}
    for i in sorted(sets):
        reps.setdefault(sets[i], i)
    want = {(a, b) for x, a in reps.items() for y, b in reps.items() if a < b and near(x, y)}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found, links = jaccard.similar_documents(df, count_links=True, block=8)
    got = [tuple(r) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    numbers = {r["doc_id"]: r["n_links"] for r in found.collect()}
    assert numbers.pop(None) == 0
    assert numbers == {i: sum(near(s, o) for k, o in sets.items() if k != i) for i, s in sets.items()}


def test_a_pass_reads_every_window_once(monkeypatch):
    plain, seen = lm.gradient, []
    monkeypatch.setattr(lm, "gradient", lambda model, ids: seen.extend(ids[:, 1].tolist()) or plain(model, ids))
    windows = np.tile(np.arange(150)[:, None], (1, lm.REACH + 1))
    lm.train(lm.fresh(np.random.default_rng(1)), windows, None, 0.002, 2)
    assert sorted(seen) == list(range(150)) and seen != sorted(seen)
