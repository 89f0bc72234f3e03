"""Texts and vectors that once broke or misled an operator."""

import random

import numpy as np
from pyspark.sql import functions as F

from conftest import DATA
from spindlewatch.llm import langid, queries, tokens, topk

VOCAB = f"{queries.TOKENIZERS}/byte_bpe_multi_50k.tiktoken"


def test_signs_above_the_basic_plane_are_letters_only_if_unicode_says_so(spark):
    model = langid.fit(spark.read.parquet(f"{DATA}/documents.parquet"), F.lit(True))
    rows = [(1, "\U0001f600\U0001f600"), (2, "\U0001d7d9\U0001d7da"), (3, "\U00020000\U00020001\U00020002")]
    found = langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert {r["doc_id"]: (r["lang_pred"] == "und") for r in found} == {1: True, 2: True, 3: False}
    assert all(r["lang_rejected"] for r in found if r["doc_id"] < 3)


def test_long_runs_of_blanks_are_encoded_as_the_pattern_would():
    code = tokens.encoder(VOCAB, queries.word_pattern())
    rng = random.Random(7)
    blanks = [" ", "\n", "\t", "\u3000", "\xa0", "\r", "\x1c", "\u200b"]  # the last two are no white space here
    for _ in range(60):
        text = "".join("".join(rng.choices(blanks[:6] if rng.random() < 0.8 else blanks, k=rng.choice([1, 3, 1023, 1024, 2500])))
                       + rng.choice(["", "word", "x", "12", "--", "'s", "\u00e9"]) for _ in range(rng.randrange(1, 6)))
        assert tokens.encode_text(code, text) == code.encode_ordinary(text)


def test_a_million_blanks_are_counted(spark):
    code = tokens.encoder(VOCAB, queries.word_pattern())
    rows = [(1, "a" + " " * 1_000_000 + "b"), (2, " " * 2_000_000), (3, "\n" * 1_200_000 + "c"), (4, "- " * 1_000_000)]
    counted = tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), VOCAB, queries.word_pattern())
    got = {r["doc_id"]: r["n_tokens"] for r in counted.collect()}
    piece = {n: len(code._encode_single_piece(sign * n)) for n, sign in
             ((999_999, b" "), (2_000_000, b" "), (1_199_999, b"\n"))}
    assert got == {1: 1 + piece[999_999] + len(code.encode_ordinary(" b")), 2: piece[2_000_000],
                   3: piece[1_199_999] + len(code.encode_ordinary("\nc")), 4: len(code.encode_ordinary("- " * 1_000_000))}


def test_top_k_is_exact_for_large_components(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(300, [1e6] + [0.1] * 5), (301, [-1e6] * 6), (302, [999_999.5, 3.0, 0.0, 0.0, 0.0, 0.3]), (303, [3e6] * 6)]
    rows += [(i, rows[0][1]) for i in range(304, 330)]  # ties
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0)
    want = []
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
