"""Pure helpers of the text operators, against plain versions."""

import random
import zlib

import numpy as np
import pytest

from spindlewatch.llm import chat, common, decontaminate, langid, lm


def test_words_are_split_at_the_six_spaces_and_lowered_in_ascii_only():
    texts = ["Ab\tÄB  c", None, "", " \x0b\x0c ", "x Y z\n"]
    words, counts = common.split_words(texts)
    assert [w.decode() for w in words.to_pylist()] == ["ab", "Äb", "c", "x y", "z"]
    assert counts.tolist() == [3, 0, 0, 0, 2]


def test_slices_rejoin_and_are_bounded():
    text = "word " * 50 + "x" * 300 + " end"
    parts = common.slices(text, 64)
    assert "".join(parts) == text and max(map(len, parts)) <= 64


def test_chat_escapes_are_reversible_and_keep_turns_apart():
    rng = random.Random(3)
    for _ in range(300):
        turns = [("".join(rng.choices(["<", "|", "\\", "n", "\n", "im_end", "a"], k=rng.randrange(8))),
                  "".join(rng.choices(["<|", "\\", "|>", "im_start", "<|im_end|>", "\n", "é"], k=rng.randrange(8))))
                 for _ in range(rng.randrange(4))]
        text, _ = chat.render(turns, "assistant")
        assert chat.parse(text) == turns


def test_loss_mask_by_search_equals_pairwise_overlap():
    rng = np.random.default_rng(1)
    for _ in range(100):
        cuts = np.unique(rng.integers(0, 60, 12))
        starts, ends = cuts[:-1], cuts[1:]
        edges = np.unique(rng.integers(0, 60, 6))
        spans = [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]
        want = [any(s < b and e > a for a, b in spans) for s, e in zip(starts, ends)]
        assert chat.loss_mask(starts, ends, spans).tolist() == want


def edits(pattern, text):
    """Least edits of the pattern against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_passages_are_found_exactly_when_their_edits_fit_the_budget():
    rng = random.Random(5)
    alphabet = "abcdefgh "
    items = [(i, "".join(rng.choices(alphabet, k=rng.randrange(60, 140))).strip() + "x") for i in range(4)]
    held = decontaminate.Items(items, 0.08)
    for trial in range(60):
        item, passage = rng.choice(items)
        part = list(passage)
        for _ in range(rng.randrange(0, 14)):
            at = rng.randrange(len(part))
            kind = rng.randrange(3)
            if kind == 0:
                part[at] = rng.choice(alphabet)
            elif kind == 1:
                part.insert(at, rng.choice(alphabet))
            elif len(part) > 1:
                del part[at]
        text = "".join(rng.choices(alphabet, k=200)) + "".join(part) + "".join(rng.choices(alphabet, k=150))
        codes, _ = decontaminate.normal(text)
        found = {held.ids[i]: n for i, _, _, n in held.regions(codes)}
        folded = "".join(map(chr, codes))
        for k, (name, _) in enumerate(items):
            least = edits("".join(map(chr, held.codes[k])), folded)
            assert found.get(name) == (least if least <= held.edits[k] else None)


def test_attention_gradient_agrees_with_differences():
    rng = np.random.default_rng(0)
    model = {k: x.astype(np.float64) + (rng.normal(0, 0.1, x.shape)) for k, x in lm.fresh(rng).items()}
    ids = rng.integers(0, 40, (3, lm.REACH + 1))
    ids[1, 20:] = -1

    def loss():
        hidden, _ = lm._attend(model, ids[:, :-1], 0)
        target = ids[:, 1:].ravel()
        live = target >= 0
        h, t = hidden.reshape(-1, lm.DIM)[live], target[live]
        z = lm._log_softmax(h @ model["group"] + model["group0"])[np.arange(len(t)), t // lm.SIDE]
        for g in np.unique(t // lm.SIDE):
            at = np.flatnonzero(t // lm.SIDE == g)
            y = lm._log_softmax(h[at] @ model["member"][g] + model["member0"][g])
            z[at] += y[np.arange(len(at)), t[at] % lm.SIDE]
        return -z.mean()

    g = lm.gradient(model, ids)
    for name in lm.PARTS:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        keep = model[name][at]
        model[name][at] = keep + 1e-4
        up = loss()
        model[name][at] = keep - 1e-4
        down = loss()
        model[name][at] = keep
        assert (up - down) / 2e-4 == pytest.approx(g[name][at], rel=2e-2, abs=1e-5)


def test_every_token_is_scored_once_in_its_own_text():
    rng = np.random.default_rng(2)
    model = lm.train(lm.fresh(rng), rng.integers(0, lm.SIDE ** 2, (64, lm.REACH + 1)), 3, 0.02, 1)
    scorer = lm.Scorer(model)
    one, two = rng.integers(0, lm.SIDE ** 2, 70).astype(np.int16), rng.integers(0, lm.SIDE ** 2, 5).astype(np.int16)
    start = np.zeros(75, bool)
    start[[0, 70]] = True
    both = lm.score_ids(scorer, np.concatenate([one, two]), start)
    for text, part in ((one, both[:70]), (two, both[70:])):
        first = np.zeros(len(text), bool)
        first[0] = True
        assert np.allclose(part, lm.score_ids(scorer, text, first), atol=1e-5)
    # All next ids together have probability one.
    hidden = scorer.hidden(np.full((1, lm.REACH), 7, np.int16))[:, -1]
    every = np.arange(lm.SIDE ** 2, dtype=np.int16)
    total = np.exp(scorer.log_probs(np.repeat(hidden, lm.SIDE ** 2, 0), every)).sum()
    assert total == pytest.approx(1, abs=1e-3)


def test_subwords_stay_inside_words_and_texts():
    buckets, owner = langid.grams(["ab c", "", "ab"])
    # " a", "ab", "b ", " ab", "ab ", " ab " of each "ab"; " c", "c ", " c " of "c".
    assert np.bincount(owner, minlength=3).tolist() == [9, 0, 6]
    assert sorted(buckets[owner == 2]) == sorted(set(buckets[owner == 0]) & set(buckets[owner == 2]))


def test_buckets_of_ids(spark):
    from pyspark.sql import functions as F

    df = spark.range(50).select("id", common.bucket_of(F.col("id"), 7).alias("b"))
    assert all(r["b"] == zlib.crc32(str(r["id"]).encode()) % 7 for r in df.collect())
