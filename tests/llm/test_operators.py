"""The text operators on small tables with nulls, empty and long texts, ties and repeated rows."""

import math
import random
from collections import Counter
from hashlib import sha256
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from spindlewatch.llm import (chat, components, decontaminate, jaccard, langid, lines, lm, mixing, queries, tokens,
                              topk, urls)

DOCS = "doc_id long, text string, lang string, lang_pred int"
VOCAB = f"{queries.TOKENIZERS}/byte_bpe_multi_50k.tiktoken"


def text_of(rng, n):
    return " ".join(rng.choice(["the", "and", "Of", "thering", "ver", "ich", "queue"]) + str(rng.randrange(40))
                    for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    texts = [text_of(rng, n) for n in (30, 40, 3, 1, 60, 2000)]
    rows = [(i, t, "xx", 5) for i, t in enumerate(texts)]
    rows += [(10, texts[0], "xx", 5), (11, texts[0] + " more", "xx", 5), (12, None, None, None), (13, "", "xx", 5),
             (14, " \n\t ", "xx", 5), (None, texts[1], "xx", 5), (0, texts[0], "xx", 5)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def brute_sets(text, size):
    words = (text or "").translate(str.maketrans("".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))))
    words = [w for w in __import__("re").split("[\\x20\\x09-\\x0D]+", words) if w]
    if not words:
        return set()
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))}


def test_language_by_held_out_accuracy(spark):
    table = queries.op1_language_id(spark, DATA)
    truth = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    rows = table.join(truth, "doc_id").filter("held_out and lang is not null").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.9 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark, docs):
    model = langid.fit(docs, F.lit(True))
    found = {(r["doc_id"], r["lang_pred"], r["lang_rejected"]) for r in langid.predict(docs, model).collect()}
    assert {(12, "und", True), (13, "und", True), (14, "und", True)} <= found
    assert langid.keep_known(docs, model).columns == ["doc_id", "text", "lang"]
    empty = langid.fit(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(docs, empty).collect()} == {"und"}


def test_decontamination(spark):
    rng = random.Random(4)
    item = text_of(rng, 20)
    rows = [(1, "lead " + item.replace(" ", "\n ") + " tail"), (2, text_of(rng, 50)), (3, None), (4, ""),
            (5, ("filler words " * 50_000) + item + (" more" * 1000)), (None, item), (1, "lead " + item + " tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "short"), (None, text_of(rng, 9))],
                                  "item_id long, text string")
    found = decontaminate.passages(docs, bench).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"], r["edits"]) for r in found) == [
        (0, 7, 0), (1, 7, 0), (1, 7, 0), (5, 7, 0)]
    far = next(r for r in found if r["doc_id"] == 5)
    assert rows[4][1][far["start"]:far["end"]] == item
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == {2, 3, 4, None}
    assert decontaminate.passages(docs.limit(0), bench).count() == decontaminate.passages(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("block", [12, 64, 1 << 20])
def test_token_files_are_counted_across_blocks(spark, tmp_path, docs, block):
    code = tokens.encoder(VOCAB, queries.word_pattern())
    path = str(tmp_path / "flat")
    tokens.write_tokens(docs, path, VOCAB, queries.word_pattern())
    flat = [np.frombuffer(p.read_bytes(), "<u2") for p in Path(path).rglob("part-*")]
    want = []
    for ids in flat:
        at, last = np.flatnonzero(ids == tokens.END), -1
        for k, a in enumerate(at):
            want.append((k, last + 1, a - last - 1, ids[last + 1:a][:5].tolist()))
            last = a
    got = tokens.scan_tokens(spark, path, head=5, block_bytes=block).collect()
    assert sorted((r["ordinal"], r["start"], r["n_tokens"], r["head"]) for r in got) == sorted(want)
    counted = tokens.count_tokens(docs, VOCAB, queries.word_pattern()).collect()
    want = [(r["doc_id"], len(code.encode_ordinary(r["text"] or ""))) for r in docs.collect()]
    assert Counter((r["doc_id"], r["n_tokens"]) for r in counted) == Counter(want)


def test_token_files_without_a_last_separator(spark, tmp_path):
    np.array([5, 9, 5, 5, 9, 9, 7], "<u4").tofile(tmp_path / "a.bin")
    (tmp_path / "b.bin").write_bytes(b"")
    got = tokens.scan_tokens(spark, str(tmp_path), end=9, width=4, block_bytes=8).collect()
    assert sorted((r["ordinal"], r["start"], r["n_tokens"]) for r in got) == [(0, 0, 1), (1, 2, 2), (2, 5, 0), (3, 6, 1)]
    assert tokens.count_tokens(spark.createDataFrame([], "doc_id long, text string"), VOCAB,
                               queries.word_pattern()).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    rows += [(i, [1.0] * 8) for i in range(400, 460)]  # ties
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (None, [1.0] * 8),
             (504, []), (505, [9.0]), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    whole = {i: np.pad(np.floor(256 * np.array(v)), (0, 8 - len(v))) for i, v in rows
             if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, query_bytes=64 * 5).collect()
    want = []
    for q in (i for i in whole if i % 50 == 0):
        best = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(df.filter("vec_id in (1, 2)"), F.lit(True)).count() == 2


def test_language_model(spark, docs):
    learns = F.col("doc_id") != 4
    rows = lm.score_documents(docs, learns, VOCAB, queries.word_pattern(), steps=5).collect()
    source = docs.collect()
    count = Counter(w for r in source if r["doc_id"] is not None and r["doc_id"] != 4
                    for w in [*(r["text"] or "").lower().split(), ""])
    n, v = sum(count.values()), len(count)
    want = []
    for r in source:
        t = [*(r["text"] or "").lower().split(), ""]
        want.append((r["doc_id"], len(t), sum(count[w] > 0 for w in t), n,
                     round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 6)))
    got = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows]
    assert Counter(got) == Counter(want)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)
    assert lm.score_documents(docs.limit(0), learns, VOCAB, queries.word_pattern()).count() == 0


def test_language_model_learns_what_helps_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")

    def held_out(steps):
        scored = lm.score_documents(docs, queries.learns(7), VOCAB, queries.word_pattern(), steps=steps)
        return scored.filter(queries.held_out(7)).agg(F.sum("score")).first()[0]

    assert held_out(1500) > 0.8 * held_out(1)


def test_language_model_beats_its_base_on_held_out_texts(spark):
    scored = queries.op5_lm_scores(spark, "/root/testdata/sf0.01").filter("held_out")
    own, base = scored.agg(F.sum("score"), F.sum("base_score")).first()
    assert own > base


def test_mixing_meets_targets_and_equals_plain_descent(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (4, None, 1), (5, 1, 1), (None, 1, 0), (99, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    rates = mixing.mix(docs, mixing.domains_of(labels), {"high": 0.5, "low": 0.2, "toxic": 0.3}).collect()
    assert len(rates) == len({r["doc_id"] for r in docs.collect()})
    t = np.array([r["tokens"] for r in rates])
    p = np.array([[r["p_high"], r["p_low"], r["p_toxic"]] for r in rates])
    assert np.allclose(p.sum(1), 1) and all(r["rate"] >= 0 for r in rates)
    target = np.array([0.5, 0.2, 0.3]) * t.sum()
    a = t[:, None] * p
    g = p.T @ a / np.outer(target, target)
    step, r, last, m = 1 / max(g.sum(1)), np.ones(len(t)), np.ones(len(t)), 1.0
    for _ in range(80):
        nxt = (1 + (1 + 4 * m * m) ** 0.5) / 2
        y = r + (m - 1) / nxt * (r - last)
        m = nxt
        if np.abs(a.T @ r / target - 1).max() <= 1e-3:
            break
        r, last = np.maximum(0, y - step * (p @ ((a.T @ y / target - 1) / target))), r
    assert np.allclose([x["rate"] for x in rates], r, atol=1e-6)
    assert mixing.mix(docs.limit(0), mixing.domains_of(labels), queries.TARGETS).count() == 0
    assert {x["rate"] for x in mixing.mix(docs.filter("text is null"), mixing.domains_of(labels), queries.TARGETS).collect()} == {1.0}


def test_url_rules_and_odd_pages(spark):
    pages = spark.createDataFrame(
        [(1, "http://A.Example.NET/en/5?x=1"), (2, "https://x.net"), (3, "https://b.example.com/de/1#t"), (4, None),
         (5, "no scheme"), (6, "http://c.org/fr/2"), (7, "http://bad.org/en/3"), (7, "http://bad.org/en/3"),
         (8, "http://notexample.net/en/1"), (None, "http://d.org?x=/fr/")], "page_id long, url string")
    labels = spark.createDataFrame([(3, 0, None), (3, 1, 0), (2, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in
           urls.judge(pages, labels, queries.RULES).collect()]
    assert len(got) == 10
    assert {g[:4] for g in got} == {
        (1, "a.example.net", "/en/5", "example.net/en/"), (2, "x.net", "", None), (3, "b.example.com", "/de/1", "example.com/de/"),
        (4, "", "", None), (5, "", "", None), (6, "c.org", "/fr/2", "org/fr/"), (7, "bad.org", "/en/3", None),
        (8, "notexample.net", "/en/1", "net/"), (None, "d.org", "", None)}
    assert {g[4] for g in got if g[3] == "net/"} == {"block"} and {g[4] for g in got} <= {"allow", "block"}
    assert urls.judge(pages.limit(0), labels, queries.RULES).count() == 0
    assert urls.judge(pages, labels.limit(0), queries.RULES).count() == 10


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(30)] + [(rng.randrange(40, 90), rng.randrange(40, 90)) for _ in range(30)]
    df = spark.createDataFrame(edges + [(200, 200)], "a long, b long")
    want = brute_components({n for e in edges if e[0] != e[1] for n in e}, edges)
    assert {r["node"]: r["component"] for r in components.components(df).collect()} == want
    assert components.components(df.limit(0)).count() == 0


def test_similar_documents_equal_brute_force(spark, docs):
    rng = random.Random(8)
    base = text_of(rng, 120).split()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for i in range(40):
        changed = list(base)
        for _ in range(rng.randrange(0, 5)):
            changed[rng.randrange(len(changed))] = "new" + str(rng.randrange(1000))
        rows.append((100 + i, " ".join(changed)))
    passage = text_of(rng, 30)
    rows += [(200 + i, passage + " " + text_of(rng, 60)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {i: brute_sets(t, 4) for i, t in rows if i is not None}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
              and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = brute_components(sets, linked)
    found, _ = jaccard.similar_documents(df)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()}
    assert got.pop(None) == (len(brute_sets(dict((i, t) for i, t in rows)[None], 4)), None)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    assert jaccard.similar_documents(df.limit(0))[0].count() == 0


def test_chat_of_odd_rows(spark):
    turns = spark.createDataFrame(
        [(1, 1, "assistant", "yes<|im_end|>"), (1, 0, "user", None), (2, 0, None, "é\n"), (None, 0, "assistant", ""),
         (3, None, "assistant", "ab"), (3, 1, "assistant", "cd"), (3, 1, "assistant", "cd")],
        "conv_id long, turn long, role string, text string")
    vocabulary = f"{queries.TOKENIZERS}/byte_bpe_50k.json"
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(turns, vocabulary)).collect()}
    digest = lambda s: sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == digest("user\n\nassistant\nyes<|im_end|>\n")
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (13, digest("yes<|im_end|>"))
    assert got[3]["loss_sha256"] == digest("abcdcd") and got[3]["n_turns"] == 3
    assert got[None]["loss_chars"] == 0 and got[2]["n_turns"] == 1
    assert chat.digests(chat.format_chats(turns.limit(0), vocabulary)).count() == 0


def test_line_dedup_keeps_one_line_per_component(spark):
    rng = random.Random(9)
    common = text_of(rng, 25)
    near = common.replace(common.split()[12], "other", 1)
    own = [text_of(rng, 20) for _ in range(6)]
    rows = [(1, f"{own[0]}\n\n{common}\n{own[1]}"), (2, f"{near}\n{own[2]}"), (3, f"  {common} \n{common}\n{own[3]}"),
            (4, None), (5, ""), (6, f"{own[4]}\n{own[4]}"), (None, common)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_gone", F.lit("x"))
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_gone"]) for r in lines.dedup_lines(df).collect()}
    assert got == {1: (rows[0][1], 3, 0), 2: (own[2], 2, 1), 3: (own[3], 3, 2), 4: (None, 0, 0), 5: ("", 0, 0),
                   6: (own[4], 2, 1), None: (common, 1, 0)}
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_minima_are_those_of_rotated_orders(spark):
    rng = random.Random(3)
    sets = [[rng.randrange(-2 ** 63, 2 ** 63) for _ in range(n)] for n in (1, 2, 5, 40, 300)] + [[7, 7, -(2 ** 63)]]
    df = spark.createDataFrame(list(enumerate(sets)), "i int, s array<long>")
    for row in lines.with_rings(df.withColumn("whole", F.col("s")), 20).select(
            F.col("whole").alias("s"), lines.minima(20).alias("m")).collect():
        marks = [-(1 << 63) + i * ((1 << 64) // 20) for i in range(20)]
        assert row["m"] == [min(row["s"], key=lambda x: (x - m) % (1 << 64)) for m in marks]


def test_similar_lines_are_found(spark):
    rng = random.Random(4)
    rows = []
    for pair in range(400):  # pairs of lines of 6 to 60 words that differ in some
        words = [f"w{rng.randrange(100000)}" for _ in range(rng.randrange(6, 60))]
        other = [f"x{rng.randrange(100000)}" if rng.random() < 0.06 else w for w in words]
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(r[0]) for r in df.orderBy("doc_id").select(lines.shingles(F.col("text"))).collect()]
    near = {i + 1 for i in range(0, 800, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}
    gone = {r["doc_id"] for r in lines.dedup_lines(df).filter("n_gone > 0").collect()}
    assert len(near) > 100 and gone <= near and len(gone) >= 0.97 * len(near)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    connection = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = queries.queries()[name](spark, DATA)
    want = connection.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    plain = lambda pdf: sorted(map(str, pdf[columns].astype(object).where(pdf[columns].notna(), None)
                                   .itertuples(index=False, name=None)))
    assert plain(df.toPandas()) == plain(want.df())


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    done = corpus_pipeline.run(spark, DATA)
    assert done.columns == [*docs.columns, "rate", "copies"]
    rows = done.collect()
    assert 0 < len(rows) <= docs.count() and len({r["doc_id"] for r in rows}) == len(rows)
    bench = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert not any(b in r["text"] for r in rows for b in bench)
    seen = Counter(x.strip() for r in rows for x in r["text"].split("\n") if x.strip())
    assert max(seen.values()) == 1
    sets = {r["doc_id"]: brute_sets(r["text"], 5) for r in rows}
    names = sorted(sets)
    assert not [(a, b) for i, a in enumerate(names) for b in names[i + 1:] if sets[a] and sets[b]
                and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert not corpus_pipeline.run(spark, DATA).limit(0).collect()
