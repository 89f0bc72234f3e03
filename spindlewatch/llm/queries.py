"""The text operators as named queries over the given tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from spindlewatch.llm import (
    chat, decontaminate, jaccard, langid, lexical, lines, lm, mixing, periodic, tokens, topk, toxicity, urls,
)
from spindlewatch.llm.common import SPLIT, bucket_of, table

# Folder of the public vocabulary files, and the word pattern their byte-pair encoders use.
TOKENIZERS = "/opt/tokenizers"
TARGETS = {"high": 0.8, "low": 0.15, "toxic": 0.05}
# The rules that the query applies.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def word_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def held_out(parts: int):
    return F.coalesce(bucket_of(F.col("doc_id"), parts) == 2, F.lit(False))


def learns(parts: int):
    return bucket_of(F.col("doc_id"), parts) != 2


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.fit(docs, learns(4))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(4).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
                        F.col("lang_rejected").alias("rejected"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(table(spark, folder, "documents"), f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken",
                               word_pattern())


def op4_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = lm.score_documents(docs, learns(7), f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken", word_pattern())
    return scored.withColumn("held_out", held_out(7))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), mixing.domains_of(table(spark, folder, "labels")), TARGETS)


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    judged = urls.judge(table(spark, folder, "pages"), table(spark, folder, "labels"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, folder, "documents"), count_links=True)[0]


def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    says = "<|im_end|><|im_start|>assistant ok"
    more = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user")
                                 .otherwise("assistant"), F.lit(says))
    return chat.digests(chat.format_chats(turns.union(more), f"{TOKENIZERS}/byte_bpe_50k.json"))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = lines.dedup_lines(table(spark, folder, "documents"))
    return done.select("doc_id", "n_lines", "n_gone", "text")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the texts, chosen by id, the words from one on become periodic."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words):
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(words[a + (i - a) % p])), " ")

    words = F.filter(F.split("text", SPLIT), lambda w: w != "")
    changed = lines.once(words, lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(F.lit("")))
    return docs.select("doc_id", F.when(h % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = periodic.find_runs(with_planted_periods(docs))
    # Exact ratios of long values; the first of the largest stays, and runs are in order.
    best = F.expr("""aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>),
        (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))""")
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    whole = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(whole.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"), bucket_of(F.col("doc_id"), 5) != 0)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(bucket_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
                         F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [op1_language_id, op2_decontamination, op3_token_counts, op4_top_k, op5_lm_scores, op6_mixing,
            op7_url_filter, op8_jaccard_join, op9_chat_format, op10_line_dedup, op11_periodic_runs, op12_toxicity,
            op13_lexical_search, pipeline]
    return {f.__name__: f for f in made}


TOP_K_SQL = """
WITH v AS (
    SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    GROUP BY vec_id),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5
"""

CHAT_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       CAST(sum(24 + length(replace(regexp_replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '<(\\*)n', '<\\\1n', 'g'), chr(10), '<n'))
           + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

URL_SQL = r"""
WITH parts AS (
    SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
known AS (
    SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN coalesce(quality, toxic) IS NOT NULL THEN 0 END) AS bad
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
hosts AS (
    SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad,
           array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix
    FROM (SELECT host, try_cast(nullif(regexp_extract(path, '(\d{1,18})[^/\d]*/?$', 1), '') AS BIGINT) AS doc_id FROM parts)
    LEFT JOIN known USING (doc_id) GROUP BY host),
overall AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0.0) AS m FROM hosts),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(m) AS m FROM hosts, overall GROUP BY suffix),
sw AS (SELECT CASE WHEN coalesce(sum(m * (1 - m) * (n - 1)), 0) = 0 THEN 1.0 ELSE 1 / least(0.99, greatest(1e-4,
        (sum(n * pow(bad / n - m, 2)) - sum(m * (1 - m))) / sum(m * (1 - m) * (n - 1)))) - 1 END AS w FROM s WHERE n > 0),
sm AS (SELECT suffix, (bad + w * m) / (n + w) AS m FROM s, sw),
d AS (SELECT domain, sum(n) AS n, sum(bad) AS bad, any_value(m) AS m FROM hosts JOIN sm USING (suffix) GROUP BY domain),
dw AS (SELECT CASE WHEN coalesce(sum(m * (1 - m) * (n - 1)), 0) = 0 THEN 1.0 ELSE 1 / least(0.99, greatest(1e-4,
        (sum(n * pow(bad / n - m, 2)) - sum(m * (1 - m))) / sum(m * (1 - m) * (n - 1)))) - 1 END AS w FROM d WHERE n > 0),
dm AS (SELECT domain, (bad + w * m) / (n + w) AS m FROM d, dw),
h AS (SELECT host, n, bad, m FROM hosts JOIN dm USING (domain)),
hw AS (SELECT CASE WHEN coalesce(sum(m * (1 - m) * (n - 1)), 0) = 0 THEN 1.0 ELSE 1 / least(0.99, greatest(1e-4,
        (sum(n * pow(bad / n - m, 2)) - sum(m * (1 - m))) / sum(m * (1 - m) * (n - 1)))) - 1 END AS w FROM h WHERE n > 0),
scores AS (SELECT host, (bad + w * m) / (n + w) AS mean, n + w AS size FROM h, hw),
ruled AS (
    SELECT p.*, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts p)
SELECT page_id, host, path, rule, CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block'
       WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block'
       ELSE CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (size + 1)) > 0.3 THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled LEFT JOIN scores USING (host)
"""


LEXICAL_SQL = r"""
WITH found AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents WHERE text IS NOT NULL),
docs AS (SELECT r, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM found WHERE len(terms) > 0),
whole AS (SELECT count(*) AS held, CAST(sum(n) AS BIGINT) AS total FROM docs),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
items AS (SELECT item_id, min(coalesce(text, '')) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id),
asked AS (
    SELECT item_id, term, count(*) AS repeats
    FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items)
    GROUP BY item_id, term),
weighed AS (
    SELECT item_id, term, repeats * CAST(floor(1000 * ln((2 * held + 2) / (2 * df + 1))) AS BIGINT) AS w
    FROM asked JOIN df USING (term), whole),
scored AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * held) // total)))) AS BIGINT) AS score
    FROM weighed JOIN tf USING (term) JOIN docs USING (r), whole
    WHERE doc_id IS NOT NULL GROUP BY item_id, r, doc_id),
ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
           doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_top_k": TOP_K_SQL, "op7_url_filter": URL_SQL, "op9_chat_format": CHAT_SQL,
            "op13_lexical_search": LEXICAL_SQL}
