"""Mixing weights: document rates whose expected domain tokens meet targets. DataFrame only.

A multinomial word classifier is counted from a labelled table and gives every document posterior
probabilities over domains: soft membership. Rates r >= 0, starting at 1, then minimise

    sum over domains k of ((sum over d of r_d * tokens_d * p_dk) / T_k - 1)^2

by projected gradient descent with momentum, T_k being the target tokens of domain k. Documents
are weighted by their tokens, so that long ones do not take all of the change. An iteration needs
one number per domain from all documents; the numbers of past iterations are folded into the
next rates where the documents are, and nothing per document goes anywhere.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, functions as F

from spindlewatch.llm.common import SPLIT, lower_ascii, without
from spindlewatch.llm.components import may_hold
from spindlewatch.session import stage

BUCKETS = 1 << 14
RESTAGE = 5


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], doc_id: str = "doc_id",
               text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, tokens, p): words per document and the posteriors in the order of `domains`.

    labelled   (doc_id, domain): a document may have several domains, and then counts for each;
               null ids and domains that are not listed are ignored
    A document's log likelihood is divided by the square root of its length, as its words do not
    vary independently. Documents without a word get the domains' shares among the labelled.
    Rows that share an id are one document; a null id is an id of its own.
    """
    def words(source: DataFrame, *more: str) -> DataFrame:
        exploded = source.select("d", *more, F.explode(F.split(lower_ascii(F.col("t")), SPLIT)).alias("w"))
        return exploded.filter("w != ''").select(
            "d", *more, F.pmod(F.hash("w"), F.lit(buckets)).alias("bucket"))

    texts = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    known = (labelled.select(F.col(labelled.columns[0]).alias("d"), F.col(labelled.columns[1]).alias("domain"))
             .filter(F.col("d").isNotNull() & F.col("domain").isin(domains)).distinct())
    # Labels meet texts before these become words: a row per text is shuffled, not one per word, and
    # few texts without a label. Labels grow with the input, so they are never broadcast.
    matched = may_hold(texts, "d", known.select("d")).join(known.hint("merge"), "d")
    per_bucket = words(matched, "domain").groupBy("bucket").agg(
        *[F.count(F.when(F.col("domain") == k, 1)).alias(f"n{i}") for i, k in enumerate(domains)])
    per_bucket = stage(per_bucket, "bucket-counts")  # at most `buckets` rows
    every = range(len(domains))
    shares = known.join(docs.select(F.col(doc_id).alias("d")).distinct(), "d").agg(
        *[F.count(F.when(F.col("domain") == k, 1)).alias(f"n{i}") for i, k in enumerate(domains)]).first()
    totals = per_bucket.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in every]).first()
    # Log likelihood of a bucket relative to one that was never seen, so that rows may be missing.
    model = per_bucket.select("bucket", *[F.log(F.col(f"n{i}") + F.lit(1.0)).alias(f"l{i}") for i in every])
    unseen = [-log(totals[f"n{i}"] + buckets) for i in every]
    prior = [log((shares[f"n{i}"] + 1) / (sum(shares) + len(domains))) for i in every]
    # Bounded by `buckets` rows of a few numbers.
    scored = (words(texts).join(F.broadcast(model), "bucket", "left").groupBy("d")
              .agg(F.count(F.lit(1)).alias("tokens"),
                   *[F.coalesce(F.sum(f"l{i}"), F.lit(0.0)).alias(f"l{i}") for i in every]))
    bare = docs.select(F.col(doc_id).alias("d"), F.lit(0).cast("long").alias("tokens"),
                       *[F.lit(0.0).alias(f"l{i}") for i in every])
    scored = scored.union(bare).groupBy("d").agg(
        F.max("tokens").alias("tokens"), *[F.max(f"l{i}").alias(f"l{i}") for i in every])
    length = F.sqrt(F.greatest(F.col("tokens"), F.lit(1)).cast("double"))
    z = [(F.col(f"l{i}") + F.col("tokens") * unseen[i]) / length + prior[i] for i in every]
    most = F.greatest(*z) if len(z) > 1 else z[0]
    odds = scored.select("d", "tokens", *[F.exp(x - most).alias(f"e{i}") for i, x in enumerate(z)])
    total = sum((F.col(f"e{i}") for i in every), F.lit(0.0))
    return odds.select(F.col("d").alias(doc_id), "tokens",
                       F.array(*[F.col(f"e{i}") / total for i in every]).alias("p"))


def fit_rates(members: DataFrame, weights: list[float], rounds: int = 80,
              tolerance: float = 1e-3) -> DataFrame:
    """`members` (.., tokens, p) with `rate` >= 0.

    weights    target share of tokens for each domain, any positive scale
    tolerance  largest relative miss of a domain's tokens at which the descent stops early
    The total of expected tokens stays the corpus's own. With no token at all every rate is 1.
    """
    every = range(len(weights))
    share = [w / sum(weights) for w in weights]
    token = F.col("tokens").cast("double")
    p = [F.col("p")[i] for i in every]
    sums = members.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), *[
        F.coalesce(F.sum(token * p[i] * p[j]), F.lit(0.0)).alias(f"g{i}_{j}")
        for i in every for j in every]).first()
    if not sums["t"]:
        return members.withColumn("rate", F.lit(1.0))
    target = [s * sums["t"] for s in share]
    # Steepest curvature: the largest row sum of a nonnegative matrix bounds its eigenvalues.
    steep = max(sum(sums[f"g{i}_{j}"] / (target[i] * target[j]) for j in every) for i in every)
    now = members.withColumn("rate", F.lit(1.0)).withColumn("last", F.lit(1.0))
    kept = members.columns
    momentum = 1.0
    for turn in range(rounds):
        following = (1 + (1 + 4 * momentum ** 2) ** 0.5) / 2
        push = (momentum - 1) / following
        momentum = following
        ahead = now.withColumn("ahead", F.col("rate") + push * (F.col("rate") - F.col("last")))
        got = ahead.agg(*[F.sum(token * p[k] * F.col("ahead")).alias(f"a{k}") for k in every],
                        *[F.sum(token * p[k] * F.col("rate")).alias(f"s{k}") for k in every]).first()
        if max(abs(got[f"s{k}"] / target[k] - 1) for k in every) <= tolerance:
            break
        pull = [(got[f"a{k}"] / target[k] - 1) / target[k] / steep for k in every]
        moved = F.col("ahead") - sum((p[k] * F.lit(pull[k]) for k in every), F.lit(0.0))
        now = ahead.select(*kept, F.greatest(F.lit(0.0), moved).alias("new"), F.col("rate").alias("last")) \
            .withColumnRenamed("new", "rate").select(*kept, "rate", "last")
        if turn % RESTAGE == RESTAGE - 1:
            now = stage(now, "rates")  # the expression does not grow with the rounds
    return now.select(*kept, "rate")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], doc_id: str = "doc_id",
        text: str = "text", **options) -> DataFrame:
    """(doc_id, tokens, p_<domain>.., rate): one row per document id.

    targets   domain -> share of tokens wanted; shares must be positive
    Null and empty texts have no token and take the rate that their prior membership gives.
    """
    domains = list(targets)
    members = stage(posteriors(docs, labelled, domains, doc_id, text), "memberships")
    rates = fit_rates(members, [targets[k] for k in domains], **options)
    return rates.select(doc_id, "tokens", *[F.col("p")[i].alias(f"p_{k}") for i, k in enumerate(domains)], "rate")


def apply_rates(docs: DataFrame, rates: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """`docs` with `rate`, and `copies`: how often an epoch takes the document.

    copies is the rate rounded up or down by a draw from the id's hash, so that its expectation is
    the rate. Columns of those names are replaced.
    """
    held = without(docs, ["rate", "copies"])
    named = rates.select(F.col(doc_id).alias("rated"), "rate")
    draw = F.pmod(F.xxhash64(F.col(doc_id), F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (held.join(named, F.col(doc_id).eqNullSafe(F.col("rated"))).drop("rated")
            .withColumn("copies", (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0))
                        .cast("long")))


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from (doc_id, quality, toxic): toxic, else high or low by quality."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high")
                         .when(F.col("quality") == 0, "low").alias("domain")).filter("domain is not null")
