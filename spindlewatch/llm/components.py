"""Connected components and linking by shared keys, in DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from spindlewatch.session import stage


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); a component is its smallest node.

    Union-find by alternating stars: every node is hung below the smallest node it can see, first
    through its larger neighbours, then through its smaller ones, until no edge changes. Minima
    are aggregated before the shuffle and joined back, so a node of any degree can be split.
    """
    now = stage(edges.filter(F.col("a") != F.col("b"))
                .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                "edges")
    before = None
    while (state := _state(now)) != before:
        before = state
        if not state[0]:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.filter(F.col("b") > F.col("a")).join(low, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.filter(F.col("m") < F.col("a")).select("a", F.col("m").alias("b")))
                 .filter(F.col("a") != F.col("b")).distinct())
        large = stage(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").filter(F.col("b") != F.col("m"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).distinct())
        now = stage(small, "small-star")
    return (now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
            .union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))


def _enough(pairs: DataFrame, needed: DataFrame | None) -> DataFrame:
    """Pairs (a, b, shared) that share the smaller `least` of their two nodes."""
    if needed is None:
        return pairs
    return (pairs.join(needed.select(F.col("node").alias("a"), F.col("least").alias("la")), "a")
            .join(needed.select(F.col("node").alias("b"), F.col("least").alias("lb")), "b")
            .filter(F.col("shared") >= F.least("la", "lb")))


ROUNDS = 6  # at most; single tries end once fewer than one in LEAST_YIELD makes a link
LEAST_YIELD = 16
SMALL = 16  # nodes of a key whose pairs may be rows
BLOCK_NODES = 64
BLOCK_ITEMS = 1 << 14  # entries of signatures a block may hold


def size_band(n: Column, share: float) -> Column:
    """A number for the size of a set: if one of two sizes is at least `share` of the other, they differ by one at most."""
    # A little wider than the share, for rounding.
    return F.floor(F.log(n) / max(-1.001 * math.log(share), 1e-6)).cast("long") if share > 0 else F.lit(0).cast("long")


def _narrow(held: DataFrame) -> DataFrame:
    """(key, node, late, head), staged: keys by band, so that nodes meet only where bands differ by one at most.

    Each node is under its own band and, `late`, under the next: nodes that are both late meet elsewhere, too.
    """
    late = F.explode(F.array(F.lit(False), F.lit(True))).alias("late")
    placed = held.select("key", "node", "band", late).select(
        F.xxhash64("key", F.col("band") + F.col("late").cast("long")).alias("key"), "node", "late")
    heads = (placed.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last"), F.min("late").alias("late"))
             .filter("head < last and not late").select("key", "head"))
    return stage(placed.join(heads, "key"), "narrow-keys")


def link(postings: DataFrame, signatures: Callable[[DataFrame], DataFrame], agree: Callable[[Column, Column], Column],
         verify: Callable[[DataFrame], DataFrame] | None = None, needed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Components of the nodes whose pairs share a key, agree by signature, and pass `verify`.

    postings    (key, node, band); rows may repeat. Read twice: it should be cheap, as a staged table is. Nodes
                of a key are compared only where their `size_band`s differ by one at most
    signatures  takes a table of nodes and returns (node, sig) for these; sig is a struct with an array `items`
    agree       condition on two signatures that every linked pair which shares a key should meet
    verify      takes distinct pairs (a, b), a < b, and returns those that are linked; without it, those that
                agree are
    needed      (node, least): a node's first try asks for the smaller `least` of the two in shared keys
    Returns (node, component) of linked nodes and verified links (a, b) that span the components; not all
    links, as connected pairs are not tried.

    Pairs within a key are never all made. First every node is tried against one other: of the
    smallest nodes of its keys, the one that it shares most keys with. Then, in rounds, one node of each
    component in a key is tried against two of that key's other components: a row for each key and
    component at most, of ids alone, so that groups grow together without pairs among their nodes; signatures
    are joined to distinct pairs. What the rounds leave apart is compared in full: nodes outside a key's
    largest component with the nodes of the key in other components. These meet in blocks of bounded size, by
    signature, and a row is made only for a pair that agrees. With `needed`, keys of few nodes give their
    pairs without signatures, to be counted. How many rounds there are changes the work, not
    what is found.
    """
    shared = stage(postings.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last"))
                   .filter("head < last").select("key"), "heads")
    held = _narrow(stage(may_hold(postings, "key", shared).distinct().join(shared, "key"), "shared-keys"))
    best = (held.filter("node != head").groupBy("node", "head").agg(F.count(F.lit(1)).alias("n"))
            .groupBy(F.col("node").alias("b")).agg(F.max_by("head", "n").alias("a"), F.max("n").alias("shared")))
    tried = stage(_enough(best, needed).select("a", "b"), "tried")
    signed = None
    if verify is None:
        signed = stage(signatures(held.select("node").distinct()), "signatures")
    links = stage((verify(tried) if verify else _passing(tried, signed, agree)).select("a", "b"), "links")
    mixed = _mixed(held.drop("head"), stage(components(links), "components"))
    if mixed.isEmpty():
        return components(links), links
    if verify:
        signed = stage(signatures(mixed.select("node").distinct()), "signatures")
    for turn in range(ROUNDS):
        pairs = stage(_single_tries(mixed, turn).join(tried, ["a", "b"], "left_anti"), "round-tried")
        if pairs.isEmpty():
            break
        agreed = stage(_passing(pairs, signed, agree), "round-agreed")
        new = stage(verify(agreed).select("a", "b"), "round-links") if verify else agreed
        tried, links = tried.union(pairs), links.union(new)
        mixed = _mixed(mixed.select("key", "node", "late"), stage(components(links), "components"))
        if new.count() * LEAST_YIELD <= pairs.count():
            break
    left = _agreeing(mixed, signed, agree) if needed is None else _counted(mixed, signed, agree, needed)
    fresh = stage(left.join(tried, ["a", "b"], "left_anti"), "fresh")
    links = links.union(stage(verify(fresh).select("a", "b"), "more-links") if verify else fresh)
    return components(links), links


def _mixed(held: DataFrame, found: DataFrame) -> DataFrame:
    """(key, node, late, component, major), staged: keys in several components; major tells their largest."""
    placed = stage(held.join(found, "node", "left").select("key", "node", "late", F.coalesce("component", "node").alias("component")),
                   "placed")
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    most = (sizes.groupBy("key").agg(F.max_by("component", "n").alias("most"), F.count(F.lit(1)).alias("parts"))
            .filter("parts > 1").select("key", "most"))
    return stage(placed.join(most, "key").select("key", "node", "late", "component", (F.col("component") == F.col("most")).alias("major")),
                 "mixed-keys")


def _passing(pairs: DataFrame, signed: DataFrame, agree: Callable) -> DataFrame:
    """The pairs (a, b) that agree by signature."""
    both = (pairs.join(signed.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
            .join(signed.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b"))
    return both.filter(agree(F.col("sa"), F.col("sb"))).select("a", "b")


def _single_tries(mixed: DataFrame, turn: int) -> DataFrame:
    """Distinct pairs (a, b): of each key and component one node, drawn anew each turn, with those drawn
    for the key's largest component and for another one."""
    drawn = mixed.groupBy("key", "component", "major").agg(F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("node"))
    one = F.struct("node", "component")
    targets = drawn.groupBy("key").agg(
        F.max_by(one, "major").alias("first"),
        F.min_by(one, F.xxhash64("component", F.lit(turn))).alias("second"))
    met = (drawn.join(targets, "key").select("node", "component", F.explode(F.array("first", "second")).alias("other"))
           .filter(F.col("component") != F.col("other.component")))
    return met.select(F.least("node", "other.node").alias("a"), F.greatest("node", "other.node").alias("b")).distinct()


def _agreeing(mixed: DataFrame, signed: DataFrame, agree: Callable) -> DataFrame:
    """Distinct pairs (a, b) of nodes of different components that share a key and agree.

    A key's nodes are dealt by hash into blocks, those of its largest component apart from the others.
    A block of the others meets every block of the key, itself included.
    """
    full = mixed.join(signed, "node")
    parts = full.groupBy("key", "major").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum(F.size("sig.items")) / BLOCK_ITEMS)).alias("parts"))
    blocks = stage(full.join(parts, ["key", "major"])
                   .groupBy("key", "major", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"))
                   .agg(F.collect_list(F.struct("node", "component", "late", "sig")).alias("nodes")), "blocks")
    left = blocks.filter("not major").select("key", F.col("part").alias("at"), F.col("nodes").alias("left"))

    met = left.join(blocks.select("key", "major", "nodes"), "key")
    return _pairs_between(met, F.col("major"), lambda x, y: agree(x["sig"], y["sig"])).distinct()


def _pairs_between(met: DataFrame, major: Column, also: Callable[[Column, Column], Column]) -> DataFrame:
    """(a, b) of the nodes in `left` with those in `nodes`, of different components and not both late."""
    def pairs(x: Column) -> Column:
        # Where two nodes meet twice, the pair is taken once.
        other = F.filter("nodes", lambda y: (x["component"] != y["component"]) & (major | (x["node"] < y["node"]))
                         & ~(x["late"] & y["late"]) & also(x, y))
        return F.transform(other, lambda y: F.struct(F.least(x["node"], y["node"]).alias("a"),
                                                     F.greatest(x["node"], y["node"]).alias("b")))

    return met.select(F.explode(F.flatten(F.transform("left", pairs))).alias("pair")).select("pair.*")


def _counted(mixed: DataFrame, signed: DataFrame, agree: Callable, needed: DataFrame) -> DataFrame:
    """As `_agreeing`, but pairs of keys with few nodes are made of ids alone, and their shared keys counted.

    A pair may share keys of many nodes, too: as many as either node has count for it.
    """
    sizes = stage(mixed.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key-sizes")
    large = mixed.join(sizes.filter(F.col("n") > SMALL).select("key"), "key")
    few = (mixed.join(sizes.filter(F.col("n") <= SMALL).select("key"), "key")
           .groupBy("key").agg(F.collect_list(F.struct("node", "component", "late")).alias("nodes")))
    counts = (_pairs_between(few.withColumn("left", F.col("nodes")), F.lit(False), lambda x, y: F.lit(True))
              .groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    more = stage(large.groupBy("node").agg(F.count(F.lit(1)).alias("m")), "large-keys")
    for one in ("a", "b"):
        counts = counts.join(more.select(F.col("node").alias(one), F.col("m").alias(f"m{one}")), one, "left")
    shared = counts.select("a", "b", (F.col("n") + F.least(F.coalesce("ma", F.lit(0)), F.coalesce("mb", F.lit(0)))).alias("shared"))
    return _enough(shared, needed).select("a", "b").union(_agreeing(large, signed, agree)).distinct()


FILTER_WORDS = 1 << 17


def may_hold(df: DataFrame, column: str, keys: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """Rows of `df` whose `column` may be among the one column of `keys`: none of those is lost.

    A bit table of fixed size, `words` rows of 64 bits, is broadcast and drops most other rows
    before they are shuffled. With more keys than bits it only drops less. Follow it by an inner
    join: the optimizer moves a semi join ahead of the filter, which then saves no shuffle.
    """
    def place(c):
        mixed = F.xxhash64(c)
        return F.pmod(F.shiftright(mixed, 6), F.lit(words)).cast("int"), F.pmod(mixed, F.lit(64)).cast("int")

    word, bit = place(F.col(keys.columns[0]))
    table = stage(keys.groupBy(word.alias("_word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits")), "bits")
    word, bit = place(F.col(column))
    return (df.withColumn("_word", word).join(F.broadcast(table), "_word")
            .filter(F.getbit("_bits", bit) == 1).select(*df.columns))
