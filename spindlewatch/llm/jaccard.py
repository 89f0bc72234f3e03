"""Similarity join of documents on word n-grams, with adaptive multi-match prefixes.

A document is the set of its distinct word n-grams, as 64-bit hashes. In a fixed order of all
n-grams, two sets with Jaccard similarity t or more share at least m of the first
n - ceil(t n) + m n-grams of each (n the set's size). A document picks its m by estimated cost:
a longer prefix makes more postings, but asks for more shared n-grams before a pair is verified.
For a pair the smaller m of the two counts.

The order puts n-grams seen in few documents first, so that passages which many documents share
are in no prefix. How often an n-gram is seen comes from counts over all documents: within a task
every n-gram found twice or more is counted, and the counts are summed. They only shape the
order, held in a table of fixed size, and the estimates: a pair is never lost by them.

Linking finds the components with as few verified pairs as it can. Every link lies inside a component,
so all links are found afterwards by testing all pairs of each component, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spindlewatch.llm.common import split_words, text_groups, word_hashes
from spindlewatch.llm.components import link, size_band
from spindlewatch.session import stage

SIZE = 4
NUMERATOR, DENOMINATOR = 85, 100
MOST_MATCHES = 4
UNCOUNTED = 0.25  # other documents expected on the list of an n-gram that was not counted
LEVEL_BITS = 22
COUNT_AT = 1 << 21
NODE_BITS = 23
BLOCK = 256


def shingle_sets(texts: list[str | None], size: int = SIZE) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a shorter text is one sequence."""
    words, counts = split_words(texts)
    h = word_hashes(words)
    odd, spread = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
    gram = np.zeros(max(len(h) - size + 1, 0), np.uint64)
    for i in range(size):
        gram = (gram ^ h[i:i + len(gram)]) * odd
        gram ^= gram >> np.uint64(31)
    gram = (gram * spread) ^ (gram >> np.uint64(29))
    at = 0
    for n in counts:
        if n >= size:
            yield np.unique(gram[at:at + n - size + 1])
        elif n:
            one = np.full(1, n, np.uint64)
            for i in range(at, at + n):
                one = (one ^ h[i:i + 1]) * odd
                one ^= one >> np.uint64(31)
            yield one * spread
        else:
            yield np.zeros(0, np.uint64)
        at += n


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list]]:
    """Ids and texts in groups of bounded size, or one text that is longer."""
    for batch in batches:
        for part in text_groups(batch, 1):
            yield part.column(0), part.column(1).to_pylist()


def _repeated(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def counts():
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(grams[n > 1].view(np.int64)), pa.array(n[n > 1])],
                                              names=["gram", "n"])

        for _, texts in _groups(batches):
            for s in shingle_sets(texts, size):
                held.append(s)
                count += len(s)
            if count > COUNT_AT:
                yield counts()
                held, count = [], 0
        if held:
            yield counts()
    return run


def levels(docs: DataFrame, size: int = SIZE, least: int = 8) -> np.ndarray:
    """How common n-grams are, as log2 levels in a table of 2^LEVEL_BITS cells, 0 for rare.

    docs is (id, text). A cell holds the highest level of the n-grams that fall into it; those
    counted under `least` times stay 0. At most one number per cell comes to the driver.
    """
    counted = docs.mapInArrow(_repeated(size), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    cells = (counted.filter(F.col("n") >= least)
             .select(F.shiftrightunsigned("gram", 64 - LEVEL_BITS).cast("int").alias("cell"),
                     F.floor(F.log2("n")).cast("tinyint").alias("level"))
             .groupBy("cell").agg(F.max("level").alias("level")))
    out = np.zeros(1 << LEVEL_BITS, np.uint8)
    for batch in cells.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out


def prefix(grams: np.ndarray, level: np.ndarray, numerator: int, denominator: int,
           most: int = MOST_MATCHES) -> tuple[int, np.ndarray]:
    """(matches asked for, prefix) of one set.

    A posting costs 1. Verifying costs as much per candidate as 50 postings; candidates are the
    other documents on the prefix's lists, and each further match asked for is taken to halve them.
    """
    n = len(grams)
    if not n:
        return 0, grams
    rank = level[grams >> np.uint64(64 - LEVEL_BITS)]
    order = np.lexsort((grams, rank))
    base = n - -(-numerator * n // denominator)
    limit = min(most, n - base)
    lists = np.cumsum(np.where(rank[order[:base + limit]] > 0, 2.0 ** rank[order[:base + limit]], UNCOUNTED))
    matches = np.arange(1, limit + 1)
    cost = base + matches + 50 * lists[base + matches - 1] / 2.0 ** (matches - 1)
    m = int(matches[cost.argmin()])
    return m, grams[order[:base + m]]


def _summaries(level: np.ndarray, size: int, numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _groups(batches):
            n, one, two, matches, heads = [], [], [], [], []
            for s in shingle_sets(texts, size):
                n.append(len(s))
                # Two independent sums over the set tell sets apart.
                one.append(int(s.sum().astype(np.int64)) if len(s) else 0)
                two.append(int(((s ^ (s >> np.uint64(17))) * np.uint64(0xC2B2AE3D27D4EB4F)).sum().astype(np.int64)) if len(s) else 0)
                m, head = prefix(s, level, numerator, denominator)
                matches.append(m)
                heads.append(head.view(np.int64))
            offsets = np.cumsum([0, *map(len, heads)])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                 pa.array(matches, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(heads)))],
                names=["doc_id", "n_shingles", "one", "two", "least", "prefix"])
    return run


def _flags(nodes: DataFrame) -> np.ndarray:
    """Bits of the nodes' hashes: a filter of fixed size that loses none."""
    cells = nodes.select(F.pmod(F.xxhash64("node"), F.lit(1 << NODE_BITS)).cast("int").alias("cell")).distinct()
    out = np.zeros(1 << NODE_BITS, bool)
    for batch in cells.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = True
    return np.packbits(out)


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE,
                      numerator: int = NUMERATOR, denominator: int = DENOMINATOR, count_links: bool = False,
                      block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, component_id) per document, and all links (a, b) between classes, a < b.

    Two documents link when denominator * |intersection| >= numerator * |union| of their n-gram
    sets. component_id is the smallest doc_id that links reach. Documents with equal sets form a
    class, represented by its smallest doc_id; links are between representatives. Null and blank
    texts have an empty set and link with nothing. A null doc_id links with nothing and has a null
    component; each such row is returned. Other rows that share a doc_id are one: should their texts
    differ, it has the largest set's size, the smallest component, and links by its greatest text.

    With count_links there is a column n_links too: how many other documents the document links with,
    those of its own class included; 0 for a null doc_id. Ids whose rows differ count once for each of
    their classes, and have the largest of their counts.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    level = levels(source, size)
    made = stage(source.mapInArrow(_summaries(level, size, numerator, denominator),
                                   "doc_id long, n_shingles long, one long, two long, least int, prefix array<long>"),
                 "summaries")
    plain = made.select("doc_id", "n_shingles", "one", "two")
    classes = stage(plain.filter("n_shingles > 0 and doc_id is not null")
                    .groupBy("n_shingles", "one", "two").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("n_docs")), "classes")
    # One row per class; a repeated row of the representative adds nothing.
    first = stage(made.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
                  .select("doc_id", "n_shingles", "least", "prefix"), "representatives")
    postings = first.select(F.explode("prefix").alias("key"), F.col("doc_id").alias("node"),
                            size_band(F.col("n_shingles"), numerator / denominator).alias("band"))
    needed = first.groupBy(F.col("doc_id").alias("node")).agg(F.min("least").alias("least"))

    def texts_of(nodes: DataFrame) -> DataFrame:
        return (_flagged(source, _flags(nodes)).join(nodes, F.col("doc_id") == F.col("node"), "left_semi")
                .groupBy("doc_id").agg(F.max("text").alias("text")))

    def verify(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        texts = stage(texts_of(nodes), "candidate-texts")
        both = (pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
                .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b"))
        return both.mapInArrow(_verifier(size, numerator, denominator), "a long, b long")

    def signatures(nodes: DataFrame) -> DataFrame:
        # An id whose rows differ stands for all of their sets.
        return (first.join(nodes, F.col("doc_id") == F.col("node"), "left_semi").groupBy(F.col("doc_id").alias("node"))
                .agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"), F.min("least").alias("least"),
                     F.array_distinct(F.flatten(F.collect_list("prefix"))).alias("items"))
                .select("node", F.struct("low", "high", "least", "items").alias("sig")))

    def agree(a: Column, b: Column) -> Column:
        # A smaller set cannot fill its share of a much larger one; else both prefixes must share enough.
        fits = ((denominator * a["high"] >= numerator * b["low"]) & (denominator * b["high"] >= numerator * a["low"]))
        shared = F.size(F.array_intersect(a["items"], b["items"]))
        return F.when(fits, shared >= F.least(a["least"], b["least"])).otherwise(False)

    found = stage(link(postings, signatures, agree, verify, needed)[0], "linked-nodes")
    blocks = _blocks(found, classes, texts_of(found.select("node")), block)
    links = blocks.mapInArrow(_block_links(size, numerator, denominator, False), "a long, b long")
    reached = classes.join(found, F.col("rep") == F.col("node"), "left").select(
        "n_shingles", "one", "two", "rep", "n_docs", F.coalesce("component", "rep").alias("component_id"))
    more = []
    if count_links:
        counted = (blocks.mapInArrow(_block_links(size, numerator, denominator, True), "rep long, n long")
                   .groupBy("rep").agg(F.sum("n").alias("n")))
        reached = reached.join(counted, "rep", "left").withColumn(
            "n_links", F.coalesce("n", F.lit(0)) + F.col("n_docs") - 1)
        more = [F.coalesce(F.max("n_links"), F.lit(0)).cast("long").alias("n_links")]
    placed = (plain.filter("doc_id is not null").join(reached, ["n_shingles", "one", "two"], "left")
              .groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"),
                                     F.min(F.coalesce("component_id", "doc_id")).alias("component_id"), *more))
    nameless = plain.filter("doc_id is null").select(
        "doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"),
        *[F.lit(0).cast("long").alias("n_links")][:len(more)])
    return placed.union(nameless), links


def _blocks(found: DataFrame, classes: DataFrame, texts: DataFrame, block: int) -> DataFrame:
    """Rows (component, i, j, part, node, n_docs, text), those of a (component, i, j) in a row.

    A component's nodes are dealt by hash into parts of about `block`; part i meets part j, i <= j.
    """
    parts = found.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    placed = (found.join(parts, "component").join(classes.select(F.col("rep").alias("node"), "n_docs"), "node")
              .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))))
    return (placed.join(texts, F.col("node") == F.col("doc_id"))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
            .select("component", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
                    "part", "node", "n_docs", "text")
            .repartition("component", "i", "j").sortWithinPartitions("component", "i", "j"))


def common_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, by products of 0/1 matrices."""
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.int64)
    sides = []
    for sets in (left, right):
        grams = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        keep = np.isin(grams, shared)
        column, row = np.searchsorted(shared, grams[keep]), row[keep]
        order = np.argsort(column, kind="stable")
        sides.append((column[order], row[order], len(sets)))
    for at in range(0, len(shared), width):
        one, two = (np.zeros((n, min(width, len(shared) - at)), np.float32) for _, _, n in sides)
        for matrix, (column, row, _) in zip((one, two), sides):
            a, b = np.searchsorted(column, [at, at + width])
            matrix[row[a:b], column[a:b] - at] = 1
        out += (one @ two.T).astype(np.int64)
    return out


def _block_links(size: int, numerator: int, denominator: int, count: bool):
    """From `_blocks`: the links (a, b), or for each node the documents it links with."""
    def block(key: tuple, held: list) -> tuple[np.ndarray, np.ndarray]:
        part, node, n_docs = (np.array(x, np.int64) for x in list(zip(*held))[:3])
        sets = [x[3] for x in held]
        left, right = np.flatnonzero(part == key[1]), np.flatnonzero(part == key[2])
        if not len(left) or not len(right):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = np.array([len(s) for s in sets])
        common = common_counts([sets[k] for k in left], [sets[k] for k in right])
        good = denominator * common >= numerator * (n[left][:, None] + n[right][None, :] - common)
        if key[1] == key[2]:
            good = np.triu(good, 1)
        if count:
            whole = np.concatenate([good @ n_docs[right], good.T @ n_docs[left]])
            return np.concatenate([node[left], node[right]])[whole > 0], whole[whole > 0]
        a, b = np.nonzero(good)
        a, b = node[left[a]], node[right[b]]
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, done = None, [], []

        def made():
            columns = [pa.array(np.concatenate(x)) for x in zip(*done)]
            return pa.RecordBatch.from_arrays(columns, names=["rep", "n"] if count else ["a", "b"])

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                keys = zip(*(batch.column(c).to_pylist() for c in ("component", "i", "j")))
                rows = zip(*(batch.column(c).to_pylist() for c in ("part", "node", "n_docs")),
                           shingle_sets(batch.column("text").to_pylist(), size))
                for now, row in zip(keys, rows):
                    if now != key:
                        if len(held) > 1:
                            done.append(block(key, held))
                        key, held = now, []
                        if sum(len(x[0]) for x in done[-1:]) > 1000 or len(done) > 1000:
                            yield made()
                            done = []
                    held.append(row)
        if len(held) > 1:
            done.append(block(key, held))
        if done:
            yield made()
    return run


def _flagged(source: DataFrame, flags: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(flags).astype(bool)
        for batch in batches:
            part = batch.filter(pa.array(bits[batch.column("cell").to_numpy()]))
            if part.num_rows:
                yield part.select(["doc_id", "text"])

    cell = F.pmod(F.xxhash64("doc_id"), F.lit(1 << NODE_BITS)).cast("int")
    return source.filter("doc_id is not null").withColumn("cell", cell).mapInArrow(run, "doc_id long, text string")


def _verifier(size: int, numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
                texts = dict(zip(a, batch.column("ta"))) | dict(zip(b, batch.column("tb")))
                sets = dict(zip(texts, shingle_sets([t.as_py() for t in texts.values()], size)))
                common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)])
                union = np.array([len(sets[x]) + len(sets[y]) for x, y in zip(a, b)]) - common
                good = denominator * common >= numerator * union
                yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])
    return run


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that represent their component, and those with a null id."""
    found, _ = similar_documents(docs, doc_id, text, **options)
    other = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("other")).distinct()
    return docs.join(other, F.col(doc_id) == F.col("other"), "left_anti")
