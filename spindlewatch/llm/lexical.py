"""Ranked lexical search over bit-sliced Bloom signatures.

A document's signature is a column of bits: each of its distinct terms sets a few, by hash. Stored by
row, a bit of many documents is one bitmap, and the bitmaps of a term's bits, joined by AND, hold every
document with that term, and some without. Documents of similar numbers of distinct terms share a
block, whose bits are in proportion to that number. A block has such a signature for the terms that a
document holds at least once, twice and four times.

For a query, the weights of its terms are summed up for every document whose bitmaps show them, for
each of the three signatures. A term's share of the score grows with its occurrences, so these sums
give an upper bound of the score: no more occurrences than the next signature's least, less one, and in
the last no more than the document's most frequent term has. Documents are rescored exactly in the
order of their bounds, until the bound falls below the query's k-th best score so far. None is left
out otherwise; each task passes on its k best, and the best of all are ranked.

Two passes read the documents: one counts them, their terms, and the documents of each query term, the
other searches. Queries are a stated set and go to the workers in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from spindlewatch.llm.common import split_terms, text_groups, word_hashes

HASHES = 3
BITS = 12  # for each distinct term of a block's largest document, at least
LEAST = (1, 2, 4)  # occurrences that a term needs for each signature
RESCORED = 64  # documents rescored at a time
BLOCK_BITS = 1 << 25
ITEM_CHARS = 1 << 20
GROUP_CHARS = 1 << 24
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)]
RESULT = "item_id long, doc_id long, score long"


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term with weight 1 adds to a score, in 64-bit integers; never less for a larger tf."""
    return (1_000_000_000 * tf) // np.maximum(1000 * tf + 8 * m, 1)


@dataclass
class Queries:
    """Item ids, the distinct terms of all items, and each item's terms: places among these, and weights."""

    ids: list[int]
    terms: list[bytes]
    places: list[np.ndarray] = field(default_factory=list)
    repeats: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def of(cls, ids: list[int], texts: list[str]) -> Queries:
        terms, counts = split_terms(texts)
        names, at, made = terms.to_pylist(), 0, cls(ids, [])
        number: dict[bytes, int] = {}
        for n in counts:
            found = Counter(names[at:at + n])
            made.places.append(np.array([number.setdefault(t, len(number)) for t in found], np.int64))
            made.repeats.append(np.array(list(found.values()), np.int64))
            at += n
        made.terms = list(number)
        return made

    def weigh(self, documents: int, holding: np.ndarray) -> None:
        """Set the weights from the number of documents, and of those that hold each term."""
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in holding],
                          np.int64)
        self.weights = [weight[p] * r for p, r in zip(self.places, self.repeats)]


@dataclass
class Group:
    """Distinct terms of some documents: document, hash, place among the query terms (or -1), occurrences."""

    n: np.ndarray  # terms of each document, with repeats
    doc: np.ndarray
    hashed: np.ndarray
    place: np.ndarray
    tf: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None], terms: pa.Array) -> Group:
        found, counts = split_terms(texts)
        coded = found.dictionary_encode()
        width = max(len(coded.dictionary), 1)
        key, tf = np.unique(np.repeat(np.arange(len(texts)), counts) * width + coded.indices.to_numpy(),
                            return_counts=True)
        doc, code = key // width, key % width
        place = pa.compute.fill_null(pa.compute.index_in(coded.dictionary, terms), -1).to_numpy()
        hashed = word_hashes(coded.dictionary)
        return cls(counts, doc, hashed[code], place[code].astype(np.int64), tf.astype(np.int64))


def _groups(batches: Iterator[pa.RecordBatch], terms: pa.Array) -> Iterator[tuple[pa.RecordBatch, Group]]:
    for batch in batches:
        for part in text_groups(batch, batch.num_columns - 1, GROUP_CHARS):
            yield part, Group.of(part.column(part.num_columns - 1).to_pylist(), terms)


def statistics(docs: DataFrame, text: str, terms: list[bytes]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and documents that hold each of `terms`."""
    wanted = pa.array(terms, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms) + 2, np.int64)
        for _, group in _groups(batches, wanted):
            total[:-2] += np.bincount(group.place[group.place >= 0], minlength=len(terms))
            total[-2:] += (group.n > 0).sum(), group.n.sum()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["at", "n"])

    counted = docs.select(text).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms) + 2, np.int64)
    out[counted.column("at").to_numpy()] = counted.column("n").to_numpy()
    return int(out[-2]), int(out[-1]), out[:-2]


def _bits(hashed: np.ndarray, bits: int) -> np.ndarray:
    """The signature's rows for each term, HASHES of them; `bits` is a power of two."""
    shift = np.uint64(64 - bits.bit_length() + 1)
    return np.stack([(hashed * odd) >> shift for odd in ODD[:HASHES]]).astype(np.int64)


class Block:
    """Signatures of some documents of a group with similar numbers of distinct terms."""

    def __init__(self, group: Group, docs: np.ndarray, largest: int, m: np.ndarray, terms: np.ndarray):
        """docs are their numbers in the group, `terms` hashes of the query terms."""
        self.docs, self.m = docs, m[docs]
        column = np.full(len(m), -1)
        column[docs] = np.arange(len(docs))
        own = column[group.doc] >= 0
        at, hashed, place, tf = column[group.doc[own]], group.hashed[own], group.place[own], group.tf[own]
        self.most = np.zeros(len(docs), np.int64)
        np.maximum.at(self.most, at, tf)
        bits = 1 << max(6, (BITS * largest - 1).bit_length())
        rows, asked = _bits(hashed, bits), _bits(terms, bits)
        self.shown = []  # for each signature: query terms x documents
        for least in LEAST:
            slices = np.zeros((bits, len(docs)), bool)
            keep = tf >= least
            for row in rows:
                slices[row[keep], at[keep]] = True
            packed = np.packbits(slices, axis=1)
            both = packed[asked[0]]
            for row in asked[1:]:
                both &= packed[row]
            self.shown.append(np.unpackbits(both, axis=1, count=len(docs)))
        # A term that is shown in one signature adds up to the next one's least occurrences, less one.
        reach = [np.minimum(self.most, upper - 1) for upper in LEAST[1:]] + [self.most]
        shares = [share(tf, self.m) for tf in reach]
        self.steps = [shares[0], *[b - a for a, b in zip(shares, shares[1:])]]
        self.exact = np.zeros((len(docs), len(terms)), np.int32)
        self.exact[at[place >= 0], place[place >= 0]] = tf[place >= 0]

    def bounds(self, places: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Upper bound of every document's score."""
        kind = np.float32 if weights.sum() < 1 << 24 else np.float64  # sums of whole numbers stay exact
        sums = [(weights.astype(kind) @ shown[places]).astype(np.int64) for shown in self.shown]
        return sum(s * step for s, step in zip(sums, self.steps))

    def scores(self, rows: np.ndarray, places: np.ndarray, weights: np.ndarray) -> np.ndarray:
        tf = self.exact[rows[:, None], places].astype(np.int64)
        return (share(tf, self.m[rows][:, None]) * weights).sum(axis=1)


def _blocks(group: Group, m: np.ndarray, terms: np.ndarray) -> Iterator[Block]:
    """Documents with a term, in blocks by the power of two of their distinct terms."""
    distinct = np.bincount(group.doc, minlength=len(group.n))
    size = np.ceil(np.log2(np.maximum(distinct, 1))).astype(np.int64)
    for one in np.unique(size[distinct > 0]):
        docs = np.flatnonzero((size == one) & (distinct > 0))
        count = max(8, BLOCK_BITS // (2 * BITS << int(one)))
        for at in range(0, len(docs), count):
            yield Block(group, docs[at:at + count], 1 << int(one), m, terms)


class Best:
    """The k best (score, id) of every query so far; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.ids = np.zeros((n, k), np.int64), np.full((n, k), np.iinfo(np.int64).max)

    def floor(self, query: int) -> int:
        """What a document must score to matter."""
        return max(1, int(self.score[query, -1]))

    def offer(self, query: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[query], score]), np.concatenate([self.ids[query], ids])
        order = np.lexsort((ids, -score))[:self.k]
        self.score[query], self.ids[query] = score[order], ids[order]


def search_block(block: Block, ids: np.ndarray, queries: Queries, best: Best) -> int:
    """Offer the block's documents to every query; returns how many were rescored."""
    done = 0
    for q, (places, weights) in enumerate(zip(queries.places, queries.weights)):
        if not len(places):
            continue
        bound = block.bounds(places, weights)
        rows = np.flatnonzero(bound >= best.floor(q))
        rows = rows[np.argsort(-bound[rows], kind="stable")]
        for at in range(0, len(rows), RESCORED):
            part = rows[at:at + RESCORED]
            part = part[bound[part] >= best.floor(q)]
            if not len(part):
                break
            score = block.scores(part, places, weights)
            done += len(part)
            kept = score > 0
            best.offer(q, score[kept], ids[block.docs[part[kept]]])
    return done


def _searcher(queries: Queries, documents: int, total: int, k: int):
    terms = pa.array(queries.terms, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, hashed = Best(len(queries.ids), k), word_hashes(terms)
        for part, group in _groups(batches, terms):
            ids = part.column(0).to_numpy()
            m = 100 - 75 + (75 * group.n * documents) // total
            for block in _blocks(group, m, hashed):
                search_block(block, ids, queries, best)
        row, place = np.nonzero(best.score > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(queries.ids, np.int64)[row]), pa.array(best.ids[row, place]),
             pa.array(best.score[row, place])], names=["item_id", "doc_id", "score"])
    return run


def _item_blocks(items: DataFrame, chars: int) -> Iterator[Queries]:
    """Items in blocks of about `chars` characters, or one longer item."""
    ids, texts, held = [], [], 0
    for row in items.toLocalIterator():
        if ids and held + len(row["t"]) > chars:
            yield Queries.of(ids, texts)
            ids, texts, held = [], [], 0
        ids.append(row["q"])
        texts.append(row["t"])
        held += len(row["t"])
    if ids:
        yield Queries.of(ids, texts)


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", item_chars: int = ITEM_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents that score highest for every item.

    Terms are runs of letters, digits and signs beyond ASCII, with A-Z lowered. Documents without a
    term (null, empty, blank) count for nothing and score 0; those with a score of 0 are not ranked. Rows
    with a null doc_id are counted, but not ranked. Every other row is a document of its own, also when
    ids or texts repeat. Equal scores are ranked by ascending doc_id. Items without a term or an id have no
    result; of items that share an id the smallest text counts.
    """
    spark = docs.sparkSession
    asked = (items.select(F.col(item_id).cast("long").alias("q"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
             .filter("q is not null").groupBy("q").agg(F.min("t").alias("t")))
    held = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = []
    for queries in _item_blocks(asked, item_chars):
        documents, total, holding = statistics(held, "text", queries.terms)
        if total and queries.terms:
            queries.weigh(documents, holding)
            # Documents without an id are in the statistics only.
            parts.append(held.filter("doc_id is not null").mapInArrow(_searcher(queries, documents, total, k), RESULT))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = W.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return (reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))
