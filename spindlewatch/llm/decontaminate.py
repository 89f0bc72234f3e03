"""Benchmark decontamination: q-gram lemma filtering, then banded alignment.

A text region within k edits of an item of m characters shares at least m + 1 - q - k*q of the
item's q-grams with it, on diagonals (text place less item place) that differ by at most k. So
shared q-grams are counted in bands of 2(k+1) diagonals that overlap by half: such a region lies
whole in one band. Bands that reach the bound are kept and verified by an edit-distance alignment
that stays inside the band. Nothing within the budget is lost, whatever the length of the text.

Text is compared in lower case, with every run of white space as one blank. The benchmark goes to
the workers in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spindlewatch.llm.common import SPACES, slices

Q = 8
RATE = 0.08
BLOCK_CHARS = 4_000_000
FILTER_BITS = 22
SLICE = 1 << 19


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case, white space folded, and the place of each in the text."""
    low = text.lower()
    if len(low) != len(text):  # a letter that lowers to two: keep the places
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    keep[:1] &= ~space[:1]
    at = np.flatnonzero(keep)
    return np.where(space[at], 32, codes[at]).astype(np.uint32), at


def qgrams(codes: np.ndarray) -> np.ndarray:
    """Rolling hash of every Q code points."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    base, width = 0x100000001B3, 1
    while width < Q:  # Q is a power of two
        h = h[:-width] * np.uint64(pow(base, width, 1 << 64)) + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    return h * np.uint64(0xBF58476D1CE4E5B9)


def align(pattern: np.ndarray, text: np.ndarray, base: np.ndarray, width: int) -> tuple:
    """Least edits of the pattern against the text along diagonals base .. base + width - 1.

    `base` holds a value for each candidate; all are aligned together. The start is free within
    the band. Returns (edits, end) for each, the end exclusive and the first of the best.
    """
    shift = np.arange(width)
    padded = np.concatenate([text, np.full(1, 0xFFFFFFFF, np.uint32)])
    column = base[:, None] + shift[None, :]
    big = np.int32(1 << 20)
    cost = np.where((column >= 0) & (column <= len(text)), 0, big).astype(np.int32)
    for i, c in enumerate(pattern):
        place = column + i  # the text character a diagonal step consumes
        inside = (place >= 0) & (place < len(text))
        step = cost + (padded[np.where(inside, place, len(text))] != c)
        step = np.where(inside, step, big)
        skip = np.concatenate([cost[:, 1:], np.full((len(cost), 1), big, np.int32)], axis=1) + 1
        cost = np.minimum(step, skip)
        cost = np.minimum.accumulate(cost - shift, axis=1).astype(np.int32) + shift
        after = place + 1
        cost = np.where((after >= 0) & (after <= len(text)), cost, big).astype(np.int32)
    best = cost.argmin(axis=1)
    return cost[np.arange(len(cost)), best], base + best + len(pattern)


class Items:
    """Benchmark items of one block with their q-grams, budgets and bounds."""

    def __init__(self, rows: list[tuple[int, str]], rate: float):
        self.ids, self.codes, self.edits, self.least = [], [], [], []
        grams, owner, place = [], [], []
        for item, text in rows:
            codes, _ = normal(text)
            codes = codes[:len(codes) - 1] if len(codes) and codes[-1] == 32 else codes
            if len(codes) < Q:
                continue
            # At least one q-gram has to survive the edits.
            k = min(int(rate * len(codes)), (len(codes) - Q) // Q)
            h = qgrams(codes)
            grams.append(h)
            owner.append(np.full(len(h), len(self.ids)))
            place.append(np.arange(len(h)))
            self.ids.append(item)
            self.codes.append(codes)
            self.edits.append(k)
            self.least.append(len(codes) + 1 - Q - k * Q)
        if not self.ids:
            return
        grams = np.concatenate(grams)
        order = np.argsort(grams, kind="stable")
        self.owner, self.place = np.concatenate(owner)[order], np.concatenate(place)[order]
        self.grams, self.first = np.unique(grams[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(order)))
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.grams >> np.uint64(64 - FILTER_BITS)] = True
        self.edits, self.least = np.array(self.edits), np.array(self.least)
        self.length = np.array([len(c) for c in self.codes])
        self.reach = int((self.length + 2 * self.edits).max()) + 2
        # Any match has this many hits in some stretch of `window` places.
        span = self.length + self.edits
        self.window = int(span.min())
        self.dense = int(np.min(-(-self.least // -(-span // self.window))))

    def candidates(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """(item, lowest diagonal of the band) of the bands that reach the bound."""
        if len(codes) < Q:
            return []
        h = qgrams(codes)
        at = np.flatnonzero(self.filter[h >> np.uint64(64 - FILTER_BITS)])
        spot = np.searchsorted(self.grams, h[at])
        spot[spot == len(self.grams)] = 0
        real = self.grams[spot] == h[at]
        at, spot = at[real], spot[real]
        if len(at) < self.dense:
            return []
        ahead = np.searchsorted(at, at + self.window) - np.arange(len(at))
        starts = at[ahead >= self.dense]
        if not len(starts):
            return []
        # Only hits that some dense stretch could belong to a match with.
        near = np.searchsorted(starts, at - self.reach - self.window)
        near = np.minimum(near, len(starts) - 1)
        close = (starts[near] <= at + self.reach) & (starts[near] >= at - self.reach - self.window)
        at, spot = at[close], spot[close]
        n = self.count[spot]
        row = np.repeat(np.arange(len(at)), n)
        entry = np.repeat(self.first[spot] - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, diagonal = self.owner[entry], at[row] - self.place[entry]
        step = self.edits[item] + 1
        band = diagonal // step
        reach = len(codes) + int(self.length.max()) + 2
        key = np.concatenate([item * (2 * reach) + band + reach, item * (2 * reach) + band - 1 + reach])
        keys, found = np.unique(key, return_counts=True)
        item = keys // (2 * reach)
        band = keys % (2 * reach) - reach
        enough = found >= self.least[item]
        return list(zip(item[enough], (band * (self.edits[item] + 1))[enough]))

    def regions(self, codes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the best region of each item that keeps the budget."""
        by_item: dict[int, list[int]] = {}
        for item, low in self.candidates(codes):
            by_item.setdefault(int(item), []).append(int(low))
        for item, lows in by_item.items():
            k, pattern = int(self.edits[item]), self.codes[item]
            best = None
            for i in range(0, len(lows), 256):
                base = np.array(lows[i:i + 256]) - k
                edits, end = align(pattern, codes, base, 2 * (k + 1) + 2 * k)
                j = np.lexsort((end, edits))[0]
                if best is None or (edits[j], end[j]) < best:
                    best = (int(edits[j]), int(end[j]))
            if best and best[0] <= k:
                edits, end = best
                back = codes[max(0, end - len(pattern) - k):end][::-1]
                _, length = align(pattern[::-1], back, np.array([-k]), 2 * k + 1)
                yield item, end - int(length[0]), end, edits


def _blocks(benchmark: DataFrame, item_id: str, text: str, size: int) -> Iterator[list]:
    rows, held = [], 0
    for row in (benchmark.select(item_id, text).filter(F.col(text).isNotNull()).distinct()
                .toLocalIterator()):
        if rows and held + len(row[1]) > size:
            yield rows
            rows, held = [], 0
        rows.append((row[0], row[1]))
        held += len(row[1])
    if rows:
        yield rows


def passages(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
             item_id: str = "item_id", item_text: str = "text", rate: float = RATE,
             block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start, end, edits): the best region of each item in each document.

    start and end are code points of the original text, end exclusive; among regions with equal
    edits the first counts. rate is the edit budget as a share of the item's characters.

    Null and empty texts match nothing; nor does an item of under `Q` characters, which names no
    passage. Null ids are returned as they are. Repeated rows of documents give repeated
    results; repeated items count once. Texts beyond a slice are read in overlapping slices.
    """
    schema = (f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, "
              f"{item_id} {benchmark.schema[item_id].dataType.simpleString()}, "
              "start long, end long, edits int")
    source = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).filter("t is not null")
    spark = docs.sparkSession
    parts = []
    for rows in _blocks(benchmark, item_id, item_text, block_chars):
        items = Items(rows, rate)
        if items.ids:
            parts.append(source.mapInArrow(_matcher(items), schema))
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)


def _matcher(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, value in zip(batch.column(0), batch.column(1)):
                found: dict[int, tuple] = {}
                for offset, piece in _overlapping(value.as_py(), items.reach):
                    codes, at = normal(piece)
                    for item, start, end, edits in items.regions(codes):
                        hit = (edits, offset + int(at[start]), offset + int(at[end - 1]) + 1)
                        found[item] = min(found.get(item, hit), hit)
                out += [(doc.as_py(), items.ids[i], s, e, n) for i, (n, s, e) in found.items()]
            if out:
                d, i, s, e, n = map(list, zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d, batch.schema.field(0).type), pa.array(i), pa.array(s, pa.int64()),
                     pa.array(e, pa.int64()), pa.array(n, pa.int32())],
                    names=["d", "i", "start", "end", "edits"])
    return run


def _overlapping(text: str, reach: int) -> Iterator[tuple[int, str]]:
    """Slices that overlap by at least one item's reach in folded characters."""
    if len(text) <= SLICE:
        yield 0, text
        return
    at, carried = 0, ""
    for piece in slices(text, SLICE):
        part = carried + piece
        yield at - len(carried), part
        at += len(piece)
        need, cut = reach, len(part)
        while need > 0 and cut > 0:  # runs of white space count as one
            cut -= 1
            need -= not (part[cut] in SPACES and cut and part[cut - 1] in SPACES)
        carried = part[cut:]


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no benchmark passage; documents with a null id stay."""
    hit = passages(docs, benchmark, doc_id=doc_id, **options)
    return docs.join(hit.select(F.col(doc_id).alias("hit")).distinct(),
                     F.col(doc_id) == F.col("hit"), "left_anti")
