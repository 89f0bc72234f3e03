"""Periodic runs of words, by online dyadic square catching.

Words are appended in portions of any size. For the periods of every octave 2^j .. 2^(j+1) - 1 there
is a family of catchers, one over each completed block of a power of two of words. A catcher looks
for copies of its block at the distances of its octave; as words are appended, the copies that have
become complete are compared by hash, all catchers and distances of an octave in one operation. A
copy found is a square in the making: its words are compared one by one, backward and forward, and
the comparison goes on with the words appended later while the text keeps the period. Squares of one
period that overlap are one zone of words x with x equal to x + period, so they merge into a run.

Block sizes are such that every run asked for holds a whole block and its copy, so none is missed.
A multiple of a run's period gives no run of its own: a copy inside a run whose period divides the
distance is left out, since the text around it has the smaller period as far as the larger one.

Octaves and blocks grow together, so a text of n words takes about n comparisons for each octave.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from spindlewatch.llm.common import append

MIN_LENGTH = 24
REPEATS = 3
PORTION = 1 << 16
ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring blocks from their hashes."""
    mixed = (left * ODD[0]) ^ (right * ODD[1])
    return (mixed ^ (mixed >> np.uint64(29))) * ODD[2]


def stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of true values."""
    edges = np.flatnonzero(np.diff(same.astype(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


class Catchers:
    """The catchers of one text, and the zones that they have found."""

    def __init__(self, min_length: int = MIN_LENGTH, repeats: int = REPEATS):
        if repeats < 2 or min_length < 1:
            raise ValueError("a run repeats its period at least twice")
        self.min_length, self.repeats = min_length, repeats
        self.words = np.zeros(0, np.int64)
        self.hashes: list[np.ndarray] = [np.zeros(0, np.uint64)]  # of the blocks of 2^i words that start at each word
        self.zones: list[list[int]] = []  # period, low, high: word x equals word x + period for low <= x < high

    def least(self, period):
        """Words in the zone of a run that is just long enough."""
        return np.maximum(self.min_length - period, (self.repeats - 1) * period)

    def append(self, codes: np.ndarray) -> None:
        """Go on with the next words, each a number that equal words share."""
        before, self.words = len(self.words), np.concatenate([self.words, codes])
        n = len(self.words)
        fresh = (codes.astype(np.uint64) + np.uint64(1)) * ODD[1]
        self.hashes[0] = np.concatenate([self.hashes[0], fresh ^ (fresh >> np.uint64(31))])
        self._extend(before)
        if n < self.min_length:
            return
        # No run has a longer period yet; those that become possible look at all words once.
        longest, known = n // self.repeats, before // self.repeats if before >= self.min_length else 0
        for octave in range(longest.bit_length()):
            low, high = 1 << octave, min(2 << octave, longest + 1)
            room = int(self.least(np.arange(low, 2 * low)).min())
            level = ((room + 1) // 2).bit_length() - 1  # any zone of `room` words holds an aligned block of 2^level
            self._grow(level)
            middle = min(max(low, known + 1), high)
            self._catch(1 << level, self.hashes[level], low, middle, before)
            self._catch(1 << level, self.hashes[level], middle, high, 0)

    def _extend(self, before: int) -> None:
        """Carry on the zones that reached the end of the text."""
        n = len(self.words)
        for zone in self.zones:
            period, _, high = zone
            if high + period == before:
                same = self.words[high:n - period] == self.words[high + period:n]
                zone[2] = high + (len(same) if same.all() else int(same.argmin()))

    def _grow(self, level: int) -> None:
        while len(self.hashes) <= level:
            self.hashes.append(np.zeros(0, np.uint64))
        for i in range(1, level + 1):
            half, done = self.hashes[i - 1], len(self.hashes[i])
            step, n = 1 << (i - 1), len(self.words) - (1 << i) + 1
            if n > done:
                new = _join(half[done:n], half[done + step:n + step])
                self.hashes[i] = np.concatenate([self.hashes[i], new]) if done else new

    def _catch(self, block: int, hashed: np.ndarray, low: int, high: int, before: int) -> None:
        """Compare the blocks with their copies at distances low .. high - 1 that the last words completed."""
        n, width = len(hashed), high - low
        if not width:
            return
        first = max(0, -(-(before - block + 2 - high) // block))
        last = (n - 1 - low) // block
        if last < first:
            return
        rows = last - first + 1
        copies = hashed[first * block + low:last * block + high]
        short = (rows - 1) * block + width - len(copies)
        if short > 0:
            copies = np.concatenate([copies, np.zeros(short, np.uint64)])
        grid = np.lib.stride_tricks.as_strided(copies, (rows, width), (8 * block, 8), writeable=False)
        row, distance = np.nonzero(grid == hashed[first * block:last * block + 1:block][:, None])
        start, period = (row + first) * block, distance + low
        new = (start + period > before - block) & (start + period < n)
        if not new.any():
            return
        start, period = start[new], period[new]
        order = np.lexsort((start, period))
        start, period = start[order], period[order]
        # Copies of neighbouring blocks at one distance are one zone.
        cut = np.flatnonzero((np.diff(period) != 0) | (np.diff(start) != block)) + 1
        begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(start)]]) - 1
        self._verify(block, period[begin], start[begin], start[end] + block)

    def _covered(self, period: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.zeros(len(period), bool)
        for q, a, b in self.zones:
            out |= (period % q == 0) & (low >= a) & (high + period <= b + q)
        return out

    def _verify(self, block: int, period: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Compare the words of each candidate zone, and those that may extend it."""
        n = len(self.words)
        fresh = np.flatnonzero(~self._covered(period, low, high))
        known = {(z[0], z[1]) for z in self.zones} if len(fresh) else set()
        for i in fresh:
            p = int(period[i])
            a, b = max(0, int(low[i]) - block + 1), min(n - p, int(high[i]) + block - 1)
            for start, end in zip(*stretches(self.words[a:b] == self.words[a + p:b + p])):
                zone = [p, a + int(start), a + int(end)]
                # One that reaches the end of the text may still grow.
                if (end - start >= self.least(p) or zone[2] + p == n) and (p, zone[1]) not in known:
                    self.zones.append(zone)
                    known.add((p, zone[1]))

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of the runs in the words so far, by start and period."""
        # A multiple of a period may have been found before it, and then has the same words.
        found: dict[tuple[int, int], int] = {}
        for p, a, b in self.zones:
            if b - a >= self.least(p):
                found[a, b - a + p] = min(p, found.get((a, b - a + p), p))
        return sorted((start, length, p) for (start, length), p in found.items())


def runs_of(words: list[bytes], min_length: int = MIN_LENGTH, repeats: int = REPEATS,
            portion: int = PORTION) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text's words."""
    if len(words) < min_length:
        return []
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    catchers = Catchers(min_length, repeats)
    for at in range(0, len(codes), portion):
        catchers.append(codes[at:at + portion])
    return catchers.runs()


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, less those that a run holds after its first period."""
    if runs:
        kept = np.ones(len(words), bool)
        for start, length, period in runs:
            kept[start + period:start + length] = False
        words = [words[i] for i in np.flatnonzero(kept)]
    return b" ".join(words)


RUN = StructType([StructField(c, LongType(), False) for c in ("start", "length", "period")])


def find_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH,
              repeats: int = REPEATS) -> DataFrame:
    """`docs` with runs, an array of (start, length, period), and collapsed, the text without repeats.

    A run is a maximal stretch of words with smallest period p that has at least `min_length` words
    and `repeats` periods; words are what stands between ASCII white space, numbered from 0, and
    compared as they are. Runs are ordered by start, then period. collapsed lacks the words that any
    run holds after its first p; its words are joined by single spaces. Null, empty and blank texts
    have no run and an empty collapsed text. Every row is looked at by itself, so repeated rows have
    equal results. Columns named runs and collapsed are replaced.
    """

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        starts, lengths, periods, sizes, kept = [], [], [], [0], []
        for value in batch.column(text):
            words = (value.as_py() or "").encode("utf-8", "surrogatepass").split()
            found = runs_of(words, min_length, repeats)
            for column, x in zip((starts, lengths, periods), zip(*found) if found else ((), (), ())):
                column.extend(x)
            sizes.append(len(starts))
            kept.append(collapse(words, found))
        structs = pa.StructArray.from_arrays(
            [pa.array(c, pa.int64()) for c in (starts, lengths, periods)],
            fields=[pa.field(c, pa.int64(), False) for c in ("start", "length", "period")])
        return [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), structs),
                pa.array(kept, pa.binary()).cast(pa.string())]

    return append(docs, [StructField("runs", ArrayType(RUN, False)), StructField("collapsed", StringType())], make)
