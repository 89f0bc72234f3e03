"""Helpers that several of the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

# Code points one numpy pass may hold; longer texts go through in slices.
PASS_CHARS = 1 << 19
# Space characters that end a word.
SPACES = " \t\n\x0b\x0c\r"
SPLIT = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Bytes that stand inside a word, and inside a term: of the latter letters, digits and all beyond ASCII.
IN_WORD = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
IN_TERM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
GROUP_CHARS = 1 << 22


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def bucket_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo `parts`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """`df` less the columns that share a name, in any case, with one of `names`."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def append(df: DataFrame, fields: list[StructField],
           make: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """`df` with columns computed from Arrow batches; columns of those names are replaced."""
    kept = without(df, [f.name for f in fields])
    names = kept.columns
    needed = kept if kept.columns == df.columns else df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = make(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + new, names=names + [f.name for f in fields])

    return needed.mapInArrow(run, StructType([*kept.schema.fields, *fields]))


def slices(text: str, limit: int = PASS_CHARS) -> list[str]:
    """The text in pieces of at most `limit` code points, cut at white space where there is any."""
    if len(text) <= limit:
        return [text]
    out, at = [], 0
    while len(text) - at > limit:
        cut = max(text.rfind(s, at + 1, at + limit) for s in SPACES)
        cut = cut if cut > at else at + limit
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def passes(texts: list[str | None], limit: int = PASS_CHARS) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(row numbers, pieces) in groups of about `limit` code points; null texts have no piece."""
    rows, pieces, held = [], [], 0
    for row, text in enumerate(texts):
        for piece in slices(text, limit) if text else ():
            if pieces and held + len(piece) > limit:
                yield np.array(rows), pieces
                rows, pieces, held = [], [], 0
            rows.append(row)
            pieces.append(piece)
            held += len(piece)
    if pieces:
        yield np.array(rows), pieces


def code_points(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the pieces, each followed by a 0, and the piece that each belongs to."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
    joined = "\0".join([*pieces, ""]).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32), np.repeat(np.arange(len(pieces)), lengths)


def split_words(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A-Z lowered, as one binary array, and the words each text has."""
    return _split(texts, IN_WORD)


def split_terms(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """The same for terms: what no ASCII sign but letters and digits interrupts."""
    return _split(texts, IN_TERM)


def _split(texts: list[str | None], within: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    if not len(data):
        return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
    inside = within[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    packed = LOWER[data[inside]]
    offsets = np.append(np.cumsum(inside)[starts] - 1, len(packed)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts),
                                  [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    return words, counts


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of every word, computed once per distinct word."""
    coded = words.dictionary_encode()
    # pandas hashes bytes with SipHash under a fixed key.
    hashed = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), object), categorize=False)
    return hashed[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)


def text_groups(batch: pa.RecordBatch, column: int, chars: int = GROUP_CHARS) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts have a bounded length in all, or one text that is longer."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    edges = np.cumsum(lengths) // chars
    cuts = [0, *(np.flatnonzero(np.diff(edges)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
