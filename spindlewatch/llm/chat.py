"""Chat formatting with loss masks aligned to token offsets.

A conversation is rendered whole: each turn is

    <|im_start|>role, line feed, text, <|im_end|>, line feed

Inside roles and texts `<|` gets a backslash after the `<`, and so does `<\\|` and so on, which
`unescape` takes back; so no text can open or close a turn. A role is kept on one line. The rendered string is encoded once with character offsets. The turns to learn from are
spans of it, sorted; binary search against the sorted token spans finds the tokens that meet one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
FORMATTED = ("formatted string, token_ids array<int>, starts array<int>, ends array<int>, "
             "loss array<boolean>, spans array<array<int>>")
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + "\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """As `escape`, and on one line: a line feed is `<n`, and `<n` itself gets a backslash."""
    return re.sub(r"<(\\*)n", r"<\\\1n", escape(role)).replace("\n", "<n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"<(\\*)n", lambda m: f"<{m[1][1:]}n" if m[1] else "\n", role))


def render(turns: list[tuple[str, str]], learn: str) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string, and the spans of the texts whose role is `learn`."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        part = f"{head}{body}{CLOSE}\n"
        parts.append(part)
        at += len(part)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    return [(unescape_role(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens share a character with a span. Tokens and spans are sorted."""
    mask = np.zeros(len(starts) + 1, np.int32)
    if spans:
        low, high = np.array(spans).T
        some = high > low
        first = np.searchsorted(ends, low[some], "right")
        last = np.searchsorted(starts, high[some], "left")
        np.add.at(mask, first, 1)
        np.add.at(mask, np.maximum(first, last), -1)
    return np.cumsum(mask[:-1]) > 0


def masked_text(formatted: str, starts: list[int], ends: list[int], loss: list[bool],
                spans: list[list[int]]) -> str:
    """The text under the mask: what the marked tokens cover of the spans, unescaped."""
    covered = np.zeros(len(formatted) + 1, np.int32)
    on = np.array(loss, bool)
    np.add.at(covered, np.array(starts, np.int64)[on], 1)
    np.add.at(covered, np.array(ends, np.int64)[on], -1)
    covered = np.cumsum(covered) > 0
    out = []
    for low, high in spans:
        seen = covered[low:high]
        part = formatted[low:high]
        out.append(unescape(part if seen.all() else "".join(c for c, s in zip(part, seen) if s)))
    return "".join(out)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.add_special_tokens([AddedToken(t, normalized=False) for t in (OPEN, CLOSE)])
    return loaded


def format_chats(turns: DataFrame, vocabulary: str, learn: str = "assistant",
                 conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """A row per conversation: the rendered string, its tokens, their offsets and the loss mask.

    Turns are ordered by `turn`, null first, ties by role and text; repeated rows are repeated
    turns. Null roles and texts are empty. Rows with a null conv_id form one conversation of
    their own. A conversation is one row by nature and has to fit a task. Other columns are
    ignored.
    """
    held = (turns.select(F.col(conv_id).alias("c"), F.col(turn).alias("n"),
                         F.coalesce(F.col(role), F.lit("")).alias("r"),
                         F.coalesce(F.col(text), F.lit("")).alias("t"))
            .groupBy("c").agg(F.sort_array(F.collect_list(F.struct("n", "r", "t"))).alias("turns"))
            .select(F.col("c").alias(conv_id), F.transform("turns", lambda x: x["r"]).alias("roles"),
                    F.transform("turns", lambda x: x["t"]).alias("texts")))
    kind = held.schema[conv_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = tokenizer(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                done = [render(list(zip(r, t)), learn) for r, t in
                        zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                encoded = [code.encode(s, add_special_tokens=False) for s, _ in done]
                offsets = [np.array(e.offsets, np.int64).reshape(-1, 2).T for e in encoded]
                masks = [loss_mask(o[0], o[1], spans) for o, (_, spans) in zip(offsets, done)]
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([s for s, _ in done], pa.string()),
                     pa.array([e.ids for e in encoded], ints),
                     pa.array([o[0].tolist() for o in offsets], ints),
                     pa.array([o[1].tolist() for o in offsets], ints),
                     pa.array([m.tolist() for m in masks], pa.list_(pa.bool_())),
                     pa.array([[list(x) for x in spans] for _, spans in done], pa.list_(ints))],
                    names=[conv_id, "formatted", "token_ids", "starts", "ends", "loss", "spans"])

    return held.mapInArrow(run, f"`{conv_id}` {kind}, {FORMATTED}")


def digests(formatted: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """What the rendered strings and masks hold, read back: turns and text under the mask."""
    from hashlib import sha256

    kind = formatted.schema[conv_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                turns = parse(row["formatted"])
                loss = masked_text(*(row[c] for c in ("formatted", "starts", "ends", "loss", "spans")))
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((row[conv_id], len(turns), sha256(whole.encode()).hexdigest(), len(loss),
                            sha256(loss.encode()).hexdigest(), len(row["formatted"])))
            if out:
                columns = list(zip(*out))
                kinds = [batch.schema.field(conv_id).type, pa.int64(), pa.string(), pa.int64(),
                         pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    names=[conv_id, "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                           "formatted_chars"])

    return (formatted.select(conv_id, "formatted", "starts", "ends", "loss", "spans")
            .mapInArrow(run, f"`{conv_id}` {kind}, n_turns long, turns_sha256 string, "
                             "loss_chars long, loss_sha256 string, formatted_chars long"))
