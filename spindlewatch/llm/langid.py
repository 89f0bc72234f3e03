"""Language identification: averaged hashed subword embeddings and a linear softmax.

Every text is the average of the embeddings of its character 2- to 4-grams inside words (word
edges included), hashed to a fixed number of buckets. Embeddings and softmax are trained together
by stochastic gradient descent in numpy. A held-back part of the sample sets a temperature, so
that scores are calibrated, and the confidence below which a text is rejected.

The training sample is bounded by `per_label` expected rows of each label; everything else sees
whole texts of all rows. Since the softmax is linear, scoring needs one (buckets x labels) table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField

from spindlewatch.llm.common import append, code_points, passes, without

UNKNOWN = "und"
BITS = 15
WIDTH = 16


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


LETTERS: list[np.ndarray] = []


def grams(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and piece of every subword, in order of the pieces."""
    if not LETTERS:
        LETTERS.append(_letters())
    codes, owner = code_points([p.lower() for p in pieces])
    letter = LETTERS[0][codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a word and one mark after it
    codes = np.where(letter, codes, 0)[keep].astype(np.uint32)
    owner = owner[keep]
    if len(codes) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.concatenate([np.zeros(1, np.uint32), codes])
    owner = np.concatenate([owner[:1], owner])
    mixed = codes * np.uint32(0x9E3779B1)
    h = mixed[:-1] * np.uint32(31) ^ mixed[1:]
    buckets, owners = [(h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)], [owner[1:]]
    whole = np.ones(len(h), bool)
    for n in (3, 4):
        h = h[:-1] * np.uint32(0x01000193) ^ mixed[n - 1:]
        whole = whole[:-1] & (codes[n - 2:len(codes) - 1] != 0)
        buckets.append(((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))[whole])
        owners.append(owner[1:len(whole) + 1][whole])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


@dataclass
class LangModel:
    """labels, the (buckets x labels) table of logits, its offset, temperature, least score."""

    labels: list[str]
    table: np.ndarray = field(repr=False)
    offset: np.ndarray
    temperature: float
    least: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated probabilities, a row per text; rows without a subword are 0."""
        width = len(self.labels)
        sums, count = np.zeros((len(texts), width)), np.zeros(len(texts))
        for rows, pieces in passes(texts):
            buckets, owner = grams(pieces)
            seen = np.bincount(owner, minlength=len(pieces))
            for k in range(width):
                sums[:, k] += np.bincount(
                    rows, np.bincount(owner, self.table[buckets, k], len(pieces)), len(texts))
            count += np.bincount(rows, seen, len(texts))
        out = sums / np.maximum(count, 1)[:, None] + self.offset
        return _softmax(out / self.temperature) * (count > 0)[:, None]


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _sample(docs: DataFrame, text: str, label: str, train: Column, per_label: int) -> DataFrame:
    """Labelled rows at the rate that is expected to leave `per_label` rows of a label."""
    usable = docs.filter(train & F.col(label).isNotNull() & F.col(text).isNotNull())
    counts = usable.groupBy(label).count().collect()  # a row per label
    if not counts:
        return docs.select(text, label).limit(0)
    rates = F.create_map(*[F.lit(x) for row in counts
                           for x in (row[label], min(1.0, per_label / row["count"]))])
    drawn = F.xxhash64(F.col(text), F.lit("draw"))
    uniform = F.pmod(drawn, F.lit(1 << 20)) / F.lit(float(1 << 20))
    return usable.filter(uniform < rates[F.col(label)]).select(text, label)


def fit(docs: DataFrame, train: Column, text: str = "text", label: str = "lang",
        per_label: int = 600, rejected: float = 0.001, epochs: int = 6) -> LangModel:
    """Train on the rows where `train` holds and the label is not null.

    per_label   expected rows sampled of each label: the bound of the training sample
    rejected    share of correctly labelled texts that the rejection threshold may cost
    Without labelled rows the model knows no label and predicts `und` everywhere.
    """

    def features(batches):
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for text_, label_ in zip(texts, labels):
                counts = np.zeros(1 << BITS)
                for _, pieces in passes([text_]):
                    counts += np.bincount(grams(pieces)[0], minlength=1 << BITS)
                at = np.flatnonzero(counts)
                if len(at):
                    share = (counts[at] / counts.sum()).astype(np.float32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([label_]), pa.array([at.astype(np.uint16).tobytes()], pa.binary()),
                         pa.array([share.tobytes()], pa.binary())], names=["label", "at", "share"])

    found = (_sample(docs, text, label, train, per_label)
             .mapInArrow(features, "label string, at binary, share binary").toArrow())
    # The order of arrival must not matter.
    rows = sorted(zip(*(found.column(c).to_pylist() for c in ("label", "at", "share"))))
    labels = sorted({r[0] for r in rows})
    if not labels:
        return LangModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(7)
    data = [(np.frombuffer(at, np.uint16).astype(np.int32), np.frombuffer(share, np.float32), labels.index(name))
            for name, at, share in rows]
    data = [data[i] for i in rng.permutation(len(data))]
    held = max(1, len(data) // 5) if len(data) > 4 else 0
    learn, check = data[held:], data[:held] or data
    embed = rng.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32)
    weight, offset = np.zeros((WIDTH, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    steps, step = epochs * len(learn), 0
    for _ in range(epochs):
        for i in rng.permutation(len(learn)):
            at, share, y = learn[i]
            rate = 1 - step / steps
            step += 1
            h = share @ embed[at]
            z = h @ weight + offset
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = weight @ p
            weight -= (0.5 * rate) * np.outer(h, p)
            offset -= (0.05 * rate) * p
            # A share is about one over the subwords of a text, hence the larger step.
            embed[at] -= (20 * rate) * np.outer(share, back)
    table = embed @ weight
    logits = np.array([share @ table[at] + offset for at, share, _ in check])
    truth = np.array([y for _, _, y in check])
    grid = np.geomspace(0.1, 10, 41)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(logits / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    # Never above even odds: a text likelier right than wrong is not rejected.
    least = min(0.5, float(np.quantile(right, rejected))) if len(right) else 0.0
    return LangModel(labels, table.astype(np.float32), offset, temperature, least)


def predict(docs: DataFrame, model: LangModel, text: str = "text") -> DataFrame:
    """`docs` with lang_pred, lang_score and lang_rejected.

    A text that is null or has no letter, and any text if the model knows no label, gets `und`,
    score 0 and rejected. Columns that bear one of the three names are replaced. Equal scores go
    to the label that sorts first. Repeated rows each get their own, equal, prediction.
    """

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column(text).to_pylist()
        if not model.labels:
            n = len(texts)
            return [pa.array([UNKNOWN] * n), pa.array([0.0] * n), pa.array([True] * n)]
        p = model.scores(texts)
        best, score = p.argmax(axis=1), p.max(axis=1)
        names = [model.labels[b] if s > 0 else UNKNOWN for b, s in zip(best, score)]
        return [pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1)),
                pa.array((score < model.least) | (score <= 0))]

    return append(docs, [StructField("lang_pred", StringType()),
                         StructField("lang_score", DoubleType()),
                         StructField("lang_rejected", BooleanType())], make)


def keep_known(docs: DataFrame, model: LangModel, text: str = "text") -> DataFrame:
    """The documents whose language is not rejected, with their own columns only."""
    names = ["lang_pred", "lang_score", "lang_rejected"]
    kept = without(docs, names).columns
    return predict(docs, model, text).filter(~F.col("lang_rejected")).select(*kept)
