"""Toxicity: a convolutional text classifier with thresholds by language.

A term is the sum of a few rows of an embedding, found by hashing the term and its first bytes, so
that inflections of one stem are alike. Filters of several widths slide over a text's terms, each
filter's largest answer in the whole text is kept, and a linear layer on these gives a logit. All
weights are trained together in numpy, by Adagrad on small batches. A held-back part of the sample
sets a temperature and the logit above which a text counts as toxic, for each language that the
text itself shows (by the language classifier of this package); rare languages keep the common one.

The training sample is bounded by `per_label` expected rows of each label; everything else sees whole
texts of all rows. A filter's answers are computed once for each distinct term of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField

from spindlewatch.llm import langid
from spindlewatch.llm.common import append, split_terms, text_groups, word_hashes

BITS = 18
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
GAP = max(WIDTHS) + 1  # empty places after each text: no filter that starts in a text, or in the first of them, sees another
PER_LABEL = 2000
LEAST_CALIBRATED = 20  # held-back texts of either label that a language needs for a threshold of its own
PREFIXES = (4, 6)  # bytes of a longer term that have rows of their own
PIECES = 1 + len(PREFIXES)
EPOCHS = 6
LEAST_STEPS = 1500  # a small sample is gone through more often
BATCH = 16


def term_rows(terms: pa.Array) -> np.ndarray:
    """Embedding rows of every term, PIECES each; -1 where a term has no such piece."""
    coded = terms.dictionary_encode()
    names = coded.dictionary.to_pylist()
    parts = [word_hashes(coded.dictionary)]
    for size in PREFIXES:
        parts.append(word_hashes(pa.array([b"%d:" % size + t[:size] for t in names], pa.binary())))
    rows = (np.stack(parts, axis=1) >> np.uint64(64 - BITS)).astype(np.int32).reshape(-1, PIECES)
    for i, size in enumerate(PREFIXES):
        rows[[len(t) <= size for t in names], i + 1] = -1
    return rows[coded.indices.to_numpy()] if len(coded) else np.zeros((0, PIECES), np.int32)


def laid_out(items: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items of all texts one after another, GAP empty places (-1) after each, and where each begins."""
    first = np.concatenate([[0], np.cumsum(counts + GAP)])
    out = np.full((int(first[-1]), *items.shape[1:]), -1, np.int64)
    out[np.arange(len(items)) + np.repeat(first[:-1] - np.cumsum(counts) + counts, counts)] = items
    return out, first


def ends_of(first: np.ndarray) -> np.ndarray:
    """Where each text ends; one without terms is one empty place."""
    return np.maximum(first[1:] - GAP, first[:-1] + 1)


def embedded(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of the embedding rows of each place."""
    return (table[rows] * (rows >= 0)[:, :, None]).sum(axis=1)


@dataclass
class ToxicModel:
    """Weights of the network; temperature, and the logit that parts the labels by language."""

    embed: np.ndarray = field(repr=False)
    kernels: list[np.ndarray] = field(repr=False)  # of each width: (width, DIM, FILTERS)
    bias: np.ndarray = field(repr=False)
    out: np.ndarray = field(repr=False)
    offset: float = 0.0
    temperature: float = 1.0
    cut: float = 0.0
    cuts: dict[str, float] = field(default_factory=dict)
    languages: langid.LangModel | None = field(default=None, repr=False)
    trained: bool = False

    def logits(self, terms: pa.Array, counts: np.ndarray) -> np.ndarray:
        """A logit for each text, given the terms of all of them and how many each has."""
        if not len(counts):
            return np.zeros(0)
        coded = terms.dictionary_encode()
        # The answers of every filter place to every distinct term; the last row is an empty place.
        x = np.concatenate([embedded(self.embed, term_rows(coded.dictionary)), np.zeros((1, DIM), np.float32)])
        places, first = laid_out(coded.indices.to_numpy(), counts)
        return self.answer([[x @ part for part in kernel] for kernel in self.kernels],
                           np.where(places < 0, len(x) - 1, places), first)

    def answer(self, tables: list[list[np.ndarray]], places: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A logit for each text from the filters' answers, of which each place names a row."""
        n, best = len(places) - max(WIDTHS) + 1, []
        spans = np.stack([first[:-1], ends_of(first)], axis=1).ravel()
        for kernel in tables:
            answers = sum(part[places[i:i + n]] for i, part in enumerate(kernel))
            best.append(np.maximum.reduceat(answers, spans, axis=0)[::2])
        hidden = np.maximum(np.concatenate(best, axis=1) + self.bias, 0)
        return hidden @ self.out + self.offset

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """From 0 to 1; 0.5 at the threshold of the text's language."""
        if not self.trained:
            return np.zeros(len(texts))
        logit = self.logits(*split_terms(texts)).astype(float)
        cut = np.full(len(texts), self.cut)
        if self.cuts:
            p = self.languages.scores(texts)
            for i, name in enumerate(self.languages.labels):
                if name in self.cuts:
                    cut[(p.argmax(axis=1) == i) & (p.max(axis=1) > 0)] = self.cuts[name]
        return 1 / (1 + np.exp(np.clip((cut - logit) / self.temperature, -500, 500)))


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.05,
          seed: int = 5) -> ToxicModel:
    """Fit the network to texts (their embedding rows) by Adagrad; both labels weigh the same."""
    rng = np.random.default_rng(seed)
    model = ToxicModel(rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32),
                       [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
                       np.zeros(len(WIDTHS) * FILTERS, np.float32),
                       rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), trained=True)
    weight = np.array([0.5 / max((labels == y).mean(), 1e-9) for y in (0, 1)])[labels]
    seen = {"embed": np.full(1 << BITS, 1e-6, np.float32), "bias": np.full_like(model.bias, 1e-6),
            "out": np.full_like(model.out, 1e-6), "offset": 1e-6}
    kernels_seen = [np.full_like(k, 1e-6) for k in model.kernels]
    epochs = max(epochs, -(-LEAST_STEPS * BATCH // len(texts)))
    for epoch in range(epochs):
        now = np.float32(rate * (1 - epoch / epochs))
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            chosen = order[at:at + BATCH]
            counts = np.array([len(texts[i]) for i in chosen])
            rows, first = laid_out(np.concatenate([texts[i] for i in chosen]), counts)
            x = embedded(model.embed, rows)
            n, answers, places = len(rows) - max(WIDTHS) + 1, [], []
            for kernel in model.kernels:
                z = sum(x[i:i + n] @ part for i, part in enumerate(kernel))
                # For each text and filter the place of its largest answer.
                place = np.array([a + z[a:b].argmax(axis=0) for a, b in zip(first[:-1], ends_of(first))])
                places.append(place)
                answers.append(np.take_along_axis(z, place, 0))
            pre = np.concatenate(answers, axis=1) + model.bias
            hidden = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.offset, -30, 30)))
            d = ((p - labels[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            d_pre = d[:, None] * model.out[None, :] * (pre > 0)
            grads = {"bias": d_pre.sum(axis=0), "out": hidden.T @ d, "offset": float(d.sum())}
            touched, changes = [], []
            for k, (kernel, place) in enumerate(zip(model.kernels, places)):
                d_k = d_pre[:, k * FILTERS:(k + 1) * FILTERS]
                grad = np.zeros_like(kernel)
                for i in range(len(kernel)):
                    grad[i] = np.einsum("tfd,tf->df", x[place + i], d_k)
                    touched.append(rows[place + i].reshape(-1, PIECES))
                    changes.append((d_k[:, :, None] * kernel[i].T[None]).reshape(-1, DIM))
                kernels_seen[k] += grad ** 2
                kernel -= now * grad / np.sqrt(kernels_seen[k])
            for name, grad in grads.items():
                seen[name] += grad ** 2
                step = now * grad / np.sqrt(seen[name])
                setattr(model, name, getattr(model, name) - step)
            at_rows = np.concatenate(touched).ravel()
            change = np.repeat(np.concatenate(changes), PIECES, axis=0)[at_rows >= 0]
            at_rows = at_rows[at_rows >= 0]
            if len(at_rows):
                own, place = np.unique(at_rows, return_inverse=True)
                total = np.zeros((len(own), DIM), np.float32)
                np.add.at(total, place, change)
                seen["embed"][own] += (total ** 2).mean(axis=1)
                model.embed[own] -= now * total / np.sqrt(seen["embed"][own])[:, None]
    # Terms that the sample does not hold say nothing: they answer like an empty place.
    held = np.zeros(1 << BITS, bool)
    for rows in texts:
        held[rows[rows >= 0]] = True
    model.embed[~held] = 0
    return model


def threshold(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The cut with the least weight of errors, in the middle of the gap where it lies."""
    order = np.argsort(logits, kind="stable")
    z, y, w = logits[order], labels[order], weights[order]
    # Errors when everything from place i on counts as toxic.
    below = np.concatenate([[0], np.cumsum(w * (y == 1))])
    above = np.concatenate([np.cumsum((w * (y == 0))[::-1])[::-1], [0]])
    edges = np.concatenate([[z[0] - 2], (z[1:] + z[:-1]) / 2, [z[-1] + 2]])
    real = np.concatenate([[True], z[1:] > z[:-1], [True]])
    errors = np.where(real, below + above, np.inf)
    best = np.flatnonzero(errors <= errors.min() + 1e-9)
    return float(edges[best[len(best) // 2]])


def _sample(docs: DataFrame, labels: DataFrame, train: Column, doc_id: str, text: str, label: str,
            per_label: int) -> tuple[DataFrame, dict[int, int]]:
    """Rows (y, text) of labelled documents, and how many labelled ids there are of each label.

    Ids whose labels differ count as toxic. About 2 * per_label ids are drawn, and only these are broadcast.
    """
    usable = (labels.select(F.col(doc_id).cast("long").alias("d"), F.col(label).cast("int").alias("y"))
              .filter(F.col("y").isin(0, 1) & F.col("d").isNotNull()).groupBy("d").agg(F.max("y").alias("y")))
    usable = usable.withColumnRenamed("d", doc_id).filter(train).withColumnRenamed(doc_id, "d")
    counts = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}  # a row per label
    rate = F.create_map(*[F.lit(x) for y in (0, 1) for x in (y, min(1.0, per_label / max(counts.get(y, 0), 1)))])
    uniform = F.pmod(F.xxhash64("d", F.lit("toxic")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = usable.filter(uniform < rate[F.col("y")])
    return docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).join(
        F.broadcast(drawn), "d").select("y", "t"), counts


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, doc_id: str = "doc_id", text: str = "text",
        label: str = "toxic", lang: str | None = "lang", per_label: int = PER_LABEL, epochs: int = EPOCHS) -> ToxicModel:
    """Train on the labelled documents where `train_rows`, a condition on `doc_id`, holds.

    per_label   expected documents sampled of each label: the bound of the training sample
    lang        column that the language classifier learns from, on training rows; None for one common threshold
    Without documents of both labels the model is untrained, and its scores are 0.
    """
    languages = langid.fit(docs, train_rows, text, lang) if lang else None
    drawn, counts = _sample(docs, labels, train_rows, doc_id, text, label, per_label)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_groups(batch, 1):
                texts = part.column(1).to_pylist()
                terms, n = split_terms(texts)
                rows, edges = term_rows(terms), np.concatenate([[0], np.cumsum(n)])
                names = [None] * len(texts)
                if languages is not None and languages.labels:
                    p = languages.scores(texts)
                    names = [languages.labels[i] if s > 0 else None for i, s in zip(p.argmax(axis=1), p.max(axis=1))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()),
                     pa.array([rows[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())],
                    names=["y", "lang", "rows"])

    found = drawn.mapInArrow(features, "y int, lang string, rows binary").toArrow()
    # The order of arrival must not matter.
    rows = sorted(zip(*(found.column(c).to_pylist() for c in ("rows", "y", "lang"))), key=lambda r: (r[0], r[1], r[2] or ""))
    rng = np.random.default_rng(13)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    y = np.array([r[1] for r in rows], np.int64)
    if len(np.unique(y)) < 2:
        return ToxicModel(np.zeros((1 << BITS, DIM), np.float32), [], np.zeros(0), np.zeros(0))
    texts = [np.frombuffer(r[0], np.int32).reshape(-1, PIECES) for r in rows]
    held = len(rows) // 4 if len(rows) >= 40 else 0
    learn = slice(held, None)
    model = train(texts[learn], y[learn], epochs) if len(np.unique(y[learn])) == 2 else train(texts, y, epochs)
    check = slice(0, held) if held and len(np.unique(y[:held])) == 2 else slice(0, None)
    checked = texts[check]
    logits = np.concatenate([_raw(model, checked[i:i + 64]) for i in range(0, len(checked), 64)])
    truth, seen = y[check], np.array([r[2] or "" for r in rows[check]])
    # Labels weigh as often as they are, not as often as they were drawn.
    weights = np.array([counts.get(k, 1) / max((y == k).sum(), 1) for k in (0, 1)])[truth]
    model.cut = threshold(logits, truth, weights)
    for name in np.unique(seen):
        at = seen == name
        if name and min((truth[at] == 0).sum(), (truth[at] == 1).sum()) >= LEAST_CALIBRATED:
            model.cuts[str(name)] = threshold(logits[at], truth[at], weights[at])
    centred = logits - np.array([model.cuts.get(x, model.cut) for x in seen])
    grid = np.geomspace(0.05, 20, 61)
    loss = [(weights * np.logaddexp(0, np.where(truth == 1, -1, 1) * centred / t)).sum() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    model.languages = languages
    return model


def _raw(model: ToxicModel, texts: list[np.ndarray]) -> np.ndarray:
    """Logits of texts that are already embedding rows."""
    rows, first = laid_out(np.concatenate(texts), np.array([len(t) for t in texts]))
    x = embedded(model.embed, rows)
    return model.answer([[x @ part for part in kernel] for kernel in model.kernels], np.arange(len(rows)), first)


def score(docs: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """`docs` with toxic_score, from 0 to 1, where 0.5 is the threshold of the text's language.

    Null texts, empty ones and texts without a term have no filter answer but the empty one's, and all
    the same score. Repeated rows have equal scores. A column named toxic_score is replaced.
    """

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        at, parts = batch.schema.get_field_index(text), []
        for part in text_groups(batch, at):
            parts.append(model.scores(part.column(at).to_pylist()))
        return [pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())]

    return append(docs, [StructField("toxic_score", DoubleType())], make)
