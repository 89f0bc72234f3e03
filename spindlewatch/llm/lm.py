"""Language-model scoring with causal self-attention over subword ids, trained in numpy.

Words are split into the subwords of a public byte-pair vocabulary. The most frequent `KEPT`
subwords of all training documents have ids of their own; others are one escape id, whose
members share its probability by their smoothed counts. So every text has a proper probability.

The model: h = tanh(own embedding + sum over earlier tokens of attention * value), attention being
softmax of query . key plus a bias for the distance, over a window of at most `REACH` tokens that
ends at the token itself. Windows overlap: each gives context to the tokens of its second half
and scores only those, so every token is scored once. The next id is drawn in two steps, its group
and its place in the group, each a softmax over `SIDE`.

Training: the model is warmed up on a bounded sample of windows, drawn from all that cover the
training documents, about `WARM_WINDOWS` in all. Then it is tuned on all training documents, cut into consecutive
windows so that every token is a target, by tasks that start from the same weights; the tuned
weights are averaged by window counts, in Spark.

Word counts, subword counts and the vocabulary cover all training documents. Documents are
tokenised once, in groups of bounded size, into a staged table: a row per group, with its distinct
words and the words of its texts as numbers into them. Only distinct words are shuffled, packed by
hash bucket; a bucket sums a word's counts over all groups and returns them to each of these.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from spindlewatch.llm.common import split_words
from spindlewatch.llm.tokens import encoder
from spindlewatch.session import stage

SIDE = 64
KEPT = SIDE * SIDE - 2  # and two more ids: the end of a document, and the escape
END_ID, ESCAPE = 0, 1
DIM = 16
HALF = 16
REACH = 2 * HALF
GROUP_BYTES = 6 << 20
BLOCK_WINDOWS = 1 << 15
WARM_WINDOWS = 20_000
WARM_BATCH, BATCH = 64, 256  # windows a step
PARTS = ("own", "query", "key", "value", "bias", "group", "group0", "member", "member0")


@dataclass
class Vocabulary:
    """path and pattern of the subword vocabulary, ids of kept subwords, cost of the others."""

    path: str
    pattern: str
    ids: np.ndarray  # of every subword of the file
    rare: np.ndarray  # log probability among the escaped; 0 for kept ones
    uses: np.ndarray | None = None  # how often training texts hold each id

    def pieces(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Subwords of all words in a row, and how many each has; b"" stands for the end."""
        code = encoder(self.path, self.pattern)
        lists = [code._encode_single_piece(b" " + w) if w else [-1] for w in words]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((x for piece in lists for x in piece), np.int64, int(counts.sum())), counts

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, their extra log cost, and the count per word."""
        flat, counts = self.pieces(words)
        end = flat < 0
        flat = np.where(end, 0, flat)
        return (np.where(end, END_ID, self.ids[flat]).astype(np.int16),
                np.where(end, 0, self.rare[flat]).astype(np.float32), counts)


def fresh(rng: np.random.Generator, uses: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Weights to begin with; with counted uses of the ids, those of the unigram model in all states."""
    n = SIDE * SIDE
    shapes = {"own": (n, DIM), "query": (n, DIM), "key": (n, DIM), "value": (n, DIM), "bias": (REACH,),
              "group": (DIM, SIDE), "group0": (SIDE,), "member": (SIDE, DIM, SIDE), "member0": (SIDE, SIDE)}
    model = {k: (rng.normal(0, 0.3, s) if k in ("own", "query", "key", "value")
                 else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
    if uses is not None:
        share = (uses + 0.5).reshape(SIDE, SIDE)
        model["group0"] = np.log(share.sum(axis=1) / share.sum()).astype(np.float32)
        model["member0"] = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)
    return model


def _attend(model: dict, ids: np.ndarray, first: int):
    """Hidden states at places first.. of each window (a row of ids; negative: no token)."""
    real = ids >= 0
    safe = np.where(real, ids, 0)
    q = model["query"][safe[:, first:]]
    k, v = model["key"][safe], model["value"][safe]
    width, n = ids.shape[1], ids.shape[1] - first
    back = np.arange(first, width)[:, None] - np.arange(width)[None, :]
    score = np.matmul(q, k.transpose(0, 2, 1)) * np.float32(DIM ** -0.5)
    score += np.where(back >= 0, model["bias"][np.clip(back, 0, REACH - 1)], np.float32(-1e9))
    score += np.where(real, np.float32(0), np.float32(-1e9))[:, None, :]
    score -= score.max(axis=2, keepdims=True)
    np.exp(score, out=score)
    score /= score.sum(axis=2, keepdims=True)
    hidden = np.tanh(np.matmul(score, v) + model["own"][safe[:, first:]])
    return hidden, (safe, q, k, v, score, back, n)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


class Scorer:
    """The trained weights, laid out for scoring."""

    def __init__(self, model: dict):
        self.model = model
        n = SIDE * SIDE
        # One more row for places without a token: no key, no weight.
        pad = lambda x: np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
        self.query = pad(model["query"] * np.float32(DIM ** -0.5))
        self.key, self.own = pad(model["key"]), pad(model["own"])
        self.value = pad(np.column_stack([model["value"], np.ones((n, 1), np.float32)]))
        back = np.arange(HALF, REACH)[:, None] - np.arange(REACH)[None, :]
        self.near = np.where(back >= 0, np.exp(model["bias"][np.clip(back, 0, REACH - 1)]), 0).astype(np.float32)
        self.one = np.ones(SIDE, np.float32)
        # States lie in -1 .. 1: the largest logit that the weights allow.
        reach = max(np.abs(model[k]).sum(axis=-2).max() + np.abs(model[k + "0"]).max() for k in ("group", "member"))
        self.cut = bool(reach > 80)

    def hidden(self, ids: np.ndarray) -> np.ndarray:
        """States at the second half of each window; `SIDE * SIDE` stands for no token."""
        mine = ids[:, HALF:]
        weight = np.matmul(np.take(self.query, mine, 0), np.take(self.key, ids, 0).transpose(0, 2, 1))
        np.exp(np.minimum(weight, np.float32(60), out=weight), out=weight)
        weight *= self.near
        both = np.matmul(weight, np.take(self.value, ids, 0))
        return np.tanh(both[:, :, :DIM] / np.maximum(both[:, :, DIM:], np.float32(1e-30))
                       + np.take(self.own, mine, 0))

    def log_probs(self, hidden: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log p(target | hidden), row by row; hidden and target in the same order."""
        model = self.model
        group, place = target // SIDE, target % SIDE
        z = hidden @ model["group"] + model["group0"]
        if self.cut:
            np.clip(z, -80, 80, out=z)
        out = z[np.arange(len(target)), group]
        out -= np.log(np.exp(z, out=z) @ self.one)
        order = np.argsort(group, kind="stable")
        edges = np.searchsorted(group[order], np.arange(SIDE + 1))
        rows, places = np.take(hidden, order, 0), place[order]
        inner = np.empty(len(target), np.float32)
        for g in range(SIDE):
            a, b = edges[g], edges[g + 1]
            if b > a:
                z = rows[a:b] @ model["member"][g] + model["member0"][g]
                if self.cut:
                    np.clip(z, -80, 80, out=z)
                chosen = z[np.arange(b - a), places[a:b]]
                inner[a:b] = chosen - np.log(np.exp(z, out=z) @ self.one)
        out[order] += inner
        return out


def gradient(model: dict, ids: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean loss of windows (rows of REACH + 1 ids; negative: no token)."""
    inputs, target = ids[:, :-1], ids[:, 1:].ravel()
    hidden3, (safe, q, k, v, a, back, _) = _attend(model, inputs, 0)
    hidden = hidden3.reshape(-1, DIM)
    live = np.flatnonzero(target >= 0)
    live = live[np.argsort(target[live] // SIDE, kind="stable")]
    g = {name: np.zeros_like(x) for name, x in model.items()}
    d_hidden = np.zeros_like(hidden)
    group, place, rows = target[live] // SIDE, target[live] % SIDE, np.arange(len(live))
    scale = np.float32(1 / max(len(live), 1))
    h = hidden[live]
    d = _softmax(h @ model["group"] + model["group0"])
    d[rows, group] -= 1
    d *= scale
    g["group"], g["group0"] = h.T @ d, d.sum(0)
    d_h = d @ model["group"].T
    edges = np.searchsorted(group, np.arange(SIDE + 1))
    parts = [(one, slice(edges[one], edges[one + 1])) for one in range(SIDE) if edges[one] < edges[one + 1]]
    z = model["member0"][group]
    for one, at in parts:
        z[at] += h[at] @ model["member"][one]
    d = _softmax(z)
    d[rows, place] -= 1
    d *= scale
    for one, at in parts:
        g["member"][one], g["member0"][one] = h[at].T @ d[at], d[at].sum(0)
        d_h[at] += d[at] @ model["member"][one].T
    d_hidden[live] = d_h
    d_pre = (d_hidden * (1 - hidden ** 2)).reshape(hidden3.shape)
    d_a = np.matmul(d_pre, v.transpose(0, 2, 1))
    d_v = np.matmul(a.transpose(0, 2, 1), d_pre)
    d_score = a * (d_a - (d_a * a).sum(axis=2, keepdims=True))
    per_back = d_score.sum(axis=0)
    causal = back >= 0
    g["bias"] = np.bincount(back[causal], per_back[causal], REACH).astype(np.float32)
    d_score *= np.float32(DIM ** -0.5)
    # Gradients of the same id are summed, for all four tables at once.
    names = ("own", "value", "query", "key")
    rows = np.concatenate([d_pre, d_v, np.matmul(d_score, k), np.matmul(d_score.transpose(0, 2, 1), q)], axis=2)
    order = np.argsort(safe.ravel(), kind="stable")
    flat = safe.ravel()[order]
    first = np.flatnonzero(np.diff(flat, prepend=-1))
    sums = np.add.reduceat(rows.reshape(-1, len(names) * DIM)[order], first, axis=0)
    for i, name in enumerate(names):
        g[name][flat[first]] = sums[:, i * DIM:(i + 1) * DIM]
    return g


def train(model: dict, windows: np.ndarray, steps: int | None, rate: float, seed: int, batch: int = BATCH) -> dict:
    """Adam on random batches of windows, the rate falling to a tenth. Without steps, once over all windows."""
    rng = np.random.default_rng(seed)
    order = None
    if steps is None:
        order, steps = rng.permutation(len(windows)), -(-len(windows) // batch)
    model = {k: x.copy() for k, x in model.items()}
    mean = {k: np.zeros_like(x) for k, x in model.items()}
    square = {k: np.zeros_like(x) for k, x in model.items()}
    for t in range(1, steps + 1):
        drawn = rng.integers(0, len(windows), min(batch, len(windows))) if order is None else order[(t - 1) * batch:t * batch]
        g = gradient(model, windows[drawn])
        now = rate * (1 - 0.9 * t / steps)
        for k in PARTS:
            mean[k] += 0.1 * (g[k] - mean[k])
            square[k] += 0.01 * (g[k] ** 2 - square[k])
            model[k] -= (now * (mean[k] / (1 - 0.9 ** t))
                         / (np.sqrt(square[k] / (1 - 0.99 ** t)) + 1e-6)).astype(np.float32)
    return model


def score_ids(scorer: Scorer, ids: np.ndarray, fresh_start: np.ndarray) -> np.ndarray:
    """log p of every id given those before it in its text; fresh_start marks the first of a text.

    The first token of a text follows the end id. Windows of REACH tokens advance by HALF.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.float32)
    # Inputs: the end id before every text, then the text but for its last token.
    before = np.where(fresh_start, END_ID, np.concatenate([[END_ID], ids[:-1]]))
    starts = np.flatnonzero(fresh_start)
    sizes = np.diff(np.append(starts, n))
    # Every text in whole halves, led by one half without a token.
    halves = -(-sizes // HALF)
    rooms = (halves + 1) * HALF
    first = np.cumsum(rooms) - rooms
    place = np.arange(n) + np.repeat(first + HALF - starts, sizes)
    padded = np.full(int(rooms.sum()), SIDE * SIDE, np.int16)
    padded[place] = before
    target = np.zeros(len(padded), np.int16)
    target[place] = ids
    blocks = padded.reshape(-1, HALF)
    lead = np.zeros(len(blocks), bool)
    lead[first // HALF] = True
    at = np.flatnonzero(~lead)
    out = np.empty((len(blocks), HALF), np.float32)
    goal = target.reshape(-1, HALF)
    for i in range(0, len(at), 512):
        part = at[i:i + 512]
        hidden = scorer.hidden(np.concatenate([blocks[part - 1], blocks[part]], axis=1))
        out[part] = scorer.log_probs(hidden.reshape(-1, DIM), goal[part].ravel()).reshape(-1, HALF)
    return out.ravel()[place]


GROUPS = ("chunk long, doc_ids array<long>, trains array<boolean>, sizes array<long>, ids binary, "
          "words binary, counts binary, ends long")
MERGED = "chunk long, bucket int, found binary, total long, known long, pieces array<int>, uses array<long>"


def _pack(words: list[bytes]) -> bytes:
    return b"\n".join(words)  # a word holds no white space


def _unpack(packed: bytes) -> list[bytes]:
    return packed.split(b"\n") if packed else []


def tokenise(docs: DataFrame, learns: Column, doc_id: str, text: str, buckets: int) -> DataFrame:
    """The staged table of groups: numbers of the texts' words, ends included, and distinct words.

    Number 0 is the end of a text, number i the i-th distinct word; these are in order of their
    hash bucket. `counts` is how often the group's training texts hold each distinct word, `ends`
    how many training texts there are. A group has GROUP_BYTES of text, or one longer text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(2)), 0)
            edges = np.cumsum(lengths.to_numpy(zero_copy_only=False)) // GROUP_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(edges)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    yield _group(chunk, batch.slice(a, b - a), buckets)
                    chunk += 1

    held = docs.select(F.col(doc_id).cast("long").alias("d"), F.coalesce(learns, F.lit(False)).alias("l"),
                       F.col(text).alias("t"))
    return stage(held.mapInArrow(run, GROUPS), "word-groups")


def _buckets(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.int64, len(words)) % buckets


def _group(chunk: int, batch: pa.RecordBatch, buckets: int) -> pa.RecordBatch:
    words, sizes = split_words(batch.column(2).to_pylist())
    coded = words.dictionary_encode()
    names = coded.dictionary.to_pylist()
    order = np.argsort(_buckets(names, buckets), kind="stable")
    number = np.empty(len(names), np.int32)
    number[order] = np.arange(len(names), dtype=np.int32)
    flat = np.zeros(int(sizes.sum()) + len(sizes), np.int32)
    inside = np.ones(len(flat), bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    flat[inside] = number[coded.indices.to_numpy()] + 1
    learns = np.array(batch.column(1).to_pylist(), bool)
    counts = np.bincount(flat[np.repeat(learns, sizes + 1)], minlength=len(names) + 1)[1:]
    one = lambda x, kind: pa.array([x], kind)
    return pa.RecordBatch.from_arrays(
        [one(chunk, pa.int64()), pa.ListArray.from_arrays([0, len(sizes)], batch.column(0)),
         one(learns.tolist(), pa.list_(pa.bool_())), one((sizes + 1).tolist(), pa.list_(pa.int64())),
         one(flat.tobytes(), pa.binary()), one(_pack([names[i] for i in order]), pa.binary()),
         one(counts.astype(np.int32).tobytes(), pa.binary()), one(int(learns.sum()), pa.int64())],
        names=["chunk", "doc_ids", "trains", "sizes", "ids", "words", "counts", "ends"])


def merge_counts(groups: DataFrame, path: str, pattern: str, buckets: int) -> DataFrame:
    """The staged counts of all training words, bucket by bucket.

    For each group and bucket `found`, the counts of the group's distinct words; for each bucket,
    in a row without a chunk, the tokens and distinct words it counts, and their subwords' uses.
    """
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in range(batch.num_rows):
                words = _unpack(batch.column("words")[g].as_py())
                counts = np.frombuffer(batch.column("counts")[g].as_py(), np.int32)
                edges = np.searchsorted(_buckets(words, buckets), np.arange(buckets + 1))
                some = np.flatnonzero(np.diff(edges))
                parts = [slice(edges[k], edges[k + 1]) for k in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), batch.column("chunk")[g].as_py(), np.int64)), pa.array(some.astype(np.int32)),
                     pa.array([_pack(words[k]) for k in parts], pa.binary()),
                     pa.array([counts[k].tobytes() for k in parts], pa.binary())],
                    names=["chunk", "bucket", "words", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        lists = [_unpack(w) for w in table.column("words").to_pylist()]
        coded = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
        numbers = coded.indices.to_numpy()
        own = np.concatenate([np.frombuffer(c, np.int32) for c in table.column("counts").to_pylist()])
        total = np.bincount(numbers, own, len(coded.dictionary)).astype(np.int64)
        found, at = [], 0
        for x in lists:
            found.append(total[numbers[at:at + len(x)]].tobytes())
            at += len(x)
        plain = Vocabulary(path, pattern, np.zeros(0), np.zeros(0))
        seen = np.flatnonzero(total)
        names = coded.dictionary.to_pylist()
        flat, n = plain.pieces([names[i] for i in seen])
        uses = np.bincount(flat, np.repeat(total[seen], n)) if len(flat) else np.zeros(0)
        some = np.flatnonzero(uses)
        bucket, rows = table.column("bucket")[0].as_py(), len(lists)
        return pa.table({
            "chunk": pa.array([*table.column("chunk").to_pylist(), None], pa.int64()),
            "bucket": pa.array([bucket] * (rows + 1), pa.int32()), "found": pa.array([*found, None], pa.binary()),
            "total": pa.array([None] * rows + [int(total.sum())], pa.int64()),
            "known": pa.array([None] * rows + [len(seen)], pa.int64()),
            "pieces": pa.array([None] * rows + [some.tolist()], pa.list_(pa.int32())),
            "uses": pa.array([None] * rows + [uses[some].astype(np.int64).tolist()], pa.list_(pa.int64()))})

    packed = groups.select("chunk", "words", "counts").mapInArrow(
        split, "chunk long, bucket int, words binary, counts binary")
    return stage(packed.groupBy("bucket").applyInArrow(merge, MERGED), "word-counts")


def fit_vocabulary(merged: DataFrame, path: str, pattern: str, ends: int = 0) -> Vocabulary:
    """From the uses of all subwords. The driver gets one number per subword of the file."""
    size = encoder(path, pattern).n_vocab
    total = np.zeros(size)
    uses = (merged.filter("chunk is null").select(F.explode(F.arrays_zip("pieces", "uses")).alias("x"))
            .groupBy(F.col("x.pieces").alias("piece")).agg(F.sum("x.uses").alias("c")))
    for row in uses.toLocalIterator():
        total[row["piece"]] = row["c"]
    kept = np.lexsort((np.arange(size), -total))[:KEPT]
    kept = kept[total[kept] > 0]
    ids = np.full(size, ESCAPE, np.int16)
    ids[kept] = np.arange(len(kept)) + 2
    others = np.where(ids == ESCAPE, total + 1, 0)
    rare = np.where(others > 0, np.log(np.maximum(others, 1) / max(others.sum(), 1)), 0).astype(np.float32)
    held = np.zeros(SIDE * SIDE)
    held[END_ID], held[ESCAPE] = ends, total[ids == ESCAPE].sum()
    held[np.arange(len(kept)) + 2] = total[kept]
    return Vocabulary(path, pattern, ids, rare, held)


def _spread(ids: np.ndarray, counts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of `ids` of a row of words, and the number of entries of each."""
    first = np.cumsum(counts) - counts
    n = counts[words]
    at = np.repeat(first[words] - np.cumsum(n) + n, n) + np.arange(n.sum())
    return ids[at], n


def _subwords(batch: pa.RecordBatch, g: int, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts of a group in a row, how many each text has, and whether it is for training."""
    words = np.frombuffer(batch.column("ids")[g].as_py(), np.int32)
    ids, _, counts = vocabulary.encode([b"", *_unpack(batch.column("words")[g].as_py())])
    ids, n = _spread(ids, counts, words)
    sizes = np.array(batch.column("sizes")[g].as_py(), np.int64)
    tokens = np.add.reduceat(n, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0, np.int64)
    return ids, tokens, np.array(batch.column("trains")[g].as_py(), bool)


def consecutive(ids: np.ndarray, tokens: np.ndarray, trains: np.ndarray,
                most: int = BLOCK_WINDOWS) -> Iterator[np.ndarray]:
    """Rows of REACH + 1 ids in blocks of `most`; each token of a training text is a target once.

    A row leads with the id before its targets, the end id at the start of a text; negative: no token.
    """
    first = (np.cumsum(tokens) - tokens)[trains]
    size = tokens[trains]
    count = -(-size // REACH)
    done = np.cumsum(count)
    for at in range(0, int(count.sum()), most):
        row = np.arange(at, min(at + most, done[-1]))
        text = np.searchsorted(done, row, side="right")
        start = first[text] + (row - done[text] + count[text]) * REACH
        place = start[:, None] + np.arange(-1, REACH)
        out = np.where(place < (first + size)[text][:, None], ids[np.clip(place, 0, len(ids) - 1)], np.int16(-1))
        out[start == first[text], 0] = END_ID
        yield out


def windows_of(groups: DataFrame, vocabulary: Vocabulary, rate: float) -> DataFrame:
    """(chunk, place, window) for the warm-up: the share `rate` of the windows that cover the training texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in range(batch.num_rows):
                chunk, at = batch.column("chunk")[g].as_py(), 0
                for block in consecutive(*_subwords(batch, g, vocabulary)):
                    # Drawn by place, so that equal data give equal draws.
                    drawn = np.flatnonzero(np.random.default_rng([3, chunk, at]).random(len(block)) < rate)
                    rows = pa.ListArray.from_arrays(np.arange(len(drawn) + 1, dtype=np.int32) * (REACH + 1),
                                                    pa.array(block[drawn].ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(drawn), chunk)), pa.array(drawn + at), rows],
                                                     names=["chunk", "place", "window"])
                    at += len(block)

    return groups.select("chunk", "trains", "sizes", "ids", "words").mapInArrow(
        run, "chunk long, place long, window array<smallint>")


def _stacked(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("window").flatten().to_numpy().reshape(-1, REACH + 1).astype(np.int64)


def fit(groups: DataFrame, vocabulary: Vocabulary, warm: int = WARM_WINDOWS, steps: int = 1500,
        epochs: int = 8) -> dict:
    """Warm up on about `warm` windows, then tune on all tokens of the training texts and average.

    The warm-up takes `steps` batches, and no more than `epochs` passes: few windows would be
    learned by heart.
    """
    spark = groups.sparkSession
    total = 1.0 if vocabulary.uses is None else max(1.0, vocabulary.uses.sum() / REACH)
    drawn = windows_of(groups, vocabulary, min(1.0, warm / total)).orderBy("chunk", "place").toArrow()
    model = fresh(np.random.default_rng(11), vocabulary.uses)
    rows = [_stacked(b) for b in drawn.to_batches() if b.num_rows]
    if not rows:
        return model
    data = np.concatenate(rows)
    model = train(model, data, min(steps, max(1, epochs * len(data) // WARM_BATCH)), 0.03, 1, WARM_BATCH)

    def tune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = model, 0
        for batch in batches:
            for g in range(batch.num_rows):
                for block in consecutive(*_subwords(batch, g, vocabulary)):
                    own = train(own, block.astype(np.int64), None, 0.004, 2)
                    seen += len(block)
        if seen:
            flat = np.concatenate([own[k].ravel() for k in PARTS]).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat))), pa.array(flat * seen), pa.array(np.full(len(flat), seen))],
                names=["at", "x", "n"])

    # A bounded number of tasks, since each returns all weights.
    held = (groups.select("chunk", "trains", "sizes", "ids", "words")
            .coalesce(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    merged = (held.mapInArrow(tune, "at long, x double, n long").groupBy("at")
              .agg((F.sum("x") / F.sum("n")).alias("x")).toArrow())
    flat = np.zeros(sum(x.size for x in model.values()))
    flat[merged.column("at").to_numpy()] = merged.column("x").to_numpy()
    out, at = {}, 0
    for k in PARTS:
        out[k] = flat[at:at + model[k].size].reshape(model[k].shape).astype(np.float32)
        at += model[k].size
    return out


def _scorer(model: dict, vocabulary: Vocabulary, ends: int, total: int, distinct: int):
    floor = total + distinct + 1
    scorer = Scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in range(batch.num_rows):
                words = np.frombuffer(batch.column("ids")[g].as_py(), np.int32)
                names = [b"", *_unpack(batch.column("words")[g].as_py())]
                found = b"".join(x["found"] for x in batch.column("merged")[g].as_py() or ())
                c = np.concatenate([[ends], np.frombuffer(found, np.int64)])
                sizes = np.array(batch.column("sizes")[g].as_py())
                first = np.cumsum(sizes) - sizes
                ids, extra, counts = vocabulary.encode(names)
                flat, n = _spread(np.arange(len(ids)), counts, words)
                tokens = np.add.reduceat(n, first)
                start = np.zeros(len(flat), bool)
                start[np.cumsum(tokens) - tokens] = True
                log = score_ids(scorer, ids[flat], start) + extra[flat]
                score = np.add.reduceat(log.astype(np.float64), np.cumsum(tokens) - tokens) / np.log(10)
                base = np.log10((c + 1) / floor)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[g].values, pa.array(sizes),
                     pa.array(np.add.reduceat((c > 0)[words].astype(np.int64), first)),
                     pa.array(np.full(len(sizes), total)),
                     pa.array(np.add.reduceat(base[words], first)), pa.array(score)],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def with_counts(groups: DataFrame, merged: DataFrame) -> DataFrame:
    """Every group with the counts of its distinct words, in about as many partitions as there are groups.

    A group is megabytes, and all rows of a partition may come to Python at once.
    """
    parts = max(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups.count())
    # A group's distinct words are bounded, so is what returns to it.
    found = (merged.filter("chunk is not null").repartition(parts, "chunk").groupBy("chunk")
             .agg(F.sort_array(F.collect_list(F.struct("bucket", "found"))).alias("merged")))
    return groups.select("chunk", "doc_ids", "sizes", "ids", "words").repartition(parts, "chunk").join(found, "chunk", "left")


def score_documents(docs: DataFrame, learns: Column, vocabulary: str, pattern: str, doc_id: str = "doc_id",
                    text: str = "text", **options) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row.

    learns is the condition for training rows. Tokens are words, A-Z lowered, and one end per text;
    null and blank texts are an end alone. base_score is the add-one unigram model, score the
    attention model's log10 probability of the whole text, end included. Repeated rows are scored
    alike and each counts in training; null ids are kept. Without training rows the model is the
    untrained one and no token is known.
    """
    # Some buckets for each task of a shuffle: a bucket holds a share of all distinct words.
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = tokenise(docs, learns, doc_id, text, buckets)
    merged = merge_counts(groups, vocabulary, pattern, buckets)
    ends = groups.agg(F.coalesce(F.sum("ends"), F.lit(0))).first()[0]
    sums = merged.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    known = fit_vocabulary(merged, vocabulary, pattern, ends)
    model = fit(groups, known, **options)
    return with_counts(groups, merged).mapInArrow(_scorer(model, known, ends, sums[0] + ends, sums[1] + (ends > 0)),
                           "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
