"""Quality classifier: random-indexing word vectors, pooled per document, then a two-layer network with a temperature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import in_fold, labelled_texts
from .scratch import lean, release
from .words import LOWER, mix, split_words, text_slices, word_hashes


@dataclass(frozen=True)
class Quality:
    """fit_rows labelled documents of at most fit_chars characters fit the model; no other limit."""

    fit_rows: int = 2000
    fit_chars: int = 20_000
    folds: int = 5
    held_out: int = 0
    threshold: float = 0.3
    buckets: int = 1 << 16
    dim: int = 32
    reach: int = 2  # words to either side that make a word's context
    hidden: int = 32
    epochs: int = 60
    seed: int = 5


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def word_ids(buf: np.ndarray, offs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its bucket by letters, its bucket by form, and the first word of each text.

    The form is the word's punctuation and digits, its case, a class of its length, and whether it repeats the last word.
    """
    starts, ends, first = split_words(buf, offs)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), first
    low = LOWER[buf]
    letter = _LETTER[buf]
    words = word_hashes(np.where(letter, low, 0).astype(np.uint8), starts, ends)

    def total(x: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(x, out=sums[1:])
        return sums[ends] - sums[starts]

    marks = total(np.where(letter, 0, mix(np.arange(256, dtype=np.uint64))[buf]))
    letters, upper = total(letter.astype(np.uint64)), total(_UPPER[buf].astype(np.uint64))
    case = np.where(upper == 0, 0, np.where((upper == letters) & (letters > 1), 2, np.where((upper == 1) & _UPPER[buf[starts]], 1, 3))).astype(np.uint64)
    same = np.zeros(len(words), np.uint64)
    same[1:] = words[1:] == words[:-1]
    same[first[:-1][first[:-1] < len(words)]] = 0
    size = np.minimum(letters, 15) // np.uint64(4)
    form = mix(marks * np.uint64(64) + case * np.uint64(16) + size * np.uint64(2) + same)
    return (words % np.uint64(buckets)).astype(np.int64), (form % np.uint64(buckets)).astype(np.int64), first


def index_vectors(p: Quality) -> np.ndarray:
    """A sparse vector of a few +1 and -1 for each bucket."""
    rng = np.random.default_rng(p.seed)
    out = np.zeros((p.buckets, p.dim), np.float32)
    rows = np.arange(p.buckets)
    for sign in (1, 1, -1, -1):
        out[rows, rng.integers(0, p.dim, p.buckets)] += sign
    return out


def context_vectors(ids: np.ndarray, first: np.ndarray, index: np.ndarray, reach: int) -> np.ndarray:
    """Random indexing: each bucket's own index vector plus the mean of the index vectors of its neighbours in all places."""
    sums, seen = np.zeros_like(index), np.bincount(ids, minlength=len(index))
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    for step in range(1, reach + 1):
        inside = doc[step:] == doc[:-step]
        left, right = ids[:-step][inside], ids[step:][inside]
        for own, other in ((left, right), (right, left)):
            for i in range(0, len(own), 1 << 16):  # in blocks, to bound memory
                some = own[i : i + (1 << 16)]
                order = np.argsort(some, kind="stable")
                kinds, at = np.unique(some[order], return_index=True)
                sums[kinds] += np.add.reduceat(index[other[i : i + (1 << 16)][order]], at)
    out = index + sums / np.maximum(seen, 1)[:, None]
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)).astype(np.float32)


def _pooled(vectors: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The mean vector of each text; zeros without words."""
    n = np.diff(first)
    out = np.zeros((len(n), vectors.shape[1]), np.float32)
    some = n > 0
    if some.any():
        out[some] = np.add.reduceat(vectors[ids], first[:-1][some]) / n[some, None]
    return out


@dataclass
class Model:
    p: Quality
    letters: np.ndarray
    forms: np.ndarray
    layers: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0

    def features(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        a, b, first = word_ids(buf, offs, self.p.buckets)
        size = np.log1p(np.diff(first)).astype(np.float32)[:, None] / 10
        return np.concatenate([_pooled(self.letters, a, first), _pooled(self.forms, b, first), size], axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.layers
        return np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2

    def scores(self, column: pa.Array) -> np.ndarray:
        parts = [self.logits(self.features(buf, offs)) for _, buf, offs in text_slices(column, 1 << 20)]
        z = np.concatenate([np.zeros(0), *parts]) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _train(model: Model, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
    """Two layers by Adam on weighted log loss."""
    p, rng = model.p, np.random.default_rng(model.p.seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    params = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], p.hidden)), np.zeros(p.hidden), rng.normal(0, p.hidden**-0.5, p.hidden), np.zeros(())]
    first, second = [np.zeros_like(v) for v in params], [np.zeros_like(v) for v in params]
    step, z = 0, (x - mean) / scale
    for _ in range(p.epochs):
        order = rng.permutation(len(z))
        for at in range(0, len(z), 128):
            rows, step = order[at : at + 128], step + 1
            w1, b1, w2, b2 = params
            h = np.tanh(z[rows] @ w1 + b1)
            d = (1 / (1 + np.exp(-(h @ w2 + b2))) - y[rows]) * weight[rows] / len(rows)
            dh = d[:, None] * w2 * (1 - h**2)
            grads = [z[rows].T @ dh + 1e-4 * w1, dh.sum(axis=0), h.T @ d + 1e-4 * w2, d.sum()]
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - 0.003 * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    model.layers = [mean, scale, *params]


def fit_temperature(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The divisor of the logits with the least weighted log loss, by golden-section search of its logarithm."""
    loss = lambda t: float((weight * np.logaddexp(0, np.where(y > 0, -z, z) / np.exp(t))).sum())
    low, high, g = -2.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit_quality(docs: DataFrame, labels: DataFrame, p: Quality = Quality()) -> Model | None:
    """A model from labelled rows outside the held-out fold; None if they do not have both labels.

    A fifth of the sample is kept from training for the temperature. The sample has as many rows of either label as it
    can; weights bring them back to their shares.
    """
    own = labels.select("doc_id", F.col("quality").alias("y"))
    rows = labelled_texts(docs, own, "y", p.folds, p.held_out, p.fit_rows, p.fit_chars)
    y = np.array([r[2] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return None
    shares = dict(own.where(~in_fold("doc_id", p.folds, p.held_out) & F.col("y").isNotNull()).groupBy("y").count().collect())
    weight = np.array([shares[int(v)] / (y == v).sum() for v in y])
    weight /= weight.mean()
    column = pa.array([r[1] for r in rows], pa.string())
    a, b, n = [], [], []
    for _, buf, offs in text_slices(column, 1 << 19):
        i, j, first = word_ids(buf, offs, p.buckets)
        a.append(i.astype(np.int32))
        b.append(j.astype(np.int32))
        n.append(np.diff(first))
    first = np.r_[0, np.cumsum(np.concatenate(n))]
    index = index_vectors(p)
    model = Model(p, context_vectors(np.concatenate(a), first, index, p.reach), context_vectors(np.concatenate(b), first, index, p.reach))
    x = np.concatenate([model.features(buf, offs) for _, buf, offs in text_slices(column, 1 << 19)])
    aside = np.arange(len(y)) % 5 == 4
    _train(model, x[~aside], y[~aside], weight[~aside])
    if len(set(y[aside].tolist())) == 2:
        model.temperature = fit_temperature(model.logits(x[aside]), y[aside], weight[aside])
    del rows, column, a, b, index, x
    release()
    return model


def score_quality(docs: DataFrame, model: Model | None, p: Quality = Quality(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    score is the calibrated probability of label 1 from the whole text alone; predicted is 1 from p.threshold on. A null or
    empty text, or one without words, is scored by its empty pool, like any other. Without a model (no labels, or one
    label only) every score is 0.5. A null doc_id is not held out. Repeated rows get equal scores. An empty table gives an
    empty result; other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), in_fold(id_col, p.folds, p.held_out).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(batch.column(2)) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= p.threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model | None, p: Quality = Quality(), text_col: str = "text") -> DataFrame:
    """The rows of docs, as they are, whose text the classifier accepts; without a model, all.

    Null and empty texts are scored like any other; repeated rows are kept or dropped alike; texts of any length are read
    whole. An empty table gives an empty result. Other columns pass through, whatever their names.
    """
    if model is None:
        return docs
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(at)) >= p.threshold))

    return docs.mapInArrow(lean(run), docs.schema)
