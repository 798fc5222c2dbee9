"""A quality classifier from positive and unlabelled text.

Trusted positives are documents labelled good whose labels may be learned from;
the unlabelled are web documents without a label. Documents labelled bad are not
used. A linear model f minimises the non-negative unbiased risk

    p * E_pos[loss(f)] + max(0, E_unl[loss(-f)] - p * E_pos[loss(-f)])

with the logistic loss: the difference estimates the risk on the bad documents
that hide among the unlabelled, and where it falls under zero, which only an
overfit can bring about, the step climbs back instead. p, the share of good
documents among the unlabelled, is estimated first: a classifier of positive
against unlabelled ranks a held-back half of both, and p is the least ratio of
the two shares above a threshold, each with its sampling error (the best bin).

Features are shares of bytes, on a square root scale, and a few of case, word
lengths, lines and repetition, all computed for a batch of texts at once by
array operations on their bytes; no label, language, source or id is among them.

At most about ``SAMPLE`` documents of either kind are learned from, taken by a
hash of the doc_id; their features, not their texts, come to the driver. Every
text is scored whole. An empty or null text has zero features and a score like
any other. Without positives every score is next to 0 (1e-13); where no document is unlabelled,
the labelled ones stand in with their labels hidden. Repeated rows are scored
one by one, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdikt.llm.common import batches, hash_sample, labelled_sample, texts, train_row
from verdikt.llm.words import raw_bytes, word_spans

SAMPLE = 8000
THRESHOLD = 0.3
STEPS, RATE, DECAY = 400, 0.05, 1e-4
EXTRA = 11


def features(column: pa.Array) -> np.ndarray:
    """A row of 256 + EXTRA features for each text."""
    n = len(column)
    data, cuts = raw_bytes(column)
    size = np.diff(cuts)
    owner = np.repeat(np.arange(n), size)
    counts = np.bincount(owner * 256 + data, minlength=256 * n).reshape(n, 256).astype(np.float64)
    total = np.maximum(size, 1)[:, None]
    out = np.zeros((n, 256 + EXTRA))
    out[:, :256] = np.sqrt(counts / total)
    start, end, doc = word_spans(data, cuts)
    words = np.bincount(doc, minlength=n)
    some = np.maximum(words, 1)
    length = end - start
    upper, lower = counts[:, 65:91].sum(axis=1), counts[:, 97:123].sum(axis=1)
    last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    alphanumeric = ((last >= 97) & (last <= 122)) | ((last >= 65) & (last <= 90)) | ((last >= 48) & (last <= 57)) | (last >= 128)
    # A word is taken for a repetition of an earlier one if length, byte sum, first and last byte agree.
    total_bytes = np.r_[0, np.cumsum(data, dtype=np.int64)]
    mark = np.stack([length, total_bytes[end] - total_bytes[start], data[start], last]) if len(end) else np.zeros((4, 0))

    def repeated(back: int) -> np.ndarray:
        same = (mark[:, back:] == mark[:, :-back]).all(axis=0) & (doc[back:] == doc[:-back])
        return np.bincount(doc[back:], same, n) / some

    lines = counts[:, 10] + (size > 0)
    out[:, 256:] = np.stack(
        [
            upper / np.maximum(upper + lower, 1),
            np.bincount(doc, length, n) / some / 10,
            np.sqrt(np.bincount(doc, length.astype(float) ** 2, n) / some) / 10,
            np.bincount(doc, ~alphanumeric, n) / some,
            np.bincount(doc, length == 1, n) / some,
            np.log1p(words) / 10,
            np.log1p(words / np.maximum(lines, 1)) / 5,
            (counts > 0).sum(axis=1) / 100,
            (size == 0).astype(float),
            repeated(1),
            repeated(2),
        ],
        axis=1,
    )
    return out


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -10, 10) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Adam:
    def __init__(self, size: int):
        self.m, self.v, self.t = np.zeros(size), np.zeros(size), 0

    def step(self, gradient: np.ndarray, rate: float) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        return rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.c_[x, np.ones(len(x))]


def separate(positive: np.ndarray, unlabelled: np.ndarray) -> np.ndarray:
    """Weights of a plain logistic regression of positive against unlabelled, balanced."""
    w, adam = np.zeros(positive.shape[1], np.float32), _Adam(positive.shape[1])
    for _ in range(STEPS // 2):
        grad = -positive.T @ _sigmoid(-positive @ w) / len(positive) + unlabelled.T @ _sigmoid(unlabelled @ w) / len(unlabelled)
        w -= adam.step(grad + DECAY * w, RATE).astype(np.float32)
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, by the best bin of a held-back half."""
    rng = np.random.default_rng(11)
    positive, unlabelled = rng.permutation(positive), rng.permutation(unlabelled)
    w = separate(positive[::2], unlabelled[::2])
    p, u = np.sort(positive[1::2] @ w), np.sort(unlabelled[1::2] @ w)
    if not len(p) or not len(u):
        return 0.5
    at = np.quantile(p, np.linspace(0, 0.95, 96))
    above_p, above_u = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
    error = np.sqrt(np.log(40) / 2 / len(p)) + np.sqrt(np.log(40) / 2 / len(u))
    best = np.argmin((above_u + error) / np.maximum(above_p, 1e-9))
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.98))


def direction(p: np.ndarray, u: np.ndarray, w: np.ndarray, prior: float) -> np.ndarray:
    """Gradient of the risk with decay; where the part of the hidden bad is negative, the opposite of that part's."""
    fp, fu = p @ w, u @ w
    hidden = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    bad = u.T @ _sigmoid(fu) / len(u) - prior * (p.T @ _sigmoid(fp)) / len(p)
    if hidden < 0:
        return -bad
    return bad - prior * (p.T @ _sigmoid(-fp)) / len(p) + DECAY * np.r_[w[:-1], 0.0]


def train(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """Minimises the non-negative risk over two matrices of features."""
    width = 256 + EXTRA
    if not len(positive):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), -30.0, 0.0)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0)
    scale = np.where(scale > 1e-4, scale, 1.0)
    p, u = (_with_one(np.clip((x - mean) / scale, -10, 10)).astype(np.float32) for x in (positive, unlabelled))
    prior = class_prior(p, u)
    w, adam = np.zeros(p.shape[1], np.float32), _Adam(p.shape[1])
    for step in range(STEPS):
        grad = direction(p, u, w, prior)
        w -= adam.step(grad, RATE * (1 - step / STEPS) + 1e-3).astype(np.float32)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def _matrix(rows: DataFrame) -> np.ndarray:
    """Features of a bounded table of texts, computed by the executors."""

    def run(parts):
        for part in parts:
            for at in range(0, part.num_rows, 256):
                x = features(part.column("text").slice(at, 256))
                yield from batches(pa.schema([("x", pa.list_(pa.float32()))]), ((row,) for row in x.astype(np.float32)))

    found = rows.select("text").mapInArrow(run, "x array<float>").toArrow().column("x").combine_chunks()
    return found.values.to_numpy(zero_copy_only=False).reshape(-1, 256 + EXTRA).astype(np.float64) if len(found) else np.zeros((0, 256 + EXTRA))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """``labels`` has doc_id and quality (1: good)."""
    positive = _matrix(labelled_sample(docs, labels.where("quality = 1"), "quality", SAMPLE))
    keys = docs.where("doc_id is not null").where(train_row(F.col("doc_id"))).select("doc_id").distinct()
    unknown = hash_sample(keys.join(labels.select("doc_id"), "doc_id", "left_anti"), SAMPLE)
    unlabelled = _matrix(texts(docs, "doc_id").join(F.broadcast(unknown), "doc_id").dropDuplicates(["doc_id"]))
    if not len(unlabelled):
        unlabelled = _matrix(labelled_sample(docs, labels, "quality", SAMPLE))
    return train(positive, unlabelled)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Each document's doc_id, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(parts):
        for part in parts:
            for at in range(0, part.num_rows, 256):
                rows = part.slice(at, 256)
                p = shared.value.scores(features(rows.column("text")))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], schema=schema)

    return texts(docs, "doc_id").mapInArrow(run, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, all columns, whose texts the model takes for good. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts):
        for part in parts:
            for at in range(0, part.num_rows, 256):
                rows = part.slice(at, 256)
                yield rows.filter(pa.array(shared.value.scores(features(rows.column("text"))) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
