"""Toxicity by subword-bag embeddings and a linear softmax, trained together.

A word (a run of letters, lower-cased) is the bag of the character n-grams of
``<word>`` and of the word itself, hashed to ``BUCKETS`` vectors. The vectors of
all units in a window of ``WINDOW`` words are averaged, and a linear softmax
over (clean, toxic) reads the average; vectors and softmax are learned together
by AdaGrad in numpy. A misspelling shares most n-grams with the word it is made
from, and so scores like it without having been seen.

Labels belong to documents, while a few words make one toxic: windows of clean
documents are all clean, and of a toxic document only those count as toxic that
the model of the round before ranks highest there (in the first round, all).
A document's logit is its highest window's, set to a probability by a logistic
curve of two parameters that is fitted on the sample's whole texts of any length,
whose logits the executors compute.

As the softmax is linear, an average's logit is the average of the logits of
its parts: after training each bucket is one number, a word's logit is computed
once and remembered, and scoring makes no vectors.

The sample is at most about ``SAMPLE`` labelled texts, taken by a hash of the
doc_id; of a repeated doc_id the least text is taken. Its texts are cut into
windows by the executors, all of each whatever its length, and about ``DRAWN``
windows of either label are learned from, drawn by a hash of doc_id and place.
With the model of that, executors look through every window of the whole sample
again for the ``TOXIC_BEST`` highest of each toxic text and the ``CLEAN_BEST`` of
each clean one; training goes on with these, so that the toxic words of a very
long text are found wherever they are. Windows are sorted by doc_id and place:
how the input is partitioned makes no difference to the model.

Scoring takes every text whole. A text without letters, empty or null gets the
prior of an empty window (the softmax's bias alone). Without labelled texts of
both kinds that have words every score is next to 0 (1e-13). Repeated rows are
scored one by one, an empty table gives no rows, and columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdikt.llm.bpe import slices
from verdikt.llm.common import Scratch, batches, labelled_sample, texts
from verdikt.llm.words import mix

BUCKETS, DIMENSIONS, WINDOW, ORDERS = 1 << 17, 8, 5, (3, 4, 5, 6)
#: Labelled texts, windows drawn of either label, and highest windows of each text; about these many at most.
SAMPLE, DRAWN, TOXIC_BEST, CLEAN_BEST = 6000, 300_000, 64, 16
#: Rounds over the drawn windows, rounds over the highest ones.
FIRST_ROUNDS, LAST_ROUNDS = 2, 3
STEPS, BATCH, RATE = 60, 4096, 0.5
#: Word logits remembered by one worker; emptied when full.
MEMORY = 500_000
THRESHOLD = 0.5

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def word_units(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(cuts, buckets): unit buckets of each word, one word after another; at least one to a word."""
    data = np.frombuffer("".join(f"<{w}>" for w in words).encode(), np.uint8).astype(np.uint64)
    size = np.array([len(w.encode()) + 2 for w in words], np.int64)
    end = np.cumsum(size)
    start, owner = end - size, np.repeat(np.arange(len(words)), size)
    at = np.arange(len(data))
    owners, hashes = [], []
    rolled = np.zeros(len(data), np.uint64)
    for n in range(1, min(max(ORDERS), len(data)) + 1):
        rolled[: len(data) - n + 1] = rolled[: len(data) - n + 1] * np.uint64(0x100000001B3) + data[n - 1 :]
        if n in ORDERS:
            inside = at + n <= end[owner]
            owners.append(owner[inside])
            hashes.append(mix(rolled[inside] + np.uint64(n)))
    # The word itself: a sum of its bytes' mixed values and places.
    place = (at - start[owner]).astype(np.uint64)
    total = np.add.reduceat(mix(data + (place << np.uint64(8))), start) if len(words) else np.zeros(0, np.uint64)
    owners.append(np.arange(len(words)))
    hashes.append(mix(total + np.uint64(99)))
    owner, bucket = np.concatenate(owners), (np.concatenate(hashes) % np.uint64(BUCKETS)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return np.r_[0, np.cumsum(np.bincount(owner, minlength=len(words)))], bucket[order]


def _units_in_parts(words: pa.Array, at_once: int = 5_000) -> tuple[np.ndarray, np.ndarray]:
    """As word_units, some words at a time, which takes less memory."""
    count, buckets = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for at in range(0, len(words), at_once):
        cuts, bucket = word_units(words.slice(at, at_once).to_pylist())
        count.append(np.diff(cuts))
        buckets.append(bucket.astype(np.int32))
    return np.concatenate(count), np.concatenate(buckets)


class Model(NamedTuple):
    """Logits of buckets, the bias, and the curve from a document's highest logit to a probability."""

    bucket: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, logit: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -30, 30))))


def window_sums(values: np.ndarray, n: int = WINDOW) -> np.ndarray:
    """Sums over every n neighbours; over all where there are fewer."""
    if len(values) <= n:
        return values.sum(keepdims=True)
    total = np.r_[0.0, np.cumsum(values)]
    return total[n:] - total[:-n]


class Scorer:
    """Documents' highest window logits; remembers words."""

    def __init__(self, model: Model):
        self._model, self._known = model, {}

    def windows(self, found: list[str]) -> np.ndarray:
        """Logits of a text's windows in order; of the bias alone where it has no words."""
        if not found:
            return np.array([self._model.bias])
        sums, sizes = np.array([self._known[w] for w in found]).T
        return window_sums(sums) / window_sums(sizes) + self._model.bias

    def learn(self, words: set[str]) -> None:
        new = list(words.difference(self._known))
        if len(self._known) + len(new) > MEMORY:
            self._known.clear()
            new = list(words)
        if new:
            cuts, bucket = word_units(new)
            sums = np.add.reduceat(self._model.bucket[bucket], cuts[:-1])
            self._known.update(zip(new, zip(sums.tolist(), np.diff(cuts).tolist())))

    def logits(self, some: list[str]) -> list[float]:
        found = [words_of(text) for text in some]
        self.learn(set().union(*found))
        return [float(self.windows(words).max()) for words in found]


def _numbered(texts: pa.ChunkedArray, known: pa.Array | None, at_once: int = 1 << 15) -> tuple[np.ndarray, pa.Array]:
    """(rows of word numbers, words in the order of their numbers), some texts at a time: what holds all is a number for each word, not the words."""
    known = pa.array([], texts.type) if known is None else known
    rows, at = np.full((len(texts), WINDOW), -1, np.int32), 0
    for chunk in texts.chunks:
        for some in (chunk.slice(i, at_once) for i in range(0, len(chunk), at_once)):
            words = pc.split_pattern(some, " ")
            flat, size = words.flatten(), pc.list_value_length(words).to_numpy()
            number = pc.index_in(flat, value_set=known)
            if number.null_count:
                known = pa.concat_arrays([known, pc.unique(flat.filter(pc.is_null(number)))])
                number = pc.index_in(flat, value_set=known)
            rows[at : at + len(some)][np.arange(WINDOW) < size[:, None]] = number.to_numpy()
            at += len(some)
    return rows, known


class Windows:
    """Windows as rows of word numbers, -1 where a text has fewer words, with the place of their text and its label.

    ``kept``: other windows, of which the clean ones stand here as well; their words keep their numbers.
    """

    def __init__(self, found: pa.Table, kept: Windows | None = None):
        rows, self.words = _numbered(found.column("words"), kept.words if kept else None)
        doc, place, label = (found.column(c).to_numpy() for c in ("doc_id", "place", "label"))
        if kept:
            also = kept.clean
            rows, doc, place, label = np.concatenate([rows, kept.rows[also]]), np.r_[doc, kept.doc[also]], np.r_[place, kept.place[also]], np.r_[label, np.zeros(len(also), label.dtype)]
        order = np.lexsort((place, doc))
        self.rows, self.doc, self.place, label = rows[order], doc[order], place[order], label[order]
        self.owner = np.cumsum(np.r_[False, self.doc[1:] != self.doc[:-1]][: len(doc)], dtype=np.int32)
        self.toxic, self.clean = (np.flatnonzero(label == y).astype(np.int32) for y in (1, 0))
        self.count, self.bucket = _units_in_parts(self.words.slice(len(kept.words) if kept else 0))
        if kept:
            self.count, self.bucket = np.r_[kept.count, self.count], np.r_[kept.bucket, self.bucket]
        self.cuts = np.r_[0, np.cumsum(self.count)]

    def units(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, edges): units of the windows one after another, and where each window's begin."""
        words = self.rows[which]
        real = words >= 0
        flat, of = words[real], np.repeat(np.arange(len(which)), real.sum(axis=1))
        size = self.count[flat]
        units = self.bucket[np.repeat(self.cuts[flat], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        of = np.repeat(of, size)
        return units, np.flatnonzero(np.r_[True, of[1:] != of[:-1]])

    def logits(self, which: np.ndarray, bucket: np.ndarray, bias: float) -> np.ndarray:
        edges = [self.cuts[at : at + 20_001] for at in range(0, len(self.count), 20_000)]
        sums = np.concatenate([*(np.add.reduceat(bucket[self.bucket[e[0] : e[-1]]], e[:-1] - e[0]) for e in edges), [0.0]])
        sizes = np.r_[self.count, 0]
        parts = (self.rows[which[at : at + 50_000]] for at in range(0, len(which), 50_000))
        return np.concatenate([sums[p].sum(axis=1) / np.maximum(1, sizes[p].sum(axis=1)) for p in parts]) + bias


def gradients(vectors: np.ndarray, softmax: np.ndarray, bias: np.ndarray, units: np.ndarray, edges: np.ndarray, target: np.ndarray):
    """(buckets, theirs, softmax's, bias's): gradients of the windows' cross entropy, summed for the vectors, in the mean for the softmax."""
    sizes = np.diff(np.r_[edges, len(units)])
    n = sizes[:, None].astype(np.float32)
    average = np.add.reduceat(vectors[units], edges, axis=0) / n
    z = average @ softmax + bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    error = (p - target) / len(target)
    each, of = error @ softmax.T / n * len(target), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    touched = np.flatnonzero(np.bincount(units, minlength=len(vectors)))
    of_vectors = np.stack([np.bincount(units, each[of, d], len(vectors))[touched] for d in range(vectors.shape[1])], axis=1).astype(vectors.dtype)
    return touched, of_vectors, average.T @ error, error.sum(axis=0)


class Learner:
    """Vectors and softmax as they are learned by AdaGrad, over one table of windows after another."""

    def __init__(self, seed: int = 7):
        self._rng = np.random.default_rng(seed)
        self._vectors = self._rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
        self._softmax, self._bias = self._rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)
        self._seen = [np.full((BUCKETS, 1), 1e-3, np.float32), np.full((DIMENSIONS, 2), 1e-3, np.float32), np.full(2, 1e-3, np.float32)]
        self._turn = 0

    def model(self) -> Model:
        return Model((self._vectors @ (self._softmax[:, 1] - self._softmax[:, 0])).astype(np.float64), float(self._bias[1] - self._bias[0]), 1.0, 0.0)

    def rounds(self, windows: Windows, n: int) -> None:
        for _ in range(n):
            positives, hard = self._chosen(windows)
            for _ in range(STEPS):
                half = BATCH // 2
                # Half of the clean windows are hard ones, those that the last round took for toxic most.
                easy = self._rng.choice(windows.clean, half - half // 2 if len(hard) else half)
                batch = np.concatenate([self._rng.choice(positives, half), easy, *([self._rng.choice(hard, half - len(easy))] if len(hard) else [])])
                target = np.zeros((len(batch), 2), np.float32)
                target[:half, 1] = target[half:, 0] = 1
                self._step(*windows.units(batch), target)
            self._turn += 1

    def _chosen(self, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(toxic windows, hard clean windows) of a round; in the first, all and none."""
        if not self._turn:
            return windows.toxic, windows.clean[:0]
        bucket, bias = self.model()[:2]
        logit = windows.logits(windows.toxic, bucket, bias)
        order = np.lexsort((-logit, windows.owner[windows.toxic]))
        docs, high = windows.owner[windows.toxic][order], logit[order]
        first = np.r_[True, docs[1:] != docs[:-1]]
        best = high[np.maximum.accumulate(np.where(first, np.arange(len(docs)), 0))]
        # A document's best window, and those about as high.
        positives = windows.toxic[order][first | ((high >= 0.5 * best) & (best > 0))]
        hard = np.argsort(-windows.logits(windows.clean, bucket, bias), kind="stable")[: max(1, len(windows.clean) // 20)]
        return positives, windows.clean[hard]

    def _step(self, units: np.ndarray, edges: np.ndarray, target: np.ndarray) -> None:
        touched, of_vectors, of_softmax, of_bias = gradients(self._vectors, self._softmax, self._bias, units, edges, target)
        seen_v, seen_s, seen_b = self._seen
        seen_v[touched] += (of_vectors * of_vectors).mean(axis=1, keepdims=True)
        self._vectors[touched] -= RATE * of_vectors / np.sqrt(seen_v[touched])
        seen_s += of_softmax * of_softmax
        self._softmax -= RATE * of_softmax / np.sqrt(seen_s)
        seen_b += of_bias * of_bias
        self._bias -= RATE * of_bias / np.sqrt(seen_b)


def curve(logits: np.ndarray, labels: np.ndarray) -> dict[str, float]:
    """Slope and shift of the logistic curve that fits best, by Newton's method with a little damping."""
    x = np.stack([logits, np.ones_like(logits)], axis=1)
    scale = np.abs(x[:, 0]).max() or 1.0
    x[:, 0] /= scale
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - labels) + 1e-3 * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
    return {"slope": float(w[0] / scale), "shift": float(w[1])}


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("place", pa.int64()), ("words", pa.string())])
_FOUND = "doc_id long, label int, place long, words string"


def _windows(rows, words: list[str], places: np.ndarray, doc_id: int, label: int) -> None:
    rows += ((doc_id, label, at, " ".join(words[at : at + WINDOW])) for at in places.tolist())


def drawn_windows(sample: DataFrame) -> DataFrame:
    """_FOUND: about DRAWN windows of either label, of all of the sample's texts whole."""

    def counted(parts):
        for part in parts:
            label, n = part.column("label").to_numpy(), np.array([len(words_of(t)) for t in part.column("text").to_pylist()])
            n = np.where(n, np.maximum(1, n - WINDOW + 1), 0)
            yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([int(n[label == y].sum()) for y in (0, 1)])], names=["label", "n"])

    total = dict(sample.select("text", "label").mapInArrow(counted, "label int, n long").groupBy("label").agg(F.sum("n")).collect())
    share = {y: min(1.0, DRAWN / max(1, n)) for y, n in total.items()}

    def run(parts):
        for part in parts:
            rows: list[tuple] = []
            for key, text, label in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "label"))):
                words = words_of(text)
                at = np.arange(max(1, len(words) - WINDOW + 1) if words else 0)
                dice = mix(mix(np.array([key], np.int64).view(np.uint64)) + at.astype(np.uint64)) >> np.uint64(11)
                _windows(rows, words, at[dice < share[label] * (1 << 53)], key, label)
            yield from batches(_SCHEMA, rows, 8192)

    return sample.select("doc_id", "text", "label").mapInArrow(run, _FOUND)


def highest_windows(sample: DataFrame, model: Model) -> DataFrame:
    """_FOUND: each text's highest windows, TOXIC_BEST or CLEAN_BEST of them; ties by place."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(parts):
        scorer = Scorer(shared.value)
        for part in parts:
            rows: list[tuple] = []
            for key, text, label in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "label"))):
                if words := words_of(text):
                    scorer.learn(set(words))
                    best = np.argsort(-scorer.windows(words), kind="stable")[: TOXIC_BEST if label else CLEAN_BEST]
                    _windows(rows, words, best, key, label)
            yield from batches(_SCHEMA, rows, 8192)

    return sample.select("doc_id", "text", "label").mapInArrow(run, _FOUND)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Trains on labelled documents whose labels may be learned from; ``labels`` has doc_id and toxic."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.save(labelled_sample(docs, labels, "toxic", SAMPLE), "sample")
    windows = Windows(drawn_windows(sample).toArrow())
    if not len(windows.toxic) or not len(windows.clean):
        return Model(np.zeros(BUCKETS), -30.0, 1.0, 0.0)
    learner = Learner()
    learner.rounds(windows, FIRST_ROUNDS)
    # Of toxic texts the highest alone; of clean ones those drawn as well.
    windows = Windows(highest_windows(sample, learner.model()).toArrow(), windows)
    learner.rounds(windows, LAST_ROUNDS)
    del windows
    pa.default_memory_pool().release_unused()
    model = learner.model()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts):
        scorer = Scorer(shared.value)
        for part in parts:
            for at, some in slices(part.column("text")):
                yield pa.RecordBatch.from_arrays([part.column("doc_id").slice(at, len(some)), pa.array(scorer.logits(some)), part.column("label").slice(at, len(some))], names=["doc_id", "logit", "label"])

    seen = sample.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, logit double, label int").toArrow().sort_by("doc_id")
    return model._replace(**curve(seen.column("logit").to_numpy(), seen.column("label").to_numpy()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Each document's doc_id, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(parts):
        scorer = Scorer(shared.value)
        for part in parts:
            for at, some in slices(part.column("text")):
                keys = part.column("doc_id").slice(at, len(some)).to_pylist()
                chances = [shared.value.probability(x) for x in scorer.logits(some)]
                yield from batches(schema, ((k, p, int(p >= THRESHOLD)) for k, p in zip(keys, chances)))

    return texts(docs, "doc_id").mapInArrow(run, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, all columns, whose texts the model takes for clean. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts):
        scorer = Scorer(shared.value)
        for part in parts:
            for at, some in slices(part.column("text")):
                chances = [shared.value.probability(x) for x in scorer.logits([t or "" for t in some])]
                yield part.slice(at, len(some)).filter(pa.array([p < THRESHOLD for p in chances]))

    return docs.mapInArrow(run, docs.schema)
