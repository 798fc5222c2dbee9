"""Words, shingles and n-grams of many texts at once, hashed with numpy.

All work is done on the UTF-8 bytes of an Arrow column: A-Z are lower-cased,
words are runs of bytes other than space and 0x09-0x0D, and every hash is a
polynomial of random byte weights modulo 2**64, mixed at the end, so a batch of
documents takes a fixed number of array operations and no loop over words.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.Generator(np.random.PCG64(20240501)).integers(0, 2**64, 256, np.uint64) | np.uint64(1)
_P, _Q, _R = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words(NamedTuple):
    """One entry for each word, in order: its document's place in the column, and its hash."""

    doc: np.ndarray
    word: np.ndarray


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of each); null is empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    cuts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, cuts - cuts[0]


def word_spans(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each word."""
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(_SPACE[data], out=inside[:-1])
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = cuts[(cuts < len(data))]
    first[edge] = inside[edge]  # a text's first byte opens a word even if the text before ends in one
    start = np.flatnonzero(first)
    last = inside[:-1] & (~inside[1:] | first[1:])
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(cuts, start, side="right") - 1


def powers(p: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, p, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _segments(value: np.ndarray, p: np.uint64, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of value[i] * p**(i - start) over [start, end), for every segment."""
    if not len(start):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value * powers(p, len(value)), out=total[1:])
    return (total[end] - total[start]) * powers(_inverse(p), len(value) + 1)[start]


def hashed_words(column: pa.Array) -> Words:
    data, cuts = raw_bytes(column)
    start, end, doc = word_spans(data, cuts)
    return Words(doc, mix(_segments(_BYTE[_LOWER[data]], _P, start, end)))


def exact_words(column: pa.Array, lanes: int) -> tuple[np.ndarray, ...]:
    """(document, hash, ...) of each word, case kept; the hashes of the two lanes are independent."""
    data, cuts = raw_bytes(column)
    start, end, doc = word_spans(data, cuts)
    value = _BYTE[data]
    first = mix(_segments(value, _P, start, end))
    return (doc, first) if lanes == 1 else (doc, first, mix(_segments(value * value + np.uint64(0x632BE59BD9B4E019), _R, start, end)))


def windows(word: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each place on."""
    return mix(_segments(word, _Q, at, at + k))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, without repeats."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


class Sets(NamedTuple):
    """Sets of documents one after another: values are sorted and distinct within each."""

    cuts: np.ndarray
    values: np.ndarray


def shingle_sets(column: pa.Array, k: int) -> Sets:
    """Distinct k-word shingles of each text; with fewer words the whole sequence is one.

    A text without words has an empty set. Shingles are 64-bit hashes.
    """
    doc, word = hashed_words(column)
    n_docs = len(column)
    count = np.bincount(doc, minlength=n_docs)
    first = np.r_[0, np.cumsum(count)]
    starts = np.maximum(count - k + 1, np.minimum(count, 1))  # shingles of each text, repeats included
    owner = np.repeat(np.arange(n_docs), starts)
    at = np.arange(len(owner)) - np.repeat(np.r_[0, np.cumsum(starts)][:-1], starts) + first[owner]
    to = np.minimum(at + k, first[owner + 1]) if len(owner) else at
    value = mix(_segments(word, _Q, at, to) + (to - at).astype(np.uint64))
    cuts = np.r_[0, np.cumsum(starts)]
    kept = [distinct(value[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    sizes = np.array([len(x) for x in kept], np.int64)
    return Sets(np.r_[0, np.cumsum(sizes)], np.concatenate([*kept, np.zeros(0, np.uint64)]))
