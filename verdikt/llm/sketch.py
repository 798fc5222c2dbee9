"""Fast similarity sketching: rounds of hashed bin placement.

In round i < t every element of a set falls into a random one of t bins with
the value i + u, u random in [0, 1); in round t + j all elements fall into bin
j. A bin keeps its least value, and rounds end for a set when its bins are all
full, which 2t rounds guarantee. Two sets agree in a bin with a probability
equal to their Jaccard similarity, and the number of bins that agree is
concentrated as sharply as with t independent hash functions, while a large set
takes one round instead of t hashes an element.
"""

from __future__ import annotations

import numpy as np

from verdikt.llm.words import Sets, mix


def _round(values: np.ndarray, i: int) -> np.ndarray:
    return mix(values ^ mix(np.array([i + 1], np.uint64) * np.uint64(0xD1342543DE82EF95)))


def sketches(sets: Sets, t: int) -> np.ndarray:
    """A row of t 64-bit values for each set; rows of empty sets are zero.

    A value holds its round in the top 16 bits and a hash of the element below.
    """
    n = len(sets.cuts) - 1
    size = np.diff(sets.cuts)
    out = np.full(n * t, np.iinfo(np.uint64).max, np.uint64)
    open_sets, values = np.flatnonzero(size), sets.values
    owner = np.repeat(np.arange(n), size)
    for i in range(2 * t):
        if not len(open_sets):
            break
        h = _round(values, i)
        place = owner * t + ((h & np.uint64(0xFFFFFFFF)) % np.uint64(t)).astype(np.int64) if i < t else owner * t + (i - t)
        np.minimum.at(out, place, (np.uint64(i) << np.uint64(48)) | (mix(h) >> np.uint64(16)))
        full = (out.reshape(n, t)[open_sets] != np.iinfo(np.uint64).max).all(axis=1)
        if full.any():
            open_sets = open_sets[~full]
            stay = np.zeros(n, bool)
            stay[open_sets] = True
            keep = stay[owner]
            owner, values = owner[keep], values[keep]
    out = out.reshape(n, t)
    out[size == 0] = 0
    return out


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for every ``rows`` coordinates of each sketch; the band's number is part of it."""
    n, t = sketch.shape
    grouped = sketch.reshape(n, t // rows, rows)
    key = np.broadcast_to(np.arange(1, t // rows + 1, dtype=np.uint64), (n, t // rows)).copy()
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, r])
    return key
