import math

import numpy as np
import pytest
from oracle import same

from verdikt.llm import negatives
from verdikt.llm.queries import ORACLES, QUERIES


def brute(rows):
    """By the contract; of rows that repeat a vec_id the least (label, vector) stands."""
    known = {}
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if key % 7 == 0 else label
        whole = [math.floor(256 * x) for x in vector]
        one = (label, np.array(whole, "<i8").tobytes(), whole)
        known[key] = min(known.get(key, one), one)
    out = []
    for a, (label, _, q) in known.items():
        if a % 100:
            continue
        scores = sorted(((-sum(x * y for x, y in zip(q, v)), b, other) for b, (other, _, v) in known.items() if b != a))
        for s, p, _ in [x for x in scores if x[2] == label][:5]:
            fits = [(b, -n) for n, b, other in scores if other != label and 80 * -s <= 100 * -n <= 100 * -s][:5]
            out += [(a, p, k + 1, b, -s, n) for k, (b, n) in enumerate(fits)]
    return sorted(out)


def rows_of(df, scratch):
    return sorted(tuple(r) for r in negatives.mined(df, scratch()).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("kind", ["float", "double"])
def test_mined(spark, scratch, monkeypatch, kind):
    """Clusters, copies, ties, other lengths and rows that take no part, with blocks small enough for annuli to exclude some."""
    for name, value in {"BLOCK": 16, "STRIP": 3, "RUN": 4, "PER_PIVOT": 40, "AT_ONCE": 2}.items():
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(2)
    vectors = [v for c in rng.normal(0, 1, (8, 6)) for v in (c + rng.normal(0, 0.2, (110, 6))).astype(np.float32).tolist()]
    rows = [(i, v, int(rng.integers(0, 4))) for i, v in enumerate(vectors)]
    rows += [(1000 + i, vectors[300], i % 3) for i in range(40)] + [(2000, None, 1), (2100, vectors[0], None), (2200, [1.0, None], 2), (2300, [float("nan")] * 6, 1), (2400, [1.0] * 9, 2), (2401, [1.0] * 8, 3), (2402, [2.0], 2), (2500, [], 1), (2600, [0.0] * 6, 1), (None, vectors[0], 1)]
    rows += [(100, vectors[5], 3), (100, vectors[6], 2), rows[200]]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], f"vec_id long, embedding array<{kind}>, label int, score int, raw string, strip int").repartition(5)
    expected = brute(rows)
    assert rows_of(df, scratch) == expected and len(expected) > 100
    assert rows_of(df.limit(0), scratch) == []


def test_whole_numbers_beyond_doubles(spark, scratch):
    rows = [(i * 50, [2.0**21 + i % 3, 3.0, float(i)], i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert max(abs(r[4]) for r in brute(rows)) > 2**53 and rows_of(df, scratch) == brute(rows)
    with pytest.raises(Exception, match="over 62 bits"):
        rows_of(spark.createDataFrame([(1, [1e300], 1)], df.schema), scratch)


def test_annuli_exclude_blocks(spark, scratch, monkeypatch):
    """On clustered vectors most blocks are never sent to a strip."""
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "STRIP", 1)
    monkeypatch.setattr(negatives, "PER_PIVOT", 40)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 3, (16, 6))
    rows = [(i, (centres[i % 16] + rng.normal(0, 0.05, 6)).tolist(), i // 16 % 3) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    seen = []

    def held(anchors, blocks, space, k, own, first, f=negatives.scanned):
        wide = negatives.intervals(anchors, space, first).withColumnsRenamed({"low": "from", "high": "to"})
        near = blocks.join(wide, "pivot").where("high >= from and low <= to").count()
        seen.append(near / (blocks.count() * anchors.select("strip").distinct().count()))
        return f(anchors, blocks, space, k, own, first)

    monkeypatch.setattr(negatives, "scanned", held)
    assert rows_of(df, scratch) == brute(rows)
    assert len(seen) == 4 and max(seen) < 0.6, seen


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    same(QUERIES["op12_hard_negatives"](spark, folder), folder, ORACLES["op12_hard_negatives"])
