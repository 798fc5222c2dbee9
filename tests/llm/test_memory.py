"""What workers and the driver hold as Python objects stays far below a batch's bytes times ten."""

import tracemalloc

import numpy as np
import pyarrow as pa

from verdikt.llm import bpe, toxicity


def peak(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_decoding_holds_one_list_of_ids():
    rows, each = 500, 1000
    ids = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * each, pa.int32()), pa.array(np.arange(rows * each) % 50_000, pa.int32()))
    part = pa.RecordBatch.from_arrays([pa.array(range(rows)), ids], names=["doc_id", "ids"])
    assert peak(lambda: [None for _ in bpe._decoded(part, len)]) < 2  # all of them: 20
    empty = pa.RecordBatch.from_arrays([pa.array([7, None]), pa.array([None, []], pa.list_(pa.int32()))], names=["doc_id", "ids"])
    assert list(bpe._decoded(empty, len)) == [(7, 0), (None, 0)]


def test_windows_hold_words_once():
    n = 40_000
    words = [" ".join(f"word{(i * 7 + j) % 500}" for j in range(toxicity.WINDOW if i % 9 else 1 + i % 5)) for i in range(n)]
    table = pa.table({"doc_id": pa.array(range(n)), "label": pa.array([i % 2 for i in range(n)], pa.int32()), "place": pa.array([0] * n, pa.int64()), "words": words})
    found = []
    assert peak(lambda: found.append(toxicity.Windows(table))) < 8  # as lists of strings: 20
    names: dict[str, int] = {}
    for row, text in zip(found[0].rows.tolist(), words):
        some = [names.setdefault(w, len(names)) for w in text.split(" ")]
        assert row == some + [-1] * (toxicity.WINDOW - len(some))


def test_training_holds_units_once():
    n, rng = 30_000, np.random.default_rng(4)
    words = [" ".join("".join(chr(97 + c) for c in w) for w in rng.integers(0, 26, (toxicity.WINDOW, 9))) for _ in range(n)]
    table = lambda some, label: pa.table({"doc_id": pa.array([i // 9 for i in some]), "label": pa.array([label] * len(some), pa.int32()), "place": pa.array(some, pa.int64()), "words": [words[i] for i in some]})
    drawn, best = pa.concat_tables([table(range(0, n, 2), 0), table(range(1, n, 2), 1)]), table(range(1, n, 20), 1)
    found, bucket = [], np.random.default_rng(5).normal(size=toxicity.BUCKETS)
    assert peak(lambda: found.append(toxicity.Windows(drawn))) < 60  # units as long integers, words as strings: 88
    assert peak(lambda: found.append(found[0].logits(found[0].clean, bucket, 0.5))) < 20  # all units' logits at once: 43
    # Kept windows beside others are as one table of both.
    both, one = toxicity.Windows(best, found[0]), toxicity.Windows(pa.concat_tables([best, drawn.slice(0, n // 2)]))
    assert [[both.words[w].as_py() for w in row] for row in both.rows[:500].tolist()] == [[one.words[w].as_py() for w in row] for row in one.rows[:500].tolist()]
    assert (both.owner == one.owner).all() and (both.toxic == one.toxic).all() and (both.clean == one.clean).all()
    assert (both.logits(both.toxic, bucket, 0.5) == one.logits(one.toxic, bucket, 0.5)).all()
    assert (both.units(both.clean[:99])[0] == one.units(one.clean[:99])[0]).all()
