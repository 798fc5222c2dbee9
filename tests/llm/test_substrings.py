import random
import re
from collections import defaultdict

import numpy as np
import pytest
from oracle import same

from verdikt.llm import substrings
from verdikt.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs):
    """[(doc_id, words, kept words)] by the contract; a null id takes no part."""
    first, split = {}, [(k, WORD.findall(t or "")) for k, t in docs]
    windows = lambda w: [tuple(w[i : i + 13]) for i in range(len(w) - 12)]
    for key, words in split:
        for w in windows(words) if key is not None else []:
            first[w] = min(first.get(w, key), key)
    out = []
    for key, words in split:
        gone = set()
        for i, w in enumerate(windows(words) if key is not None else []):
            if first[w] < key:
                gone.update(range(i, i + 13))
        out.append((key, len(words), " ".join(w for i, w in enumerate(words) if i not in gone), len(gone)))
    return out


def check(df, docs):
    rows = substrings.deduplicate(df).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], r["text"], sum(b - a for a, b in r["removed"])) for r in rows)
    assert got == sorted((str(k), *rest) for k, *rest in brute(docs))
    return rows


def test_cover_meets_every_pair_of_places():
    for i in range(substrings.PERIOD):
        for j in range(substrings.PERIOD):
            assert any((i + k) % substrings.PERIOD in substrings.COVER and (j + k) % substrings.PERIOD in substrings.COVER for k in range(substrings.PERIOD))
    assert substrings.ANCHOR + substrings.PERIOD - 1 == substrings.WINDOW


@pytest.mark.parametrize("pairs", [1 << 21, 40])
def test_passages(documents, monkeypatch, pairs):
    """Passages of about a window's length at every shift, copies, repeats inside a text; with tasks that settle much or little."""
    monkeypatch.setattr(substrings, "PAIRS", pairs)
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "Ab", "é", "漢", "\x00"]) + str(rng.randint(0, 400))
    passages, texts = [[word() for _ in range(n)] for n in (11, 12, 13, 14, 20, 60)], []
    for _ in range(90):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += [word() for _ in range(rng.randint(0, 15))] + rng.choice(passages)
        texts.append(rng.choice([" ", "\n", "\t\x0b "]).join(parts))
    texts += texts[:6] + ["x y " * 40, "x y " * 41, "X y " * 40]
    docs = [(k * 7 - 100, t) for k, t in enumerate(texts)]
    rng.shuffle(docs)
    rows = check(documents(docs, parts=5), docs)
    assert sum(len(r["removed"]) for r in rows) > 60


def test_awkward_rows(documents, awkward):
    passage = " ".join(f"w{i}" for i in range(30))
    docs = [(1, passage), (1, "x " + passage), (1, passage), (None, passage), (None, None), (0, "y"), (2, passage + " z"), (2, "head " + passage), (3, passage), (4, None), (5, ""), (6, " \n\t")]
    rows = check(documents(docs), docs)
    assert {r["text"] for r in rows if r["doc_id"] == 2} == {"z", "head"}
    plain = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    check(awkward, plain)
    assert substrings.deduplicate(awkward.limit(0)).count() == 0


def test_a_hot_passage_is_asked_for_once_a_task(documents):
    passage = " ".join(f"w{i}" for i in range(40))
    docs = documents([f"start{i} {passage} end{i}" for i in range(400)], parts=4).select("doc_id", "text")
    asked = substrings.anchor_questions(docs, 8).collect()
    open_, told = (sum(len(r["high"]) // 4 for r in asked if r["kind"] == k) for k in (substrings.OPEN, substrings.SHARED))
    assert told < 4 * 40 and open_ < 400 * 8
    answers = substrings.anchor_questions(docs, 8).groupBy("place").applyInArrow(substrings.shared, "doc_id long, key int")
    asked = substrings.window_questions(substrings.met(docs, answers), 8).collect()
    open_ = sum(len(r["docs"]) // 8 for r in asked if r["kind"] == substrings.OPEN)
    assert open_ < 4 * 28 + 2 * 12 * 400 and sum(len(r["docs"]) // 8 for r in asked) > 400 * 28


def test_texts_are_shuffled_once(spark, small):
    """The exchange of the texts is one stage for both joins where answers are too many to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = substrings.deduplicate(spark.read.parquet(f"{small}/documents.parquet"))
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "ReusedExchange" in final and final.count("SortMergeJoin") == 2 - final.count("ReusedExchange") + 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hashes_of_words_are_independent():
    import pyarrow as pa

    from verdikt.llm.words import exact_words

    texts = [f"w{i} W{i} {i:x}" for i in range(20000)]
    _, high, low = exact_words(pa.array(texts), 2)
    words = " ".join(texts).split()
    known = defaultdict(set)
    for w, h, l in zip(words, high.tolist(), low.tolist()):
        known[w].add((h, l))
    assert all(len(v) == 1 for v in known.values()) and len({h for h in high.tolist()}) == len({h for h in low.tolist()}) == len(known)
    assert not np.any(high == low)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    same(QUERIES["op11_substring_dedup"](spark, folder), folder, ORACLES["op11_substring_dedup"])
