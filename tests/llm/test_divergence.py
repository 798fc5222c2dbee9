import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import same

from verdikt.llm import divergence
from verdikt.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, min_docs):
    df, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in ((a or "", b or "", (c or "").translate(LOWER)) for a, b, c in docs):
        terms = TERM.findall(text)
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
        sources[lang].add(source)
    out = []
    for lang, some in sources.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        whole = sum((counts[lang, s] for s in some), Counter())

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(counts[lang, s]) for s in some}
        for s in some:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in some if o != s))
            terms = sorted(((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]))[:50]
            out += [(lang, s, part, item.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"ENTRIES": 100, "SOURCES": 3, "TEXT_BYTES": 300}])
def test_audit(spark, scratch, monkeypatch, sizes):
    """Languages with and without kept terms, ties, terms beyond ASCII, null columns, repeated rows; with blocks and buckets of any size."""
    monkeypatch.setattr(divergence, "MIN_DOCS", 4)
    for name, value in sizes.items():
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(8)
    words = ["the", "The", "é", "É", "漢字", "a b", "x1y", "don't", "\U0001f600", "z" * 300, *(f"w{chr(97 + i)}" for i in range(26))]
    docs = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "é", "Z", None, ""]), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(120)]
    docs += [("en", "empty", None), ("en", "none", "123 456"), ("fr", "one", "rare words"), ("fr", "two", "other words"), ("it", "alone", "")] + docs[:5]
    df = spark.createDataFrame([(i % 50, *d, 1, "x") for i, d in enumerate(docs)], "doc_id long, lang string, source string, text string, n int, term string").repartition(3)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in divergence.audit(df, scratch()).select(*columns).collect()) == brute(docs, 4)
    assert divergence.audit(df.limit(0), scratch()).count() == 0


def test_awkward(awkward, scratch, monkeypatch):
    monkeypatch.setattr(divergence, "MIN_DOCS", 1)
    docs = [(r["lang"], r["source"], r["text"]) for r in awkward.select("lang", "source", "text").collect()]
    assert sorted(tuple(r) for r in divergence.audit(awkward, scratch()).collect()) == brute(docs, 1)


def test_groups_hold_equal_bytes_whatever_the_hash():
    rng = random.Random(1)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(500)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    start, end, _ = divergence.term_spans(data, np.array([0, len(data)]))
    for hashed in (divergence.xxhash.xxh3_64_intdigest, lambda b: len(b) % 2, lambda b: 0):
        group, first = divergence.grouped(data, start, end, hashed)
        assert [words[first[g]] for g in group] == words and len(first) == len(set(words))


def test_shares_are_exact(spark):
    rows = [(c, n, v) for c, n, v in [(0, 0, 1), (9 * 10**14, 9 * 10**14, 1), (123456789012345, 987654321098765, 10**9), (0, 9 * 10**15, 3), (5, 5, 0)]]
    got = spark.createDataFrame(rows, "c long, n long, v long").select(divergence.share(*(divergence.F.col(x) for x in "cnv"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (c + 5) // (n + 5 * v) if v else 1 for c, n, v in rows]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    same(QUERIES["op13_source_divergence"](spark, folder), folder, ORACLES["op13_source_divergence"])
