import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from oracle import DATA
from verdikt.llm import quality, toxicity
from verdikt.llm.queries import QUERIES


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


@pytest.mark.parametrize(("query", "label", "least"), [("op5_quality_classifier", "quality", 0.97), ("op9_toxicity", "toxic", 0.9)])
def test_held_out(spark, query, label, least):
    folder = f"{DATA}/sf0.01"
    rows = {r["doc_id"]: r for r in QUERIES[query](spark, folder).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for k, r in rows.items())
    known = [(r["doc_id"], r[label]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    assert auc(np.array([rows[k]["score"] for k, _ in known]), np.array([y for _, y in known])) >= least
    # Labels of held-out rows are not learned from: turning them over changes nothing.
    if label == "toxic":
        labels, docs = spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/documents.parquet")
        turned = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
        again = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, turned)).collect()}
        assert again == {k: r["score"] for k, r in rows.items()}


def test_class_prior():
    rng = np.random.default_rng(0)
    good, bad = lambda n: rng.normal(1, 1, (n, 4)), lambda n: rng.normal(-1.5, 1, (n, 4))
    for share in (0.3, 0.6, 0.9):
        n = 4000
        mixed = np.r_[good(int(n * share)), bad(n - int(n * share))]
        rng.shuffle(mixed)
        assert abs(quality.class_prior(np.c_[good(n), np.ones(n)].astype(np.float32), np.c_[mixed, np.ones(n)].astype(np.float32)) - share) < 0.06


def test_risk_finds_the_hidden_bad():
    """Positive and unlabelled texts only; the model still tells good from bad."""
    rng = random.Random(2)
    good = lambda: " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=40)).capitalize() + "."
    bad = lambda: " | ".join(rng.choices(["A!!", "##b", "$$C"], k=40))
    f = lambda texts: quality.features(pa.array(texts))
    model = quality.train(f([good() for _ in range(300)]), f([good() if i % 4 else bad() for i in range(400)]))
    assert abs(model.prior - 0.75) < 0.2
    assert (model.scores(f([good() for _ in range(100)])) > 0.8).all() and (model.scores(f([bad() for _ in range(100)])) < 0.2).all()


CLEAN = [f"{a}{b}{c}" for a in ("pl", "tr", "gr") for b in ("ane", "ust", "ood") for c in ("", "s", "ly")]


def clean_text(rng, *more, k=60):
    words = [*rng.choices(CLEAN, k=k), *more]
    return " ".join(rng.sample(words, len(words)))


def test_unseen_misspellings(spark, documents):
    rng = random.Random(4)
    texts = [clean_text(rng) for _ in range(300)] + [clean_text(rng, rng.choice(["worthless", "disgusting", "pathetic"])) for _ in range(100)]
    labels = spark.createDataFrame([(i, int(i >= 300)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(documents(texts), labels)
    scorer = toxicity.Scorer(model)
    text = lambda *more: clean_text(rng, *more)
    chance = [model.probability(x) for x in scorer.logits([text("worthlesss"), text("disgustin"), text("patheticc"), text("WORTHLESS!"), text(), text()])]
    assert min(chance[:4]) > 0.5 > max(chance[4:])


def test_long_texts_are_learned_from(spark, documents, monkeypatch):
    """All toxic texts are long, with one toxic word each, and few of their windows are drawn; partitions and repeated ids make no difference."""
    monkeypatch.setattr(toxicity, "DRAWN", 20_000)
    rng = random.Random(9)
    texts = [clean_text(rng, k=1000) for _ in range(60)] + [clean_text(rng, rng.choice(["worthless", "disgusting"]), k=4000) for _ in range(60)]
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(120)], "doc_id long, toxic int")
    assert min(len(t) for t in texts[60:]) > 15_000
    rows = [*enumerate(texts), (3, texts[3] + " zzz"), (70, texts[70] + " zzz")]
    model, again = (toxicity.fit(documents(rng.sample(rows, len(rows)), parts=n), labels) for n in (2, 5))
    assert model.bias == again.bias and model.slope == again.slope and (model.bucket == again.bucket).all()
    chance = [model.probability(x) for x in toxicity.Scorer(model).logits([clean_text(rng, "worthless", k=3000), clean_text(rng, "disgustingg", k=50), clean_text(rng, k=3000), clean_text(rng, k=50)])]
    assert min(chance[:2]) > 0.5 > max(chance[2:])


def test_windows_written_out(spark, documents):
    texts = ["a b c d e f g", "x y", "", None, "1 2"]
    sample = documents(texts).selectExpr("doc_id", "coalesce(text, '') text", "cast(doc_id % 2 as int) label")
    got = sorted((r["doc_id"], r["place"], r["words"]) for r in toxicity.drawn_windows(sample).collect())
    assert got == [(0, 0, "a b c d e"), (0, 1, "b c d e f"), (0, 2, "c d e f g"), (1, 0, "x y")]
    model = toxicity.Model(np.random.default_rng(1).normal(size=toxicity.BUCKETS), 0.5, 1.0, 0.0)
    scorer = toxicity.Scorer(model)
    scorer.learn(set("abcdefg"))
    best = sorted(r["place"] for r in toxicity.highest_windows(sample, model).where("doc_id = 0").collect())
    assert best == [0, 1, 2] and np.argmax(scorer.windows(list("abcdefg"))) in best


def test_gradients_written_out():
    """Against finite differences of the cross entropy, window by window."""
    rng = np.random.default_rng(3)
    vectors, softmax, bias = rng.normal(size=(6, 3)), rng.normal(size=(3, 2)), rng.normal(size=2)
    units, edges = np.array([0, 1, 1, 4, 5, 0, 2]), np.array([0, 3, 5])
    target = np.array([[1, 0], [0, 1], [0, 1]], float)

    def loss(v, s, b):
        total = 0.0
        for at, to, y in zip(edges, [*edges[1:], len(units)], target):
            z = sum(v[u] for u in units[at:to]) / (to - at) @ s + b
            total -= (y * (z - math.log(sum(math.exp(x) for x in z)))).sum()
        return total

    touched, of_vectors, of_softmax, of_bias = toxicity.gradients(vectors, softmax, bias, units, edges, target)
    assert touched.tolist() == [0, 1, 2, 4, 5]
    all_vectors = np.zeros_like(vectors)
    all_vectors[touched] = of_vectors
    for array, got, scale in ((vectors, all_vectors, 1), (softmax, of_softmax, 3), (bias, of_bias, 3)):
        for place in np.ndindex(array.shape):
            old, step = array[place], 1e-6
            array[place] = old + step
            up = loss(vectors, softmax, bias)
            array[place] = old - step
            down = loss(vectors, softmax, bias)
            array[place] = old
            assert abs((up - down) / 2 / step / scale - got[place]) < 1e-5


def test_word_units_are_those_of_the_word():
    cuts, bucket = toxicity.word_units(["été", "a", "worthless", "a"])
    assert (np.diff(cuts) > 0).all() and (bucket[cuts[1] : cuts[2]] == bucket[cuts[3] : cuts[4]]).all()
    alone = toxicity.word_units(["worthless"])[1]
    assert sorted(alone) == sorted(bucket[cuts[2] : cuts[3]])
    assert sorted(toxicity.word_units(["a"])[1]) == sorted(bucket[cuts[1] : cuts[2]])  # alone, shorter than the longest n-gram


@pytest.mark.parametrize("model", [quality, toxicity])
def test_awkward_tables(spark, awkward, model):
    column = "quality" if model is quality else "toxic"
    for labels in ([], [(1, 1)], [(5, 1), (9, 0), (None, 1), (6, None), (5, 1), (4, 1), (8, 0), (3, 1), (2, 0)]):
        known = spark.createDataFrame(labels, f"doc_id long, {column} int")
        rows = model.score(awkward, model.fit(awkward, known)).collect()
        assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    nothing = awkward.limit(0)
    assert model.score(nothing, model.fit(nothing, known.limit(0))).count() == 0


def test_risk_written_out():
    """The training direction against finite differences of the risk, summed document by document."""
    rng = random.Random(6)
    row = lambda shift: [rng.gauss(shift, 1), rng.gauss(0, 1), 1.0]
    p, u = [row(1) for _ in range(30)], [row(0) for _ in range(40)]
    loss = lambda z: max(z, 0) + math.log1p(math.exp(-abs(z)))

    def parts(w, prior):
        f = lambda x: sum(a * b for a, b in zip(x, w))
        good = prior * sum(loss(-f(x)) for x in p) / len(p)
        bad = sum(loss(f(x)) for x in u) / len(u) - prior * sum(loss(f(x)) for x in p) / len(p)
        return good + quality.DECAY / 2 * sum(a * a for a in w[:-1]), bad

    signs = set()
    for prior in (0.1, 0.6, 0.95):
        for w in ([0.0, 0.0, 0.0], [0.7, -0.2, 0.1], [4.0, 1.0, 6.0]):
            step, want = 1e-5, []
            bad = parts(w, prior)[1]
            signs.add(bad >= 0)
            for k in range(3):
                up, down = ([x + (s if i == k else 0) for i, x in enumerate(w)] for s in (step, -step))
                (g1, b1), (g0, b0) = parts(up, prior), parts(down, prior)
                want.append((g1 + b1 - g0 - b0 if bad >= 0 else b0 - b1) / 2 / step)
            assert np.allclose(quality.direction(np.array(p), np.array(u), np.array(w), prior), want, atol=1e-6)
    assert signs == {True, False}


def slow_mix(h):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> shift) * factor % 2**64
    return h ^ h >> 31


def slow_units(word):
    """Buckets of a word, n-gram by n-gram."""
    data, found = f"<{word}>".encode(), []
    for n in (3, 4, 5, 6):
        for i in range(len(data) - n + 1):
            h = 0
            for byte in data[i : i + n]:
                h = (h * 0x100000001B3 + byte) % 2**64
            found.append(slow_mix((h + n) % 2**64) % toxicity.BUCKETS)
    total = sum(slow_mix(byte + (i << 8)) for i, byte in enumerate(data)) % 2**64
    return [*found, slow_mix((total + 99) % 2**64) % toxicity.BUCKETS]


def slow_score(model, text):
    """The probability of the window whose units' logits have the highest mean, window by window."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    units = [[float(model.bucket[b]) for b in slow_units(w)] for w in words]
    windows = [sum(units[i : i + 5], []) for i in range(max(1, len(words) - 4))] if words else []
    best = max((sum(w) / len(w) for w in windows), default=0.0) + model.bias
    return 1 / (1 + math.exp(-min(30, max(-30, model.slope * best + model.shift))))


def test_scores_written_out(spark, documents):
    folder = f"{DATA}/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert model.bucket.any() and model.slope > 0
    some = [*(r["text"] for r in docs.limit(25).collect()), "", None, "one", "é 5 ß", "a b c d", "x" * 3000, "word " * 3000]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(documents(some), model).collect()}
    assert np.allclose([got[i] for i in range(len(some))], [slow_score(model, t or "") for t in some], atol=1e-9)


def test_quality_scores_written_out(spark, documents):
    """Scores of a fitted model, byte shares counted one by one, equal those of the batch; the rest of the features are held against loops in part."""
    folder = f"{DATA}/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    some = [*(r["text"] for r in docs.limit(25).collect()), "", "one", "é 5 ß", "x" * 3000, "Word word Word\nx. "]
    x = quality.features(pa.array(some))
    for row, text in zip(x, some):
        data, words = text.encode(), re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
        assert np.allclose(row[:256], [math.sqrt(data.count(bytes([b])) / max(1, len(data))) for b in range(256)])
        upper, lower = sum(65 <= b < 91 for b in data), sum(97 <= b < 123 for b in data)
        mean = sum(map(len, words)) / max(1, len(words))
        lines = data.count(b"\n") + (len(data) > 0)
        want = [upper / max(1, upper + lower), mean / 10, math.sqrt(sum(len(w) ** 2 for w in words) / max(1, len(words))) / 10]
        want += [sum(not (w[-1:].isalnum() or w[-1] >= 128) for w in words) / max(1, len(words)), sum(len(w) == 1 for w in words) / max(1, len(words))]
        want += [math.log1p(len(words)) / 10, math.log1p(len(words) / max(1, lines)) / 5, len(set(data)) / 100, float(not data)]
        assert np.allclose(row[256:265], want)
    got = {r["doc_id"]: r["score"] for r in quality.score(documents(some), model).collect()}
    for i, row in enumerate(x):
        z = sum(min(10, max(-10, (v - m) / s)) * w for v, m, s, w in zip(row, model.mean, model.scale, model.weights)) + model.bias
        assert abs(got[i] - 1 / (1 + math.exp(-min(30, max(-30, z))))) < 1e-6


@pytest.mark.parametrize("model", [quality, toxicity])
def test_accepted_rows_of_awkward_tables(spark, awkward, model):
    column, wanted = ("quality", 1) if model is quality else ("toxic", 0)
    known = spark.createDataFrame([(5, 1), (9, 0), (4, 1), (8, 0), (3, 1), (2, 0)], f"doc_id long, {column} int")
    fitted = model.fit(awkward, known)
    kept, scores = model.accepted(awkward, fitted), model.score(awkward, fitted).collect()
    assert kept.columns == awkward.columns and kept.count() == sum(r["predicted"] == wanted for r in scores)
    assert model.accepted(awkward.limit(0), fitted).count() == 0


def test_one_doc_id_of_many_rows_is_learned_from_once(spark, documents):
    docs = documents([(7, f"text {i}") for i in range(500)] + [(i, f"other words {i} here") for i in range(20, 60)])
    labels = spark.createDataFrame([(i, 1) for i in range(20, 40)], "doc_id long, quality int")
    keys = docs.select("doc_id").distinct().count()
    seen = []
    plain = quality._matrix
    quality._matrix = lambda rows: seen.append(m := plain(rows)) or m
    try:
        quality.fit(docs, labels)
    finally:
        quality._matrix = plain
    assert sum(map(len, seen)) <= keys
