import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from oracle import same
from pyspark.sql import functions as F

from verdikt.llm import ego, minhash
from verdikt.llm.components import components
from verdikt.llm.queries import ORACLES, QUERIES
from verdikt.llm.sketch import sketches
from verdikt.llm.words import shingle_sets

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Union(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, x, y):
        a, b = self.find(x), self.find(y)
        self[max(a, b)] = min(a, b)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(docs):
    sets, where, union = [(k, shingles(t)) for k, t in docs], defaultdict(list), Union()
    for i, (key, found) in enumerate(sets):
        union.find(key)
        shared = Counter(j for s in found for j in where[s])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(found) + len(sets[j][1]) - n):
                union.join(key, sets[j][0])
        for s in found:
            where[s].append(i)
    return {key: union.find(key) for key, _ in sets}


def edited(rng, words, share):
    return " ".join(rng.choice(["new", "other", "word"]) + str(rng.randint(0, 999)) if rng.random() < share else w for w in words)


@pytest.mark.parametrize("block", [512, 8])
def test_near_duplicates(documents, scratch, monkeypatch, block):
    """Families of copies edited lightly and heavily about the limit, exact copies, a shared passage."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    passage, texts = " ".join(word() for _ in range(60)), []
    for size in (1, 2, 5, 60):
        base = [word() for _ in range(120)]
        texts += [edited(rng, base, rng.choice([0, 0.01, 0.02, 0.03, 0.05])) for _ in range(size)]
    texts += [" ".join(word() for _ in range(rng.randint(5, 90))) + " " + passage for _ in range(40)]
    texts += ["Short One", "short  one", "short\tone", "a b c d e f", "", None, " \n"]
    docs = [*enumerate(texts), (3, texts[4] + " tail"), (None, "short one")]
    rng.shuffle(docs)
    got = minhash.linked(documents(docs), scratch()).collect()
    expected = brute([d for d in docs if d[0] is not None])
    assert len(got) == len(docs)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == expected[r["doc_id"]] and r["kept"] == (expected[r["doc_id"]] == r["doc_id"])
    assert sorted((str(r["doc_id"]), r["n_shingles"]) for r in got) == sorted((str(k), len(shingles(t))) for k, t in docs)
    assert len(set(expected.values())) < len(expected) - 35


@pytest.mark.parametrize("block", [512, 100])
def test_a_template_below_the_limit_emits_no_pairs(spark, documents, scratch, monkeypatch, block):
    """2,000 documents of pairwise similarity about 0.65 share buckets but not links; what leaves the tasks grows with the documents."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    template = [word() for _ in range(80)]
    docs = documents([(i, " ".join([*template, *(word() for _ in range(17))])) for i in range(2000)])
    seen = {}
    for name in ("candidates", "confirmed"):
        monkeypatch.setattr(minhash, name, lambda *a, f=getattr(minhash, name), name=name: seen.setdefault(name, f(*a).cache()))
    rows = minhash.linked(docs, scratch()).collect()
    assert all(r["kept"] for r in rows) and len(rows) == 2000
    held = seen["candidates"]
    blocks = held.select("key").distinct().count() * -(-2000 // block)
    assert held.count() > 2000 and held.count() <= 2000 * blocks and "partners" not in held.columns and seen["confirmed"].count() == 0
    assert [f.dataType.typeName() for f in held.schema] == ["long", "integer", "integer", "integer", "long", "long", "long", "array", "binary"]


def test_a_clique_comes_out_as_a_forest(spark):
    """Of the links among documents of one pair of blocks a task gives one less than there are documents in each component."""
    texts = [f"one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen end{i % 3}" for i in range(60)] + ["something else altogether here now " + str(i) * 3 for i in range(4)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sketched = minhash.sketched(docs).where("n > 0")
    held = sketched.select(F.element_at("bands", 1).alias("key"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("mine"), "doc_id", "n", F.col("doc_id").alias("root"), F.transform("bands", lambda b: b * 0 + F.xxhash64("doc_id")).alias("bands"), "sketch")
    held = held.withColumn("key", F.lit(1).cast("long")).withColumn("bands", F.concat(F.array(F.lit(1).cast("long")), F.slice("bands", 2, 31)))
    edges = minhash.confirmed(held, docs).collect()
    union = Union()
    for a, b in edges:
        union.join(a, b)
    assert len(edges) == 59 and len({union.find(i) for i in range(60)}) == 1


def test_near_duplicates_query(spark):
    folder = "/root/testdata/sf0.001"
    same(QUERIES["op6_minhash_dedup"](spark, folder), folder, ORACLES["op6_minhash_dedup"])


def test_dedup_keeps_one(documents, scratch, awkward):
    docs = documents(["one two three four five six"] * 3 + ["else"] + [None, None])
    assert sorted(r["doc_id"] for r in minhash.deduplicate(docs, scratch()).collect()) == [0, 3, 4, 5]
    assert minhash.deduplicate(docs, scratch()).columns == docs.columns
    assert minhash.linked(awkward, scratch()).count() == awkward.count()
    assert minhash.linked(awkward.limit(0), scratch()).count() == 0


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(0)
    common, parts = rng.integers(0, 2**62, 3000).astype(str), rng.integers(0, 2**62, (2, 1000)).astype(str)
    sets = shingle_sets(pa.array(["one", *(" ".join(np.r_[common, p]) for p in parts), ""]), 1)
    found = sketches(sets, 512)
    assert (found[:3] != np.iinfo(np.uint64).max).all() and (found[3] == 0).all()
    assert abs((found[1] == found[2]).mean() - 0.6) < 0.08


@pytest.mark.parametrize("shape", ["path", "star", "random", "loops"])
def test_components(spark, scratch, shape):
    rng = random.Random(7)
    edges = {"path": [(i, i + 1) for i in range(70)], "star": [(0, i) for i in range(1, 80)], "random": [(rng.randint(0, 99), rng.randint(0, 99)) for _ in range(70)], "loops": [(1, 1), (2, None), (None, 3)]}[shape]
    union = Union()
    for a, b in edges:
        if a is not None and b is not None and a != b:
            union.join(a, b)
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), scratch(), "t").collect()}
    assert got == {x: union.find(x) for x in list(union)}


def test_embeddings_query(spark):
    folder = "/root/testdata/sf0.001"
    same(QUERIES["op7_ego_embeddings"](spark, folder), folder, ORACLES["op7_ego_embeddings"])

def brute_links(vectors):
    """(links of each usable vector, union of what is linked), length by length."""
    count, union = {}, Union()
    usable = [i for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and any(v)]
    for size in {len(vectors[i]) for i in usable}:
        some = [i for i in usable if len(vectors[i]) == size]
        x = np.array([vectors[i] for i in some], np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        links = x @ x.T >= 0.95
        for a, b in zip(*np.nonzero(links)):
            union.join(some[a], some[b])
        count.update(zip(some, links.sum(axis=1) - 1))
    return count, union


@pytest.mark.parametrize("kind", ["float", "double"])
def test_grid_join(spark, scratch, monkeypatch, kind):
    """Clusters, copies, scaled copies, other lengths and unusable vectors, with intervals small enough to recurse."""
    for name, value in {"INTERVAL": 16, "LEAF": 4, "FAN": 3, "STRIP_INTERVALS": 5}.items():
        monkeypatch.setattr(ego, name, value)
    rng = np.random.default_rng(1)
    vectors = [v.tolist() for c in rng.normal(0, 1, (12, 8)) for v in c + rng.normal(0, 0.12, (15, 8))]
    vectors += [vectors[0]] * 6 + [[2 * x for x in vectors[1]], [-x for x in vectors[1]], [0.0] * 8, [1.0, None] * 4, [float("nan")] * 8, [float("inf")] * 8, [], None, [1.0] * 5, [1e-38] * 8, [1e38] * 8]
    vectors += [[1.0, 0.01], [1.0, 0.0], [3.0], [1.0], [-2.0], [1.0, 0.02], *[v.tolist() for v in rng.normal(1, 0.3, (30, 9))], [1.0] * 100, [1.0] * 99 + [1.1], [1.0, *[0.0] * 7, 0.0]]
    if kind == "double":
        vectors += [[1e300] * 8, [1e-300] * 8, [5e-324, 0.0, 0.0], [1.0, 0.0, 0.0], [1e-60, 1e-60, 0.0], [1e200, 1e200, 0.0], [1 + 1e-12, 1.0], [1.0, 1.0]]
    else:
        vectors = [v and [x if x is None else float(np.float32(x)) for x in v] for v in vectors]
    rows = spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(vectors)], f"vec_id long, embedding array<{kind}>, size int, raw string").repartition(5)
    rows = rows.unionByName(spark.createDataFrame([(None, vectors[0], 1, "x")], rows.schema))
    count, union = brute_links(vectors)
    got = {r["vec_id"]: r for r in ego.linked(rows, scratch()).collect()}
    assert len(got) == len(vectors) + 1 and got[None]["n_links"] == 0 and got[None]["kept"]
    for i in range(len(vectors)):
        assert (got[i]["n_links"], got[i]["component_id"]) == (count.get(i, 0), union.find(i)), i
    assert ego.linked(rows.limit(0), scratch()).count() == 0


def test_a_vector_is_sent_to_few_tasks(spark, scratch):
    """However little the boxes can tell apart, an interval goes to at most STRIPS groups, not to one for each partner."""
    rng = np.random.default_rng(5)
    grid = ego.Axes("<f4", np.eye(16))
    rows = [(i, rng.normal(0, 1, 16).astype("<f4").tobytes()) for i in range(2000)]
    classes = spark.createDataFrame(rows, "rep long, raw binary").selectExpr("rep", "1L as weight", "16 as size", "raw")
    cut = ego.ordered(classes, grid, ego.epsilon(0.95), 1).toPandas()
    assert cut["ids"].map(len).sum() == 2000 and len(cut) == 1
    nodes = spark.range(64).selectExpr("id as node", "array(id) as ids", "array(1L) as weights").withColumn("raw", F.lit(np.ones(16, "<f4").tobytes()))
    pairs = spark.range(64).selectExpr("id as a").crossJoin(spark.range(64).selectExpr("id as b")).where("a <= b")
    out = ego.joined(pairs, nodes, 8, grid, 0.95)
    tasks = out.where("n is not null").groupBy("rep").agg(F.count(F.lit(1)).alias("tasks"), F.sum("n").alias("n")).collect()
    assert len(tasks) == 64 and all(r["tasks"] == 8 and r["n"] == 63 for r in tasks)
