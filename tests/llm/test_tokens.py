import functools
import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from oracle import DATA
from verdikt.llm import bpe, orc_tokens, packing, units
from verdikt.llm.units import UnitEncoder

RANKS, FILE = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
PARTS = ["a", "the", "’", " ", "  ", "\n", "\n\n", "\t", ".", "'s", "'", "5", "é", "ß", "漢", "\u00a0", "\u2028", "\x1c", "!", "n't", "<|endoftext|>", "\r\n", "\u0301", "|", "x" * 300]


@functools.cache
def tokenizer():
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("memory", [1_200_000, 40])
def test_units_equal_whole_texts(memory):
    rng = random.Random(3)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(6000)] + ["", "x" * 3000, " ", "a\n", "\na"]
    whole = [e.ids for e in tokenizer().encode_batch(texts, add_special_tokens=False)]
    for encoder in (bpe.file_encoder(FILE), bpe.rank_encoder(RANKS, P.PATTERN)):
        encoder = UnitEncoder(encoder._all, encoder._piece, memory)
        got = [np.frombuffer(raw, "<u4").tolist() for at in range(0, len(texts), 100) for raw in encoder.encode(texts[at : at + 100])]
        assert got == whole


@pytest.mark.parametrize("n", [4095, 4096, 4097, 9000])
def test_runs_of_white_space_equal_whole_texts(n):
    """About the length from which runs are cut out; the separator 0x1C is no white space to the patterns."""
    runs = [" " * n, "\n" * n, " \n" * n, "\u00a0\u2003" * n, "\t" * n + " ", " " * n + "\x1c" + " " * n]
    texts = [before + run + after for run in runs for before in ("", "a", "漢 ") for after in ("", "b", "'s", "é  ", "\x1c", " !" + run + "x")]
    whole = [e.ids for e in tokenizer().encode_batch(texts, add_special_tokens=False)]
    for encoder in (bpe.file_encoder(FILE), bpe.rank_encoder(RANKS, P.PATTERN)):
        assert [np.frombuffer(raw, "<u4").tolist() for raw in encoder.encode(texts)] == whole


def test_long_runs_are_all_seen():
    rng = random.Random(8)
    for _ in range(400):
        parts = [rng.choice(["word ", "x", " " * rng.choice([1, 2000, 2048, 4095]), rng.choice(" \n\t") * rng.randint(4090, 9000), "a" * rng.randint(1, 5000)]) for _ in range(rng.randint(1, 9))]
        text = "".join(parts)
        assert units.long_runs(text) == [m.span() for m in re.finditer(r"[ \n\t]{4096,}", text)]


def test_two_million_characters_of_one_class(documents):
    n = 2_000_000
    runs = [" " * n, "\n" * n, "\t" * n, "\u3000" * n, " \r\n" * (n // 3) + "end", "漢" * n, "x" * n, "5" * n, "!" * n, "'" * n, "漢a1!" * (n // 4), "a " * (n // 2)]
    rows = {r["doc_id"]: r for r in bpe.digests(documents(runs, parts=4), RANKS, P.PATTERN).collect()}
    assert all(rows[i]["exact"] and rows[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(runs))
    encoder = bpe.file_encoder(FILE)
    assert [len(encoder.encode([t])[0]) // 4 for t in runs] == [rows[i]["n_tokens"] for i in range(len(runs))]


def test_codec(spark, awkward):
    encoding = bpe.rank_encoding(RANKS, P.PATTERN)
    assert isinstance(encoding, tiktoken.Encoding)
    rows, texts = bpe.digests(awkward, RANKS, P.PATTERN).collect(), [(r["doc_id"], r["text"] or "") for r in awkward.collect()]
    whole = [(str(key), encoding.encode_ordinary(text)) for key, text in texts]
    expected = sorted((key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) for key, ids in whole)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"]) for r in rows) == expected and all(r["exact"] for r in rows)
    assert sorted(r["decoded_sha256"] for r in rows) == sorted(hashlib.sha256(t.encode()).hexdigest() for _, t in texts)
    back = bpe.decode(bpe.encode(awkward, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted(bytes(r["raw"]) for r in back) == sorted(t.encode() for _, t in texts)
    lone = spark.createDataFrame([(1, [5]), (2, []), (3, None), (4, [223])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: bytes(r["raw"]) for r in bpe.decode(lone, RANKS, P.PATTERN).collect()}[2] == b""
    assert bpe.digests(awkward.limit(0), RANKS, P.PATTERN).count() == 0


def test_orc_files(spark, awkward, scratch):
    path = scratch().path("t.orc")
    orc_tokens.write(awkward, path, FILE, 2)
    rows = sorted(orc_tokens.digests(spark, path).collect(), key=lambda r: r["start"])
    texts = sorted(((r["doc_id"] if r["doc_id"] is not None else -(10**9), r["text"] or "") for r in awkward.collect()))
    ids = [e.ids + [2] for e in tokenizer().encode_batch([t for _, t in texts], add_special_tokens=False)]
    assert [r["start"] for r in rows] == np.cumsum([0, *map(len, ids)])[:-1].tolist()
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted((len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for i in ids)
    assert [r["doc_id"] for r in rows] == [None, *(k for k, _ in texts[1:])]
    assert orc_tokens.lookup(spark, path, [5, -7, 99]).count() == 3
    plan = orc_tokens.lookup(spark, path, [5])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualTo(doc_id,5)" in plan or "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)" in plan or "In(doc_id" in plan
    empty = scratch().path("e.orc")
    orc_tokens.write(awkward.limit(0), empty, FILE, 2)
    assert orc_tokens.digests(spark, empty).count() == 0


def test_orc_metadata(spark, scratch, monkeypatch):
    """Footers: several stripes, run-length encoded ids, row indexes and Bloom filters on doc_id; and what a lookup reads."""
    monkeypatch.setattr(orc_tokens, "STRIPE", 1 << 16)
    path, n = scratch().path("m.orc"), 44_000
    docs = spark.range(n).selectExpr("id * 3 as doc_id", "concat('some words of document ', id, ' and ', id * 7) as text").coalesce(1)
    orc_tokens.write(docs, path, FILE, 2)
    jvm, stripes, groups = spark._jvm, 0, 0
    for file in spark.read.orc(path).inputFiles():
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(file), jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
        assert reader.getRowIndexStride() == orc_tokens.ROW_GROUP and reader.getSchema().getFieldNames().get(0) == "doc_id"
        rows = reader.rows()
        for stripe in reader.getStripes():
            footer = rows.readStripeFooter(stripe)
            kinds = [(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()]
            assert (1, "BLOOM_FILTER_UTF8") in kinds and (1, "ROW_INDEX") in kinds and not any(k.startswith("BLOOM") and c != 1 for c, k in kinds)
            assert footer.getColumns(3).getKind().toString() == "DIRECT_V2"  # the ids: run lengths of integers
            stripes, groups = stripes + 1, groups + -(-stripe.getNumberOfRows() // orc_tokens.ROW_GROUP)
        rows.close()
    assert stripes >= 2 * len(spark.read.orc(path).inputFiles()) and groups >= n // orc_tokens.ROW_GROUP

    def read_by(ids):
        found = orc_tokens.lookup(spark, path, ids)
        rows = found.collect()
        leaf = found._jdf.queryExecution().executedPlan().collectLeaves().head()
        return len(rows), leaf.metrics().apply("numOutputRows").value()

    some, read = read_by([3 * 12_345])
    assert some == 1 and read <= orc_tokens.ROW_GROUP  # one row group by its minimum and maximum
    some, read = read_by([3 * 12_345 + 1])
    assert some == 0 and read == 0  # within the bounds, but not in the Bloom filter


def check_packing(rows, texts, window=1024):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    ids = {}
    for key, text in texts:
        ids.setdefault(key, []).append(tokenizer().encode(text, add_special_tokens=False).ids + [0])
    assert set(ids) == set(by_doc) and sum(r["length"] for r in rows) == sum(len(i) for x in ids.values() for i in x)
    for key, lists in ids.items():
        if len(lists) == 1:
            at = 0
            for r in sorted(by_doc[key], key=lambda r: r["start"]):
                assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(lists[0]), zlib.crc32(np.array(lists[0][at : at + r["length"]], "<u4").tobytes()))
                at += r["length"]
            assert at == len(lists[0])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_rows_of_tokens_equal_whole_texts(awkward):
    """Ids with their end id, of 16 or 32 bits, and the tasks' frequencies of them."""
    texts = [r["text"] or "" for r in awkward.collect()]
    whole = [e.ids for e in tokenizer().encode_batch(texts, add_special_tokens=False)]
    for size, kind in ((1 << 16, "<u2"), (1 << 17, "<u4")):
        rows = packing.tokenised(awkward, FILE, size - 1, size).collect()
        ids = [np.frombuffer(r["ids"], kind).tolist() for r in rows if r["ids"] is not None]
        assert sorted(ids) == sorted(i + [size - 1] for i in whole)
        sums = [r for r in rows if r["df"] is not None]
        df = sum(np.frombuffer(r["df"], np.int64) for r in sums)
        assert df.tolist() == np.bincount([t for i in whole for t in set(i)], minlength=size).tolist()
        assert (sum(r["documents"] for r in sums), sum(r["tokens"] for r in sums)) == (len(whole), sum(map(len, whole)))


@pytest.mark.parametrize("shard", [400_000, 3000])
def test_packing(awkward, scratch, shard):
    rows = packing.pack(awkward, FILE, 0, scratch(), shard_tokens=shard).collect()
    assert check_packing(rows, [(r["doc_id"], r["text"] or "") for r in awkward.collect()]) == 0
    assert packing.pack(awkward.limit(0), FILE, 0, scratch()).count() == 0


def test_packing_joins_like_documents(documents, scratch):
    """Short documents of two vocabularies: windows hold one of them, but for those at a seam."""
    rng = random.Random(5)
    words = [[f"{c}{a}{b}" for a in "aeiou" for b in "bcdfg"] for c in ("zug", "qim")]
    texts = [" ".join(rng.choices(words[i % 2], k=60)) for i in range(200)]
    rows = packing.pack(documents(texts), FILE, 0, scratch()).collect()
    assert check_packing(rows, list(enumerate(texts))) == 0
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], set()).add(r["doc_id"] % 2)
    assert sum(len(v) == 1 for v in windows.values()) > 0.8 * len(windows)


@pytest.mark.parametrize("topics", [40, 160])
def test_packing_joins_like_documents_of_many_shards(documents, scratch, topics):
    """Four documents of each topic fill about a window; the shards hold few of all topics."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    common = [word() for _ in range(30)]
    texts = []
    for _ in range(topics):
        base = [word() if rng.random() < 0.7 else rng.choice(common) for _ in range(80)]
        texts += [" ".join(w if rng.random() < 0.95 else rng.choice(common) for w in base) for _ in range(4)]
    order = rng.sample(range(len(texts)), len(texts))
    rows = packing.pack(documents([(i, texts[i]) for i in order]), FILE, 0, scratch(), shard_tokens=10_000).collect()
    assert check_packing(rows, list(enumerate(texts))) == 0
    assert len({r["sequence_id"] >> 24 for r in rows}) >= topics // 16
    windows = {}
    for r in rows:
        windows.setdefault(r["doc_id"], set()).add(r["sequence_id"])
    met = [any(windows[i] & windows[j] for j in range(i // 4 * 4, i // 4 * 4 + 4) if j != i) for i in range(len(texts))]
    assert sum(met) > 0.8 * len(met)


@pytest.mark.parametrize("at_once", [2000, 10])
def test_packing_ranks_by_all_tokens_of_a_seed(monkeypatch, at_once):
    """Ranks equal those of BM25 written out, for seeds of far more tokens than the heaviest few."""
    monkeypatch.setattr(packing, "AT_ONCE", at_once)
    rng = np.random.default_rng(2)
    ids = [rng.choice(400, size=rng.integers(0, 300), p=(w := 1 / np.arange(1, 401)) / w.sum()) for _ in range(150)]
    ids += [ids[3], ids[3], np.array([399] * 5), np.zeros(0, np.int64)]
    held = np.array([np.bincount(i, minlength=400) for i in ids])
    df, length = (held > 0).sum(0), held.sum(1)
    idf, mean = np.log1p((len(ids) - df + 0.5) / (df + 0.5)), length.mean()
    weights = idf * held * (packing.K1 + 1) / (held + packing.K1 * (1 - packing.B + packing.B * length[:, None] / mean))
    index = packing.Index([i.astype(np.uint16) for i in ids], idf, mean)
    for seed in range(len(ids)):
        score = np.round((weights * (held[seed] > 0) * (df > 1)).sum(1), 9)
        found = np.flatnonzero(score)
        assert index.ranked(seed).tolist() == found[np.argsort(-score[found], kind="stable")].tolist()


def test_frequencies_are_summed_level_by_level(spark, monkeypatch):
    monkeypatch.setattr(packing, "SUMS", 3)
    rng = np.random.default_rng(4)
    parts = [(rng.integers(0, 9, 20), int(rng.integers(1, 5)), int(rng.integers(0, 50))) for _ in range(40)]
    rows = spark.createDataFrame([(bytearray(df.astype(np.int64).tobytes()), d, t) for df, d, t in parts], "df binary, documents long, tokens long").repartition(13)
    df, documents, tokens = packing.statistics(rows, 20)
    assert df.tolist() == sum(p[0] for p in parts).tolist() and (documents, tokens) == (sum(p[1] for p in parts), sum(p[2] for p in parts))
    assert packing.statistics(rows.limit(0), 20)[0].tolist() == [0] * 20


def test_a_sketch_of_many_documents_is_dealt_among_shards():
    bounds = np.array([3, 7, 7, 7, 9])
    shards = packing.dealt(np.array([1, 3, 8, 10] + [7] * 3000), np.arange(3004), bounds)
    assert shards[:4].tolist() == [0, 0, 4, 5]
    assert np.bincount(shards[4:]).tolist()[:1] == [0] and (np.bincount(shards[4:])[1:4] > 800).all() and len(np.bincount(shards[4:])) == 4


def test_packing_of_real_documents(spark, small, scratch):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    assert check_packing(packing.pack(docs, FILE, 0, scratch(), shard_tokens=50_000).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()]) == 0


def test_shards_are_cut_from_sorted_ranges(documents, scratch, monkeypatch):
    """A range gives any number of shards, and what the driver samples does not grow with them."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps"], k=40)) for _ in range(400)] + ["same words in all of these " * 4] * 200
    monkeypatch.setattr(packing, "RANGES", 2)
    monkeypatch.setattr(packing, "BOUND_SAMPLE", 8)
    rows = packing.pack(documents(texts), FILE, 0, scratch(), shard_tokens=2000).collect()
    assert check_packing(rows, list(enumerate(texts))) == 0
    seen = {r["sequence_id"] >> 24 for r in rows}
    assert {s >> 22 for s in seen} == {0, 1} and len(seen) >= 10


def test_shards_of_a_range():
    part = pa.RecordBatch.from_pydict({"doc_id": list(range(6)), "ids": [b"ab", b"cd", b"x" * 20, b"ef", b"gh", b"ij"]})
    assert [k for k, _ in packing.shards([part, part], 5)] == [[0, 1], [2], [3, 4], [5, 0], [1], [2], [3, 4], [5]]


def test_words_go_to_the_model_alone():
    """Plain words take the library's short way, all others the long one; both give the ids of the whole text."""
    rng = random.Random(12)
    letters = [chr(c) for c in range(256) if chr(c).isalpha()] + list("abcdefgh" * 9)
    others = ["Ā", "œuf", "漢字", "ǅ", "é", "don't", "'s", "x1", "²", "½", "a²", "ª", "µ", "º", "s", "ll", "<|endoftext|>", "x" * 201, "é" * 300, "a.\nb", "ß,,", "\x85", "\xad"]
    words = ["".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(4000)]
    texts = [" ".join(rng.choices(words, k=20) + rng.choices(others, k=rng.randint(0, 4))) for _ in range(1500)]
    given = []
    plain = bpe.file_encoder(FILE)
    encoder = UnitEncoder(lambda units: given.extend(units) or plain._all(units), plain._piece, encode_word=plain._word)
    whole = [e.ids for e in tokenizer().encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(raw, "<u4").tolist() for at in range(0, len(texts), 100) for raw in encoder.encode(texts[at : at + 100])] == whole
    long_way = {p.removeprefix(" ") for unit in given for p in unit.split("\n")} - {text.split(" ")[0] for text in texts}
    assert not long_way.intersection(words)  # before: nearly all of them


def test_words_take_the_long_way_where_other_steps_come_first(tmp_path):
    steps = json.loads(open(FILE, encoding="utf-8").read())
    for n, change in enumerate([{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": steps["pre_tokenizer"] | {"add_prefix_space": True}}, {"added_tokens": [{**steps["added_tokens"][0], "id": steps["model"]["vocab"]["the"], "content": "the"}]}]):
        path = str(tmp_path / f"{n}.json")
        with open(path, "w", encoding="utf-8") as file:
            json.dump(steps | change, file)
        assert bpe.word_encoder(path) is None
    assert bpe.word_encoder(FILE) is not None


@pytest.mark.parametrize("memory", [1_200_000, 60])
def test_stops_and_line_breaks_are_pieces_of_their_own(memory):
    """Stops after letters are parted from them, after anything else not; equal to whole texts, and a word is learned once."""
    rng = random.Random(21)
    parts = ["word", "Wort", "é", "漢", "Ж", "\U0001e900", "ª", "5", "²", "%%", ")", "'", "'s", "\0", "\0.", ".", ",", "\u0301", "\x1c", "\t", "\u00a0", "x" * 210]
    glue = [" ", " ", " ", ". ", ", ", "\n", ".\n", "  ", "\n\n", " \n", "..", ". . ", ",,  "]
    texts = ["".join(rng.choice(parts if i % 2 else glue) for i in range(rng.randint(0, 16))) for _ in range(8000)]
    whole = [e.ids for e in tokenizer().encode_batch(texts, add_special_tokens=False)]
    for plain in (bpe.file_encoder(FILE), bpe.rank_encoder(RANKS, P.PATTERN)):
        encoder = UnitEncoder(plain._all, plain._piece, memory, plain._word)
        got = [np.frombuffer(raw, "<u4").tolist() for at in range(0, len(texts), 500) for raw in encoder.encode(texts[at : at + 500])]
        assert got == whole
        ids, cuts = encoder.encode_flat(pa.array([None, *texts[:40], None]))
        assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == [[], *whole[:40], []]
    encoder = UnitEncoder(plain._all, plain._piece)
    before = len(encoder._after)
    encoder.encode([f"a word{end}next word" for end in [" ", ". ", ", ", ".\n", ",\n", "\n"]])
    assert len(encoder._after) - before == 4  # "a", "word", "next", "\nnext": none with a stop or with a break inside


def test_words_are_parted_by_the_model():
    """Many words in one string for the model give the ids of each alone."""
    rng = random.Random(22)
    letters = [chr(c) for c in range(256) if chr(c).isalpha()] + list("abcdefgh" * 9)
    words = ["".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(1000)]
    encode = bpe.word_encoder(FILE)
    for lead in (" ", "\n"):
        whole = [e.ids for e in tokenizer().encode_batch([lead + w for w in words], add_special_tokens=False)]
        assert [np.frombuffer(raw, "<u4").tolist() for raw in encode(words, lead)] == whole
        assert encode([], lead) == []


@pytest.mark.parametrize("merge", [("a", "\u0120"), ("\u010a", "a")])
def test_words_take_the_long_way_where_a_merge_crosses_them(tmp_path, merge):
    steps = json.loads(open(FILE, encoding="utf-8").read())
    steps["model"]["vocab"]["".join(merge)] = len(steps["model"]["vocab"]) + 1
    steps["model"]["merges"].append(list(merge) if isinstance(steps["model"]["merges"][0], list) else " ".join(merge))
    path = str(tmp_path / "crossing.json")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(steps, file)
    assert bpe.word_encoder(path) is None
