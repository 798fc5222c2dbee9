import public_tokenizers
import pytest

import corpus_pipeline as C
from test_near import brute
from test_tokens import check_packing
from verdikt.llm import pii, quality, toxicity

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    columns, held = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in C.STAGES] == ["quality", "toxicity", "near_duplicates", "personal_data", "packing"]
    for stage, model, wanted in ((C.quality_stage, quality, 1), (C.toxicity_stage, toxicity, 0)):
        out = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        scores = {r["doc_id"]: r["predicted"] for r in model.score(docs, model.fit(docs, labels)).collect()}
        assert {r["doc_id"] for r in out.collect()} == {k for k in held if scores[k] == wanted} and out.columns == columns
        docs, held = out, {r["doc_id"]: r["text"] for r in out.collect()}
    assert 0.6 < len(held) / 1000 < 0.95
    out = spark.createDataFrame(C.near_duplicate_stage(spark, docs, SF).collect(), docs.schema)
    root = brute(sorted(held.items()))
    assert {r["doc_id"] for r in out.collect()} == {k for k in held if root[k] == k}
    docs, held = out, {k: t for k, t in held.items() if root[k] == k}
    out = spark.createDataFrame(C.personal_data_stage(spark, docs, SF).collect(), docs.schema)
    for r in out.collect():
        base, added = pii.spans_of(held[r["doc_id"]])
        assert r["text"] == pii.masked(held[r["doc_id"]], base + added) and r["n_chars"] == len(r["text"]) and not pii.plain_spans(r["text"])
    rows = C.packing_stage(spark, out, SF).collect()
    assert check_packing(rows, [(r["doc_id"], r["text"]) for r in out.collect()]) == 0
    assert public_tokenizers.PATTERN


def test_run_is_repeatable(spark):
    once, again = (sorted(map(tuple, C.run(spark, "/root/testdata/sf0.001").select("doc_id", "start", "length", "ids_crc32").collect())) for _ in range(2))
    assert once and {r[0] for r in once} == {r[0] for r in again}


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_stages_on_awkward_tables(spark, awkward, tmp_path, name):
    """Nulls, empty and very long texts, repeated rows, null ids, clashing columns, tables without rows."""
    stage, sf = dict(C.STAGES)[name], str(tmp_path)
    labels = [(5, 1, 0), (9, 0, 1), (4, 1, 0), (8, 0, 1), (3, 1, 0), (2, 0, None), (None, 1, 1), (6, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{sf}/labels.parquet")
    clashing = awkward.selectExpr("*", "true as kept", "0L as component_id", "0 as n", "'x' as sketch", "0L as place", "1 as label")
    out, rows = stage(spark, clashing, sf), clashing.count()
    if name == "packing":
        assert check_packing(out.collect(), [(r["doc_id"], r["text"] or "") for r in clashing.collect()]) == 0
    else:
        assert out.columns == clashing.columns and out.count() <= rows
        if name == "near_duplicates":
            assert out.where("doc_id is null").count() == clashing.where("doc_id is null").count() and out.where("text is null").count() == 1
        if name == "personal_data":
            assert out.count() == rows and out.where("text is null").count() == 1
    empty = stage(spark, clashing.limit(0), sf)
    assert empty.count() == 0 and empty.columns == out.columns
