"""The corpus pipeline: from raw documents to packed training windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared scratch folder and reads it again for the next
stage. Every stage works on all that its predecessor kept, and all but the last
return the columns of ``documents``.

1. quality: documents that the positive-unlabelled classifier rejects go
2. toxicity: documents that the subword model calls toxic go
3. near_duplicates: of each group of near-duplicates the least doc_id stays
4. personal_data: identifiers, plain or disguised, are masked in the texts
5. packing: windows of at most 1024 tokens, one row for each piece

Each row is judged by its own text. Models, their labels and their held-out fold
are those of the operators; no label is looked at when a row is judged.

A null text is judged as an empty one by the models, is no one's near-duplicate,
stays null under masking and is packed as an end id alone; texts are never cut,
however long. Of rows that tie or repeat, the models keep all or none; rows that
repeat a doc_id count as one document in near_duplicates and stay or go together;
a row without doc_id stays there. An empty table gives an empty one, of the
columns of ``documents`` or, at the end, of pieces. Further columns, whatever
their names, are kept up to packing, which ignores them. Where labels hold too
little to learn from, the quality stage rejects all and the toxicity stage none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.llm import minhash, packing, pii, quality, toxicity
from verdikt.llm.common import Scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs, Scratch(spark, "pipeline-dedup")).select(*docs.columns)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, Scratch(spark, "pipeline-packing"))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: No SQL: the models are trained, the packing is greedy. tests/llm holds run() against the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
