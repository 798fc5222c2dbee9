"""Token ids in ORC files: run-length encoded stripes, row indexes, Bloom filters.

``write`` range-partitions the documents by id, so that each file holds one
interval of ids in ascending order, and tokenises after the shuffle. The ORC
writer stores ids as run-length encoded integers in stripes, compressed lightly
on top, and keeps minima and maxima for every ``ROW_GROUP`` rows and a Bloom
filter on ``doc_id``; a lookup by id therefore skips files, stripes and row
groups by their metadata, and a scan is dealt out by stripe. Each row also has
the number of ids that stand before it in its own file (``ahead``) and the
file's place in order (``part``), so a document's global start needs only one
total for each file.

Null text is written as an empty document (the end id alone), a null doc_id
comes first, repeated rows are all written, extra columns are not. An empty
table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.llm.bpe import SLICE, file_encoder
from verdikt.llm.common import slices, tasks, texts

SCHEMA = "doc_id long, ids array<int>, n_tokens long, ahead long, part int"
#: Rows between two entries of the row index, bytes of a stripe, false positives of the Bloom filter.
ROW_GROUP, STRIPE, FALSE_HITS = 1000, 16 << 20, 0.01


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Writes every document's ids, ``end_id`` appended, as ORC files under ``path``."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("ahead", pa.int64()), ("part", pa.int32())])

    def run(parts):
        encoder, place, ahead = file_encoder(tokenizer), TaskContext.get().partitionId(), 0
        for part in parts:
            for some in slices(part, "text", SLICE):
                ids, bare = encoder.encode_flat(some.column("text"))
                ids, cuts = np.insert(ids, bare[1:], end_id).view("<i4"), bare + np.arange(len(bare))
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids))
                columns = [some.column("doc_id"), lists, pa.array(np.diff(cuts)), pa.array(ahead + cuts[:-1]), pa.array(np.full(some.num_rows, place, np.int32))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                ahead += int(cuts[-1])

    keyed = texts(docs, "doc_id").withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("text")]
    ranged = keyed.repartitionByRange(tasks(docs), *order[:2]).sortWithinPartitions(*order)
    ids = ranged.select("doc_id", "text").mapInArrow(run, SCHEMA)
    (
        ids.write.mode("overwrite").option("orc.compress", "SNAPPY").option("orc.stripe.size", STRIPE)
        .option("orc.create.index", "true").option("orc.row.index.stride", ROW_GROUP)
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", FALSE_HITS).orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The written rows; filters on doc_id are pushed down to the files' metadata."""
    return spark.read.schema(SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some ids, by minima, maxima and Bloom filters."""
    return read(spark, path).where(F.col("doc_id").isin([int(i) for i in doc_ids]))


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): ids that stand before each file. One short row a file, summed on the driver."""
    totals = read(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    rows, base = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in totals):
        rows.append((part, base))
        base += n
    return spark.createDataFrame(rows, "part int, base long")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""
    schema = pa.schema([("doc_id", pa.int64()), ("ahead", pa.int64()), ("part", pa.int32()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(parts):
        for part in parts:
            ids = part.column("ids")
            cuts = ids.offsets.to_numpy()
            raw, at = memoryview(ids.values.to_numpy(zero_copy_only=False)).cast("B"), (4 * cuts).tolist()
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ahead"), part.column("part"), pa.array(np.diff(cuts), pa.int64()), pa.array(crc, pa.int64())], schema=schema)

    rows = read(spark, path).select("doc_id", "ids", "ahead", "part").mapInArrow(run, "doc_id long, ahead long, part int, n_tokens long, ids_crc32 long")
    # One row for each file: its number is that of write()'s tasks.
    joined = rows.join(F.broadcast(starts(spark, path)), "part")
    return joined.select("doc_id", (F.col("base") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")
