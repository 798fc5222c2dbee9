"""Helpers shared by the text operators: tables, samples, output batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.sources.scratch import Scratch

__all__ = ["Scratch", "batches", "for_splits", "hash_sample", "labelled_sample", "packed", "slices", "table", "tasks", "texts", "train_row", "unpacked"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(scanned: DataFrame) -> int:
    """Tasks for a shuffle of all of a table that is read from files: its splits, which follow its bytes, or the session's number if that is greater."""
    last = scanned.select(F.spark_partition_id().alias("split")).agg(F.max("split")).first()[0]  # reads no column
    return for_splits(scanned.sparkSession, 0 if last is None else last + 1)


def for_splits(spark: SparkSession, splits: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * splits)


def texts(df: DataFrame, *keep: str) -> DataFrame:
    """The columns an operator needs, null text read as empty; other columns are dropped."""
    return df.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def batches(schema: pa.Schema, rows, size: int = 1024):
    """Record batches of at most ``size`` rows from an iterator of row tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def slices(part: pa.RecordBatch, column: str, size: int):
    """The batch in runs of rows whose texts have about ``size`` bytes together; a longer text stands alone."""
    total, at = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(part.column(column)), 0).to_pylist()):
        if i > at and total + n > size:
            yield part.slice(at, i - at)
            total, at = 0, i
        total += n
    if part.num_rows > at:
        yield part.slice(at)


def packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """values[cuts[i]:cuts[i + 1]] as the bytes of row i."""
    values = np.ascontiguousarray(values)
    offsets = (np.asarray(cuts) * values.dtype.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def unpacked(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """All rows' values one after another."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def train_row(doc_id):
    """True for rows whose labels may be learned from; the others are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, bound: int) -> DataFrame:
    """(doc_id, text, label) of about ``bound`` documents at most whose labels may be learned from.

    Rows are taken where a hash of the doc_id is under the threshold that leaves
    ``bound`` of them on average; the chosen ids, a bounded list, are broadcast,
    so that texts are not shuffled. Null labels and ids are left out, and of
    repeated ids the least text is taken.
    """
    known = labels.where(f"doc_id is not null and {column} is not null").where(train_row(F.col("doc_id")))
    chosen = hash_sample(known.groupBy("doc_id").agg(F.min(column).cast("int").alias("label")), bound)
    found = texts(docs, "doc_id").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def hash_sample(keys: DataFrame, bound: int) -> DataFrame:
    """About ``bound`` rows at most of a table with distinct doc_id, by a hash of doc_id."""
    n = keys.count()
    return keys if n <= bound else keys.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * (bound / n)))
