"""Rows of a scan's tasks leave in batches that are bounded in rows and in bytes."""

import pyarrow as pa
from pyspark.sql import functions as F

from verdikt.functions import content as C
from verdikt.sources.files import gathered


def test_batches_are_bounded_in_rows_and_bytes():
    schema = pa.schema([("name", pa.string()), ("content", pa.binary())])
    made = [{"name": str(i), "content": b"x" * (3000 if i % 100 == 7 else 1) if i % 5 else None} for i in range(1000)]
    parts = list(gathered(iter(made), schema, most=64, size=4000))
    assert [r for p in parts for r in p.to_pylist()] == made
    assert 1000 // 64 <= len(parts) < 40 and max(p.num_rows for p in parts) == 64
    assert max(sum(len(r["content"] or b"") for r in p.to_pylist()) for p in parts) < 4000 + 3000
    assert list(gathered(iter([]), schema)) == []


def test_types_are_told_without_pandas(spark):
    rows = spark.createDataFrame([(0, bytearray(b"plain")), (1, bytearray("é".encode() * 5000)), (2, bytearray(b"\x01\x02")), (3, bytearray(b"")), (4, None), (5, bytearray(b"\xff" * 30))], "i int, c binary")
    told = rows.select("i", C.file_type(F.col("c")).alias("k"))
    assert "_text_flags(substring" in told._jdf.queryExecution().executedPlan().toString()  # the columns themselves, no struct of copies
    assert [r["k"] for r in told.sort("i").collect()] == ["text", "text", "unknown", "unknown", "unknown", "unknown"]
