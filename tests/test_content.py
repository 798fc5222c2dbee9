import pytest

from pyspark.sql import functions as F
from verdikt.functions import content as C


def types(spark, blobs):
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs)], "i int, content binary")
    return [r[0] for r in rows.sort("i").select(C.file_type(F.col("content"))).collect()]


def test_types_by_content(spark):
    tar = b"\0" * 257 + b"ustar" + b"\0" * 250
    iso = b"\0" * 0x8001 + b"CD001" + b"\0" * 10
    blobs = {b"MZ\x90": "pe", b"\x7fELF": "elf", b"junk\n%PDF-1.4": "pdf", b"echo hi\n": "text", tar: "tar", iso: "iso", b"": "unknown", b"\xff\xfea\0": "text", b"a\0b": "unknown", b"{\\rtf1": "rtf", b"\xca\xfe\xba\xbe\0\0\0\x34": "unknown"}
    assert types(spark, blobs) == list(blobs.values())


@pytest.mark.parametrize(
    ("data", "whole", "expected"),
    [(b"", True, False), (b"abc", True, True), (b"\x01" + b"a" * 20, True, True), (b"\x01" + b"a" * 19, True, False), ("é".encode() * 3, True, True), (b"a" * 10 + "漢".encode()[:2], False, True), (b"a" * 10 + b"\xff" * 2, False, True), (b"a" * 10 + b"\xff" * 2, True, False)],
)
def test_looks_like_text(data, whole, expected):
    assert C.looks_like_text(data, whole) is expected


def test_names(spark):
    rows = spark.createDataFrame([("a/b.txt",), ("x/",), ("",), ("///",), ("..\\..\\e",), ("q.TGZ",)], "n string")
    got = rows.select(C.base_name(F.col("n")), C.unsafe_path(F.col("n")), C.upload_name(F.col("n")), C.inner_name(C.base_name(F.col("n")), ".gz", ".tgz")).collect()
    assert [r[0] for r in got] == ["b.txt", "x", ".", "/", "..\\..\\e", "q.TGZ"]
    assert [r[1] for r in got] == [False, False, False, True, True, False]
    assert [r[2] for r in got] == ["b.txt", "x", "upload", "upload", "e", "q.TGZ"]
    assert got[5][3] == "q.tar" and got[0][3] == "b.txt.decompressed" and got[2][3] == "data"


def test_entropy(spark):
    assert C.byte_entropy(b"\0" * 100) == 0 and C.byte_entropy(bytes(range(256))) == 8 and C.byte_entropy(b"") == 0
    assert spark.range(1).select(C.entropy(F.array(*[F.lit(1)] * 8))).first()[0] == 3


def test_lower_keeps_other_letters(spark):
    raw = bytes(range(256))
    got = spark.createDataFrame([(bytearray(raw),)], "c binary").select(C.ascii_lower(C.latin1(F.col("c")))).first()[0]
    assert got.encode("latin-1") == raw.lower()
