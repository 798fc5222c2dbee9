"""Packed hash files as a Spark data source, ``packed_hashes``: reading with pushed filters, writing in parallel.

    spark.read.format("packed_hashes").option("path", p).load().where("hash in (...)")
    rows.write.format("packed_hashes").option("path", p).mode("overwrite").save()

A packed file (little endian) has an 8-byte magic that ends in its version, the
time it was made, the names of its sources, and sorted records of 32 + 1 bytes
(SHA-256) and, from version 2, 16 + 1 bytes (MD5), the last byte being the source.

Reading: a table scan has one task for each ``perTask`` records. ``hash =`` and ``hash
IN`` are answered by binary search in the sorted records, so a lookup reads some
twenty-six records of 48 million; ``algo =`` leaves the other kind unread.

Writing: rows come ranged and sorted by kind and hash (``write_packed`` sees to
that), each task writes its records as a file of its own beside the target and says
how many there are and between which hashes; the commit puts header and parts
together in that order and renames. A task that is run again writes a part of
another name, and only those that were committed are used. No row passes through
the driver. All executors must be able to open the folder.
"""

from __future__ import annotations

import json
import os
import shutil
import struct
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

SIGNATURES = "algo string, hash string, src_idx int, source string"
# The packed file's magic, without the version byte.
MAGIC = b"FGHDB\0\0"
WIDTH = {"sha256": 32, "md5": 16}
#: Hashes that a task looks up.
LOOKUPS = 10_000
_SCHEMA = pa.schema([("algo", pa.string()), ("hash", pa.string()), ("src_idx", pa.int32()), ("source", pa.string())])


class Packed:
    """Header of a packed file; ValueError where it isn't one."""

    def __init__(self, path: str):
        self.path = path
        size = os.path.getsize(path)
        with open(path, "rb") as f:
            head = f.read(18)
            if len(head) < 18 or head[:7] != MAGIC or head[7] not in (1, 2):
                raise ValueError("bad magic (not a packed hash file)")
            self.created, count = struct.unpack_from("<qH", head, 8)
            self.sources = []
            for _ in range(count):
                raw = f.read(2)
                name = f.read(struct.unpack("<H", raw)[0]) if len(raw) == 2 else b""
                if len(raw) < 2 or len(name) < struct.unpack("<H", raw)[0]:
                    raise ValueError("truncated source table")
                self.sources.append(name.decode())
            kinds = 1 if head[7] == 1 else 2
            counts = f.read(8 * kinds)
            if len(counts) < 8 * kinds:
                raise ValueError("truncated header")
            self.sha256, self.md5 = (*struct.unpack(f"<{kinds}Q", counts), 0)[:2]
            self.start = f.tell()
        if size - self.start != 33 * self.sha256 + 17 * self.md5:
            raise ValueError("record table size mismatch")

    def table(self, algo: str) -> tuple[int, int, int]:
        """(bytes of a hash, offset of the first record, records) of one kind."""
        return (32, self.start, self.sha256) if algo == "sha256" else (16, self.start + 33 * self.sha256, self.md5)

    def name(self, place: int) -> str:
        return self.sources[place] if place < len(self.sources) else "unknown"


class Records:
    """The sorted records of one kind, found by binary search; ``reads`` counts records read."""

    def __init__(self, file, width: int, start: int, count: int):
        self._file, self._width, self._start, self._count, self.reads = file, width, start, count, 0

    def _at(self, i: int) -> bytes:
        self.reads += 1
        self._file.seek(self._start + i * (self._width + 1))
        return self._file.read(self._width + 1)

    def find(self, key: bytes) -> int | None:
        """The source's place, or None."""
        low, high = 0, self._count
        while low < high:
            middle = (low + high) // 2
            record = self._at(middle)
            if record[: self._width] == key:
                return record[self._width]
            low, high = (middle + 1, high) if record[: self._width] < key else (low, middle)
        return None


def _well(value) -> str | None:
    """The kind of a hash as it stands in the table; None for a value that no record has."""
    kind = {64: "sha256", 32: "md5"}.get(len(value)) if isinstance(value, str) else None
    return kind if kind and all(c in "0123456789abcdef" for c in value) else None


class PackedReader(DataSourceReader):
    def __init__(self, path: str, per_task: int):
        self.path, self.per_task = path, per_task
        self.algos, self.wanted = set(WIDTH), None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("algo",):
                self.algos &= {f.value}
            elif isinstance(f, (EqualTo, In)) and f.attribute == ("hash",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        file, tasks = Packed(self.path), []
        for algo in WIDTH:
            if algo not in self.algos:
                continue
            _, _, count = file.table(algo)
            if self.wanted is None:
                tasks += [InputPartition((algo, i, min(self.per_task, count - i), None)) for i in range(0, count, self.per_task)]
            else:
                keys = sorted(v for v in self.wanted if _well(v) == algo)
                tasks += [InputPartition((algo, 0, count, keys[i : i + LOOKUPS])) for i in range(0, len(keys), LOOKUPS)]
        return tasks or [InputPartition(("md5", 0, 0, None))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        algo, first, count, keys = partition.value
        file = Packed(self.path)
        width, start, _ = file.table(algo)
        with open(self.path, "rb") as f:
            if keys is None:
                f.seek(start + first * (width + 1))
                left = count
                while left > 0:
                    raw = f.read(min(left, 50_000) * (width + 1))
                    found = [(raw[i : i + width].hex(), raw[i + width]) for i in range(0, len(raw), width + 1)]
                    left -= len(found)
                    yield self._batch(algo, file, found)
            else:
                records = Records(f, width, start, count)
                found = [(key, place) for key in keys if (place := records.find(bytes.fromhex(key))) is not None]
                if found:
                    yield self._batch(algo, file, found)

    @staticmethod
    def _batch(algo: str, file: Packed, found: list[tuple[str, int]]) -> pa.RecordBatch:
        hashes, places = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array([algo] * len(found)), pa.array(hashes), pa.array(places, pa.int32()), pa.array([file.name(p) for p in places])], schema=_SCHEMA)


@dataclass
class Part(WriterCommitMessage):
    """A task's file: its records of each kind, in order."""

    file: str
    first: tuple[str, str] | None  # kind as it is ordered, hash
    last: tuple[str, str] | None
    sha256: int
    md5: int


class PackedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, created: int, sources: list[str]):
        self.path, self.created, self.sources = path, created, sources
        self.folder = f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        os.makedirs(self.folder, exist_ok=True)
        place, counts = {s: i for i, s in enumerate(self.sources)}, {"sha256": 0, "md5": 0}
        file, first, last = f"{self.folder}/{uuid.uuid4().hex}", None, None
        with open(file, "wb") as f:
            for batch in iterator:
                for algo, value, source in zip(*(batch.column(c).to_pylist() for c in ("algo", "hash", "source"))):
                    key = (("0" if algo == "sha256" else "1"), value)
                    if last is not None and key <= last:
                        raise ValueError("rows must be sorted by kind and hash, one row a hash")
                    first, last = first or key, key
                    raw = bytes.fromhex(value)
                    if len(raw) != WIDTH[algo]:
                        raise ValueError(f"{value} is no {algo}")
                    f.write(raw + bytes([place[source]]))
                    counts[algo] += 1
            f.flush()
            os.fsync(f.fileno())
        return Part(file, first, last, **counts)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.first is not None), key=lambda m: m.first)
        if any(a.last >= b.first for a, b in zip(parts, parts[1:])):
            raise ValueError("tasks' rows overlap; rows must be ranged by kind and hash")
        temporary = f"{self.path}.{uuid.uuid4().hex}"
        with open(temporary, "wb") as f:
            f.write(MAGIC + b"\2" + struct.pack("<qH", self.created, len(self.sources)))
            for s in self.sources:
                f.write(struct.pack("<H", len(s.encode())) + s.encode())
            f.write(struct.pack("<QQ", sum(p.sha256 for p in parts), sum(p.md5 for p in parts)))
            for part in parts:
                with open(part.file, "rb") as more:
                    shutil.copyfileobj(more, f, 1 << 20)
            f.flush()
            os.fsync(f.fileno())
        put_in_place(temporary, self.path)
        shutil.rmtree(self.folder, ignore_errors=True)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


def put_in_place(temporary: str, path: str) -> None:
    """Renames a written file over another, whose mode and, where that is allowed, owner it takes."""
    try:
        before = os.stat(path)
    except FileNotFoundError:
        os.chmod(temporary, 0o644)
    else:
        os.chmod(temporary, before.st_mode & 0o7777)
        try:
            os.chown(temporary, before.st_uid, before.st_gid)
        except PermissionError:
            pass
    os.replace(temporary, path)


class PackedSource(DataSource):
    """Options: path; perTask (records a task reads); created (seconds) and sources (a JSON list, in order) for writing."""

    @classmethod
    def name(cls) -> str:
        return "packed_hashes"

    def schema(self) -> str:
        return SIGNATURES

    def reader(self, schema) -> PackedReader:
        return PackedReader(self.options["path"], int(self.options.get("perTask", 500_000)))

    def writer(self, schema, overwrite: bool) -> PackedWriter:
        if not overwrite and os.path.exists(self.options["path"]):
            raise ValueError("a packed file can only be written whole (mode overwrite)")
        return PackedWriter(self.options["path"], int(self.options.get("created", time.time())), json.loads(self.options["sources"]))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_packed(spark: SparkSession, path: str, per_task: int = 500_000) -> DataFrame:
    """SIGNATURES of a packed file that every executor can open; an unknown source's name is 'unknown'."""
    register(spark)
    Packed(path)
    return spark.read.format("packed_hashes").option("path", path).option("perTask", per_task).load()


def write_packed(signatures: DataFrame, path: str, created: int | None = None) -> dict[str, int]:
    """A packed file of version 2, written by tasks; the number of records of each kind."""
    spark = signatures.sparkSession
    register(spark)
    sources = [r["source"] for r in signatures.groupBy("source").agg(F.min("src_idx").alias("i")).sort("i", "source").limit(256).collect()]
    if len(sources) > 255:
        raise ValueError("a packed file holds 255 sources at most")
    kind, n = F.when(F.col("algo") == "sha256", 0).otherwise(1), int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = signatures.select("algo", "hash", F.col("src_idx").cast("int").alias("src_idx"), "source").repartitionByRange(n, kind, "hash").sortWithinPartitions(kind, "hash")
    rows.write.format("packed_hashes").option("path", path).option("created", int(time.time()) if created is None else created).option("sources", json.dumps(sources)).mode("overwrite").save()
    file = Packed(path)
    return {algo: n for algo, n in (("sha256", file.sha256), ("md5", file.md5)) if n}
