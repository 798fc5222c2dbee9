"""Files to scan: a walk that loses none, and contents read by the executors.

Spark's own binary source leaves out empty files and names that begin with a
dot or an underscore, which a scan may not. The walk lists regular files, and their
contents are read, in tasks, for which every executor must see the same folders. A
file that cannot be listed or read, or is over the size limit, is a row with a
problem; one over the limit is read in pieces, and its row has hashes, size and
head (``large``).
"""

from __future__ import annotations

import hashlib
import os
import stat
import uuid
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.sources.scratch import Scratch

#: What is known of a file too large to hold.
LARGE = "struct<sha256:string,md5:string,size:bigint,head:binary,file:string>"
FILES = f"file_id long, name string, content binary, problem string, large {LARGE}"
LISTING = "file_id long, name string, size long, problem string"
#: Bytes read at a time of a file too large to hold.
CHUNK = 1 << 20
#: Bytes of such a file that its type is told from.
HEAD = 64 << 10


_LISTED = pa.schema([("name", pa.string()), ("size", pa.int64()), ("problem", pa.string()), ("folder", pa.bool_())])


def _listed(path: str, size: int = 0, problem: str | None = None, folder: bool = False) -> dict:
    try:
        path.encode()
    except UnicodeEncodeError:  # bytes that are no UTF-8; such a file can be named in no result as it is
        path, problem, folder = path.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), problem or "the name is not UTF-8", False
    return {"name": path, "size": size, "problem": problem, "folder": folder}


def _named(path: str) -> Iterator[dict]:
    """A path that was asked for; it may be a link."""
    try:
        info = os.stat(path)
    except OSError as e:
        yield _listed(path, problem=str(e))
        return
    regular, folder = stat.S_ISREG(info.st_mode), stat.S_ISDIR(info.st_mode)
    yield _listed(path, info.st_size if regular else 0, None if regular or folder else "not a regular file", folder)


def _inside(folder: str) -> Iterator[dict]:
    """Regular files and folders of a folder; links aren't followed."""
    try:
        with os.scandir(folder) as entries:
            for entry in entries:
                try:
                    if entry.is_dir(follow_symlinks=False):
                        yield _listed(entry.path, folder=True)
                    elif entry.is_file(follow_symlinks=False):
                        yield _listed(entry.path, entry.stat(follow_symlinks=False).st_size)
                except OSError as e:
                    yield _listed(entry.path, problem=str(e))
    except OSError as e:
        yield _listed(folder, problem=str(e))


def walk(spark: SparkSession, paths: Iterable[str], scratch: Scratch) -> DataFrame:
    """LISTING of all regular files under the paths, numbered in the order of their names; what can't be listed is a row with a problem.

    Folders are listed by tasks, level by level; the driver only learns whether
    there is a further level, and one count for each partition of the numbering.
    """

    def listing(look):
        def run(parts):
            for part in parts:
                for path in part.column("name").to_pylist():
                    rows = look(path)
                    while some := list(islice(rows, 10_000)):
                        yield pa.RecordBatch.from_pylist(some, schema=_LISTED)

        return run

    schema = "name string, size long, problem string, folder boolean"
    frontier, depth, found = spark.createDataFrame([(p,) for p in paths], "name string"), 0, None
    while True:
        level = frontier.repartition("name").mapInArrow(listing(_inside if depth else _named), schema)
        level = scratch.save(level, f"level-{depth}")
        files = level.where("not folder").drop("folder")
        found = files if found is None else found.unionByName(files)
        frontier, depth = level.where("folder").select("name"), depth + 1
        if not frontier.head(1):
            break
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = found.repartitionByRange(n, "name").sortWithinPartitions("name").select("*", F.spark_partition_id().alias("part"), inside.alias("at"))
    ranged, before, starts = scratch.save(ranged, "ranged"), 0, []
    for part, held in sorted(tuple(r) for r in ranged.groupBy("part").count().collect()):
        starts.append((part, before))
        before += held
    first = F.broadcast(spark.createDataFrame(starts, "part int, first long"))  # one row a partition
    return ranged.join(first, "part").select((F.col("first") + F.col("at")).alias("file_id"), "name", "size", "problem")


def gathered(rows: Iterable[dict], schema: pa.Schema, most: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in batches, which end with the row that makes them ``most`` rows or ``size`` bytes of contents and texts."""
    held: list[dict] = []
    total = 0
    for row in rows:
        held.append(row)
        total += sum(len(v) for v in row.values() if isinstance(v, (bytes, str)))
        if len(held) >= most or total >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def read_files(spark: SparkSession, paths: Iterable[str], limit: int, per_task: int = 64 << 20) -> DataFrame:
    """FILES of the paths, which every executor must be able to open."""
    scratch = Scratch(spark, "walk")
    listed = scratch.save(walk(spark, paths, scratch), "files")
    count, size = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, -(-size // per_task), -(-count // 10_000))
    known = pa.struct([("sha256", pa.string()), ("md5", pa.string()), ("size", pa.int64()), ("head", pa.binary()), ("file", pa.string())])
    schema = pa.schema([("file_id", pa.int64()), ("name", pa.string()), ("content", pa.binary()), ("problem", pa.string()), ("large", known)])

    def opened(parts):
        for part in parts:
            for row in part.to_pylist():
                content, problem, large = None, row["problem"], None
                try:
                    if problem is None and row["size"] > limit:
                        large = hashed(row["name"]) | {"file": row["name"]}
                        problem = f"file exceeds the size limit ({row['size']} bytes); only its hash was checked"
                    elif problem is None:
                        with open(row["name"], "rb") as f:
                            content = f.read()
                except OSError as e:
                    problem = str(e)
                yield {"file_id": row["file_id"], "name": row["name"], "content": content, "problem": problem, "large": large}

    return listed.repartition(tasks, "file_id").mapInArrow(lambda parts: gathered(opened(parts), schema), FILES)


def read_stream(spark: SparkSession, stream, name: str, limit: int) -> DataFrame:
    """FILES of one stream, which comes before the files of any walk."""
    data = stream.read(limit + 1)
    problem = f"{name} exceeds the size limit ({limit} bytes)" if len(data) > limit else None
    return spark.createDataFrame([(-1, name, None if problem else bytearray(data), problem, None)], FILES)


def hashed(path: str) -> dict:
    """size, sha256, md5 and head of a file, read in pieces."""
    one, two, size, head = hashlib.sha256(), hashlib.md5(), 0, b""
    with open(path, "rb") as f:
        while piece := f.read(CHUNK):
            one.update(piece)
            two.update(piece)
            head, size = head or piece[:HEAD], size + len(piece)
    return {"size": size, "sha256": one.hexdigest(), "md5": two.hexdigest(), "head": head}


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes rows (name, content) as files of a folder that all executors share, null as empty; how many."""

    def run(parts):
        for part in parts:
            for name, content in zip(part.column("name").to_pylist(), part.column("content").to_pylist()):
                if os.path.basename(name) != name or name in ("", ".", ".."):
                    raise ValueError(f"{name!r} is no file name")
                temporary = f"{folder}/.{uuid.uuid4().hex}"
                with open(temporary, "wb") as f:
                    f.write(content or b"")
                os.replace(temporary, f"{folder}/{name}")  # a task that runs again writes the same file again
            yield pa.RecordBatch.from_pydict({"n": pa.array([part.num_rows], pa.int64())})

    os.makedirs(folder, exist_ok=True)
    return rows.select("name", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def local_path(path: str) -> str:
    """The path of a file: or plain address; ValueError for those of other stores."""
    scheme, _, rest = path.rpartition(":")
    if scheme not in ("", "file"):
        raise ValueError(f"{path} is not in a file system that every executor mounts")
    return os.path.normpath("/" + rest.lstrip("/")) if scheme else path


def hash_files(files: DataFrame) -> DataFrame:
    """(file_id, size, sha256, md5) of (file_id, name), read in pieces: for files too large to hold."""
    schema = pa.schema([("file_id", pa.int64()), ("size", pa.int64()), ("sha256", pa.string()), ("md5", pa.string())])

    def run(parts):
        for part in parts:
            for row in part.to_pylist():
                got = hashed(row["name"])
                yield pa.RecordBatch.from_pylist([{"file_id": row["file_id"]} | {k: got[k] for k in ("size", "sha256", "md5")}], schema=schema)

    return files.select("file_id", "name").mapInArrow(run, "file_id long, size long, sha256 string, md5 string")


def from_texts(rows: DataFrame, key: str, text: str, prefix: str = "doc_", suffix: str = ".txt") -> DataFrame:
    """A table's texts as files: file_id, name, content."""
    return rows.select(F.col(key).cast("long").alias("file_id"), F.concat(F.lit(prefix), F.col(key).cast("string"), F.lit(suffix)).alias("name"), F.encode(F.col(text), "UTF-8").alias("content"))
