"""Signature tables on disk: snapshots in Parquet.

A snapshot is a new folder, bucketed by kind and hash, so that look-ups need no
shuffle of it, and sorted, so that row groups cover narrow ranges; a pointer file names the one in force and is replaced in
one step, so readers see the old snapshot or the new one whole. A replaced snapshot
goes when a grace time is over and no reader holds a lease on it. Packed hash files
are in ``packed``.
"""

from __future__ import annotations

import glob
import json
import os
import shutil
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.sources.packed import SIGNATURES, put_in_place



def replace_file(path: str, data: bytes) -> None:
    """Writes beside the file and renames, so that no reader sees half of it."""
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    put_in_place(temporary, path)


TIERS = ("base", "delta")
#: Seconds for which a replaced snapshot stays for readers that have no lease.
GRACE = 3_600


def _table(snapshot: str) -> str:
    return f"verdikt_{snapshot.replace('-', '_')}"


class Store:
    """Snapshots of the tiers base and delta in one folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, os.path.abspath(folder)
        os.makedirs(folder, exist_ok=True)

    def _pointer(self) -> dict[str, str]:
        try:
            with open(f"{self.folder}/current.json") as f:
                return json.load(f)
        except (OSError, ValueError):
            return {}

    def exists(self, tier: str) -> bool:
        return tier in self._pointer()

    def read(self, tier: str, pointer: dict | None = None) -> DataFrame:
        pointer = self._pointer() if pointer is None else pointer
        at, n = pointer.get(tier), pointer.get(f"{tier}-buckets")
        if not at:
            return self.spark.createDataFrame([], SIGNATURES)
        if not n:
            return self.spark.read.schema(SIGNATURES).parquet(f"{self.folder}/{at}")
        # The folder says which bucket a file is, the table how many there are; other sessions may not know it yet.
        table = _table(at)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({SIGNATURES}) USING parquet CLUSTERED BY (algo, hash) SORTED BY (algo, hash) INTO {n} BUCKETS LOCATION '{self.folder}/{at}'")
        return self.spark.table(table)

    def tiers(self, pointer: dict | None = None) -> list[DataFrame]:
        """Base, then delta: for look-ups, where the first that has a hash counts."""
        pointer = self._pointer() if pointer is None else pointer
        return [self.read(tier, pointer) for tier in TIERS]

    @contextmanager
    def lease(self, seconds: float = 86_400):
        """The tiers in force, whose files stay while the block runs, or for so many seconds if its process dies in it."""
        while True:
            pointer, file = self._pointer(), f"{self.folder}/lease-{uuid.uuid4().hex}.json"
            held = [pointer[t] for t in TIERS if t in pointer]
            replace_file(file, json.dumps({"held": held, "until": time.time() + seconds}).encode())
            if self._pointer() == pointer:
                break
            os.remove(file)  # a refresh came between; the lease may be too late
        try:
            yield self.tiers(pointer)
        finally:
            os.remove(file)

    def vacuum(self, grace: float = GRACE) -> list[str]:
        """Removes snapshots that were replaced over ``grace`` seconds ago and that no lease holds; their names. One refresh at a time may call it."""
        pointer, now, held = self._pointer(), time.time(), set()
        for file in glob.glob(f"{glob.escape(self.folder)}/lease-*.json"):
            try:
                with open(file) as f:
                    lease = json.load(f)
            except FileNotFoundError:  # given back meanwhile
                continue
            held |= set(lease["held"]) if lease["until"] > now else set()
        retired = pointer.get("retired", {})
        gone = [name for name, since in retired.items() if now - since >= grace and name not in held]
        if gone:
            # The pointer forgets them first: what is half removed is never looked for again.
            pointer["retired"] = {n: since for n, since in retired.items() if n not in gone}
            replace_file(f"{self.folder}/current.json", json.dumps(pointer).encode())
        for name in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {_table(name)}")
            shutil.rmtree(f"{self.folder}/{name}", ignore_errors=True)
        return gone

    def write(self, tiers: dict[str, DataFrame | None]) -> None:
        """Puts new snapshots in force together; None takes a tier away."""
        pointer = self._pointer()
        retired = pointer.setdefault("retired", {})
        for tier, rows in tiers.items():
            pointer.pop(f"{tier}-buckets", None)
            if tier in pointer:
                retired[pointer[tier]] = time.time()
            if rows is None:
                pointer.pop(tier, None)
                continue
            name = f"{tier}-{uuid.uuid4().hex}"
            n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            dealt = rows.select("algo", "hash", "src_idx", "source").repartition(n, "algo", "hash").sortWithinPartitions("algo", "hash")
            dealt.write.bucketBy(n, "algo", "hash").sortBy("algo", "hash").format("parquet").option("path", f"{self.folder}/{name}").saveAsTable(_table(name))
            pointer[tier], pointer[f"{tier}-created"], pointer[f"{tier}-buckets"] = name, time.time(), n
        replace_file(f"{self.folder}/current.json", json.dumps(pointer).encode())

    def created(self) -> float:
        """When the newest snapshot in force was made; 0 where there is none."""
        pointer = self._pointer()
        return max((pointer.get(f"{tier}-created", 0.0) for tier in ("base", "delta") if tier in pointer), default=0.0)

    def point_lookup(self, tier: str, value: str) -> DataFrame:
        """The rows of one hash, by the minima and maxima of files and row groups."""
        return self.read(tier).where(F.col("hash") == value.lower())
