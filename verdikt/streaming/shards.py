"""Shards of an append feed as a stream, folded into the signature table.

The offset of the stream is the number of the next shard, which the checkpoint
keeps; shards that have appeared are one micro-batch, each downloaded by a task
of its own. A micro-batch is folded into a tier and put in force by one step, and
folding is a union by hash, so that a batch that is run again, because the process
died between the fold and the checkpoint, leaves every shard's rows there once.
"""

from __future__ import annotations

import re
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.query import StreamingQuery

from verdikt.config import Feed
from verdikt.operators import signatures as S
from verdikt.sources.signature_store import Store

LINES = "source string, shard long, line string"
_SCHEMA = pa.schema([("source", pa.string()), ("shard", pa.int64()), ("line", pa.string())])
#: Lines of a batch of rows.
AT_ONCE = 50_000


def _there(url: str, timeout: float) -> bool:
    """Whether the shard can be read; False only where the server says that it is not there."""
    try:
        with urllib.request.urlopen(url, timeout=timeout):
            return True
    except urllib.error.HTTPError as e:
        if e.code == 404:
            return False
        raise
    except urllib.error.URLError as e:
        if isinstance(e.reason, FileNotFoundError):
            return False
        raise


class ShardReader(DataSourceStreamReader):
    def __init__(self, source: str, url: str, first: int, most: int, timeout: float):
        self.source, self.url, self.first, self.most, self.timeout = source, url, first, most, timeout
        self._next = first

    def initialOffset(self) -> dict:
        return {"shard": self.first}

    def latestOffset(self) -> dict:
        """Up to ``most`` shards beyond the last answer; it stops at the first that is not there yet."""
        for _ in range(self.most):
            if not _there(self.url % self._next, self.timeout):
                break
            self._next += 1
        return {"shard": self._next}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self._next = max(self._next, end["shard"])
        return [InputPartition(i) for i in range(start["shard"], end["shard"])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        shard, held = partition.value, []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([self.source] * len(held), pa.string()), pa.array([shard] * len(held), pa.int64()), pa.array(held, pa.string())], schema=_SCHEMA)

        with urllib.request.urlopen(self.url % shard, timeout=self.timeout) as reply:
            for line in reply:
                held.append(line.decode("utf-8", "replace").rstrip("\r\n"))
                if len(held) >= AT_ONCE:
                    yield batch()
                    held = []
        if held:
            yield batch()


class Shards(DataSource):
    """Options: source (the feed's name), url (with a place for the shard's number), first, most (shards of a batch), timeout."""

    @classmethod
    def name(cls) -> str:
        return "signature_shards"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> ShardReader:
        o = self.options
        if not re.search(r"%0?\d*d", o["url"]):
            raise ValueError("the url needs a place for the shard's number, such as %05d")
        return ShardReader(o["source"], o["url"], int(o.get("first", 0)), int(o.get("most", 1000)), float(o.get("timeout", 300)))


def shard_lines(spark: SparkSession, feed: Feed, most: int = 1000) -> DataFrame:
    """LINES of an append feed, as a stream."""
    spark.dataSource.register(Shards)
    return spark.readStream.format("signature_shards").option("source", feed.name).option("url", feed.url).option("most", most).load()


def folded(store: Store, lines: DataFrame, enabled: list[str], tier: str = "base") -> None:
    """Adds the lines' hashes to a tier; adding them again changes nothing."""
    fetched = S.parse(lines.select("source", "line")).select("algo", "hash", "source")
    if tier == "delta":
        store.write({"delta": S.incremental_refresh(fetched, store.read("base"), store.read("delta"), enabled)})
    else:
        both = store.read(tier).select("algo", "hash", "source").unionByName(fetched)
        store.write({tier: S.deduplicated(S.with_priority(both, enabled))})


def fold_shards(spark: SparkSession, store: Store, feed: Feed, enabled: list[str], checkpoint: str, tier: str = "base", most: int = 1000) -> StreamingQuery:
    """Folds all shards that are there by now, batch by batch, then ends. The caller holds the update lock."""

    def one(batch: DataFrame, number: int) -> None:
        folded(store, batch, enabled, tier)

    return shard_lines(spark, feed, most).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
