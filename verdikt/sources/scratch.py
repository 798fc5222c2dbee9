"""Scratch tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Parquet tables in the folder that spark.checkpoint.dir names, used to cut lineage.

    A written table survives the loss of any executor, unlike a local
    checkpoint, and is column-pruned when it is read again. ``drop`` removes a
    table that no later plan needs; whatever is left goes when the Python
    process ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="verdikt-")
        self.spark, self.root = spark, f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._clear)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        self._delete(self.path(name))

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def _clear(self) -> None:
        with contextlib.suppress(Exception):
            self._delete(self.root)
