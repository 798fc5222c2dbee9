"""Scans of files as they arrive.

``scan_stream`` hands every micro-batch to the batch scan and appends its
results; the checkpoint makes each batch's output its own folder, so a batch
that is run again replaces what it wrote. Signatures are read anew for each
batch, and so follow the snapshot in force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from verdikt.config import Config
from verdikt.operators.scan import scan
from verdikt.operators.verdict import results

FILES = "file_id long, name string, content binary"


def arriving(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """Parquet files of (file_id, name, content) as a stream."""
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", per_batch).parquet(folder)


def scan_stream(files: DataFrame, out: str, checkpoint: str, config: Config, signatures: Callable[[], DataFrame]) -> StreamingQuery:
    """Writes results as Parquet under ``out``/batch=N for all that has arrived, then ends."""

    def one(batch: DataFrame, number: int) -> None:
        table = signatures()
        n = table.limit(1).count()
        scanned = scan(batch, config, table)
        results(batch, scanned, config, n).write.mode("overwrite").parquet(f"{out}/batch={number}")
        scanned.release()

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
