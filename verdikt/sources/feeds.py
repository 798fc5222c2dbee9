"""Signature feeds: lines of downloaded files, and the downloads themselves.

Downloads land as files, piece by piece; Spark reads and parses them. A zip feed's
members are unpacked on the way, and one in which no hash stands is an error. A feed that changes nothing since the last time (304) or
has no further shard (404) says so by its own exception.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import urllib.error
import urllib.request
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.config import Feed


class NotModified(Exception):
    pass


class NotFound(Exception):
    pass


_HASH = re.compile(rb"(?:^|[, \t\"';|:])(?:[0-9A-Fa-f]{64}|[0-9A-Fa-f]{32})(?:[, \t\"';|:]|$)")


def _unpacked(packed, out) -> None:
    """Writes the lines of all members; ValueError where none holds a hash."""
    found = False
    with zipfile.ZipFile(packed) as archive:
        for name in archive.namelist():
            if name.endswith("/"):
                continue
            with archive.open(name) as member:
                for line in member:
                    found = found or line.lstrip()[:1] not in (b"#", b";") and _HASH.search(line.strip()) is not None
                    out.write(line)
            out.write(b"\n")
    if not found:
        raise ValueError("feed contained no hashes")


def fetch(feed: Feed, folder: str, shard: int | None = None, etag: str = "", modified: str = "", timeout: float = 300) -> tuple[str, str, str]:
    """Downloads a feed into a file of the folder: (path, etag, last-modified)."""
    url = feed.url if shard is None else feed.url % shard
    request = urllib.request.Request(url)
    if feed.header_name:
        request.add_header(feed.header_name, re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], ""), feed.header_value))
    if etag:
        request.add_header("If-None-Match", etag)
    if modified:
        request.add_header("If-Modified-Since", modified)
    path = os.path.join(folder, f"{feed.name}{'' if shard is None else f'-{shard:05d}'}.txt")
    try:
        with tempfile.TemporaryFile() as held:
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                shutil.copyfileobj(reply, held)
                tag, since = reply.headers.get("ETag", ""), reply.headers.get("Last-Modified", "")
            held.seek(0)
            with open(path, "wb") as out:
                if feed.format == "zip":
                    _unpacked(held, out)
                else:
                    shutil.copyfileobj(held, out)
    except urllib.error.HTTPError as e:
        if e.code == 304:
            raise NotModified(url) from None
        if e.code == 404:
            raise NotFound(url) from None
        raise
    except urllib.error.URLError as e:
        if isinstance(e.reason, FileNotFoundError):
            raise NotFound(url) from None
        raise
    return path, tag, since


def lines(spark: SparkSession, paths: dict[str, list[str]]) -> DataFrame:
    """(source, line) of each source's landed files."""
    out = spark.createDataFrame([], "source string, line string")
    for source, files in paths.items():
        if files:
            out = out.unionByName(spark.read.text(files).select(F.lit(source).alias("source"), F.col("value").alias("line")))
    return out


def list_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file, line_no, line) of the *.txt files of a local list, in name order."""
    names = sorted(n for n in os.listdir(folder) if n.endswith(".txt")) if os.path.isdir(folder) else []
    rows = []
    for name in names:  # lists are kept by hand and small
        with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
            rows += [(name, i, line.rstrip("\r\n")) for i, line in enumerate(f)]
    return spark.createDataFrame(rows, "file string, line_no int, line string")
