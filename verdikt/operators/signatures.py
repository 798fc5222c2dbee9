"""The signature table: parsing, de-duplication, lookup and refresh.

A signature is (algo, hash, src_idx, source, tier): algo sha256 or md5, hash in
lower-case hex, src_idx the source's place in the configuration (a lower one
wins), tier base or delta (base wins). All of it is joins and aggregates keyed
by the hash, which is spread evenly; the hash of an empty file is never stored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY = (hashlib.sha256(b"").hexdigest(), hashlib.md5(b"").hexdigest())
COLUMNS = ("algo", "hash", "src_idx", "source")
#: Engines of detections.
SIGNATURE, HEURISTIC, ARCHIVE = "signature", "heuristic", "archive"
#: A hash match's score.
MATCH = 100


def parsed_hash(line: Column) -> Column:
    """struct<algo, hash> of the first SHA-256 in a feed line, else its first MD5, else null.

    Comment lines (# or ;) and empty ones hold none. Tokens stand between
    commas, blanks, tabs, quotes, semicolons, bars and colons.
    """
    plain = F.regexp_replace(line, r"^[ \t\n\x0b\f\r\x85\xa0]+|[ \t\n\x0b\f\r\x85\xa0]+$", "")
    tokens = F.split(plain, r"[, \t\"';|:]")
    sha256 = F.get(F.filter(tokens, lambda t: t.rlike(r"^[0-9A-Fa-f]{64}\z")), 0)
    md5 = F.get(F.filter(tokens, lambda t: t.rlike(r"^[0-9A-Fa-f]{32}\z")), 0)
    skipped = (plain == "") | plain.startswith("#") | plain.startswith(";")
    found = F.when(sha256.isNotNull(), F.struct(F.lit("sha256").alias("algo"), F.lower(sha256).alias("hash"))).when(md5.isNotNull(), F.struct(F.lit("md5").alias("algo"), F.lower(md5).alias("hash")))
    return F.when(~skipped, found)


def parse(lines: DataFrame) -> DataFrame:
    """(source, algo, hash) of the lines (source, line) that hold a hash."""
    found = lines.withColumn("h", parsed_hash(F.col("line"))).where("h is not null")
    return found.select("source", F.col("h.algo").alias("algo"), F.col("h.hash").alias("hash")).where(~F.col("hash").isin(*EMPTY))


def with_priority(signatures: DataFrame, sources: list[str]) -> DataFrame:
    """src_idx by the order of ``sources``; what is not among them comes last."""
    order = F.array(*(F.lit(s) for s in sources)) if sources else F.array().cast("array<string>")
    place = F.array_position(order, F.col("source"))
    return signatures.withColumn("src_idx", F.when(place > 0, place - 1).otherwise(F.lit(len(sources))).cast("int"))


def deduplicated(signatures: DataFrame) -> DataFrame:
    """One row a hash: the source with the least src_idx, then the first by name. Summed before the shuffle."""
    best = F.min(F.struct("src_idx", "source")).alias("best")
    kept = signatures.where(~F.col("hash").isin(*EMPTY)).groupBy("algo", "hash").agg(best)
    return kept.select("algo", "hash", F.col("best.src_idx").alias("src_idx"), F.col("best.source").alias("source"))


def full_refresh(fetched: DataFrame, base: DataFrame, delta: DataFrame, enabled: list[str], replaced: list[str]) -> DataFrame:
    """The new base: what was fetched, and of the old base and delta the enabled sources that were not replaced.

    A feed that failed is not among ``replaced`` and so keeps its old rows.
    """
    keep = F.col("source").isin(*enabled) & ~F.col("source").isin(*replaced)
    old = base.select(*COLUMNS).unionByName(delta.select(*COLUMNS)).where(keep)
    return deduplicated(with_priority(fetched.select("algo", "hash", "source").unionByName(old.select("algo", "hash", "source")), enabled))


def incremental_refresh(fetched: DataFrame, base: DataFrame, delta: DataFrame, enabled: list[str]) -> DataFrame:
    """The new delta: fetched hashes that the base does not have, and the old delta's enabled sources."""
    new = fetched.select("algo", "hash", "source").join(base.select("algo", "hash"), ["algo", "hash"], "left_anti")
    old = delta.where(F.col("source").isin(*enabled)).select("algo", "hash", "source")
    return deduplicated(with_priority(new.unionByName(old), enabled))


def merged(base: DataFrame, delta: DataFrame) -> DataFrame:
    """One row a hash over both tiers: the base's, where it has the hash."""
    both = base.select("algo", "hash", "source", F.lit(0).alias("tier")).unionByName(delta.select("algo", "hash", "source", F.lit(1).alias("tier")))
    return both.groupBy("algo", "hash").agg(F.min(F.struct("tier", "source")).alias("best")).select("algo", "hash", F.coalesce("best.source", F.lit("unknown")).alias("source"))


def set_counts(base: DataFrame, delta: DataFrame) -> DataFrame:
    """(source, algo, n) over both tiers, which are taken for disjoint."""
    both = base.select("source", "algo").unionByName(delta.select("source", "algo"))
    return both.groupBy("source", "algo").agg(F.count(F.lit(1)).alias("n"))


def set_summary(base: DataFrame, delta: DataFrame) -> DataFrame:
    """One row: n over both tiers, and the names of all their sources in order."""
    counts = set_counts(base, delta)
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sort_array(F.collect_set("source")).alias("sources"))


def local_entries(lines: DataFrame) -> DataFrame:
    """(algo, hash, name) of a local list's lines (file, line_no, line): the last entry of a hash wins.

    The first field is the hash; a name that is missing is the file's stem.
    """
    text = F.regexp_replace("line", r"^\s+|\s+$", "")
    fields = F.split(text, r"\s+", 2)
    key = F.lower(F.get(fields, 0))
    algo = F.when(key.rlike(r"^[0-9a-f]{64}\z"), "sha256").when(key.rlike(r"^[0-9a-f]{32}\z"), "md5")
    stem = F.regexp_replace(F.regexp_extract("file", "[^/]*$", 0), r"\.txt\z", "")
    rows = lines.where(~text.startswith("#")).select(algo.alias("algo"), key.alias("hash"), F.coalesce(F.get(fields, 1), stem).alias("name"), F.struct("file", "line_no").alias("place")).where("algo is not null")
    return rows.groupBy("algo", "hash").agg(F.max_by("name", "place").alias("name"))


def looked_up(objects: DataFrame, signatures: DataFrame | list[DataFrame], custom: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """The objects with ``allowed`` (boolean) and ``hit`` (the first match's name, or null).

    Order: allowed SHA-256, custom SHA-256, signature SHA-256, custom MD5,
    signature MD5. Objects of no bytes are not looked up, and an MD5 never
    allows. ``signatures`` has one row a hash (see ``merged``), local lists too; it
    may be several tables, of which the first that has a hash counts.

    The distinct hashes of the objects meet each list in a join of its own, so that
    a list that is bucketed by (algo, hash) is not shuffled; what was found, which is
    little as a rule, then goes back to the objects by one join for each algorithm,
    so the objects need not be shuffled for a large list.
    """
    tiers = signatures if isinstance(signatures, list) else [signatures]
    lists = [t.select("algo", "hash", F.lit(1 + k).alias("rank"), F.concat(F.lit("Malware."), F.upper("algo"), F.lit("."), F.col("source")).alias("name")) for k, t in enumerate(tiers)]
    if custom is not None:
        lists.append(custom.select("algo", "hash", F.lit(0).alias("rank"), "name"))
    if allowed is not None:
        lists.append(allowed.where("algo = 'sha256'").select("algo", "hash", F.lit(-1).alias("rank"), F.lit(None).cast("string").alias("name")))
    asked = objects.where("size > 0").select(F.explode(F.array(*(F.struct(F.lit(a).alias("algo"), F.col(a).alias("hash")) for a in ("sha256", "md5")))).alias("h"))
    asked = asked.select("h.algo", "h.hash").where("hash is not null").distinct()
    hits = asked.join(lists[0], ["algo", "hash"])
    for more in lists[1:]:
        hits = hits.unionByName(asked.join(more, ["algo", "hash"]))
    best = hits.groupBy("algo", "hash").agg(F.min(F.struct("rank", "name")).alias("best"))
    found = objects.withColumns({"__sha256": F.when(F.col("size") > 0, F.col("sha256")), "__md5": F.when(F.col("size") > 0, F.col("md5"))})
    for algo in ("sha256", "md5"):
        found = found.join(best.where(F.col("algo") == algo).select(F.col("hash").alias(f"__{algo}"), F.col("best").alias(f"__by_{algo}")), f"__{algo}", "left")
    is_allowed = F.coalesce(F.col("__by_sha256.rank") == -1, F.lit(False))
    found = found.withColumns({"allowed": is_allowed, "hit": F.when(~is_allowed, F.coalesce("__by_sha256.name", "__by_md5.name"))})
    return found.drop("__sha256", "__md5", "__by_sha256", "__by_md5")


def hash_answer(hashes: DataFrame, signatures: DataFrame, custom: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(hash, status, name) for bare hashes: malicious, safe (allowed SHA-256), unknown or bad."""
    low = F.lower("hash")
    sha256, md5 = low.rlike(r"^[0-9a-f]{64}\z"), low.rlike(r"^[0-9a-f]{32}\z")
    rows = hashes.select("hash", F.when(sha256, low).alias("sha256"), F.when(md5, low).alias("md5"), F.lit(1).cast("long").alias("size"), (sha256 | md5).alias("well"))
    status = F.when(~F.col("well"), "bad").when(F.col("hit").isNotNull(), "malicious").when(F.col("allowed"), "safe").otherwise("unknown")
    return looked_up(rows, signatures, custom, allowed).select("hash", status.alias("status"), F.col("hit").alias("name"))
