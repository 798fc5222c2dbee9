"""From detections and issues to one verdict a file.

An object's score is the sum of its detections' scores, a file's the highest of
its objects'. A score at the threshold is conclusive; an allowed file is safe;
else an issue makes the file unsafe to vouch for. Sums and maxima are taken
before the shuffle, by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdikt.config import Config
from verdikt.operators.scan import Scanned

NO_SIGNATURES = "no signature database; run an update first"


def object_scores(detections: DataFrame) -> DataFrame:
    return detections.groupBy("file_id", "ord").agg(F.sum("score").cast("long").alias("score"))


def file_scores(detections: DataFrame) -> DataFrame:
    return object_scores(detections).groupBy("file_id").agg(F.max("score").alias("score"))


def verdict(score: Column, allowed: Column, issues: Column, config: Config) -> Column:
    bad = issues > 0
    return F.when(score >= config.threshold, "malicious").when(allowed, "safe").when(bad & (config.unscannable == "malicious"), "malicious").when(bad, "error").otherwise("safe")


def in_order(ord_: Column) -> Column:
    """A sort key that puts objects after the objects inside them (children before parents)."""
    return F.concat_ws("", F.transform(ord_, lambda i: F.lpad(i.cast("string"), 10, "0")), F.lit("~"))


def results(files: DataFrame, scanned: Scanned, config: Config, signatures: int) -> DataFrame:
    """One row a file: file_id, file, size, sha256, md5, type, verdict, error, score, objects_scanned, allowlisted, detections, unscannable, warnings."""
    top = scanned.objects.where("depth = 0").select("file_id", F.col("size"), "sha256", "md5", F.col("file_type").alias("type"), F.col("allowed").alias("allowlisted"))
    counted = scanned.objects.groupBy("file_id").agg(F.count(F.lit(1)).alias("objects_scanned"))
    scores = file_scores(scanned.detections)
    entry = F.struct((-F.col("score")).alias("k"), in_order(F.col("ord")).alias("o"), "seq", "engine", "name", F.col("path").alias("object"), "score")
    found = scanned.detections.groupBy("file_id").agg(F.sort_array(F.collect_list(entry)).alias("d"))
    found = found.select("file_id", F.transform("d", lambda d: F.struct(*(d[c].alias(c) for c in ("engine", "name", "object", "score")))).alias("detections"))
    note = F.struct(F.col("ord").alias("o"), "seq", F.col("path").alias("object"), "reason")

    def notes(rows: DataFrame, out: str) -> DataFrame:
        held = rows.groupBy("file_id").agg(F.sort_array(F.collect_list(note)).alias("n"))
        return held.select("file_id", F.transform("n", lambda n: F.struct(n["object"].alias("object"), n["reason"].alias("reason"))).alias(out))

    rows = files.select(F.col("file_id").cast("long").alias("file_id"), F.col("name").alias("file")).join(top, "file_id")
    for more in (counted, scores, found, notes(scanned.issues, "unscannable"), notes(scanned.warnings, "warnings")):
        rows = rows.join(more, "file_id", "left")
    pairs = "array<struct<object:string,reason:string>>"
    missing = F.array(F.struct(F.lit("").alias("object"), F.lit(NO_SIGNATURES).alias("reason"))).cast(pairs)
    lacking = ~F.col("allowlisted") & F.lit(config.require_signatures and signatures == 0)
    listed = F.coalesce("unscannable", F.array().cast(pairs))
    rows = rows.withColumns({"score": F.coalesce("score", F.lit(0).cast("long")), "unscannable": F.when(lacking, F.concat(missing, listed)).otherwise(listed)})
    # What could not be read at all is a failure under any policy.
    judged = verdict(F.col("score"), F.col("allowlisted"), F.size("unscannable"), config)
    rows = rows.withColumn("verdict", F.when(F.col("size").isNull(), "error").otherwise(judged))
    rows = rows.withColumn("error", F.when(F.col("verdict") == "error", F.get("unscannable", 0)["reason"]))
    none = F.array().cast("array<struct<engine:string,name:string,object:string,score:int>>")
    return rows.select("file_id", "file", "size", "sha256", "md5", "type", "verdict", "error", "score", "objects_scanned", "allowlisted", F.coalesce("detections", none).alias("detections"), "unscannable", F.coalesce("warnings", F.array().cast(pairs)).alias("warnings"))


def shown_names(detections: Column) -> Column:
    """Up to three names for display; after the first, those under a score of 20 end the list."""
    weak = F.array_position(F.transform(detections, lambda d, i: (i > 0) & (d["score"] < 20)), True)
    strong = F.when(weak > 0, F.slice(detections, F.lit(1), (weak - 1).cast("int"))).otherwise(detections)
    return F.transform(F.slice(strong, 1, 3), lambda d: d["name"])


def exit_code(verdicts: DataFrame) -> DataFrame:
    """One row: 1 if any file is malicious, else 2 if any failed, else 0."""
    any_of = lambda v: F.max((F.col("verdict") == v).cast("int"))
    counts = verdicts.agg(any_of("malicious").alias("m"), F.greatest(any_of("error"), any_of("retry")).alias("e"))
    return counts.select(F.when(F.col("m") == 1, 1).when(F.col("e") == 1, 2).otherwise(0).alias("exit_code"))


def result_json(rows: DataFrame) -> DataFrame:
    """(file_id, json): a result as one JSON line; empty lists and nulls are left out, detections stay. Of a file that could not be read there is its name and the error."""
    def filled(c):
        return F.when(F.size(c) > 0, F.col(c)).alias(c)
    columns = ["file", "size", "sha256", "md5", "type", "verdict", "error", filled("unscannable"), "score", "detections", "objects_scanned", filled("warnings"), F.when(F.col("allowlisted"), True).alias("allowlisted")]
    return rows.select("file_id", F.when(F.col("size").isNull(), F.to_json(F.struct("file", "error"))).otherwise(F.to_json(F.struct(*columns))).alias("json"))


def result_text(rows: DataFrame, verbose: bool = False) -> DataFrame:
    """(file_id, line): a result for reading; verbose ones have a line for each detection, issue and warning too."""
    names = F.concat_ws(", ", shown_names(F.col("detections")))
    line = F.when(F.col("verdict") == "malicious", F.concat(F.lit("MALICIOUS  "), "file", F.lit("  (score "), F.col("score").cast("string"), F.lit("): "), names))
    line = line.when(F.col("verdict") == "error", F.concat(F.lit("ERROR      "), "file", F.lit("  "), F.coalesce("error", F.lit("")))).otherwise(F.concat(F.lit("SAFE       "), "file"))
    if verbose:
        hits = F.transform("detections", lambda d: F.concat(F.lit("    ["), d["engine"], F.lit("] "), d["name"], F.lit(" (score "), d["score"].cast("string"), F.lit(") in "), d["object"]))
        notes = [F.transform(c, lambda n, label=label: F.concat(F.lit(f"    {label}: "), n["object"], F.lit(": "), n["reason"])) for c, label in (("unscannable", "not inspected"), ("warnings", "warning"))]
        line = F.concat_ws("\n", line, hits, *notes)
    return rows.select("file_id", line.alias("line"))


def top_findings(detections: DataFrame, most: int = 3) -> DataFrame:
    """(file_id, names): names for display, strongest first. Only the best few of a file ever meet in one row."""
    order = Window.partitionBy("file_id").orderBy(F.desc("score"), "ord", "seq", "name")
    best = detections.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    held = best.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("k", "name", "score"))).alias("d"))
    return held.select("file_id", F.concat_ws(",", shown_names(F.col("d"))).alias("names"))


def first_of_each_name(detections: DataFrame) -> DataFrame:
    """(file_id, name, score): of each name the first finding whose score is over zero, by object and place; one row a name leaves a task."""
    first = detections.where("score > 0").groupBy("file_id", "name").agg(F.min(F.struct("ord", "seq", "score")).alias("first"))
    return first.select("file_id", "name", F.col("first.score").alias("score"))
