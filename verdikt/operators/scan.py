"""The scan: every file, and every object inside it, to findings and issues.

1. Files are typed and hashed and written once, with their contents.
2. Archives, and PDFs with objects in their streams, are unfolded: a task takes a
   file apart depth first, all the way down, and gives each member as a row, which
   is typed, hashed and written once. A file's archives share one budget of bytes
   and members, spent in the order in which a reader would meet them.
3. All objects' hashes, without contents, meet the signatures in one join. An
   allowed object and one with a match are not opened, so what came out of them
   goes again. Where that matters to others, as the budget had been spent, the file
   is unfolded once more with what is now known, until nothing new is found.
4. Where bytes must be parsed a task parses them and passes the content on to the
   expressions that inspect it; findings of objects that were not to be opened go.
   No step joins or shuffles contents.

An object's place is ``ord``, the path of child numbers from the file down, so
that results have a fixed order. Whatever could not be inspected is an issue
row; no step drops an object. The tables are in the shared scratch folder, so a
lost executor costs no more than its own tasks. ``Scanned.release`` removes them.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdikt.config import Config
from verdikt.functions.content import ARCHIVES, SEALED, base_name, container, file_type, hashes, is_archive, is_encrypted_office
from verdikt.operators import archives, clamd, documents, programs
from verdikt.operators.inspect import TEXT_SEEN, inspected
from verdikt.operators.rules import exploded
from verdikt.operators.signatures import ARCHIVE, HEURISTIC, MATCH, SIGNATURE, looked_up
from verdikt.sources.files import LARGE, gathered
from verdikt.sources.scratch import Scratch

OBJECTS = f"file_id long, ord array<int>, path string, name string, depth int, content binary, problem string, large {LARGE}"
#: Types that ``dissect`` takes apart.
PARSED = ("pe", "elf", "ole", "pdf", "unknown")
_MEMBERS = pa.schema(
    [
        ("file_id", pa.int64()),
        ("ord", pa.list_(pa.int32())),
        ("path", pa.string()),
        ("name", pa.string()),
        ("depth", pa.int32()),
        ("content", pa.binary()),
        ("sealed", pa.list_(pa.int32())),
        ("decrypted", pa.bool_()),
        ("container", pa.bool_()),
        ("met", pa.bool_()),
        ("too_deep", pa.bool_()),
        ("opened", pa.list_(pa.struct([("name", pa.string()), ("score", pa.int32())]))),
        ("issues", pa.list_(pa.string())),
        ("warnings", pa.list_(pa.string())),
    ]
)
#: A member has a content; a container has a second row, without one, for what its reader says.
MEMBERS = "file_id long, ord array<int>, path string, name string, depth int, content binary, sealed array<int>, decrypted boolean, container boolean, met boolean, too_deep boolean, opened array<struct<name:string,score:int>>, issues array<string>, warnings array<string>"
_DETAIL = pa.schema([("names", pa.list_(pa.string())), ("macros", pa.string()), ("pdf_body", pa.string()), ("pdf_streams", pa.string()), ("pdf_renamed", pa.bool_()), ("notes", pa.list_(pa.string()))])
DETAIL = "names array<string>, macros string, pdf_body string, pdf_streams string, pdf_renamed boolean, notes array<string>"


def top_level(files: DataFrame) -> DataFrame:
    """OBJECTS of files (file_id, name, content); optional columns say why a content is missing (``problem``) and what is known of one over the limit (``large``)."""
    has = set(files.columns)
    name = base_name(F.col("name"))
    return files.select(
        F.col("file_id").cast("long").alias("file_id"),
        F.array().cast("array<int>").alias("ord"),
        name.alias("path"),
        name.alias("name"),
        F.lit(0).alias("depth"),
        F.col("content").cast("binary").alias("content"),
        (F.col("problem") if "problem" in has else F.when(F.col("content").isNull(), "content could not be read")).alias("problem"),
        (F.col("large") if "large" in has else F.lit(None).cast(LARGE)).alias("large"),
    )


def _wide(content):
    """UTF-16 text with a byte order mark, as text; null for other contents."""
    low, high = F.substring(content, 1, 2) == F.lit(b"\xff\xfe"), F.substring(content, 1, 2) == F.lit(b"\xfe\xff")
    body = F.expr("substring(content, 3)")
    even = F.expr("substring(content, 3, (octet_length(content) - 2) div 2 * 2)")
    text = F.when(low, F.decode(even, "UTF-16LE")).when(high, F.decode(even, "UTF-16BE"))
    return F.when(F.octet_length(body) > 0, F.regexp_replace(text, r"[^\x00-\xff]", "?"))


def described(objects: DataFrame) -> DataFrame:
    """The objects with size, sha256, md5, kind and locked_office."""
    known = {c: F.coalesce(h, F.col(f"large.{c}")) for c, h in hashes(F.col("content")).items()}
    return objects.withColumns(known | {"kind": file_type(F.coalesce("content", "large.head")), "locked_office": F.coalesce(is_encrypted_office(F.col("content")), F.lit(False))})


class Unfolding:
    """One file, taken apart depth first. ``closed``: SHA-256 of objects that are not opened."""

    def __init__(self, file_id: int, config: Config, password: str | None, closed: set[str]):
        self.file_id, self.config, self.password, self.closed = file_id, config, password, closed
        self.limits = archives.Limits(config.max_file_size, config.max_compress_ratio)
        self.budget = archives.Budget(config.max_total_extract, config.max_archive_files)

    def rows(self, name: str, path: str, data: bytes, ord_: tuple = (), sealed: tuple | None = None):
        """Members of an object, and theirs, each before the next; then the object's own row, if it is a container."""
        kind = container(data)
        if kind is None or self.closed and hashlib.sha256(data).hexdigest() in self.closed:
            return
        got, deep = archives.Opened(), len(ord_) >= self.config.max_archive_depth
        members = self._members(kind, name, data, got)
        if deep:
            deep = kind != "pdf" or next(iter(members), None) is not None
        else:
            try:
                for at, member in enumerate(members):
                    place, below = (*ord_, at), f"{path}!{member.name}"
                    inner = place if member.decrypted else sealed
                    yield self._row(place, below, member.name, content=member.data, sealed=inner, decrypted=member.decrypted)
                    yield from self.rows(member.name, below, member.data, place, inner)
            except Exception as e:  # a reader's failure is this object's issue, not the file's
                got.issues.append(f"could not be parsed: {type(e).__name__}: {e}")
        yield self._row(ord_, path, name, sealed=sealed, container=True, met=self.budget.met, too_deep=deep, opened=[{"name": n, "score": s} for n, s in got.findings], issues=got.issues, warnings=got.warnings)

    def _members(self, kind: str, name: str, data: bytes, got: archives.Opened):
        if kind != "pdf":
            yield from archives.opened(kind, name, data, self.limits, self.budget, self.password, got)
        elif self.config.heuristics:
            # Objects in a PDF's streams take nothing from the budget.
            for at, stream in enumerate(documents.streams(data)[0]):
                if stream.startswith(documents.OBJECT_MAGIC):
                    yield archives.Member(f"stream{at}", stream)

    def _row(self, ord_: tuple, path: str, name: str, **more) -> dict:
        return {"file_id": self.file_id, "ord": ord_, "path": path, "name": name, "depth": len(ord_), "container": False} | more


def unfold(files: DataFrame, config: Config, password: str | None = None) -> DataFrame:
    """MEMBERS of files (file_id, ord, path, name, content), and of a column ``closed``, if any: hashes that keep an object shut.

    A file is one task's work, which holds its content and those of the containers
    that lead to a member; the budget bounds what may come out.
    """

    def rows(parts):
        for part in parts:
            for i in range(part.num_rows):
                get = {c: part.column(c)[i].as_py() for c in part.schema.names}
                one = Unfolding(get["file_id"], config, password, set(get.get("closed") or ()))
                yield from one.rows(get["name"], get["path"], get["content"])

    columns = [c for c in ("file_id", "path", "name", "content", "closed") if c in files.columns]
    return files.select(*columns).mapInArrow(lambda parts: gathered(rows(parts), _MEMBERS), MEMBERS)


def dissect(objects: DataFrame) -> DataFrame:
    """The objects with DETAIL of programs, macros and PDFs; the rest of the row, content and all, passes through."""

    def details(name: str, kind: str, data: bytes) -> dict:
        row = {"names": [], "notes": []}
        if kind == "pe":
            row["names"] = programs.pe_findings(data)
        elif kind == "elf":
            row["names"] = programs.elf_findings(data)
        elif kind == "pdf":
            plain, row["pdf_renamed"] = documents.plain_names(data)
            inflated, whole = documents.streams(data)
            row["pdf_body"] = plain.lower().decode("latin-1")
            row["pdf_streams"] = b"\n".join(inflated).lower().decode("latin-1")
            if not whole:
                row["notes"].append(f"{name}: PDF streams beyond the first {len(inflated)} were not inspected")
        else:
            macros, whole = documents.modules(data)
            row["macros"] = "\n".join(macros) if macros else None
            if not whole:
                row["notes"].append(f"{name}: VBA modules beyond the first {documents.MODULES}, or beyond {documents.MODULE_BYTES} bytes of one, were not inspected")
            if kind == "ole" and not macros and documents.VBA_PROJECT in data:
                row["names"] = ["Heuristic.Macro.Present"]
        return row

    def detail(part, i: int) -> dict:
        name, kind, data = (part.column(c)[i].as_py() for c in ("name", "kind", "content"))
        try:
            row = details(name, kind, data)
        except Exception as e:  # a reader's failure is this object's, not the job's
            row = {"names": [], "notes": [f"!could not be parsed: {type(e).__name__}: {e}"]}
        return row | {"content": data}

    def run(parts):
        for part in parts:
            at = 0
            for some in gathered((detail(part, i) for i in range(part.num_rows)), _DETAIL):
                yield pa.RecordBatch.from_arrays([*part.slice(at, len(some)).columns, *some.columns], names=[*part.schema.names, *_DETAIL.names])
                at += len(some)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in objects.schema)
    return objects.mapInArrow(run, f"{fields}, {DETAIL}")


class Scanned:
    """Tables of a scan: objects, detections, issues, warnings; see ``verdict.results``."""

    def __init__(self, objects: DataFrame, detections: DataFrame, issues: DataFrame, warnings: DataFrame, scratch: Scratch):
        self.objects, self.detections, self.issues, self.warnings, self._scratch = objects, detections, issues, warnings, scratch

    def release(self) -> None:
        """Removes the tables; for when results have been written."""
        self._scratch.drop("")


PLACE = ["file_id", "ord"]


def opened_below(known: DataFrame, shut: DataFrame) -> DataFrame:
    """Places of the objects (file_id, ord) that came out of one of ``shut``."""
    shut_places = shut.select("file_id", F.col("ord").alias("above"))
    inside = known.where(F.size("ord") > 0).join(shut.select("file_id").distinct(), "file_id", "left_semi").select(*PLACE)
    above = inside.withColumn("above", F.explode(F.transform(F.sequence(F.lit(0), F.size("ord") - 1), lambda n: F.slice("ord", F.lit(1), n))))
    return above.join(shut_places, ["file_id", "above"], "left_semi").select(*PLACE).distinct()


def scan(files: DataFrame, config: Config, signatures: DataFrame | list[DataFrame] | None = None, custom: DataFrame | None = None, allowed: DataFrame | None = None, password: str | None = None) -> Scanned:
    """Scans (file_id, name, content). ``signatures`` has algo, hash, source (see ``looked_up``); local lists algo, hash, name."""
    spark = files.sparkSession
    scratch = Scratch(spark, "scan")
    if signatures is None:
        signatures = spark.createDataFrame([], "algo string, hash string, source string")
    top = scratch.save(described(top_level(files)), "files")

    def looked(rows: DataFrame) -> DataFrame:
        slim = rows.select(*PLACE, "path", "depth", "size", "sha256", "md5", "kind", "problem", F.col("content").isNotNull().alias("held"), F.col("large").isNotNull().alias("is_large"), "locked_office", "sealed", "decrypted")
        return looked_up(slim, signatures, custom, allowed)

    none = {"sealed": F.lit(None).cast("array<int>"), "decrypted": F.lit(False)}
    absent = {"problem": F.lit(None).cast("string"), "large": F.lit(None).cast(LARGE)}
    boxes = top.where("content is not null").where(F.col("kind").isin(*ARCHIVES, "pdf"))
    rounds: list[tuple[DataFrame, DataFrame, DataFrame]] = []  # members, their look-ups, files of the round that a later one replaces
    known_top = scratch.save(looked(top.withColumns(none)), "known-files")
    again = boxes
    while True:
        n = len(rounds)
        members = scratch.save(described(unfold(again, config, password).withColumns(absent)), f"members-{n}")
        known = scratch.save(looked(members.where("not container")), f"known-{n}")
        shut = known_top.unionByName(known).where("allowed or hit is not null").select(*PLACE, "sha256")
        # Files whose budget was spent while something was open that is now known to stay shut.
        spent = members.where("container and met").select("file_id").distinct()
        opened = members.where("container and not too_deep").select(*PLACE).join(spent, "file_id", "left_semi")
        stale = scratch.save(shut.join(opened, PLACE, "left_semi").select("file_id").distinct(), f"stale-{n}")
        rounds.append((members, known, stale))
        if not stale.head(1):
            break
        # A file's shut objects are among its members, whose number is bounded.
        closed = shut
        for _, before, _ in rounds[:-1]:
            closed = closed.unionByName(before.where("allowed or hit is not null").select(*PLACE, "sha256"))
        closed = closed.join(stale, "file_id", "left_semi").groupBy("file_id").agg(F.collect_set("sha256").alias("closed"))
        again = boxes.join(closed, "file_id")

    def current(table: DataFrame, n: int) -> DataFrame:
        """Rows of a round but those of files that a later round took apart anew; never with contents."""
        return table.join(rounds[n][2], "file_id", "left_anti") if n < len(rounds) - 1 else table

    known = known_top
    reports = None
    for n, (members, looked_at, _) in enumerate(rounds):
        known = known.unionByName(current(looked_at, n))
        said = current(members.where("container").select(*PLACE, "path", "depth", "too_deep", "opened", "issues", "warnings"), n)
        reports = said if reports is None else reports.unionByName(said)
    below = opened_below(known, known.where("allowed or hit is not null"))
    known = scratch.save(known.join(below, PLACE, "left_anti"), "known")
    kept = known.where("not allowed and hit is null").select(*PLACE)
    reports = scratch.save(reports.join(kept, PLACE, "left_semi"), "reports")
    for n in range(len(rounds)):
        scratch.drop(f"known-{n}")

    detections = [known.where("hit is not null").select(*PLACE, "path", F.lit(0).alias("seq"), F.lit(SIGNATURE).alias("engine"), F.col("hit").alias("name"), F.lit(MATCH).alias("score"))]
    issues, warnings = [], []
    open_slim = known.where("held and not allowed and hit is null")
    contents = [top.withColumns(none).withColumn("round", F.lit(-1)), *(m.where("not container").withColumn("round", F.lit(n)) for n, (m, _, _) in enumerate(rounds))]

    def last_round(found: DataFrame) -> DataFrame:
        """Of slim rows with a file and a round, those of each file's last round, and of the files themselves."""
        for n, (_, _, stale) in enumerate(rounds[:-1]):
            found = found.join(stale.withColumn("round", F.lit(n)), ["file_id", "round"], "left_anti")
        return found

    covered = None
    if config.clamav != "off":
        # The daemon sees whole files and opens archives itself, but for members that only the password opens; a whole file's match counts beside the objects' sums.
        whole = top.where("content is not null")
        large = top.where("content is null and large is not null").join(known_top.where("not allowed and hit is null").select(*PLACE), PLACE, "left_semi")
        asked = whole.unionByName(large).select(*PLACE, "content", F.col("large.file").alias("file"), F.lit(-1).alias("round"))
        for n, (members, _, _) in enumerate(rounds):
            asked = asked.unionByName(members.where("decrypted").select(*PLACE, "content", F.lit(None).cast("string").alias("file"), F.lit(n).alias("round")))
        seen = last_round(scratch.save(clamd.scanned(asked, config.clamav_address, config.clamav_timeout), "clamd"))
        seen = seen.join(known.where("not allowed and (hit is null or size(ord) = 0)").select(*PLACE, "path"), PLACE)
        is_top = F.size("ord") == 0
        beside = F.when(is_top, F.array(F.lit((1 << 31) - 1))).otherwise(F.col("ord"))
        detections.append(seen.where("signature is not null").select("file_id", beside.alias("ord"), "path", F.lit(0).alias("seq"), F.lit(clamd.ENGINE).alias("engine"), F.col("signature").alias("name"), F.lit(MATCH).alias("score")))
        where = issues if config.clamav == "required" else warnings
        where.append(seen.where("problem is not null").select(*PLACE, "path", F.when(is_top, 8000).otherwise(-2).alias("seq"), F.col("problem").alias("reason")))
        covered = seen.where("problem is null").select("file_id", F.col("ord").alias("sealed"))

    def uncovered(rows: DataFrame) -> DataFrame:
        """Objects that the daemon did not see, itself or with the file or decrypted member that holds them."""
        return rows if covered is None else rows.withColumn("sealed", F.coalesce("sealed", F.array().cast("array<int>"))).join(covered, ["file_id", "sealed"], "left_anti")

    # Of a file too large to open, a hit or the daemon's answer says enough.
    unseen = uncovered(known.where("problem is not null and not allowed and (not is_large or hit is null)"))
    issues.append(unseen.select(*PLACE, "path", F.lit(-1).alias("seq"), F.col("problem").alias("reason")))
    if config.heuristics:
        rows = _union([part.where("content is not null").select(*PLACE, "path", "name", "kind", "content", "round") for part in contents])
        parsed = dissect(rows.where(F.col("kind").isin(*PARSED)))
        plain = rows.where(~F.col("kind").isin(*PARSED)).withColumns({f.split()[0]: F.lit(None).cast(f.split()[1]) for f in DETAIL.split(", ")})
        found = inspected(parsed.unionByName(plain).withColumn("decoded", F.when(F.col("kind") == "text", _wide(F.col("content")))).withColumnRenamed("kind", "file_type"))
        found = found.select(*PLACE, "path", "round", "findings", "notes")
        found = scratch.save(last_round(scratch.save(found, "details").where("size(findings) > 0 or size(notes) > 0")).join(kept, PLACE, "left_semi"), "found")
        detections.append(exploded(found, "findings", *PLACE, "path").select(*PLACE, "path", (F.col("seq") + 1).alias("seq"), F.lit(HEURISTIC).alias("engine"), "name", "score"))
        notes = found.select(*PLACE, "path", F.posexplode_outer("notes").alias("seq", "reason")).where("reason is not null")
        issues.append(notes.where(F.col("reason").startswith("!")).select(*PLACE, "path", "seq", F.substring("reason", 2, 1 << 30).alias("reason")))
        warnings.append(notes.where(~F.col("reason").startswith("!")).select(*PLACE, "path", (F.col("seq") + 500).alias("seq"), "reason"))
        warnings.append(known.where((F.col("kind") == "text") & F.col("held") & ~F.col("allowed") & F.col("hit").isNull() & (F.col("size") > TEXT_SEEN)).select(*PLACE, "path", F.lit(900).alias("seq"), F.lit(f"script rules saw the first {TEXT_SEEN} characters only").alias("reason")))
    detections.append(reports.select(*PLACE, "path", F.posexplode("opened").alias("seq", "f")).select(*PLACE, "path", (F.col("seq") + 1000).alias("seq"), F.lit(ARCHIVE).alias("engine"), F.col("f.name").alias("name"), F.col("f.score").alias("score")))
    issues.append(reports.select(*PLACE, "path", F.posexplode("issues").alias("seq", "reason")))
    warnings.append(reports.select(*PLACE, "path", F.posexplode("warnings").alias("seq", "reason")))
    issues.append(open_slim.where("locked_office").select(*PLACE, "path", F.lit(-1).alias("seq"), F.lit("password-protected Office document; content cannot be inspected").alias("reason")))
    sealed = uncovered(open_slim.where(F.col("kind").isin(*SEALED)))
    issues.append(sealed.select(*PLACE, "path", F.lit(0).alias("seq"), F.concat("kind", F.lit(" containers can only be inspected with ClamAV, which did not scan it")).alias("reason")))
    nested = reports.where("too_deep")
    detections.append(nested.select(*PLACE, "path", F.lit(2000).alias("seq"), F.lit(ARCHIVE).alias("engine"), F.lit("Heuristic.Archive.TooDeep").alias("name"), F.lit(50).alias("score")))
    issues.append(nested.select(*PLACE, "path", F.lit(0).alias("seq"), F.lit(f"nested deeper than max_archive_depth ({config.max_archive_depth})").alias("reason")))
    scratch.drop("details")
    objects = known.select(*PLACE, "path", "depth", "size", "sha256", "md5", F.col("kind").alias("file_type"), "allowed")
    return Scanned(objects, _union(detections), _union(issues), _union(warnings), scratch)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
