"""Registered queries over the standard tables, with the SQL that says the same.

Documents stand in for files: the text's UTF-8 bytes are the content, the
source is the feed's name, toxic documents are known malware and documents of
low quality are allowed by hand.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.config import Config
from verdikt.functions import content as C
from verdikt.operators import inspect as I
from verdikt.operators import rules as R
from verdikt.operators import scan as SC
from verdikt.operators import signatures as S
from verdikt.operators import verdict as V
from verdikt.plans.samples import GAPS, KINDS, LINES, MAGICS, NAMES, SNIPPETS, TEXTS, cases
from verdikt.sources.files import from_texts, local_path, read_files, write_files
from verdikt.sources.scratch import Scratch
from verdikt.streaming.scans import FILES, scan_stream

#: Documents that go into one archive of the round-trip queries.
PER_ARCHIVE = 64
CONFIG = Config(require_signatures=False)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


# -- tables that stand in for feeds -------------------------------------------


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(algo, hash, source) of every document, by both algorithms."""
    docs = _table(spark, sf_dir, "documents")
    content = F.encode("text", "UTF-8")
    both = docs.select("source", F.explode(F.array(F.struct(F.lit("sha256").alias("algo"), F.sha2(content, 256).alias("hash")), F.struct(F.lit("md5").alias("algo"), F.md5(content).alias("hash")))).alias("h"))
    return both.select("h.algo", "h.hash", "source")


def _by_label(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").where(condition)
    return docs.join(labels, "doc_id").select("source", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), F.md5(F.encode("text", "UTF-8")).alias("md5"))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_label(spark, sf_dir, "toxic = 1").select(F.lit("sha256").alias("algo"), F.col("sha256").alias("hash"), "source")
    return S.merged(rows, rows.limit(0))


def _allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_label(spark, sf_dir, "quality = 0").select(F.lit("sha256").alias("algo"), F.col("sha256").alias("hash")).distinct().withColumn("name", F.lit("by hand"))


_FEED_SQL = """feed AS (SELECT 'sha256' AS algo, sha256(text) AS hash, source FROM documents UNION ALL SELECT 'md5', md5(text), source FROM documents)"""
_KNOWN_SQL = """known AS (SELECT sha256(d.text) AS hash, min(d.source) AS source FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1 GROUP BY 1),
allowed AS (SELECT DISTINCT sha256(d.text) AS hash FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 0)"""


# -- hashes and signatures ----------------------------------------------------


def object_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = from_texts(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return files.select("file_id", "name", *(c.alias(n) for n, c in C.hashes(F.col("content")).items()))


def feed_line_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sha256, md5 = F.sha2(F.encode("text", "UTF-8"), 256), F.md5(F.encode("text", "UTF-8"))
    forms = F.array(*(F.replace(F.replace(F.replace(F.lit(x), F.lit("{h}"), sha256), F.lit("{m}"), md5), F.lit("{H}"), F.upper(sha256)) for x in LINES))
    lines = docs.select("doc_id", F.posexplode(forms).alias("line_no", "line")).withColumn("h", S.parsed_hash(F.col("line")))
    return lines.select("doc_id", "line_no", F.col("h.algo").alias("algo"), F.col("h.hash").alias("hash"))


def _feed_line_sql() -> str:
    forms = ", ".join(f"({i}, replace(replace(replace({_q(x)}, '{{h}}', sha256(d.text)), '{{m}}', md5(d.text)), '{{H}}', upper(sha256(d.text))))" for i, x in enumerate(LINES))
    return f"""
WITH lines AS (SELECT d.doc_id, v.line_no, v.line FROM documents d, LATERAL (VALUES {forms}) v(line_no, line)),
tokens AS (SELECT doc_id, line_no, CASE WHEN trim(line) = '' OR left(trim(line), 1) IN ('#', ';') THEN [] ELSE regexp_split_to_array(trim(line, ' ' || chr(9)), '[, \\t"'';|:]') END AS t FROM lines),
found AS (SELECT doc_id, line_no, list_filter(t, lambda x: regexp_full_match(x, '[0-9A-Fa-f]{{64}}'))[1] AS h, list_filter(t, lambda x: regexp_full_match(x, '[0-9A-Fa-f]{{32}}'))[1] AS m FROM tokens)
SELECT doc_id, line_no, CASE WHEN h IS NOT NULL THEN 'sha256' WHEN m IS NOT NULL THEN 'md5' END AS algo, lower(coalesce(h, m)) AS hash FROM found"""


def _sources(spark: SparkSession, sf_dir: str) -> list[str]:
    """The configuration's feeds, in order: a short list by its nature."""
    return [r[0] for r in _table(spark, sf_dir, "documents").select("source").distinct().sort("source").collect()]


def sig_build_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.deduplicated(S.with_priority(_feed(spark, sf_dir), _sources(spark, sf_dir)))


_DEDUPE_SQL = f"""
WITH {_FEED_SQL}, src AS (SELECT source, (row_number() OVER (ORDER BY source) - 1)::INTEGER AS src_idx FROM (SELECT DISTINCT source FROM documents)),
ranked AS (SELECT algo, hash, src_idx, source, row_number() OVER (PARTITION BY algo, hash ORDER BY src_idx) AS k FROM feed JOIN src USING (source))
SELECT algo, hash, src_idx, source FROM ranked WHERE k = 1"""


def _tiers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """Base: documents without a label; delta: those of low quality; fetched: toxic ones and all of the first feeds."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id", "left").select(F.lit("sha256").alias("algo"), F.sha2(F.encode("text", "UTF-8"), 256).alias("hash"), "source", "quality", "toxic")
    enabled = [s for s in _sources(spark, sf_dir) if s != "src3"]
    tier = lambda c: S.deduplicated(S.with_priority(rows.where(c).select("algo", "hash", "source"), enabled))
    return tier("quality is null"), tier("quality = 0"), rows.where("toxic = 1 or source in ('src0', 'src1')").select("algo", "hash", "source"), enabled


_TIERS_SQL = """src AS (SELECT source, CASE WHEN source = 'src3' THEN n ELSE k END::INTEGER AS src_idx FROM (SELECT source, row_number() OVER (ORDER BY source = 'src3', source) - 1 AS k, count(*) FILTER (source <> 'src3') OVER () AS n FROM (SELECT DISTINCT source FROM documents))),
rows AS (SELECT 'sha256' AS algo, sha256(d.text) AS hash, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
base AS (SELECT hash, min_by(source, (src_idx, source)) AS source FROM rows JOIN src USING (source) WHERE quality IS NULL GROUP BY hash),
delta AS (SELECT hash, min_by(source, (src_idx, source)) AS source FROM rows JOIN src USING (source) WHERE quality = 0 GROUP BY hash),
fetched AS (SELECT hash, source FROM rows WHERE toxic = 1 OR source IN ('src0', 'src1'))"""
_BEST_SQL = "SELECT 'sha256' AS algo, hash, min(src_idx) AS src_idx, min_by(source, (src_idx, source)) AS source FROM every JOIN src USING (source) GROUP BY hash"


def base_delta_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, delta, fetched, enabled = _tiers(spark, sf_dir)
    return S.incremental_refresh(fetched, base, delta, enabled)


def full_refresh_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, delta, fetched, enabled = _tiers(spark, sf_dir)
    return S.full_refresh(fetched, base, delta, enabled, ["src0", "src1"])


def failed_feed_keeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a full refresh in which src1 failed: its old rows stay."""
    base, delta, fetched, enabled = _tiers(spark, sf_dir)
    return S.full_refresh(fetched.where("source <> 'src1'"), base, delta, enabled, ["src0"])


def set_counts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, delta, _, _ = _tiers(spark, sf_dir)
    return S.set_counts(base, delta)


def sig_lookup_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against all five tables of the lookup."""
    files = from_texts(_table(spark, sf_dir, "documents"), "doc_id", "text").withColumns(C.hashes(F.col("content")))
    _, delta, _, _ = _tiers(spark, sf_dir)
    md5 = _by_label(spark, sf_dir, "quality = 1").select(F.lit("md5").alias("algo"), F.col("md5").alias("hash"), "source")
    custom = _by_label(spark, sf_dir, "toxic = 1 and quality = 0").select(F.lit("sha256").alias("algo"), F.col("sha256").alias("hash")).distinct().withColumn("name", F.lit("Custom.One"))
    known = S.merged(_known(spark, sf_dir), delta).unionByName(S.merged(md5, md5.limit(0)))
    allowed = _by_label(spark, sf_dir, "toxic = 0 and quality = 0").select(F.lit("sha256").alias("algo"), F.col("sha256").alias("hash")).distinct().withColumn("name", F.lit("by hand"))
    return S.looked_up(files.drop("content"), known, custom, allowed).select("file_id", "allowed", "hit")


_PRECEDENCE_SQL = f"""
WITH {_TIERS_SQL},
toxic AS (SELECT hash, min(source) AS source FROM rows WHERE toxic = 1 GROUP BY hash),
d256 AS (SELECT hash, coalesce(t.source, d.source) AS source FROM toxic t FULL JOIN delta d USING (hash)),
d5 AS (SELECT md5(d.text) AS hash, min(d.source) AS source FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 GROUP BY 1),
c256 AS (SELECT DISTINCT hash FROM rows WHERE toxic = 1 AND quality = 0), allow AS (SELECT DISTINCT hash FROM rows WHERE toxic = 0 AND quality = 0)
SELECT d.doc_id AS file_id, a.hash IS NOT NULL AS allowed, CASE WHEN a.hash IS NULL THEN coalesce(CASE WHEN c.hash IS NOT NULL THEN 'Custom.One' END, 'Malware.SHA256.' || x.source, 'Malware.MD5.' || y.source) END AS hit
FROM documents d LEFT JOIN allow a ON a.hash = sha256(d.text) LEFT JOIN c256 c ON c.hash = sha256(d.text) LEFT JOIN d256 x ON x.hash = sha256(d.text) LEFT JOIN d5 y ON y.hash = md5(d.text)"""


def hash_api_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    forms = F.array(F.sha2(F.encode("text", "UTF-8"), 256), F.upper(F.sha2(F.encode("text", "UTF-8"), 256)), F.md5(F.encode("text", "UTF-8")), F.col("source"))
    return S.hash_answer(docs.select(F.explode(forms).alias("hash")).distinct(), _known(spark, sf_dir), None, _allowed(spark, sf_dir))


_API_SQL = f"""
WITH {_KNOWN_SQL}, asked AS (SELECT DISTINCT unnest([sha256(text), upper(sha256(text)), md5(text), source]) AS hash FROM documents)
SELECT q.hash, CASE WHEN NOT regexp_full_match(q.hash, '[0-9A-Fa-f]{{64}}|[0-9A-Fa-f]{{32}}') THEN 'bad' WHEN a.hash IS NOT NULL THEN 'safe' WHEN k.hash IS NOT NULL THEN 'malicious' ELSE 'unknown' END AS status,
 CASE WHEN a.hash IS NULL THEN 'Malware.SHA256.' || k.source END AS name FROM asked q LEFT JOIN allowed a ON a.hash = lower(q.hash) LEFT JOIN known k ON k.hash = lower(q.hash)"""


# -- types, names and rules ---------------------------------------------------


def detect_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of every document, page and turn, and of contents by magic."""
    magic = spark.createDataFrame([(c, bytearray(bytes.fromhex(h) + b"\0" * n)) for c, h, n in MAGICS], "case string, content binary")
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("case"), F.encode("text", "UTF-8").alias("content"))
    pages = _table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("case"), F.encode("html", "UTF-8").alias("content"))
    every = magic.unionByName(docs).unionByName(pages)
    kind = F.col("file_type")
    return every.select("case", C.file_type(F.col("content")).alias("file_type")).withColumns({"archive": C.is_archive(kind), "executable": C.is_executable(kind)})


def _detect_sql() -> str:
    magic = ", ".join(f"('{c}', '{h}' || repeat('00', {n}))" for c, h, n in MAGICS)
    types = {"fat": "macho", "java": "unknown", "emptyzip": "zip", "notbzip2": "unknown", "png": "image", "jpeg": "image", "gif": "image", "zeros": "unknown", "short": "text", "empty": "unknown"}
    tests = [("4d5a", "pe"), ("7f454c46", "elf"), ("feedfacf", "macho"), ("cafebabe000000[01]", "macho"), ("d0cf11e0a1b11ae1", "ole"), ("504b0(304|506)", "zip"), ("1f8b08", "gzip"), ("425a683[1-9]", "bzip2"), ("fd377a585a00", "xz"), ("377abcaf271c", "7z"), ("526172211a07", "rar"), ("4d53434600000000", "cab"), ("4c00000001140200", "lnk"), ("7b5c7274", "rtf"), ("89504e470d0a1a0a|ffd8ff|47494638", "image")]
    cases = " ".join(f"WHEN regexp_matches(h, '^({m})') THEN '{t}'" for m, t in tests)
    assert set(types) <= {c for c, _, _ in MAGICS}
    # Text by its first bytes: no zero byte, and control characters under a twentieth; the tables' strings are valid UTF-8.
    text = """CASE WHEN strlen(t) = 0 THEN 'unknown' WHEN contains(left(t, 1024), '%PDF-') THEN 'pdf' WHEN regexp_matches(left(t, 8192), '\\x00') THEN 'unknown'
 WHEN 20 * length(regexp_replace(left(t, 8192), '[^\\x01-\\x08\\x0b\\x0e-\\x1a\\x1c-\\x1f]', '', 'g')) < least(strlen(t), 8192) THEN 'text' ELSE 'unknown' END"""
    return f"""
WITH blobs(c, h) AS (VALUES {magic}), typed AS (
SELECT c AS "case", CASE {cases} WHEN h <> '' AND NOT contains(h, '00') AND regexp_full_match(h, '([2-7][0-9a-f])+') THEN 'text' ELSE 'unknown' END AS file_type FROM blobs
UNION ALL SELECT c, CASE {cases} ELSE {text} END FROM (SELECT c, t, lower(hex(encode(left(t, 16)))) AS h FROM (SELECT 'd' || doc_id AS c, text AS t FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages) WHERE t IS NOT NULL))
SELECT "case", file_type, file_type IN ('zip', 'gzip', 'bzip2', 'xz', 'tar') AS archive, file_type IN ('pe', 'elf', 'macho') AS executable FROM typed"""


def name_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deceptive names: the samples, and every part's name with an ending."""
    given = spark.createDataFrame([(n,) for n in NAMES], "name string")
    parts = _table(spark, sf_dir, "part").select(F.concat("p_name", F.element_at(F.array(F.lit(".pdf.exe"), F.lit(".docx"), F.lit(".txt")), (F.col("p_size") % 3 + 1).cast("int"))).alias("name")).distinct()
    kinds = F.explode(F.array(*(F.lit(k) for k in KINDS))).alias("file_type")
    rows = given.unionByName(parts).distinct().select("name", kinds)
    found = rows.select(F.col("name").alias("file"), "file_type", I.name_findings(F.col("name"), F.col("file_type")).alias("f"))
    return R.exploded(found, "f", "file", "file_type").select(F.col("file").alias("name"), "file_type", F.col("name").alias("finding"), "score")


def _names_sql() -> str:
    given, kinds = ", ".join(f"({_q(n)})" for n in NAMES), ", ".join(f"('{k}')" for k in KINDS)
    docs = ", ".join(f"'{d}'" for d in I.DOCUMENTS)
    return f"""
WITH names AS (SELECT * FROM (VALUES {given}) v(name) UNION SELECT p_name || ['.pdf.exe', '.docx', '.txt'][p_size % 3 + 1] FROM part),
rows AS (SELECT n.name, k.file_type, lower(CASE WHEN n.name = '' THEN '.' ELSE regexp_extract(regexp_replace(n.name, '/+$', ''), '[^/]*$') END) AS base FROM names n, (VALUES {kinds}) k(file_type)),
found AS (SELECT *, contains(base, chr(8238)) AS rlo, regexp_matches(base, {_q(I.DOUBLE)}) AS twice, regexp_extract(base, '\\.[^./]*$') AS ext FROM rows)
SELECT name, file_type, 'Heuristic.Name.RightToLeftOverride' AS finding, 80 AS score FROM found WHERE rlo
UNION ALL SELECT name, file_type, 'Heuristic.Name.DoubleExtension', 50 FROM found WHERE twice
UNION ALL SELECT name, file_type, 'Heuristic.Name.DisguisedExecutable', 50 FROM found WHERE twice AND file_type IN ('pe', 'elf', 'macho', 'lnk')
UNION ALL SELECT name, file_type, 'Heuristic.Name.Masquerade', 60 FROM found WHERE file_type = 'pe' AND ext IN ({docs})"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case, name, text): the samples, each document and page."""
    given = spark.createDataFrame([(f"s{i}", n, t) for i, (n, t) in enumerate(TEXTS)], "case string, name string, text string")
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("case"), F.lit("d.txt").alias("name"), "text")
    pages = _table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("case"), F.lit("p.html").alias("name"), F.col("html").alias("text"))
    return given.unionByName(docs).unionByName(pages)


def _texts_sql() -> str:
    given = ", ".join(f"('s{i}', {_q(n)}, {_q(t)})" for i, (n, t) in enumerate(TEXTS))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""texts AS (SELECT *, translate(text, '{upper}', '{lower}') AS low FROM (SELECT * FROM (VALUES {given}) v("case", name, text)
 UNION ALL SELECT 'd' || doc_id, 'd.txt', text FROM documents UNION ALL SELECT 'p' || page_id, 'p.html', html FROM pages))"""


def _rule_sql(rule: R.Rule, text: str) -> str:
    tests = [f"contains({text}, {_q(x)})" for x in rule.all_of]
    for literals in (rule.any_of, rule.near):
        if literals:
            tests.append("(" + " OR ".join(f"contains({text}, {_q(x)})" for x in literals) + ")")
    if rule.regex:
        tests.append(f"regexp_matches({text}, {_q(rule.regex)})")
    return " AND ".join(tests)


def _rules(catalogue: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _texts(spark, sf_dir).where("text is not null").select("case", C.latin1(F.encode("text", "UTF-8")).alias("body"))
        found = R.findings(rows, "body", R.CATALOGUES[catalogue], "f")
        return R.exploded(found, "f", "case").select("case", F.col("name").alias("finding"), "score")

    return query


def _rules_sql(catalogue: str) -> str:
    """One statement a rule, in RE2 itself. No text of the tables holds an anchor, so windows don't matter here."""
    each = [f"""SELECT "case", {_q(r.name)} AS finding, {r.score} AS score FROM texts WHERE {_rule_sql(r, "low")}""" for r in R.CATALOGUES[catalogue]]
    return f"WITH {_texts_sql()}\n" + "\nUNION ALL ".join(each)


def inspect_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that inspection finds in texts: names, scripts, Office parts, macros, embedded programs."""
    rows = _texts(spark, sf_dir).where("text is not null").select("case", "name", F.lit("text").alias("file_type"), F.encode("text", "UTF-8").alias("content"))
    absent = {"names": "array<string>", "macros": "string", "pdf_body": "string", "pdf_streams": "string", "pdf_renamed": "boolean", "decoded": "string"}
    found = I.inspected(rows.withColumns({c: F.lit(None).cast(t) for c, t in absent.items()}))
    return R.exploded(found, "findings", "case").select("case", F.col("name").alias("finding"), "score")


def _inspect_tests() -> list[tuple[str, int, str]]:
    """(finding, score, condition) of all that inspection looks for in a text of columns name, text, low."""
    links, out = "ends_with(lower(name), '.rels')", """contains(low, 'targetmode="external"')"""
    hidden = "contains(low, '/oleobject') AND contains(low, 'mhtml:')"
    tests = [(r.name, r.score, _rule_sql(r, "low")) for r in R.SCRIPT]
    tests += [(r.name, r.score, f"contains(low, 'attribute vb_name') AND {_rule_sql(r, 'lower(text)')}") for r in R.VBA]
    tests += [
        ("Heuristic.Macro.Present", 10, "contains(low, 'attribute vb_name')"),
        ("Heuristic.Name.RightToLeftOverride", 80, "contains(lower(name), chr(8238))"),
        ("Heuristic.Name.DoubleExtension", 50, f"regexp_matches(lower(name), {_q(I.DOUBLE)})"),
        ("Heuristic.Office.Follina", 100, f"{links} AND (contains(low, 'ms-msdt:') OR contains(low, 'search-ms:'))"),
        ("Heuristic.Office.RemoteTemplate", 60, f"{links} AND {out} AND contains(low, 'attachedtemplate')"),
        ("Heuristic.Office.RemoteOLE", 70, f"{links} AND {out} AND {hidden}"),
        ("Heuristic.Office.RemoteOLE", 40, f"""{links} AND {out} AND NOT ({hidden}) AND contains(low, '/oleobject"') AND contains(low, 'target="http')"""),
        ("Heuristic.Office.RemoteFrame", 30, f"""{links} AND {out} AND contains(low, '/frame"') AND contains(low, 'target="http')"""),
        ("Heuristic.Office.XLM.MacroSheet", 30, "contains(lower(name), 'macrosheets/')"),
        ("Heuristic.Office.XLM.Exec", 50, f"contains(lower(name), 'macrosheets/') AND regexp_matches(low, {_q(I.MACRO_SHEET)})"),
        ("Heuristic.Office.XLM.Download", 30, "contains(lower(name), 'macrosheets/') AND (contains(low, 'urlmon') OR contains(low, 'urldownloadtofile'))"),
        ("Heuristic.Office.XLM.AutoOpen", 40, "ends_with(lower(name), 'workbook.xml') AND contains(low, '_xlnm.auto_open')"),
        ("Heuristic.Script.EmbeddedPE", 50, "contains(text, 'TVqQAAMAAAAEAAAA') OR contains(text, 'TVpQAAIAAAAEAA8A')"),
        ("Heuristic.HTML.Smuggling", 40, "contains(low, 'createobjecturl') AND contains(low, 'atob(') AND (contains(low, '.download') OR contains(low, 'mssaveoropenblob'))"),
    ]
    return tests


def _inspect_sql() -> str:
    each = [f"""SELECT "case", {_q(n)} AS finding, {s} AS score FROM texts WHERE {t}""" for n, s, t in _inspect_tests()]
    return f"WITH {_texts_sql()}\n" + "\nUNION ALL ".join(each)


def rule_near_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule whose two halves stand apart in a text longer than a window, by more or less than one reaches."""
    gap = F.element_at(F.array(*(F.lit(n) for n in GAPS)), (F.col("n_chars") % len(GAPS) + 1).cast("int"))
    body = F.concat(F.coalesce("text", F.lit("")), F.repeat(F.lit("plain words "), F.lit(100)), F.lit("\ncurl "), F.repeat(F.lit("x "), gap), F.lit("| sudo bash"))
    rows = _table(spark, sf_dir, "documents").select("doc_id", C.latin1(F.encode(body, "UTF-8")).alias("body"))
    found = R.exploded(R.findings(rows, "body", R.SCRIPT, "f"), "f", "doc_id")
    return found.select("doc_id", F.col("name").alias("finding"), "score")


def _near_sql() -> str:
    rule = next(r for r in R.SCRIPT if r.name == "Heuristic.Shell.PipeToShell")
    gaps = f"[{', '.join(map(str, GAPS))}][n_chars % {len(GAPS)} + 1]"
    return f"""
WITH b AS (SELECT doc_id, 'curl ' || repeat('x ', {gaps}) || '| sudo bash' AS body FROM documents),
w AS (SELECT doc_id, left(body, 4 + {R.REACH}) AS seen FROM b)
SELECT doc_id, '{rule.name}' AS finding, {rule.score} AS score FROM w WHERE regexp_matches(seen, {_q(rule.regex)})"""


def rtf_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RTF rules over every document as the body of an RTF, with control words by its length."""
    low = C.ascii_lower(F.concat(F.lit("{\\rtf1 "), "text", F.element_at(F.array(F.lit("\\ObjData 4d5a90000300000004000000FFFF"), F.lit("\\objupdate Equation.3"), F.lit("\\objclass Package d0cf11e0a1b11ae1 \\objocx"), F.lit("")), (F.col("n_chars") % 4 + 1).cast("int"))))
    found = _table(spark, sf_dir, "documents").select("doc_id", F.explode(I.rtf_findings(low)).alias("f"))
    return found.select("doc_id", F.col("f.name").alias("finding"), F.col("f.score").alias("score"))


_RTF_SQL = """
WITH r AS (SELECT doc_id, n_chars % 4 AS k FROM documents WHERE text IS NOT NULL)
SELECT r.doc_id, v.finding, v.score FROM r JOIN (VALUES (0, 'Heuristic.RTF.EmbeddedObject', 15), (0, 'Heuristic.RTF.EmbeddedPE', 50), (1, 'Heuristic.RTF.ObjUpdate', 25),
 (1, 'Heuristic.RTF.EquationEditor', 60), (2, 'Heuristic.RTF.Package', 30), (2, 'Heuristic.RTF.ActiveX', 25)) v(k, finding, score) ON v.k = r.k"""


def entropy_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.round(C.content_entropy(F.encode("text", "UTF-8")), 6).alias("entropy"))


_ENTROPY_SQL = """
WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS byte FROM documents), n AS (SELECT doc_id, byte, count(*) AS c FROM b GROUP BY ALL),
p AS (SELECT doc_id, c / sum(c) OVER (PARTITION BY doc_id) AS p FROM n)
SELECT d.doc_id, coalesce(round(e.entropy, 6), 0.0) AS entropy FROM documents d LEFT JOIN (SELECT doc_id, -sum(p * log2(p)) AS entropy FROM p GROUP BY doc_id) e USING (doc_id)"""


# -- scores and verdicts ------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as detections: an order is a file, a line an object, its quantity a score."""
    lines = _table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_orderkey").alias("file_id"), F.array("l_linenumber").alias("ord"), F.concat(F.lit("Rule."), "l_returnflag", F.lit("."), "l_linestatus").alias("name"), F.floor("l_quantity").cast("int").alias("score"), F.col("l_partkey").alias("seq"))


_LINES_SQL = "lines AS (SELECT l_orderkey AS file_id, l_linenumber AS obj, 'Rule.' || l_returnflag || '.' || l_linestatus AS name, floor(l_quantity)::INTEGER AS score, l_partkey AS seq FROM lineitem)"


def object_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.object_scores(_lines(spark, sf_dir)).select("file_id", F.get("ord", F.lit(0)).alias("obj"), "score")


def file_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.file_scores(_lines(spark, sf_dir))


def findings_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First finding of each name in an order, by line."""
    return V.first_of_each_name(_lines(spark, sf_dir))


def _verdicts(spark: SparkSession, sf_dir: str, config: Config) -> DataFrame:
    """Orders as files: priority 5-LOW is allowed, open orders have an issue, scores add up by order."""
    scores = _lines(spark, sf_dir).groupBy("file_id").agg(F.sum("score").alias("score"))
    orders = _table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "file_id").join(scores, "file_id", "left")
    score = F.coalesce("score", F.lit(0))
    return orders.select("file_id", score.alias("score"), V.verdict(score, F.col("o_orderpriority") == "5-LOW", (F.col("o_orderstatus") == "O").cast("int"), config).alias("verdict"))


def verdict_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir, Config())


def verdict_policy_malicious(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir, Config(unscannable="malicious"))


def exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By priority: the code that a batch of these orders ends with."""
    rows = _verdicts(spark, sf_dir, Config())
    return V.exit_code(rows)


def _verdict_sql(policy: str) -> str:
    return f"""WITH {_LINES_SQL}, s AS (SELECT file_id, sum(score)::BIGINT AS score FROM lines GROUP BY file_id),
v AS (SELECT o.o_orderkey AS file_id, coalesce(s.score, 0) AS score, CASE WHEN coalesce(s.score, 0) >= 100 THEN 'malicious' WHEN o.o_orderpriority = '5-LOW' THEN 'safe' WHEN o.o_orderstatus = 'O' THEN '{policy}' ELSE 'safe' END AS verdict
FROM orders o LEFT JOIN s ON s.file_id = o.o_orderkey)"""


def top_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names shown for each order: strongest first, at most three, weak ones left out after the first."""
    return V.top_findings(_lines(spark, sf_dir))


_TOP_SQL = f"""
WITH {_LINES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, obj, seq, name) AS k FROM lines)
SELECT file_id, string_agg(name, ',' ORDER BY k) AS names FROM r WHERE k <= 3 AND (k = 1 OR score >= 20) GROUP BY file_id"""


# -- whole scans --------------------------------------------------------------


def _summary(rows: DataFrame) -> DataFrame:
    return rows.select("file_id", "file", "size", "sha256", "verdict", "score", "objects_scanned", "allowlisted", F.get("detections", F.lit(0))["name"].alias("first_name"))


def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every document."""
    files = from_texts(_table(spark, sf_dir, "documents"), "doc_id", "text")
    scanned = SC.scan(files, CONFIG, _known(spark, sf_dir), None, _allowed(spark, sf_dir))
    return _summary(V.results(files, scanned, CONFIG, 1))


_SCAN_SQL = f"""
WITH {_KNOWN_SQL}
SELECT d.doc_id AS file_id, 'doc_' || d.doc_id || '.txt' AS file, strlen(d.text) AS size, sha256(d.text) AS sha256,
 CASE WHEN a.hash IS NULL AND k.hash IS NOT NULL THEN 'malicious' ELSE 'safe' END AS verdict, CASE WHEN a.hash IS NULL AND k.hash IS NOT NULL THEN 100 ELSE 0 END::BIGINT AS score,
 1::BIGINT AS objects_scanned, a.hash IS NOT NULL AS allowlisted, CASE WHEN a.hash IS NULL THEN 'Malware.SHA256.' || k.source END AS first_name
FROM documents d LEFT JOIN allowed a ON a.hash = sha256(d.text) LEFT JOIN known k ON k.hash = sha256(d.text)"""


#: Bytes beyond which the files of ``scan_large_files`` are only hashed.
LARGE_FILES = 2_000


def scan_large_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files on disk, of which those over a small limit are read in pieces: hashes, lists and the type by the head."""
    folder = local_path(Scratch(spark, "large").path("files"))
    write_files(from_texts(_table(spark, sf_dir, "documents"), "doc_id", "text"), folder)
    config = replace(CONFIG, max_file_size=LARGE_FILES)
    files = read_files(spark, [folder], config.max_file_size)
    rows = V.results(files, SC.scan(files, config, _known(spark, sf_dir), None, _allowed(spark, sf_dir)), config, 1)
    doc_id = F.regexp_extract("file", r"doc_(-?\d+)\.txt$", 1).cast("long").alias("doc_id")
    return rows.select(doc_id, "size", "sha256", "md5", "verdict", "score", "allowlisted", F.get("detections", F.lit(0))["name"].alias("first_name"), F.size("unscannable").alias("n_issues"))


_LARGE_SQL = f"""
WITH {_KNOWN_SQL},
f AS (SELECT d.doc_id, strlen(d.text) AS size, sha256(d.text) AS sha256, md5(d.text) AS md5, a.hash IS NOT NULL AS allowlisted, a.hash IS NULL AND k.hash IS NOT NULL AS bad, k.source
  FROM documents d LEFT JOIN allowed a ON a.hash = sha256(d.text) LEFT JOIN known k ON k.hash = sha256(d.text)),
g AS (SELECT *, size > {LARGE_FILES} AND NOT allowlisted AND NOT bad AS unseen FROM f)
SELECT doc_id, size, sha256, md5, CASE WHEN bad THEN 'malicious' WHEN unseen THEN 'error' ELSE 'safe' END AS verdict, CASE WHEN bad THEN 100 ELSE 0 END::BIGINT AS score, allowlisted,
 CASE WHEN bad THEN 'Malware.SHA256.' || source END AS first_name, unseen::INTEGER AS n_issues FROM g"""


def _snippet(length):
    return F.element_at(F.array(*(F.lit(x) for x in SNIPPETS)), (length % len(SNIPPETS) + 1).cast("int"))


def scan_injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with lines of scripts put in: rules, signatures and lists meet in one verdict."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), _snippet(F.col("doc_id"))).alias("text"))
    files = from_texts(docs, "doc_id", "text")
    found = docs.select(F.sha2(F.encode("text", "UTF-8"), 256).alias("hash"), F.lit("sha256").alias("algo"), "doc_id")
    known = S.merged(found.where("doc_id % 7 = 3").select("algo", "hash", F.lit("feed").alias("source")), found.limit(0).select("algo", "hash", F.lit("feed").alias("source")))
    allowed = found.where("doc_id % 11 = 5").select("algo", "hash").distinct().withColumn("name", F.lit("by hand"))
    rows = V.results(files, SC.scan(files, CONFIG, known, None, allowed), CONFIG, 1)
    return rows.select("file_id", "verdict", "score", F.size("detections").alias("n_detections"), "allowlisted")


def _injected_sql() -> str:
    snippets = ", ".join(_q(x) for x in SNIPPETS)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    each = "\nUNION ALL ".join(f"SELECT doc_id, {s} AS score FROM texts WHERE {t}" for _, s, t in _inspect_tests())
    return f"""
WITH texts AS (SELECT doc_id, 'doc_' || doc_id || '.txt' AS name, text, translate(text, '{upper}', '{lower}') AS low, sha256(text) AS hash FROM (SELECT doc_id, coalesce(text, '') || [{snippets}][doc_id % {len(SNIPPETS)} + 1] AS text FROM documents)),
found AS ({each}),
scored AS (SELECT doc_id, sum(score) AS score, count(*) AS n FROM found GROUP BY doc_id),
listed AS (SELECT t.doc_id, t.hash IN (SELECT hash FROM texts WHERE doc_id % 11 = 5) AS allowlisted, t.hash IN (SELECT hash FROM texts WHERE doc_id % 7 = 3) AS known FROM texts t),
judged AS (SELECT l.*, CASE WHEN allowlisted THEN 0 WHEN known THEN 100 ELSE coalesce(s.score, 0) END AS score, CASE WHEN allowlisted THEN 0 WHEN known THEN 1 ELSE coalesce(s.n, 0) END AS n FROM listed l LEFT JOIN scored s USING (doc_id))
SELECT doc_id AS file_id, CASE WHEN score >= {CONFIG.threshold} THEN 'malicious' ELSE 'safe' END AS verdict, score::BIGINT AS score, n::INTEGER AS n_detections, allowlisted FROM judged"""


def scan_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files of other kinds: bombs, nesting, passwords, cut members, programs, macros, PDF, shortcuts, wide text."""
    made = cases()
    files = spark.createDataFrame([(i, name, bytearray(content)) for i, (name, content, *_) in enumerate(made)], "file_id long, name string, content binary")
    config = Config(require_signatures=False, max_file_size=1 << 20, max_total_extract=8 << 20, max_archive_files=50, max_archive_depth=3)
    rows = V.results(files, SC.scan(files, config), config, 0)
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("detections", lambda d: d["name"]))), ",")
    return rows.select("file", "verdict", "score", "objects_scanned", names.alias("names"), F.size("unscannable").alias("n_issues"))


def _samples_sql() -> str:
    rows = ", ".join(f"({_q(name)}, '{verdict}', {score}::BIGINT, {objects}::BIGINT, {_q(','.join(sorted(names)))}, {issues})" for name, _, verdict, score, objects, names, issues in cases())
    return f"SELECT * FROM (VALUES {rows}) v(file, verdict, score, objects_scanned, names, n_issues)"


def stream_scan_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan of the documents as a stream of files; nothing is allowed here."""
    scratch = Scratch(spark, "stream")
    scratch.save(from_texts(_table(spark, sf_dir, "documents"), "doc_id", "text"), "in")
    known = scratch.save(_known(spark, sf_dir), "known")
    arrived = spark.readStream.schema(FILES).parquet(scratch.path("in"))
    scan_stream(arrived, scratch.path("out"), scratch.path("checkpoint"), CONFIG, lambda: known).awaitTermination()
    return _summary(spark.read.parquet(scratch.path("out")))


def _packed(kind: str):
    """Archives of the documents, PER_ARCHIVE consecutive ids to each: file_id, name, content."""
    schema = pa.schema([("file_id", pa.int64()), ("name", pa.string()), ("content", pa.binary())])

    def pack(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("doc_id").to_pylist(), group.column("text").to_pylist()))
        out, key = io.BytesIO(), group.column("bucket")[0].as_py()
        if kind == "tgz":
            with tarfile.open(fileobj=out, mode="w:gz") as tar:
                for doc_id, text in rows:
                    entry = tarfile.TarInfo(f"d/{doc_id}.txt")
                    entry.size = len(text.encode())
                    tar.addfile(entry, io.BytesIO(text.encode()))
        else:
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                for doc_id, text in rows:
                    archive.writestr(f"d/{doc_id}.txt", text)
        content = out.getvalue()
        if kind == "nested":
            outer = io.BytesIO()
            with zipfile.ZipFile(outer, "w") as archive:
                archive.writestr("inner.zip", content)
            content = outer.getvalue()
        return pa.table([[key], [f"a{key}.{'tgz' if kind == 'tgz' else 'zip'}"], [content]], schema=schema)

    return pack


def _roundtrip(kind: str, depth: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.floor(F.col("doc_id") / PER_ARCHIVE).cast("long").alias("bucket"))
        files = Scratch(spark, kind).save(docs.groupBy("bucket").applyInArrow(_packed(kind), "file_id long, name string, content binary"), "archives")
        scanned = SC.scan(files, CONFIG)
        return scanned.objects.where(F.col("depth") == depth).select("file_id", "path", "sha256", "size", "depth")

    return query


def _roundtrip_sql(path: str, depth: int) -> str:
    return f"SELECT doc_id // {PER_ARCHIVE} AS file_id, 'a' || doc_id // {PER_ARCHIVE} || '{path}' || doc_id || '.txt' AS path, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, '')) AS size, {depth} AS depth FROM documents"


QUERIES = {
    "scan_documents": scan_documents,
    "scan_large_files": scan_large_files,
    "object_hashes": object_hashes,
    "feed_line_parse": feed_line_parse,
    "sig_build_dedupe": sig_build_dedupe,
    "base_delta_incremental": base_delta_incremental,
    "full_refresh_replace": full_refresh_replace,
    "failed_feed_keeps": failed_feed_keeps,
    "set_counts_by_source": set_counts_by_source,
    "sig_lookup_precedence": sig_lookup_precedence,
    "hash_api_lookup": hash_api_lookup,
    "detect_type": detect_type,
    "name_findings": name_findings,
    "rules_script": _rules("script"),
    "rules_binary": _rules("binary"),
    "rules_vba": _rules("vba"),
    "rules_pdf_js": _rules("pdf_js"),
    "inspect_texts": inspect_texts,
    "rtf_findings": rtf_findings,
    "entropy_bits": entropy_bits,
    "object_score": object_score,
    "file_score": file_score,
    "findings_dedupe": findings_dedupe,
    "verdict_error": verdict_error,
    "verdict_policy_malicious": verdict_policy_malicious,
    "exit_code": exit_code,
    "top_names": top_names,
    "archive_roundtrip_zip": _roundtrip("zip", 1),
    "archive_roundtrip_tgz": _roundtrip("tgz", 2),
    "archive_roundtrip_nested": _roundtrip("nested", 2),
    "stream_scan_equals_batch": stream_scan_equals_batch,
    "scan_injected": scan_injected,
    "scan_samples": scan_samples,
    "rule_near_window": rule_near_window,
}

ORACLES = {
    "scan_documents": _SCAN_SQL,
    "scan_large_files": _LARGE_SQL,
    "scan_injected": _injected_sql(),
    "scan_samples": _samples_sql(),
    "rule_near_window": _near_sql(),
    "object_hashes": "SELECT doc_id AS file_id, 'doc_' || doc_id || '.txt' AS name, sha256(text) AS sha256, md5(text) AS md5, strlen(text) AS size FROM documents",
    "feed_line_parse": _feed_line_sql(),
    "sig_build_dedupe": _DEDUPE_SQL,
    "base_delta_incremental": f"WITH {_TIERS_SQL}, every AS (SELECT hash, source FROM fetched WHERE hash NOT IN (SELECT hash FROM base) UNION ALL SELECT hash, source FROM delta WHERE source <> 'src3') {_BEST_SQL}",
    "full_refresh_replace": f"WITH {_TIERS_SQL}, every AS (SELECT hash, source FROM fetched UNION ALL SELECT hash, source FROM (SELECT * FROM base UNION ALL SELECT * FROM delta) WHERE source NOT IN ('src0', 'src1', 'src3')) {_BEST_SQL}",
    "failed_feed_keeps": f"WITH {_TIERS_SQL}, every AS (SELECT hash, source FROM fetched WHERE source <> 'src1' UNION ALL SELECT hash, source FROM (SELECT * FROM base UNION ALL SELECT * FROM delta) WHERE source NOT IN ('src0', 'src3')) {_BEST_SQL}",
    "set_counts_by_source": f"WITH {_TIERS_SQL} SELECT source, 'sha256' AS algo, count(*) AS n FROM (SELECT * FROM base UNION ALL SELECT * FROM delta) GROUP BY source",
    "sig_lookup_precedence": _PRECEDENCE_SQL,
    "hash_api_lookup": _API_SQL,
    "detect_type": _detect_sql(),
    "name_findings": _names_sql(),
    "rules_script": _rules_sql("script"),
    "rules_binary": _rules_sql("binary"),
    "rules_vba": _rules_sql("vba"),
    "rules_pdf_js": _rules_sql("pdf_js"),
    "inspect_texts": _inspect_sql(),
    "rtf_findings": _RTF_SQL,
    "entropy_bits": _ENTROPY_SQL,
    "object_score": f"WITH {_LINES_SQL} SELECT file_id, obj, sum(score)::BIGINT AS score FROM lines GROUP BY ALL",
    "file_score": f"WITH {_LINES_SQL} SELECT file_id, max(score) AS score FROM (SELECT file_id, obj, sum(score)::BIGINT AS score FROM lines GROUP BY ALL) GROUP BY file_id",
    "findings_dedupe": f"WITH {_LINES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY file_id, name ORDER BY obj, seq, score) AS k FROM lines WHERE score > 0) SELECT file_id, name, score FROM r WHERE k = 1",
    "verdict_error": _verdict_sql("error") + " SELECT * FROM v",
    "verdict_policy_malicious": _verdict_sql("malicious") + " SELECT * FROM v",
    "exit_code": _verdict_sql("error") + " SELECT CASE WHEN bool_or(verdict = 'malicious') THEN 1 WHEN bool_or(verdict = 'error') THEN 2 ELSE 0 END AS exit_code FROM v",
    "top_names": _TOP_SQL,
    "archive_roundtrip_zip": _roundtrip_sql(".zip!d/", 1),
    "archive_roundtrip_tgz": "SELECT doc_id // 64 AS file_id, 'a' || doc_id // 64 || '.tgz!a' || doc_id // 64 || '.tar!d/' || doc_id || '.txt' AS path, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, '')) AS size, 2 AS depth FROM documents",
    "archive_roundtrip_nested": _roundtrip_sql(".zip!inner.zip!d/", 2),
    "stream_scan_equals_batch": """
WITH known AS (SELECT sha256(d.text) AS hash, min(d.source) AS source FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1 GROUP BY 1)
SELECT d.doc_id AS file_id, 'doc_' || d.doc_id || '.txt' AS file, strlen(d.text) AS size, sha256(d.text) AS sha256, CASE WHEN k.hash IS NOT NULL THEN 'malicious' ELSE 'safe' END AS verdict,
 CASE WHEN k.hash IS NOT NULL THEN 100 ELSE 0 END::BIGINT AS score, 1::BIGINT AS objects_scanned, false AS allowlisted, 'Malware.SHA256.' || k.source AS first_name
FROM documents d LEFT JOIN known k ON k.hash = sha256(d.text)""",
}
