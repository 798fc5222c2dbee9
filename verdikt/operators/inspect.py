"""Findings of names and contents, type by type, as Spark expressions.

``inspected`` adds to each object the array of its findings. Text, shortcuts,
RTF and the string rules of programs are expressions alone. What must be parsed
byte by byte (programs' headers, macros, PDF streams) comes from one pass of
``dissect`` over just those objects, as columns that the same rules then read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdikt.functions.content import ascii_lower, base_name, is_executable, is_test_file, latin1
from verdikt.operators import rules as R

# Extensions, interpreters, markers and scores.
DOUBLE = r"\.(pdf|docx?|xlsx?|pptx?|rtf|txt|jpe?g|png|gif|bmp|mp3|mp4|avi|mov|zip|rar|csv|html?)[\s_.]*\.(exe|scr|com|pif|bat|cmd|js|jse|vbs|vbe|wsf|wsh|hta|lnk|ps1|msi|cpl|jar|iso|img|vhdx?)$"
DOCUMENTS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".txt", ".jpg", ".jpeg", ".png", ".gif", ".mp3", ".mp4", ".rtf", ".csv")
RISKY = (".exe", ".scr", ".com", ".pif", ".bat", ".cmd", ".js", ".jse", ".vbs", ".vbe", ".wsf", ".wsh", ".hta", ".lnk", ".ps1", ".msi", ".cpl", ".jar", ".dll", ".iso", ".img", ".vhd", ".vhdx", ".docm", ".xlsm", ".pptm", ".one")
INTERPRETERS = ("cmd.exe", "powershell", "pwsh", "mshta", "wscript", "cscript", "rundll32", "regsvr32", "certutil", "bitsadmin", "msiexec", "conhost", "forfiles", "curl.exe")
MACRO_SHEET = r"(exec|call|register|formula\.fill|halt)\s*\("
#: Names of the Office parts that are looked into.
OFFICE_PART = r"(?i)(\.rels\z|macrosheets/|workbook\.xml\z)"
PDF_SCRIPT, PDF_AUTO = r"/(javascript|js)[\s/<(\[]", r"/(openaction|aa)[\s/<\[]"
#: Characters of a text that the script rules see.
TEXT_SEEN = 16 << 20
STRUCTURAL = {
    "Heuristic.PE.Malformed": 30,
    "Heuristic.PE.WritableCode": 15,
    "Heuristic.PE.EncryptedCode": 25,
    "Heuristic.PE.EntryPointOutsideSections": 35,
    "Heuristic.PE.EntryPointLastSection": 20,
    "Heuristic.PE.ProcessInjection": 50,
    "Heuristic.PE.ProcessHollowing": 50,
    "Heuristic.PE.Keylogger": 35,
    "Heuristic.PE.Downloader": 20,
    "Heuristic.PE.CredentialAccess": 30,
    "Heuristic.PE.AntiDebug": 10,
    "Heuristic.PE.CryptoRansom": 25,
    "Heuristic.PE.MinimalImports": 15,
    "Heuristic.PE.EmbeddedExecutable": 30,
    "Heuristic.ELF.Malformed": 25,
    "Heuristic.ELF.Packer.UPX": 20,
    "Heuristic.ELF.NoSections": 15,
    "Heuristic.ELF.WritableCode": 15,
    "Heuristic.ELF.PackedStatic": 20,
    "Heuristic.Macro.Present": 10,
}
#: Every packer that a section's name betrays.
PACKER = 20


def extension(base: Column) -> Column:
    return F.regexp_extract(base, r"\.[^./]*\z", 0)


def is_risky_name(name: Column) -> Column:
    return extension(F.lower(base_name(name))).isin(*RISKY)


def name_findings(name: Column, kind: Column) -> Column:
    base = F.lower(base_name(name))
    double = base.rlike(R.java(DOUBLE))
    return R.chosen(
        (base.contains("‮"), "Heuristic.Name.RightToLeftOverride", 80),
        (double, "Heuristic.Name.DoubleExtension", 50),
        (double & (is_executable(kind) | (kind == "lnk")), "Heuristic.Name.DisguisedExecutable", 50),
        ((kind == "pe") & extension(base).isin(*DOCUMENTS), "Heuristic.Name.Masquerade", 60),
    )


def office_part_findings(name: Column, low: Column) -> Column:
    """Parts of an Office container, as they come out of its zip."""
    path = F.lower(name)
    links, sheet = path.endswith(".rels"), path.contains("macrosheets/")
    outside = links & low.contains('targetmode="external"')
    hidden = outside & low.contains("/oleobject") & low.contains("mhtml:")
    return R.chosen(
        (links & (low.contains("ms-msdt:") | low.contains("search-ms:")), "Heuristic.Office.Follina", 100),
        (outside & low.contains("attachedtemplate"), "Heuristic.Office.RemoteTemplate", 60),
        (hidden, "Heuristic.Office.RemoteOLE", 70),
        (~hidden & outside & low.contains('/oleobject"') & low.contains('target="http'), "Heuristic.Office.RemoteOLE", 40),
        (outside & low.contains('/frame"') & low.contains('target="http'), "Heuristic.Office.RemoteFrame", 30),
        (sheet, "Heuristic.Office.XLM.MacroSheet", 30),
        (sheet & low.rlike(R.java(MACRO_SHEET)), "Heuristic.Office.XLM.Exec", 50),
        (sheet & (low.contains("urlmon") | low.contains("urldownloadtofile")), "Heuristic.Office.XLM.Download", 30),
        (path.endswith("workbook.xml") & low.contains("_xlnm.auto_open"), "Heuristic.Office.XLM.AutoOpen", 40),
    )


def embedded_findings(text: Column) -> Column:
    """Programs in base64 (by case), and pages that put a download together."""
    return R.chosen(
        (text.contains("TVqQAAMAAAAEAAAA") | text.contains("TVpQAAIAAAAEAA8A"), "Heuristic.Script.EmbeddedPE", 50),
        (R.mentions(text, "createobjecturl") & R.mentions(text, "atob(") & (R.mentions(text, ".download") | R.mentions(text, "mssaveoropenblob")), "Heuristic.HTML.Smuggling", 40),
    )


def rtf_findings(low: Column) -> Column:
    return R.chosen(
        (low.contains("\\objdata"), "Heuristic.RTF.EmbeddedObject", 15),
        (low.contains("\\objupdate"), "Heuristic.RTF.ObjUpdate", 25),
        # The third literal has capitals and so never fits lower-cased text; it is kept as it is defined.
        (low.contains("equation.3") | low.contains("4571756174696f6e2e33") | low.contains("4571756174696f6e204e6174697665"), "Heuristic.RTF.EquationEditor", 60),
        (low.contains("\\objclass package") | low.contains("5061636b61676500"), "Heuristic.RTF.Package", 30),
        (low.contains("4d5a90000300000004000000ffff"), "Heuristic.RTF.EmbeddedPE", 50),
        (low.contains("d0cf11e0a1b11ae1") & low.contains("\\objocx"), "Heuristic.RTF.ActiveX", 25),
    )


def shortcut_findings(low: Column) -> Column:
    launches = F.lit(False)
    for program in INTERPRETERS:
        launches = launches | low.contains(program)
    return R.chosen((launches, "Heuristic.LNK.LaunchesInterpreter", 40), (low.rlike(R.java(r"\s{80,}")), "Heuristic.LNK.HiddenArguments", 30))


def ole_findings(content: Column) -> Column:
    wide = lambda s: F.lit(s.encode("utf-16-le"))
    return R.chosen(
        (content.contains(wide("Equation Native")) | content.contains(F.lit(b"Equation.3")), "Heuristic.Office.EquationEditor", 50),
        (content.contains(wide("\x01Ole10Native")), "Heuristic.Office.OLEPackage", 20),
    )


def pdf_findings(body: Column, renamed: Column) -> Column:
    scripted = body.rlike(R.java(PDF_SCRIPT))
    return R.chosen(
        (renamed, "Heuristic.PDF.ObfuscatedNames", 25),
        (scripted, "Heuristic.PDF.JavaScript", 20),
        (scripted & body.rlike(R.java(PDF_AUTO)), "Heuristic.PDF.AutoJavaScript", 30),
        (body.contains("/launch"), "Heuristic.PDF.Launch", 50),
        (body.contains("/embeddedfile"), "Heuristic.PDF.EmbeddedFile", 10),
        (body.contains("/richmedia"), "Heuristic.PDF.RichMedia", 15),
    )


def named_findings(names: Column) -> Column:
    """Findings that ``dissect`` gives by name alone."""
    scores = F.create_map(*(F.lit(x) for pair in STRUCTURAL.items() for x in pair))
    score = lambda n: F.coalesce(F.element_at(scores, n), F.when(n.startswith("Heuristic.PE.Packer."), PACKER), F.lit(0))
    return F.transform(names, lambda n: F.struct(n.alias("name"), score(n).cast("int").alias("score")))


def inspected(objects: DataFrame) -> DataFrame:
    """The objects with ``findings``, array<FINDING>, first of each name.

    Needs name, file_type, content and the columns of ``dissect``: names (array
    of structural findings), macros (source of VBA modules, or null), pdf_body,
    pdf_streams, pdf_renamed. Null content has no findings.
    """
    none = F.array().cast(f"array<{R.FINDING}>")
    kind, content = F.col("file_type"), F.col("content")
    text = F.when(kind == "text", F.left(F.coalesce(F.col("decoded"), latin1(content)), F.lit(TEXT_SEEN)))
    bare = F.replace(latin1(content), F.lit("\0"), F.lit(""))
    rows = objects.withColumns(
        {
            "__text": text,
            "__script": F.when(kind == "text", text).when(kind == "lnk", bare),
            "__part": F.when((kind == "text") & F.col("name").rlike(OFFICE_PART), ascii_lower(text)),
            "__link": F.when(kind == "lnk", ascii_lower(bare)),
            "__rtf": F.when(kind == "rtf", ascii_lower(latin1(content))),
            "__strings": F.when(is_executable(kind), latin1(content)),
        }
    )
    rows = rows.withColumns(
        {
            # Exported modules and macros as plain text.
            "__vba": F.lower(F.when((kind == "text") & R.mentions(F.col("__text"), "attribute vb_name"), F.col("__text")).otherwise(F.col("macros"))),
            "__pdf_js": F.when(F.col("pdf_body").rlike(R.java(PDF_SCRIPT)), F.concat_ws("\n", "pdf_body", "pdf_streams")),
        }
    )
    for column, catalogue in (("__script", "script"), ("__strings", "binary"), ("__vba", "vba"), ("__pdf_js", "pdf_js")):
        rows = R.findings(rows, column, R.CATALOGUES[catalogue], f"__found{column}")
    is_text, macro = kind == "text", F.array(R.finding("Heuristic.Macro.Present", 10))
    parts = [
        name_findings(F.col("name"), kind),
        F.when(kind.isin("lnk"), shortcut_findings(F.col("__link"))),
        named_findings(F.col("names")),
        F.when(F.col("pdf_body").isNotNull(), pdf_findings(F.col("pdf_body"), F.col("pdf_renamed"))),
        F.when(kind == "rtf", rtf_findings(F.col("__rtf"))),
        F.col("__found__script"),
        F.when(F.col("__part").isNotNull(), office_part_findings(F.col("name"), F.col("__part"))),
        F.when(F.col("__vba").isNotNull(), F.concat(macro, F.col("__found__vba"))),
        F.when(kind == "ole", ole_findings(content)),
        F.when(is_text, embedded_findings(F.col("__text"))),
        F.col("__found__strings"),
        F.col("__found__pdf_js"),
    ]
    every = F.concat(*(F.coalesce(p, none) for p in parts))
    found = F.when(is_test_file(content), F.array(R.finding("EICAR-Test-File", 100))).otherwise(R.distinct_findings(every))
    return rows.withColumn("findings", F.when(content.isNotNull(), found).otherwise(none)).drop(*(c for c in rows.columns if c.startswith("__")))
