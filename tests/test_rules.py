import random
import re

import pyarrow.parquet as pq
import pytest

from oracle import same
from pyspark.sql import functions as F
from verdikt.operators import inspect as I
from verdikt.operators import rules as R
from verdikt.plans.catalog import ORACLES, QUERIES
from verdikt.plans.samples import TEXTS


def fired(spark, texts, catalogue="script"):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = R.findings(rows, "t", R.CATALOGUES[catalogue], "f").sort("i").collect()
    return [[f["name"] for f in r["f"]] for r in found]


def test_every_script_sample_is_found(spark):
    scripts = [t.lower() for n, t in TEXTS if n[1:] in (".ps1", ".js", ".vbs", ".bat", ".sh", ".py", ".php")]
    assert all(fired(spark, scripts))


def test_engines_agree_on_boundaries(spark):
    # RE2's word boundary and white space are ASCII; Java's and Python's own are not.
    rows = spark.createDataFrame([("éshell(", "x\u000by", "a.txt\n")], "a string, b string, c string")
    assert rows.select(F.col("a").rlike(R.java(r"\bshell\s*\(")), F.col("b").rlike(R.java(r"x\sy")), F.col("c").rlike(R.java(r"txt$"))).first()[:] == (True, False, False)
    assert R.python(r"\bshell\s*\(").search("éshell(") and not R.python(r"x\sy").search("x\u000by") and not R.python("txt$").search("a.txt\n")


@pytest.mark.parametrize("gap", [100, 1000, 5000])
def test_windows(spark, gap):
    """The expression must match within reach of an anchor, whatever the text's length."""
    text = "curl" + "a" * gap + " | sh" + "\n" * 3000
    near = gap + len(" | sh") <= R.REACH
    assert (["Heuristic.Shell.PipeToShell"] in fired(spark, [text])) is near
    assert fired(spark, ["x" * 5000 + "\ncurl a | sh"]) == [["Heuristic.Shell.PipeToShell"]]


def test_null_and_empty_text(spark):
    assert fired(spark, [None, ""]) == [[], []]


def test_first_finding_of_a_name_counts(spark):
    f = lambda n, s: F.struct(F.lit(n).alias("name"), F.lit(s).alias("score"))
    got = spark.range(1).select(R.distinct_findings(F.array(f("a", 1), f("b", 0), f("a", 5), f("c", 2)))).first()[0]
    assert [(r["name"], r["score"]) for r in got] == [("a", 1), ("c", 2)]


def test_risky_names(spark):
    rows = spark.createDataFrame([("x/A.EXE",), ("a.txt",), ("docm",)], "n string")
    assert [r[0] for r in rows.select(I.is_risky_name(F.col("n"))).collect()] == [True, False, False]


def test_every_anchor_counts(spark, tmp_path):
    """Texts with thousands of anchors before the one that a rule needs: the query gives what its SQL gives."""
    texts = ["plain", "curl\n" * 2500, "wget curl\n" * 3000 + "x" * 5000, "curl " * 20_000 + "\n"]
    rows = [(i * 100 + k, t, k) for i, t in enumerate(texts) for k in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    (tmp_path / "sql").mkdir()
    pq.write_table(pq.read_table(f"{tmp_path}/documents.parquet"), f"{tmp_path}/sql/documents.parquet")
    got = QUERIES["rule_near_window"](spark, str(tmp_path))
    assert got.count() > len(texts)
    same(got, f"{tmp_path}/sql", ORACLES["rule_near_window"])


def test_windows_are_searched_by_themselves():
    """Searching overlapping windows together changes nothing: boundaries at a window's ends, matches longer than it."""
    dice, near = random.Random(4), [r for rules in R.CATALOGUES.values() for r in rules if r.near]
    each = lambda text, r: any(R.python(r.regex).search(text[max(0, m.start() - R.REACH) : m.end() + R.REACH]) for a in r.near for m in re.finditer(re.escape(a), text))
    for _ in range(3000):
        rule = dice.choice(near)
        words = [*rule.near, *re.findall(r"[a-z0-9/\\.:-]{2,}", rule.regex), " ", "|", "(", "sh", "shx", "\n", "a" * 300, "x " * 200, "iexx", ".exey"]
        text = "".join(dice.choices(words, k=dice.randint(10, 60)))
        assert R.near_matches(text, rule) == each(text, rule)
    # A window ends within a word: by itself it has a match. Further off it has none.
    for gap, name in ((R.REACH - 3, ["Heuristic.Shell.PipeToShell"]), (R.REACH - 2, [])):
        text = "curl\n" * 3000 + "curl" + "a" * gap + "|shell" + "x" * 2000
        assert [R.SCRIPT[i].name for i in R.fired(text, R.SCRIPT)] == name
