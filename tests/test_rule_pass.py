"""Catalogues are evaluated in one pass over the texts, and hints never cost a finding."""

import random

import pytest
from pyspark.sql import functions as F

from verdikt.operators import rules as R
from verdikt.plans.samples import TEXTS

HINTED = [r for rules in R.CATALOGUES.values() for r in rules if r.hint]
PARTS = """autoopen auto_open autoexec autoclose auto_close document_open documentopen document_close workbook_open workbook_activate workbook_beforeclose
app_documentopen app_workbookopen document_new autonew shell( shell(1) wscript.shell shellexecute x.run(y .exec( win32_process .create( strreverse( callbyname(
%u0c0c %u9090 %u0a0a \\x0c\\x0c\\x0c\\x0c unescape("%uabcd%u eval( unescape( string.fromcharcode""".split()
PARTS += ['declare ptrsafe function a lib "kernel32', 'declare sub b lib "urlmon', 'shell "a', "chrw$(1 + 2) & " * 15, "chr(65)+" * 16]


def without_hints(text, rules):
    low = R.lowered(text)
    has = lambda some: any(x in low for x in some)
    found = []
    for i, r in enumerate(rules):
        if all(x in low for x in r.all_of) and (not r.any_of or has(r.any_of)) and (not r.near or has(r.near)):
            if not r.regex or (R.near_matches(low, r) if r.near and len(low) > R.REACH else R.python(r.regex).search(low)):
                found.append(i)
    return found


@pytest.mark.parametrize("catalogue", R.CATALOGUES)
def test_hints_cost_no_finding(catalogue):
    dice, rules = random.Random(1), R.CATALOGUES[catalogue]
    texts = [t for _, t in TEXTS] + PARTS + [p.upper() for p in PARTS] + [" ".join(dice.choices([*PARTS, "plain", "é", "漢", "\n"], k=6)) for _ in range(200)]
    for text in texts:
        assert R.fired(text, rules) == without_hints(text, rules)


def test_every_hinted_rule_fires_on_its_parts():
    assert len(HINTED) == 6
    assert all(any(R.python(r.regex).search(p) for p in PARTS) for r in HINTED)


def test_one_pass_without_copies_of_the_batch(spark):
    rows = spark.createDataFrame([(0, "x" * 3000 + "\ncurl a | sh"), (1, None), (2, "漢 CURL a | sh"), (3, "é$_ĀÿI")], "i int, t string")
    found = R.findings(rows, "t", R.SCRIPT, "f")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "translate(" not in plan
    assert [[f["name"] for f in r["f"]] for r in found.sort("i").collect()] == [["Heuristic.Shell.PipeToShell"], [], ["Heuristic.Shell.PipeToShell"], []]
    # Characters beyond ISO-8859-1 are no question marks.
    assert R.lowered("Ā?A") == "Ā?a" and not R.fired("c99shell <Āphp", R.SCRIPT)
    assert found.where(F.size("f") > 0).count() == 2
