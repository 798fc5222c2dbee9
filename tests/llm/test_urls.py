import re

from oracle import same

from verdikt.llm import urls as U
from verdikt.llm.queries import ORACLES, QUERIES


def test_query_equals_its_sql(spark, small):
    same(QUERIES["op1_url_filter"](spark, small), small, ORACLES["op1_url_filter"])


def brute(url):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    low = re.sub("[A-Z]", lambda m: m[0].lower(), re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)) if 32 <= int(m[1], 16) < 127 else m[0], url or ""))
    found = sorted(t for t in U.WEIGHTS if re.search(rf"(?<![^\W_]){re.escape(t)}(?![^\W_])", low))
    weight = sum(U.WEIGHTS[t] for t in found)
    return host, path, best and best.host + best.path, best.verdict if best else "block" if weight >= U.LIMIT else "allow", found, weight


def test_rules_and_terms(spark):
    given = [None, "", "nonsense", "http://", "HTTP://Example.ORG/es/x", "https://a.example.org/en/12?q", "http://example.org/en/2", "http://org", "http://org/", "http://notorg/", "http://a.com/de/", "http://b.com/fr/x#y", "http://x.net/free-casino", "http://x.net/xxx", "http://x.net/xxxx", "http://x.net/sex", "http://sex.bet.net", "http://x.net/a?u=http://porn", "http://x.net/sussex/essex", "http://x.net/ésex é", "x://y/../sex_bet", "http://x.net/%73ex%2Dbet", "http://x.net/%50ORN", "http://x.net/%2573ex/bet", "http://x.net/%e4sex%C3%A9/%zz%7", "http://x.net/freeporn", "http://x.net/porntube?x", "http://x.net/" + "a/" * 50_000 + "xxx"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(given)], "page_id long, url string, html string, rule string")
    got = {r["page_id"]: tuple(r)[1:] for r in U.filter_urls(pages).collect()}
    assert [got[i] for i in range(len(given))] == [brute(u) for u in given]
    assert U.filter_urls(pages.limit(0)).count() == 0


def test_vocabulary_from_a_table(spark):
    table = spark.createDataFrame([("Spam", 2, "x"), ("spam", 1, "y"), ("eggs", 1, "z"), ("ham", 1, "z"), (None, 2, ""), ("", 2, ""), ("none", None, "")], "term string, weight int, url string")
    weights = U.load_vocabulary(table)
    assert weights == {"spam": 2, "eggs": 1, "ham": 1} and len(U.WEIGHTS) > 300
    pages = spark.createDataFrame([(1, "http://a.net/spam"), (2, "http://a.net/eggs"), (3, "http://a.net/eggs/ham"), (4, "http://a.net/porn"), (4, None)], "page_id long, url string")
    assert sorted((r["page_id"], r["verdict"]) for r in U.filter_urls(pages, rules=(), weights=weights).collect()) == [(1, "block"), (2, "allow"), (3, "block"), (4, "allow"), (4, "allow")]
    assert {r["verdict"] for r in U.filter_urls(pages, rules=(), weights={}).collect()} == {"allow"}
