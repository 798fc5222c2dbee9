"""URL filtering: host and path rules first, a weighted vocabulary for the rest.

A rule allows or blocks a host with all its subdomains, as far as the path
starts with the rule's path; of the rules that fit, the longest decides. Where
none fits, an Aho-Corasick automaton finds the vocabulary's terms in one pass
over the whole url, whose percent escapes of printable ASCII characters are
undone once and whose A-Z are lower-cased. A hit counts only between boundaries
(the start, the end, or a character that is neither letter nor digit), each term
counts once, and the url is blocked when the weights reach ``LIMIT``: one strict
term does so alone, soft terms only when several distinct ones meet.

The vocabulary is a table of terms and weights (``load_vocabulary``); the default
is made from stems by rule. It goes to every task, so its size is checked.

A null url, and one without ``://``, has an empty host and path and fits no
rule; a null url has no terms and is allowed. A url may be very long. Repeated
rows, and rows with equal or null ids, each get a verdict, an empty table gives
no rows, and other columns are ignored.
"""

from __future__ import annotations

import functools
import re
import string
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdikt.llm.common import batches


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, rule: str) -> Rule:
        host, slash, rest = rule.partition("/")
        return cls(verdict, host, slash + rest)


#: The rules of the registered query.
RULES = (
    Rule.parse("allow", "org/"),
    Rule.parse("block", "example.org/es/"),
    Rule.parse("block", "example.org/en/1"),
    Rule.parse("allow", "com/fr/"),
    Rule.parse("block", "com/de/"),
)
#: Stems: one term of the first kind blocks, of the second several distinct ones.
STRICT = ("porn", "porno", "xxx", "hentai", "milf", "camgirl", "escort", "bdsm", "gangbang", "hardcore-sex", "sexcam", "nsfw", "fetish", "blowjob", "creampie", "onlyfans-leak")
SOFT = ("sex", "sexy", "adult", "nude", "naked", "hot", "girl", "teen", "dating", "casino", "bet", "poker", "slot", "jackpot", "roulette", "viagra", "cialis", "pill", "payday", "loan", "torrent", "warez", "crack", "keygen", "free", "cheap", "bonus", "replica")
#: What a stem is found with besides: endings of both kinds, and words written together with a strict stem.
ENDINGS, TAILS, HEADS = ("s", "z", "ing"), ("tube", "hub", "video", "videos", "pics", "site", "cams", "star", "chat"), ("free", "live", "best", "hot", "real")
LIMIT = 2
#: Terms that a vocabulary may have: it goes to every task.
LARGEST = 1_000_000


def inflected(strict=STRICT, soft=SOFT, limit: int = LIMIT) -> dict[str, int]:
    """Term -> weight of all forms of the stems."""
    weights = {stem + end: 1 for stem in soft for end in ("", *ENDINGS)}
    for stem in strict:
        weights |= dict.fromkeys([stem + end for end in ("", *ENDINGS, *TAILS)] + [head + stem for head in HEADS], limit)
    return weights


WEIGHTS = inflected()


def load_vocabulary(table: DataFrame) -> dict[str, int]:
    """Term -> weight of a table (term, weight): the greatest weight of a term, lower-cased; nulls and empty terms are left out."""
    low = F.translate("term", string.ascii_uppercase, string.ascii_lowercase)
    rows = table.where("term <> '' and weight is not null").groupBy(low.alias("term")).agg(F.max("weight").cast("int").alias("weight")).limit(LARGEST + 1).collect()
    if len(rows) > LARGEST:
        raise ValueError(f"a vocabulary of more than {LARGEST} terms")
    return {r["term"]: r["weight"] for r in rows}


_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_ESCAPE = re.compile(r"%([2-6][0-9A-Fa-f]|7[0-9A-Ea-e])")
SCHEMA = "page_id long, host string, path string, rule string, verdict string, terms array<string>, weight int"


@functools.cache
def automaton(terms: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term in terms or ("\0",):  # an automaton must hold something
        found.add_word(term, term)
    found.make_automaton()
    return found


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    for stop in "?#":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def plain(url: str | None) -> str:
    """The url as terms are sought in it."""
    url = url or ""
    return (_ESCAPE.sub(lambda m: chr(int(m[1], 16)), url) if "%" in url else url).translate(_LOWER)


def hits(text: str, found) -> list[str]:
    """Distinct terms that stand between boundaries, sorted."""
    seen = set()
    for last, term in found.iter(text):
        first = last - len(term) + 1
        if (first == 0 or not text[first - 1].isalnum()) and (last + 1 == len(text) or not text[last + 1].isalnum()):
            seen.add(term)
    return sorted(seen)


class Rules:
    """The rules by host, so that a url is held only against those of its own suffixes."""

    def __init__(self, rules):
        self._by_host: dict[str, list[Rule]] = {}
        for rule in rules:
            self._by_host.setdefault(rule.host, []).append(rule)

    def longest(self, host: str, path: str) -> Rule | None:
        best, suffix = None, host
        while suffix:
            for rule in self._by_host.get(suffix, ()):
                if path.startswith(rule.path) and (best is None or len(rule.host + rule.path) > len(best.host + best.path)):
                    best = rule
            suffix = suffix.partition(".")[2]
        return best


def filter_urls(pages: DataFrame, rules=RULES, weights: dict[str, int] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """A verdict for each row of (page_id, url): see SCHEMA. No shuffle; the vocabulary is a parameter."""
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("terms", pa.list_(pa.string())), ("weight", pa.int32())])

    def run(parts):
        book, found = Rules(rules), automaton(tuple(weights))

        def row(key, url):
            host, path = split_url(url)
            rule, terms = book.longest(host, path), [t for t in hits(plain(url), found) if t in weights]
            weight = sum(weights[t] for t in terms)
            verdict = rule.verdict if rule else "block" if weight >= limit else "allow"
            return key, host, path, rule and rule.host + rule.path, verdict, terms, weight

        for part in parts:
            yield from batches(schema, map(row, part.column("page_id").to_pylist(), part.column("url").to_pylist()))

    return pages.select("page_id", "url").mapInArrow(run, SCHEMA)
