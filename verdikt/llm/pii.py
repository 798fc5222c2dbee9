"""Personal data in text, plain or disguised, as spans of the source text.

Plain ("base") identifiers are e-mail addresses, IP addresses, card numbers and
phone numbers, each found leftmost and non-overlapping in the text as it is.

Disguised ones are found after deobfuscation. A chain of transducers rewrites
the text, and each keeps, for every character that it puts out, the interval of
source characters which that character stands for:

1. homoglyphs, full-width and foreign digits to ASCII, invisible characters to
   nothing;
2. runs of spelled digits, figures and dots with a disguise among them ("plus 44
   seven ...", "8 dot 8 dot 8 dot 8", "10[.]0[.]0[.]1") to figures, where that
   makes an identifier;
3. at/dot disguises ("jo (at) mail [dot] org", "jo at mail dot org") to @ and .

The detectors run over the rewritten text, and what they find is mapped back to
source characters. A mapped span is added where a rewriting took part in it and
no base span of its kind covers it. Base spans always stay. Texts in which no
transducer could act (a linear scan of each batch decides) skip the chain.

Offsets are code points, ends exclusive. A null or empty text has no spans,
repeated rows are judged one by one, an empty table gives no rows, and columns
other than doc_id and text are ignored. Every detector is linear in the text's
length, so that very long texts and long runs of one character do no harm.
"""

from __future__ import annotations

import functools
import hashlib
import re
import sys
import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from verdikt.llm.bpe import slices
from verdikt.llm.common import batches, texts

KINDS = ("email", "ip", "card", "phone")


class Span(NamedTuple):
    start: int
    kind: int  # place in KINDS: spans sort by start, then kind
    end: int

    def __str__(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


# -- detectors ---------------------------------------------------------------

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str):
    """The pattern's matches, found from the @ outwards: no start is tried twice."""
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            done = m.end()
            yield start, done


def ips(text: str):
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            yield m.span()


def cards(text: str):
    for m in _CARD.finditer(text):
        if 12 <= len(m[0]):
            digits = _DIGITS.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
            yield m.span()


def plain_spans(text: str) -> list[Span]:
    found: list[Span] = []
    if "@" in text:
        found += (Span(a, 0, b) for a, b in emails(text))
    if any(d in text for d in "0123456789"):
        found += (Span(a, 1, b) for a, b in ips(text))
        found += (Span(a, 2, b) for a, b in cards(text))
        if "+" in text:
            found += (Span(a, 3, b) for a, b in phones(text))
    return sorted(found)


# -- transducers -------------------------------------------------------------


class Mapped(NamedTuple):
    """A rewritten text; character i stands for source[start[i]:end[i]], ``changed`` where a rule wrote it."""

    text: str
    start: np.ndarray
    end: np.ndarray
    changed: np.ndarray

    @classmethod
    def of(cls, text: str) -> Mapped:
        at = np.arange(len(text))
        return cls(text, at, at + 1, np.zeros(len(text), bool))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Replaces [a, b) by a string for each of the ascending, disjoint edits."""
        if not edits:
            return self
        a, b, size = (np.array(x) for x in zip(*((a, b, len(out)) for a, b, out in edits)))
        gone = np.zeros(len(self.text) + 1, np.int64)
        np.add.at(gone, a, 1)
        np.add.at(gone, b, -1)
        kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
        changed = np.zeros(len(kept) + size.sum(), bool)
        changed[np.repeat(a - (np.cumsum(b - a) - (b - a)), size) + np.arange(size.sum())] = True
        start, end = np.empty(len(changed), np.int64), np.empty(len(changed), np.int64)
        start[changed], end[changed] = np.repeat(self.start[a], size), np.repeat(self.end[b - 1], size)
        start[~changed], end[~changed] = self.start[kept], self.end[kept]
        old = changed.copy()
        old[~changed] = self.changed[kept]
        return Mapped(rewritten(self.text, edits), start, end, old)


def rewritten(text: str, edits: list[tuple[int, int, str]]) -> str:
    parts, done = [], 0
    for a, b, out in edits:
        parts += [text[done:a], out]
        done = b
    return "".join([*parts, text[done:]])


#: Letters of other alphabets that look like ASCII letters, dashes and dots.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһԛԝ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναρυ" "‐‑‒–—―−․﹒",
        "ABESIJKMHOPCTYXaesijopcyxdhqw" "ABEZHIKMNOPTYXovapu" "-------..",
        strict=True,
    )
)
#: Zero-width characters, joiners, the soft hyphen and the byte order mark.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


@functools.cache
def homoglyphs() -> dict[int, str]:
    """Characters to the one ASCII character that they stand for, by compatibility forms and digit values."""
    table = {ord(k): v for k, v in LOOKALIKES.items()}
    for code in range(0xA0, min(sys.maxunicode, 0x1FFFF)):
        if 0xD800 <= code < 0xE000 or 0x3400 <= code < 0xA000 or 0xAC00 <= code < 0xD800:
            continue
        char = chr(code)
        if (digit := unicodedata.decimal(char, None)) is not None:
            table[code] = str(digit)
        elif unicodedata.category(char) != "No" and len(plain := unicodedata.normalize("NFKC", char)) == 1 and " " <= plain <= "~":
            table[code] = plain
    return table


def _ranges(codes: list[int]) -> str:
    """A character class of sorted code points, in RE2 syntax."""
    out, first = [], None
    for code, after in zip(codes, [*codes[1:], -1]):
        first = code if first is None else first
        if after != code + 1:
            out.append(f"\\x{{{first:X}}}-\\x{{{code:X}}}")
            first = None
    return "".join(out)


#: The digits 0 to 9 as English, Spanish, French and German spell them.
SPELLED = (
    ("zero", "oh", "cero", "zéro", "null"),
    ("one", "uno", "un", "eins"),
    ("two", "dos", "deux", "zwei"),
    ("three", "tres", "trois", "drei"),
    ("four", "cuatro", "quatre", "vier"),
    ("five", "cinco", "cinq", "fünf"),
    ("six", "seis", "sechs"),
    ("seven", "siete", "sept", "sieben"),
    ("eight", "ocho", "huit", "acht"),
    ("nine", "nueve", "neuf", "neun"),
)
_DIGIT_OF = {word: str(d) for d, words in enumerate(SPELLED) for word in words}
AT_WORDS, DOT_WORDS = ("at", "arroba", "arobase"), ("dot", "punto", "point", "punkt")

_WORD = "|".join(sorted(_DIGIT_OF, key=len, reverse=True))
_DOTS = "|".join(DOT_WORDS)
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_IN_BRACKETS = rf"{_OPEN}[ \t]{{0,3}}(?:{_DOTS}|\.)[ \t]{{0,3}}{_CLOSE}"

#: What a number may be made of; ``lastgroup`` names the kind.
_ITEM = re.compile(rf"(?P<figure>[0-9]++)|(?P<point>\.)|(?P<dot>{_IN_BRACKETS}|(?<!\w)(?:{_DOTS})(?!\w))|(?P<plus>(?<!\w)plus(?!\w)|\+)|(?P<word>(?<!\w)(?:{_WORD})(?!\w))", re.IGNORECASE)
#: What may stand between two of them.
_GAP = re.compile(r"[ \t\n,()\-]{0,3}")

_AT = re.compile(rf"[ \t]{{0,3}}{_OPEN}[ \t]{{0,3}}(?:{'|'.join(AT_WORDS)}|@)[ \t]{{0,3}}{_CLOSE}[ \t]{{0,3}}|[ \t]{{1,3}}(?:{'|'.join(AT_WORDS)}|@)[ \t]{{1,3}}|@", re.IGNORECASE)
_DOT = rf"(?:[ \t]{{0,3}}{_IN_BRACKETS}[ \t]{{0,3}}|[ \t]{{1,3}}(?:{_DOTS})[ \t]{{1,3}})"
_DOT_AT = re.compile(_DOT, re.IGNORECASE)
#: Domains and local parts with plain and disguised dots, of any length.
_REST = re.compile(rf"[A-Za-z0-9-]++(?:(?:\.|{_DOT})[A-Za-z0-9-]++)++", re.IGNORECASE)
_BEFORE = re.compile(rf"[A-Za-z0-9._%+-]++(?:{_DOT}[A-Za-z0-9._%+-]++)*+", re.IGNORECASE)
_TOP = re.compile(r"[A-Za-z]{2,24}\Z")


def unify_characters(text: Mapped) -> Mapped:
    glyphs = text.text.translate(homoglyphs())
    changed = text.changed | (np.frombuffer(glyphs.encode("utf-32-le"), np.uint32) != np.frombuffer(text.text.encode("utf-32-le"), np.uint32))
    same = Mapped(glyphs, text.start, text.end, changed)
    edits = [(m.start(), m.end(), "") for m in re.finditer(f"[{INVISIBLE}]+", glyphs)]
    out = same.rewrite(edits)
    if edits:  # what follows something invisible counts as rewritten
        after = np.array([m[1] for m in edits]) - np.cumsum([m[1] - m[0] for m in edits])
        out.changed[after[after < len(out.text)]] = True
    return out


def _runs(text: str):
    """Items of numbers that stand side by side, two or more with a disguise among them."""
    run: list[re.Match] = []
    for item in _ITEM.finditer(text):
        if run:
            gap = item.start() - run[-1].end()
            points = "point" in (item.lastgroup, run[-1].lastgroup)
            if gap > 3 * (not points) or not _GAP.fullmatch(text, run[-1].end(), item.start()):
                yield run
                run = []
        run.append(item)
    yield run


def _spoken(text: str, run: list[re.Match], glue: str) -> list[tuple[int, int, str]]:
    """Edits that write a run in figures: gaps between figures stay, between figures and words there is ``glue``, elsewhere nothing."""
    edits, last = [], None
    for item in run:
        kind = item.lastgroup
        if last is not None and last.end() < item.start():
            kinds = {kind, last.lastgroup}
            if kinds != {"figure"}:
                edits.append((last.end(), item.start(), glue if kinds == {"figure", "word"} else ""))
        if kind == "word":
            edits.append((*item.span(), _DIGIT_OF[item[0].lower()]))
        elif kind == "dot" or kind == "plus" and item[0] != "+":
            edits.append((*item.span(), "." if kind == "dot" else "+"))
        last = item
    return edits


def unify_digits(text: Mapped) -> Mapped:
    """Rewrites the runs that are identifiers in figures, so that numbers in prose stay words."""
    edits = []
    for run in _runs(text.text):
        if len(run) < 2 or not any(i.lastgroup in ("word", "dot") or i.lastgroup == "plus" and i[0] != "+" for i in run):
            continue
        first, last = run[0].start(), run[-1].end()
        for glue in (" ", ""):
            found = _spoken(text.text, run, glue)
            if plain_spans(rewritten(text.text[first:last], [(a - first, b - first, out) for a, b, out in found])):
                edits += found
                break
    return text.rewrite(edits)


def unify_addresses(text: Mapped) -> Mapped:
    """Rewrites whole disguised addresses only, so that "at" and "dot" elsewhere stay words.

    A local part ends where its "at" begins, and no "at" inside a local part or
    domain begins an address, so that no stretch of text is read twice.
    """
    edits, done = [], 0
    before = {m.end(): m for m in _BEFORE.finditer(text.text)}
    for at in _AT.finditer(text.text):
        local = before.get(at.start())
        if local is None or local.start() < done:
            continue
        rest = _REST.match(text.text, at.end())
        if rest is None or not _TOP.search(rest[0]):
            continue
        ahead, dots = [*_DOT_AT.finditer(local[0])], [*_DOT_AT.finditer(rest[0])]
        plain = at[0] == "@" and any(m[0].strip(" \t")[0] in "[({<" for m in ahead)
        if at[0].strip(" \t")[0] not in "[({<" and not dots and not plain:  # a bare "at" needs a disguised dot with it
            continue
        edits += [(m.start() + local.start(), m.end() + local.start(), ".") for m in ahead]
        edits += [(at.start(), at.end(), "@")]
        edits += [(m.start() + at.end(), m.end() + at.end(), ".") for m in dots]
        done = rest.end()
    return text.rewrite(edits)


#: RE2: whether a transducer could act in a text at all.
@functools.cache
def trigger() -> str:
    glyphs = _ranges(sorted([*homoglyphs(), *map(ord, INVISIBLE)]))
    gap, words = r"[ \t\n,().\-]{1,3}", rf"(?:{_WORD})"
    spoken = rf"\b(?:{_WORD}|plus){gap}(?:{_WORD}|[0-9+])|[0-9]{gap}{words}\b"
    return rf"[{glyphs}]|(?i:\b(?:{_DOTS})\b|{_OPEN}[ \t]*(?:{'|'.join(AT_WORDS)}|@|\.)[ \t]*{_CLOSE}|{spoken})"


def disguised_spans(text: str, base: list[Span]) -> list[Span]:
    mapped = unify_addresses(unify_digits(unify_characters(Mapped.of(text))))
    added = set()
    for start, kind, end in plain_spans(mapped.text):
        if mapped.changed[start:end].any():
            span = Span(int(mapped.start[start]), kind, int(mapped.end[end - 1]))
            if not any(b.kind == kind and b.start <= span.start and span.end <= b.end for b in base):
                added.add(span)
    return sorted(added)


def spans_of(text: str, triggered: bool = True) -> tuple[list[Span], list[Span]]:
    """(base, added) spans of a text."""
    base = plain_spans(text)
    return base, disguised_spans(text, base) if triggered else []


# -- over tables -------------------------------------------------------------

SPANS = "array<struct<kind:string,start:int,end:int,disguised:boolean>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("disguised", pa.bool_())]))


def _judged(column: pa.Array):
    """(text, base, added) of each text of a column."""
    for _, some in slices(column):
        could = pc.match_substring_regex(pa.array(some, pa.string()), trigger()).to_pylist()
        for text, hit in zip(some, could):
            yield text, *spans_of(text, hit)


def find(docs: DataFrame) -> DataFrame:
    """Each document's spans: doc_id, spans (see SPANS), by start and then kind."""
    schema = pa.schema([("doc_id", pa.int64()), ("spans", _ARROW)])

    def run(parts):
        for part in parts:
            rows = ((key, [(KINDS[s.kind], s.start, s.end, d) for s, d in sorted([(s, False) for s in base] + [(s, True) for s in added])]) for key, (_, base, added) in zip(part.column("doc_id").to_pylist(), _judged(part.column("text"))))
            yield from batches(schema, ((k, [dict(zip(("kind", "start", "end", "disguised"), s)) for s in ss]) for k, ss in rows))

    return texts(docs, "doc_id").mapInArrow(run, f"doc_id long, spans {SPANS}")


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span's characters replaced by its kind; overlapping spans are masked as one."""
    out, done = [], 0
    for s in sorted(spans):
        if s.start >= done:
            out += [text[done : s.start], f"<{KINDS[s.kind].upper()}>"]
        done = max(done, s.end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with personal data masked in ``text``; null text stays null."""

    def run(parts):
        for part in parts:
            column = part.column("text")
            new = [masked(text, base + added) if base or added else text for text, base, added in _judged(column.fill_null(""))]
            new = [text if known else None for text, known in zip(new, column.is_valid().to_pylist())]
            yield part.set_column(part.schema.get_field_index("text"), part.schema.field("text"), pa.array(new, column.type))

    return docs.mapInArrow(run, docs.schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of base spans, and all spans, of every document.

    n_email, n_ip, n_card and n_phone count the base spans that base_sha256 is
    taken over; n_disguised counts the spans that deobfuscation added.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_disguised", pa.int64())])

    def run(parts):
        for part in parts:
            rows = (
                (key, *(sum(s.kind == k for s in base) for k in range(4)), hashlib.sha256(",".join(map(str, base)).encode()).hexdigest(), ",".join(map(str, sorted(base + added))), len(added))
                for key, (_, base, added) in zip(part.column("doc_id").to_pylist(), _judged(part.column("text")))
            )
            yield from batches(schema, rows)

    return texts(docs, "doc_id").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long")
