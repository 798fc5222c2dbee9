import hashlib
import random
import re

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from oracle import same
from verdikt.llm import pii
from verdikt.llm.queries import ORACLES, QUERIES

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


@pytest.mark.parametrize("alphabet", ["a.@-1 +(0245", "0123456789 -", "a@b.c-%_", "0.1.2 "])
def test_plain_spans(alphabet):
    rng = random.Random(alphabet)
    for _ in range(20_000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 45)))
        assert [tuple(s) for s in pii.plain_spans(text)] == brute(text), text


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail jo.doe (at) mail [dot] example [dot] org now", "email", "jo.doe (at) mail [dot] example [dot] org"),
        ("write jo at mail dot org.", "email", "jo at mail dot org"),
        ("n\u0430me@ex\u0430mple.com x", "email", "n\u0430me@ex\u0430mple.com"),
        ("é jo\u200b.x@e\u200bxample.com!", "email", "jo\u200b.x@e\u200bxample.com"),
        ("call plus four four two zero seven nine four six zero nine five eight now", "phone", "plus four four two zero seven nine four six zero nine five eight"),
        ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("card four one one one 1111 1111 one one one one.", "card", "four one one one 1111 1111 one one one one"),
        ("at one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
        ("block 192[.]168[.]1[.]1 now", "ip", "192[.]168[.]1[.]1"),
        ("8 dot 8 dot 8 dot 8", "ip", "8 dot 8 dot 8 dot 8"),
        ("at 192 dot 168 dot 1 dot 1, 5 times", "ip", "192 dot 168 dot 1 dot 1"),
        ("eight dot eight dot eight dot eight", "ip", "eight dot eight dot eight dot eight"),
        ("one zero dot one dot two dot five", "ip", "one zero dot one dot two dot five"),
        ("+four four 20 7946 0958", "phone", "+four four 20 7946 0958"),
        ("plus 44 seven seven 20 nine four 60 five one", "phone", "plus 44 seven seven 20 nine four 60 five one"),
        ("+1 (two one two) 555-0100.", "phone", "+1 (two one two) 555-0100"),
        ("jo [dot] doe@mail.org", "email", "jo [dot] doe@mail.org"),
        ("a dot b dot c dot d dot e at mail dot org", "email", "a dot b dot c dot d dot e at mail dot org"),
        ("x" * 300 + " [at] mail.org", "email", "x" * 300 + " [at] mail.org"),
        ("cuatro uno uno uno 1111 1111 uno uno uno uno", "card", "cuatro uno uno uno 1111 1111 uno uno uno uno"),
    ],
)
def test_disguises(text, kind, found):
    base, added = pii.spans_of(text)
    assert (pii.KINDS.index(kind), found) in [(s.kind, text[s.start : s.end]) for s in added]
    assert pc.match_substring_regex(pa.array([text]), pii.trigger())[0].as_py()


@pytest.mark.parametrize("text", ["look at example.com", "meet at the dot", "one two three four", "Москва 2024", "the point at issue", "follow us @ example.com", "café naïve ½ ²", "one. two. three. four.", "chapters 1, 2 and three dot", "section 1.2 point four"])
def test_clean_text_stays_clean(text):
    assert pii.spans_of(text) == ([], [])


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000, "@" * 100_000, "+1" * 50_000, "one " * 40_000, "at dot " * 20_000, "a." * 60_000 + "@b.c", " at " * 40_000, "(" * 100_000, "1." * 90_000, "\u200b" * 50_000, "8 dot " * 40_000, "+four " * 40_000, "x dot at dot " * 20_000, "jo [at] x dot at dot " * 10_000])
def test_long_runs(text):
    pii.spans_of(text)


def disguise(rng, kind):
    """A random identifier and a disguise of it, character by character."""
    word = lambda c: rng.choice([w for w in pii.SPELLED[int(c)] if w.isalpha()])
    dot = lambda: rng.choice([" dot ", "[.]", " [dot] ", "(dot)", " (.) "])
    if kind == "email":
        local, host = ("".join(rng.choices("bcdfghjkm", k=rng.randint(2, 9))) for _ in range(2))
        plain = f"{local}.x@{host}.org"
        return plain, plain.replace("@", rng.choice([" at ", "[at]", " (at) "])).replace(".", dot() if rng.random() < 0.5 else " dot ")
    if kind == "ip":
        parts = [str(rng.randint(0, 255)) for _ in range(4)]
        mode = rng.random()
        spell = [" ".join(map(word, p)) if mode < 0.7 and (mode < 0.3 or rng.random() < 0.5) else p for p in parts]
        return ".".join(parts), "".join(x for i, p in enumerate(spell) for x in ([dot()] if i else []) + [p])
    digits = "".join(rng.choices("0123456789", k=11 if kind == "phone" else 15))
    if kind == "card":
        digits = next(d for d in (digits + c for c in "0123456789") if pii.luhn(d))
    spoken, spelled = [], False
    for at in range(0, len(digits), 4):  # blocks of figures and of words, one at least of words
        spell = rng.random() < 0.5 or (at + 4 >= len(digits) and not spelled)
        spelled |= spell
        spoken.append(" ".join(map(word, digits[at : at + 4])) if spell else digits[at : at + 4])
    sign = "+" if kind == "phone" else ""
    return sign + digits, (rng.choice(["+", "plus ", "+ "]) if sign else "") + " ".join(spoken)


@pytest.mark.parametrize("kind", pii.KINDS)
def test_disguised_identifiers_come_back(kind):
    """Disguises of random base identifiers, in prose, give the disguise's own place."""
    rng = random.Random(kind)
    for _ in range(1500):
        plain, hidden = disguise(rng, kind)
        assert [s.kind for s in pii.plain_spans(plain)] == [pii.KINDS.index(kind)] or kind != "email"
        text = f"{rng.choice(['', 'é ', 'look: '])}{hidden}{rng.choice(['', ' x', '!', '; so'])}"
        base, added = pii.spans_of(text)
        assert (kind, hidden) in [(pii.KINDS[s.kind], text[s.start : s.end]) for s in base + added], text
        assert pc.match_substring_regex(pa.array([text]), pii.trigger())[0].as_py()


def test_rewriting_keeps_the_places():
    """Against characters rewritten one by one."""
    rng = random.Random(1)
    for _ in range(2000):
        mapped, slow = pii.Mapped.of(text := "".join(rng.choices("abc", k=rng.randint(1, 12)))), [(c, i, i + 1, False) for i, c in enumerate(text)]
        for _ in range(2):
            cuts = sorted(rng.sample(range(len(slow) + 1), 2 * rng.randint(0, (len(slow) + 1) // 2)))
            edits = [(a, b, "".join(rng.choices("XYZ", k=rng.randint(0, 3)))) for a, b in zip(cuts[::2], cuts[1::2])]
            for a, b, out in reversed(edits):
                slow[a:b] = [(c, slow[a][1], slow[b - 1][2], True) for c in out]
            mapped = mapped.rewrite(edits)
            assert list(zip(mapped.text, mapped.start.tolist(), mapped.end.tolist(), mapped.changed.tolist())) == slow


def test_tables(spark, awkward, documents):
    texts = ["x a@b.cd 1.2.3.4", "call +1 (212) 555-0100 or jo at mail dot org", None, ""]
    docs = documents(texts)
    got = {r["doc_id"]: r for r in pii.digests(docs).collect()}
    assert (got[0]["n_email"], got[0]["n_ip"], got[0]["spans"]) == (1, 1, "email:2:8,ip:9:16")
    assert got[0]["base_sha256"] == hashlib.sha256(b"email:2:8,ip:9:16").hexdigest() and got[2]["spans"] == got[3]["spans"] == ""
    assert (got[1]["n_phone"], got[1]["n_email"], got[1]["n_disguised"]) == (1, 0, 1)
    masked = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert masked == {0: "x <EMAIL> <IP>", 1: "call <PHONE> or <EMAIL>", 2: None, 3: ""}
    assert pii.redact(docs).columns == docs.columns
    assert pii.digests(awkward).count() == pii.find(awkward).count() == awkward.count() and pii.digests(docs.limit(0)).count() == 0
    assert [s["kind"] for r in pii.find(docs).where("doc_id = 0").collect() for s in r["spans"]] == ["email", "ip"]


@pytest.mark.parametrize("query", ["pii_base", "bpe_decoded"])
def test_queries_equal_their_sql(spark, small, query):
    same(QUERIES[query](spark, small), small, ORACLES[query])
