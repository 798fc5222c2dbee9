"""Tokenising by remembered units.

A byte-level BPE pre-tokeniser never joins a non-space character to a space
that follows it, and a lone space always opens the next pre-token. A text may
therefore be cut before every single space that stands between two non-space
characters, and the ids of the text are the ids of its units in order. A lone
line break between two such characters is a pre-token of its own, and so are a
full stop or comma between a letter or digit and a place of these two kinds, and
a run of plain punctuation after letters. Natural text repeats its units and their
parts, so a bounded memory of their ids spares the tokeniser most of its work.
Texts are cut and their pieces numbered in Arrow, many texts at a time, and each
distinct piece is looked up once.
Where a piece touches other white space the cut would not be safe, and
neighbouring pieces stay together.

A run of white space is one pre-token but for its last character, which goes
with what follows it, and at a text's end it is one whole. Runs of ``LONG_RUN``
characters or more, which a library's pattern may not have the stack for, are
cut out by that rule and encoded as the single pre-tokens that they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Units remembered by one Python worker. When the memory is full, its first quarter stays: common units come up early.
MEMORY = 700_000
#: A unit over this many characters is tokenised anew each time.
LONGEST_KEPT = 200
#: White space as Unicode has it, and as the pre-tokenisers' patterns do: without the four separators 0x1C to 0x1F.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LONG_RUN = 4096
_LONG = re.compile(f"[{WHITE}]{{{LONG_RUN},}}")
#: Punctuation that parts from letters before it; apostrophes are not among it.
SUFFIX = ".,!?;:#$%&*|"


def long_runs(text: str) -> list[tuple[int, int]]:
    """Spans of LONG_RUN white-space characters or more. One in LONG_RUN characters is looked at before all are."""
    half = LONG_RUN // 2
    for at in range(LONG_RUN - 1, len(text), LONG_RUN):  # a long run covers such a place, and half of it lies on one side
        if text[at].isspace() and (text[at - half + 1 : at].isspace() or text[at + 1 : at + half].isspace()):
            return [m.span() for m in _LONG.finditer(text)]
    return []


#: Opens a piece that is a full stop or comma parted from what is before it. A text that holds it itself is cut at spaces alone.
MARK = "\0"
STOPS = ".,"


def _pieces(texts: pa.Array) -> pa.ListArray:
    """The texts cut before spaces, which go, before line breaks, which stay, and before stops, which get MARK."""
    texts = pc.replace_substring(texts, "\n", " \n")
    for stop in STOPS:
        texts = pc.replace_substring(texts, f"{stop} ", f" {MARK}{stop} ")
    return pc.split_pattern(texts, " ")


def _strings(pieces: pa.Array) -> list[str]:
    """Strings without spaces, in much less time than to_pylist takes."""
    ended = pc.binary_join_element_wise(pieces, pa.scalar("", pieces.type), pa.scalar(" ", pieces.type))  # a space after each
    return str(ended.buffers()[2], "utf-8").split(" ")[:-1]


def _source(pieces: list[str], first: bool) -> str:
    """What pieces one after another were cut from; ``first``: from a text's beginning on."""
    return "".join([p if first and not i or p[:1] == "\n" else p[1:] if p[:1] == MARK else " " + p for i, p in enumerate(pieces)])


def _closed(piece: str) -> bool:
    """Whether a piece ends in a letter or digit; of scripts whose letters Unicode no longer adds to."""
    return piece[-1:].isalnum() and piece[-1] < "\u0530"


def _parted(before: str, piece: str) -> bool:
    """Whether no pre-token crosses the cut between two pieces."""
    if piece[:1] == MARK:
        return _closed(before)
    first = piece[1:2] if piece[:1] == "\n" else piece[:1]
    return bool(first and before) and not first.isspace() and not before[-1].isspace()


def _plain(piece: str) -> bool:
    """Whether a piece can be remembered: neither its first character, but for one line break, nor its last is white space."""
    if len(piece) > LONGEST_KEPT or piece.isalpha():
        return len(piece) <= LONGEST_KEPT
    first = piece[1:2] if piece[:1] == "\n" else piece[:1]
    return bool(first) and not first.isspace() and not piece[-1].isspace() and first != MARK


def _letters(piece: str) -> bool:
    return piece[piece[:1] == "\n" :].isalpha()


class UnitEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    ``encode_all`` tokenises a list of strings and returns an array of ids for
    each, ``encode_piece`` one string without pre-tokenising it. Units without
    inner white space are handed over many to a string, parted by line breaks,
    which are pre-tokens of their own there. ``encode_word``, where the library has a
    shorter way for them, gives the ids of words of letters up to U+00FF, each with a
    space or line break before it.
    """

    def __init__(self, encode_all: Callable[[Sequence[str]], list[np.ndarray]], encode_piece: Callable[[str], np.ndarray], memory: int = MEMORY, encode_word: Callable[[list[str], str], list[bytes]] | None = None):
        self._all, self._piece, self._memory, self._word = encode_all, encode_piece, memory, encode_word
        self._break = encode_all(["\n"])[0]
        self._lone_break = self._break.tobytes()
        self._stops = dict(zip([MARK + stop for stop in STOPS], self._encode(STOPS)))
        self._after: dict[str, bytes] = dict(self._stops)  # piece -> ids of it in a text, with the space or line break before it
        self._bare: dict[str, bytes] = {}  # punctuation, and texts from one safe cut to another -> ids

    def _encode(self, texts: Sequence[str]) -> list[bytes]:
        return [ids.tobytes() for ids in self._all(texts)]

    def _library(self, units: list[str]) -> list[bytes]:
        """Ids of each unit, given as it stands, by the library."""
        found: dict[str, bytes] = {}
        solid = [u for u in units if u and len(u) <= LONGEST_KEPT and u.isprintable() and " " not in u[1:] and u != " "] if len(self._break) == 1 else []
        for at in range(0, len(solid), 256):
            some = solid[at : at + 256]
            ids = self._all(["\n".join(some)])[0]
            cuts = np.flatnonzero(ids == self._break[0])
            if len(cuts) == len(some) - 1:
                raw, ends = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
                found.update(zip(some, [raw[a:b] for a, b in zip([0, *[x + 4 for x in ends]], ends)]))
        if len(found) == len(units):
            return [found[u] for u in units]
        left = [u for u in units if u not in found]
        found.update(zip(left, self._encode(left)))
        return [found[u] for u in units]

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Puts pieces' ids into the memory, and returns them. Letters with plain punctuation
        after them are put together from parts that others share."""
        known, bare = self._after, self._bare
        joint = [(p, s) for p in pieces if p[-1] in SUFFIX and _letters(s := p.rstrip(SUFFIX)) and _closed(s)]
        ends = list({p[len(s) :] for p, s in joint}.difference(bare))
        bare.update(zip(ends, self._library(ends)))
        left = pieces.difference([p for p, _ in joint]).union([s for _, s in joint if s not in known])
        new: dict[str, bytes] = {}
        if self._word:
            latin = lambda p: p.isascii() or len(p.encode("latin-1", "ignore")) == len(p)
            words, lines = [p for p in left if p.isalpha() and latin(p)], [p for p in left if p[0] == "\n" and p[1:].isalpha() and latin(p)]
            new.update(zip(words, self._word(words, " ")))
            new.update(zip(lines, self._word([p[1:] for p in lines], "\n")))
            left.difference_update(new)
        spaced, broken = [p for p in left if p[0] != "\n"], [p for p in left if p[0] == "\n"]
        new.update(zip(spaced, self._library([" " + p for p in spaced])))
        new.update([(p, self._lone_break + ids) for p, ids in zip(broken, self._library([p[1:] for p in broken]))])
        new.update([(p, (new[s] if s in new else known[s]) + bare[p[len(s) :]]) for p, s in joint])
        known.update(new)
        return new

    def encode(self, texts: Sequence[str] | pa.Array) -> list[bytes]:
        """Ids of each text; equal to tokenising the whole text at once."""
        ids, cuts = self.encode_flat(texts)
        raw, at = ids.tobytes(), (4 * cuts).tolist()
        return [raw[a:b] for a, b in zip(at[:-1], at[1:])]

    def encode_flat(self, texts: Sequence[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As encode: ids of all texts one after another, and where each begins and the last ends."""
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()).fill_null("")
        apart = {}
        for i in np.flatnonzero(pc.or_(pc.greater_equal(pc.binary_length(column), LONG_RUN), pc.match_substring(column, MARK)).to_numpy(zero_copy_only=False)).tolist():
            text = column[i].as_py()
            if (runs := long_runs(text)) or MARK in text:
                apart[i] = self._apart(text, runs)
        if not apart:
            return self._cut(column)
        rest = np.ones(len(column), bool)
        rest[[*apart]] = False
        ids, cuts = self._cut(pc.if_else(pa.array(rest), column, ""))
        lists = [apart[i] if i in apart else ids[a:b] for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()))]
        return np.concatenate(lists), np.cumsum([0, *map(len, lists)])

    def _apart(self, text: str, runs: list[tuple[int, int]]) -> np.ndarray:
        """Ids of a text that holds MARK or long runs of white space."""
        done, ids = 0, []
        for start, end in runs:
            end -= end < len(text)
            ids += [self._between(text[done:start]), self._piece(text[start:end])]
            done = end
        return np.concatenate([*ids, self._between(text[done:])])

    def _between(self, text: str) -> np.ndarray:
        if MARK not in text:
            return self._cut(pa.array([text], pa.large_string()))[0]
        first, *rest = SAFE_CUT.split(text)
        return np.frombuffer(b"".join(self._library([first, *[" " + p for p in rest]])), "<u4")

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As encode_flat, for texts without MARK and long runs of white space."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        known, bare, (full, comma) = self._after, self._bare, self._stops.values()
        if len(bare) > self._memory // 4:
            bare.clear()
        cut = _pieces(texts)
        bounds, coded = cut.offsets.to_numpy(), cut.values.dictionary_encode()
        code, pieces = np.array(coded.indices), _strings(coded.dictionary)
        found = [*map(known.get, pieces)]
        stops = [i for i, ids in enumerate(found) if ids is full or ids is comma]
        new, odd = {}, []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            if _plain(p := pieces[i]):
                new[p] = i
            else:
                odd.append(i)
                found[i] = b""
        if len(known) + len(new) > self._memory:
            first = dict(islice(known.items(), self._memory // 4))
            known.clear()
            known.update(self._stops | first)
        learned = self._learn(set(new))
        for p, i in new.items():
            found[i] = learned[p]
        spans = self._spans(code, bounds, pieces, odd, stops)
        units = list({unit for _, _, unit in spans}.difference(bare))
        bare.update(zip(units, self._library(units)))
        nothing = len(found)
        found.append(b"")
        for start, end, unit in spans:
            code[start:end] = nothing
            code[start] = len(found)
            found.append(bare[unit])
        for unit in units:
            if len(unit) > LONGEST_KEPT:
                del bare[unit]
        ids = pa.array(found, pa.large_binary()).take(pa.array(code))
        ends, raw = np.frombuffer(ids.buffers()[1], np.int64), ids.buffers()[2]
        flat = np.frombuffer(raw, "<u4", int(ends[len(code)]) // 4) if raw else np.zeros(0, "<u4")
        return flat, ends[bounds] // 4

    @staticmethod
    def _spans(code: np.ndarray, bounds: np.ndarray, pieces: list[str], odd: list[int], stops: list[int]) -> list[tuple[int, int, str]]:
        """(start, end, text) of what stays together up to safe cuts: texts' first pieces, odd pieces, and stops that are not after letters or digits, with their neighbours."""
        held = np.zeros((3, len(pieces)), bool)
        held[0, stops] = True
        stop = np.flatnonzero(held[0][code])  # a piece is before each
        held[1, code[stop - 1]] = True
        held[1, [i for i in np.flatnonzero(held[1]).tolist() if _closed(pieces[i])]] = False
        held[2, odd] = True
        at = np.unique(np.concatenate([bounds[:-1], np.flatnonzero(held[2][code]), stop[held[1][code[stop - 1]]]]))
        text = np.searchsorted(bounds, at, "right") - 1
        spans, done = [], 0
        for i, low, high in zip(at.tolist(), bounds[text].tolist(), bounds[text + 1].tolist()):
            if i < done:
                continue
            start, done = i, i + 1
            while start > low and not _parted(pieces[code[start - 1]], pieces[code[start]]):
                start -= 1
            while done < high and not _parted(pieces[code[done - 1]], pieces[code[done]]):
                done += 1
            spans.append((start, done, _source([pieces[c] for c in code[start:done].tolist()], start == low)))
        return spans
