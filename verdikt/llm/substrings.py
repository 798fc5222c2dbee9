"""Exact removal of passages that an earlier document has, by difference-cover anchors.

A window is ``WINDOW`` consecutive words of a document; a word is removed where a
window that covers it also starts in a document with a smaller doc_id. Hashing
all windows of all texts is what the cover saves:

1. Anchors. ``COVER`` is a difference cover modulo ``PERIOD``: for any two places
   i, j there is a shift under ``PERIOD`` that brings both onto places whose
   residues are in the cover. So two equal windows, wherever they start, hold an
   equal run of ``ANCHOR`` = ``WINDOW - PERIOD + 1`` words at a covered place of
   both. Only these runs, three of seven places, are hashed and shuffled, to
   learn which of them two documents share.
2. Extension. A window can only be in two documents if it holds a shared anchor;
   just those windows are hashed, in full and to 128 bits, and shuffled, to learn
   the least doc_id of each.
3. A document whose windows have a lesser holder loses the words they cover.

Both questions are asked in the same way. A task gathers up to ``PAIRS`` pairs
(hash, document) and settles what it can by itself: of documents that share a
hash in the task only the least asks on, so a passage that a third of all
documents have is asked for once a task, not once a document. The questions go
as packed arrays, one for each range of hashes (``place``), and each range
answers with one row for each hash that a document has to know of. Answers meet
the texts by doc_id; both times it is the same shuffle of the texts. No pairs of
documents come out.

Of an anchor's hash the range and 32 more bits are sent; a chance equality
only adds a window to be looked at. Windows are equal where both of their
independent 64-bit hashes are.

A null or empty text has no words; a text shorter than a window loses none. A
very long text is one row of one task, some 40 bytes of memory a character. Rows
that repeat a doc_id are one document with several texts, which does not take
from itself. Equal texts of different ids leave the least id's alone. A null
doc_id takes no part: its row keeps all words and takes from no one. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdikt.llm.common import packed, slices, tasks, texts, unpacked
from verdikt.llm.words import exact_words, windows

WINDOW = 13
PERIOD, COVER = 7, (1, 2, 4)
ANCHOR = WINDOW - PERIOD + 1
#: Pairs that a task gathers before it asks, bytes of text that are hashed at once.
PAIRS, TEXT_BYTES = 1 << 21, 1 << 20
#: Rows of a question: pairs that are still open; hashes that are known to be shared; settled pairs, which only travel on.
OPEN, SHARED, SETTLED = 0, 1, 2

_COVERED = np.isin(np.arange(PERIOD), COVER)
_ASK = pa.schema([("place", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("high", pa.binary()), ("low", pa.binary())])
_ASK_SQL = "place int, kind int, docs binary, high binary, low binary"
#: One row for each document and hash.
_FLAGS, _GONE = pa.schema([("doc_id", pa.int64()), ("key", pa.int32())]), pa.schema([("doc_id", pa.int64()), ("key", pa.int64())])


class Hashed:
    """A slice of texts as words: doc (row), one or two hashes a word, the word's place in its text, words from it on."""

    def __init__(self, column: pa.Array, lanes: int = 1):
        self.doc, *self.hashes = exact_words(column, lanes)
        self.count = np.bincount(self.doc, minlength=len(column))
        self.first = np.r_[0, np.cumsum(self.count)]
        self.place = np.arange(len(self.doc)) - self.first[self.doc]
        self.left = self.count[self.doc] - self.place

    def anchors(self) -> np.ndarray:
        """Words at which an anchor starts, of texts that have a window."""
        return np.flatnonzero(_COVERED[self.place % PERIOD] & (self.left >= ANCHOR) & (self.count[self.doc] >= WINDOW))

    def starts(self) -> np.ndarray:
        return np.flatnonzero(self.left >= WINDOW)


def covering(n: int, at: np.ndarray, before: int, after: int) -> np.ndarray:
    """For each of n places whether one of ``at`` stands from ``before`` places before it to ``after`` places after it."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.maximum(at - after, 0), 1)
    np.add.at(change, np.minimum(at + before + 1, n), -1)
    return np.cumsum(change[:-1]) > 0


def _place(hash_: np.ndarray, places: int) -> np.ndarray:
    return ((hash_ >> np.uint64(32)) * np.uint64(places) >> np.uint64(32)).astype(np.int32)


def _home(docs: np.ndarray, places: int) -> np.ndarray:
    return _place(docs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), places)


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Places at which any of the columns, which are sorted together, changes."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    changed = np.ones(len(columns[0]), bool)
    changed[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(changed)


def _rows(kind: int, docs: np.ndarray | None, place: np.ndarray, *keys: np.ndarray) -> pa.RecordBatch:
    """One row for each place; within it sorted by document, as runs compress well."""
    order = np.argsort(place, kind="stable") if docs is None else np.lexsort((docs, place))
    place = place[order]
    cuts = np.r_[_begins(place), len(place)]
    none = pa.array([b""] * (len(cuts) - 1), pa.binary())
    high, low = [*(packed(k[order], cuts) for k in keys), none][:2]
    return pa.RecordBatch.from_arrays([pa.array(place[cuts[:-1]]), pa.array(np.full(len(cuts) - 1, kind, np.int32)), none if docs is None else packed(docs[order], cuts), high, low], schema=_ASK)


class Gathered:
    """What a task has to ask: columns that are put together when there are ``PAIRS`` rows."""

    def __init__(self, questions):
        self._questions, self._held, self._n = questions, [], 0

    def add(self, *columns: np.ndarray):
        self._held.append(columns)
        self._n += len(columns[0])
        if self._n >= PAIRS:
            yield from self.flush()

    def flush(self):
        if self._n:
            columns = [np.concatenate(x) for x in zip(*self._held)]
            self._held, self._n = [], 0
            yield from self._questions(*columns)


def _answers(docs: list[np.ndarray], keys: list[np.ndarray], schema: pa.Schema) -> pa.Table:
    """Sorted by document, as runs compress well."""
    docs, keys = np.concatenate(docs), np.concatenate(keys)
    order = np.argsort(docs, kind="stable")
    return pa.table([pa.array(docs[order]), pa.array(keys[order].view(np.dtype(f"i{keys.dtype.itemsize}")))], schema=schema)


def _of(group: pa.Table, kind: int) -> pa.Table:
    return group.filter(pc.equal(group.column("kind"), kind))


def anchor_questions(docs: DataFrame, places: int) -> DataFrame:
    def questions(docs: np.ndarray, hash_: np.ndarray):
        order = np.lexsort((docs, hash_))
        docs, hash_ = docs[order], hash_[order]
        some = _begins(docs, hash_)
        docs, hash_ = docs[some], hash_[some]
        first = np.zeros(len(docs), bool)
        first[_begins(hash_)] = True
        only = first & np.r_[first[1:], True]
        place, key = _place(hash_, places), hash_.astype(np.uint32)
        for kind, which in ((OPEN, only), (SHARED, first & ~only), (SETTLED, ~only)):
            if which.any():
                yield _rows(kind, None if kind == SHARED else docs[which], _home(docs[which], places) if kind == SETTLED else place[which], key[which])

    def run(parts):
        asked = Gathered(questions)
        for part in parts:
            for rows in slices(part, "text", TEXT_BYTES):
                ids, words = rows.column("doc_id").to_numpy(), Hashed(rows.column("text"))
                at = words.anchors()
                yield from asked.add(ids[words.doc[at]], windows(words.hashes[0], at, ANCHOR))
        yield from asked.flush()

    return docs.mapInArrow(run, _ASK_SQL)


def shared(group: pa.Table) -> pa.Table:
    """Of a range of anchors, for each document those that another has too."""
    asked, told, known = _of(group, OPEN), _of(group, SHARED), _of(group, SETTLED)
    docs, keys = unpacked(asked.column("docs"), np.int64), unpacked(asked.column("high"), np.uint32)
    order = np.lexsort((docs, keys))
    docs, keys = docs[order], keys[order]
    first = _begins(keys)
    last = np.r_[first, len(keys)][1:] - 1
    many = (docs[first] != docs[last]) | np.isin(keys[first], unpacked(told.column("high"), np.uint32))
    some = np.repeat(many, last - first + 1)
    return _answers([docs[some], unpacked(known.column("docs"), np.int64)], [keys[some], unpacked(known.column("high"), np.uint32)], _FLAGS)


def met(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, text, keys): the texts, as they are shuffled once for all who ask, with their documents' answers, null where there are none."""
    # At most as many keys as the document has words.
    told = answers.repartition("doc_id").groupBy("doc_id").agg(F.collect_list("key").alias("keys"))
    return docs.join(told, "doc_id", "left")


def _answered(rows: pa.RecordBatch, kind: type, doc: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key, of the row ``doc``, is among the row's answers."""
    out, cuts, answers = np.zeros(len(keys), bool), np.searchsorted(doc, np.arange(rows.num_rows + 1)).tolist(), rows.column("keys")
    for i in range(rows.num_rows):
        a, b = cuts[i], cuts[i + 1]
        if b > a:
            known = np.unique(answers[i].values.to_numpy().view(kind))
            out[a:b] = known[np.minimum(np.searchsorted(known, keys[a:b]), len(known) - 1)] == keys[a:b]
    return out


def window_questions(texts_: DataFrame, places: int) -> DataFrame:
    """Of ``met`` with shared anchors, the windows that hold one."""

    def questions(docs: np.ndarray, high: np.ndarray, low: np.ndarray):
        order = np.lexsort((docs, low, high))
        docs, high, low = docs[order], high[order], low[order]
        some = _begins(docs, low, high)
        docs, high, low = docs[some], high[some], low[some]
        first = np.zeros(len(docs), bool)
        first[_begins(high, low)] = True
        yield _rows(OPEN, docs[first], _place(high[first], places), high[first], low[first])
        if not first.all():  # a lesser document of this task has them
            yield _rows(SETTLED, docs[~first], _home(docs[~first], places), high[~first])

    def run(parts):
        asked = Gathered(questions)
        for part in parts:
            for rows in slices(part.filter(part.column("keys").is_valid()), "text", TEXT_BYTES):
                ids, words = rows.column("doc_id").to_numpy(), Hashed(rows.column("text"), lanes=2)
                at = words.anchors()
                hit = at[_answered(rows, np.uint32, words.doc[at], windows(words.hashes[0], at, ANCHOR).astype(np.uint32))]
                some = words.starts()
                # An anchor is in the windows that start up to PERIOD - 1 words before it; those of another text do not reach a window's length.
                some = some[covering(len(words.doc), hit, 0, PERIOD - 1)[some]]
                if len(some):
                    yield from asked.add(ids[words.doc[some]], windows(words.hashes[0], some, WINDOW), windows(words.hashes[1], some, WINDOW))
        yield from asked.flush()

    return texts_.mapInArrow(run, _ASK_SQL)


def lesser(group: pa.Table) -> pa.Table:
    """Of a range of windows, for each document those that one with a smaller id has too."""
    asked, known = _of(group, OPEN), _of(group, SETTLED)
    docs, high, low = unpacked(asked.column("docs"), np.int64), unpacked(asked.column("high"), np.uint64), unpacked(asked.column("low"), np.uint64)
    order = np.lexsort((docs, low, high))
    docs, high, low = docs[order], high[order], low[order]
    first = _begins(high, low)
    some = docs > np.repeat(docs[first], np.diff(np.r_[first, len(docs)]))
    return _answers([docs[some], unpacked(known.column("docs"), np.int64)], [high[some], unpacked(known.column("high"), np.uint64)], _GONE)


def without(texts_: DataFrame) -> DataFrame:
    """(doc_id, text, n_words, removed) of ``met`` with windows to remove.

    ``text`` holds the words that stay, joined by one space; ``removed`` has the runs of
    words that go, as [start, end) in words.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("removed", pa.list_(pa.list_(pa.int64())))])

    def run(parts):
        for part in parts:
            for rows in slices(part, "text", TEXT_BYTES):
                at = np.flatnonzero(rows.column("keys").is_valid().to_numpy(zero_copy_only=False))
                some, gone, kept, counts, removed = rows.take(pa.array(at)), {}, [], [], []
                if len(at):
                    words = Hashed(some.column("text"))
                    starts, first = words.starts(), words.first.tolist()
                    hit = starts[_answered(some, np.uint64, words.doc[starts], windows(words.hashes[0], starts, WINDOW))]
                    covered = covering(len(words.doc), hit, WINDOW - 1, 0)
                    gone = {row: covered[a:b] for row, a, b in zip(at.tolist(), first, first[1:])}
                for i, text in enumerate(rows.column("text").cast(pa.binary()).to_pylist()):
                    words, out = text.split(), gone.get(i)
                    counts.append(len(words))
                    if out is None or not out.any():
                        kept.append(b" ".join(words))
                        removed.append([])
                    else:
                        kept.append(b" ".join([w for w, x in zip(words, out.tolist()) if not x]))
                        removed.append(np.flatnonzero(np.diff(np.r_[False, out, False].astype(np.int8))).reshape(-1, 2).tolist())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(removed, schema.field("removed").type)], schema=schema)

    return texts_.mapInArrow(run, "doc_id long, text string, n_words long, removed array<array<long>>")


def deduplicate(docs: DataFrame) -> DataFrame:
    """Each row's doc_id, text without what earlier documents have, n_words (before) and removed (runs of words)."""
    places = tasks(docs)
    # Only where it must be: under a cast Spark would not see that the texts' two shuffles are one.
    rows = texts(docs if docs.schema["doc_id"].dataType == T.LongType() else docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    known = rows.where("doc_id is not null")
    anchors = anchor_questions(known, places).groupBy("place").applyInArrow(shared, "doc_id long, key int")
    gone = window_questions(met(known, anchors), places).groupBy("place").applyInArrow(lesser, "doc_id long, key long")
    apart = rows.where("doc_id is null").withColumn("keys", F.lit(None).cast("array<long>"))
    return without(met(known, gone).unionByName(apart))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, run: n + F.get(run, F.lit(1)) - F.get(run, F.lit(0)))
    return deduplicate(docs).select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))
