"""Audit of sources: how far each (lang, source) group's use of terms is from the others' and from its language's.

A term is a run of letters A-Z (lower-cased) and of characters beyond ASCII. A
language keeps the V terms that at least ``MIN_DOCS`` of its documents have. A
group, and a language as a whole, gives each kept term, occurring or not, the
smoothed share p = 1 + floor(10^9 * (count + 5) / (N + 5 * V)) in whole numbers,
N being its count of kept terms. ``pairs`` has the distance of each two sources of
a language, summed over all kept terms; ``over_used`` the terms of which a group
makes the most over its language.

1. Terms are found in tasks on the UTF-8 bytes of many texts at once: a lookup
   table marks letters, their edges are the terms. Slices are grouped by xxhash,
   and every slice is held against the bytes of its group's first, so that slices
   of different bytes never count as one. A compressed sparse matrix of groups by
   terms gives counts and numbers of documents, by sums over its segments.
2. One shuffle by (lang, term) sums these rows; terms of too few documents, nearly
   all of the rows, end there.
3. A source's row of the matrix of shares is its share of an absent term but for
   the terms that it has, so two sources' distance is V times the distance of
   these two constants, corrected at the terms that either has. Kept terms are
   dealt into buckets of about ``ENTRIES`` entries, a language's sources into
   blocks of about ``SOURCES``; a task has a bucket of two blocks, corrects all their
   pairs by segment sums, and Spark adds up the buckets. However many rows a source
   has, it is one row for each kept term by then.

Null text, lang and source read as empty; each row is a document, repeated doc_ids
and null ones too; a text without terms still makes its group occur. Texts of
about ``TEXT_BYTES`` are taken together; a longer one stands alone and takes about
40 bytes of memory a byte. Ties are ordered by the item's UTF-8 bytes. Where a
language keeps no term its distances are 0. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdikt.llm.common import Scratch, packed, slices, tasks
from verdikt.llm.words import raw_bytes

MIN_DOCS, TOP = 30, 50
TEXT_BYTES, ENTRIES, SOURCES = 2 << 20, 1 << 16, 256

_LETTER = np.ones(256, bool)
_LETTER[:0x41] = _LETTER[0x5B:0x61] = _LETTER[0x7B:0x80] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def term_spans(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of each term of the texts data[cuts[i]:cuts[i + 1]]."""
    inside = np.r_[_LETTER[data], False]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = cuts[cuts < len(data)]
    first[edge] = inside[edge]  # a text's first letter opens a term even if the text before ends in one
    start = np.flatnonzero(first)
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | first[1:])) + 1
    return start, end, np.searchsorted(cuts, start, side="right") - 1


def grouped(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashed=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """(group of each slice, first slice of each group); slices share a group exactly when their bytes are equal."""
    raw = data.tobytes()
    keys = np.fromiter((hashed(raw[a:b]) for a, b in zip(start.tolist(), end.tolist())), np.uint64, len(start))
    _, first, group = np.unique(keys, return_index=True, return_inverse=True)
    size, lead = end - start, first[group]
    before = np.cumsum(size) - size
    at = np.repeat(start[lead] - before, size) + np.arange(int(size.sum()))
    own = np.repeat(start - before, size) + np.arange(int(size.sum()))
    differ = data[own] != data[np.minimum(at, len(data) - 1)]
    wrong = size != size[lead]
    if len(size):
        wrong |= np.add.reduceat(differ.astype(np.int64), before) > 0
    firsts, others = first.tolist(), {}
    for k in np.flatnonzero(wrong).tolist():  # hash collisions
        word = raw[start[k] : end[k]]
        if word not in others:
            others[word] = len(firsts)
            firsts.append(k)
        group[k] = others[word]
    return group, np.array(firsts, np.int64)


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of runs of rows (lang, source, text): occurrences and rows that have the term."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(parts):
        for part in parts:
            for rows in slices(part, "text", TEXT_BYTES):
                data, cuts = raw_bytes(rows.column("text"))
                data = _LOWER[data]
                start, end, doc = term_spans(data, cuts)
                if not len(start):
                    continue
                term, first = grouped(data, start, end)
                names, owner = {}, []
                for key in zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist()):
                    owner.append(names.setdefault(key, len(names)))
                # The sparse matrix of rows by terms, then of groups by terms.
                cell, n = np.unique(doc * len(first) + term, return_counts=True)
                key = np.array(owner)[cell // len(first)] * len(first) + cell % len(first)
                order = np.argsort(key, kind="stable")
                key, n = key[order], n[order]
                begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                group, at = key[begins] // len(first), key[begins] % len(first)
                size = (end - start)[first]
                letters = np.repeat(start[first] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                words = packed(data[letters], np.r_[0, np.cumsum(size)]).cast(pa.string())
                langs, sources = (pa.array(x, pa.string()).take(pa.array(group)) for x in zip(*names))
                yield pa.RecordBatch.from_arrays([langs, sources, words.take(pa.array(at)), pa.array(np.add.reduceat(n, begins)), pa.array(np.diff(np.r_[begins, len(key)]))], schema=schema)

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 5) / (total + 5 * terms)), exact; 1 where there are no terms."""
    whole = "decimal(20,0)"
    part = F.expr("cast(1000000000 as decimal(10,0))") * (count + 5).cast(whole)
    return F.when(terms > 0, F.lit(1) + F.call_function("div", part, F.greatest(total + 5 * terms, F.lit(1)).cast(whole))).otherwise(1).cast("long")


class Audit:
    """kept (lang, term, source, n, total): occurrences of kept terms in a source and in its language; groups (lang, source, n, total, terms)."""

    def __init__(self, docs: DataFrame, scratch: Scratch):
        self.scratch = scratch
        rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
        by_term = counted(rows).repartition(tasks(docs), "lang", "term")
        counts = by_term.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        whole = Window.partitionBy("lang", "term")
        kept = counts.withColumns({"total": F.sum("n").over(whole), "docs": F.sum("docs").over(whole)}).where(F.col("docs") >= MIN_DOCS)
        self.kept = scratch.save(kept.select("lang", "term", "source", "n", "total"), "kept")
        langs = self.kept.groupBy("lang", "term").agg(F.first("total").alias("n")).groupBy("lang").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
        sums = self.kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
        groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
        self.groups = scratch.save(groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "total", "terms"))), "groups")

    def over_used(self, top: int = TOP) -> DataFrame:
        """lang, source, item (term), value (share over the language's), rank; at most ``top`` to a source."""
        known = self.groups.select("lang", "source", F.col("n").alias("of"), F.col("total").alias("of_lang"), "terms")
        p, q = share(F.col("n"), F.col("of"), F.col("terms")), share(F.col("total"), F.col("of_lang"), F.col("terms"))
        found = self.kept.where("n > 0").join(known, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
        return ranked(found).where(F.col("rank") <= top)

    def pairs(self) -> DataFrame:
        """lang, source, item (another source), value (distance), rank."""
        buckets = max(1, -(-self.kept.count() // ENTRIES))
        blocks = self.groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SOURCES).cast("int").alias("blocks"))
        zero = share(F.lit(0).cast("long"), F.col("n"), F.col("terms"))
        rows = self.groups.join(blocks, "lang").select("lang", "source", "n", "terms", zero.alias("zero"), "blocks", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("mine"))
        entries = self.kept.join(rows.withColumnRenamed("n", "of"), ["lang", "source"])
        entries = entries.select("lang", "source", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"), "term", share(F.col("n"), F.col("of"), F.col("terms")).alias("share"), "zero", "terms", "blocks", "mine")
        # Every source stands in each bucket, whether or not it has any of its terms.
        heads = rows.select("lang", "source", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "zero", "terms", "blocks", "mine")
        dealt = entries.unionByName(heads, allowMissingColumns=True).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("lang", "bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "source", "term", "share", "zero", "terms")
        parts = dealt.groupBy("lang", "bucket", "i", "j").applyInArrow(distances, "lang string, a string, b string, value long")
        sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
        return ranked(sums.select("lang", both.alias("p"), "value").select("lang", "p.source", "p.item", "value"))


def ranked(rows: DataFrame) -> DataFrame:
    """Rows of (lang, source, item, value) numbered by descending value, then by item."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def distances(group: pa.Table) -> pa.Table:
    """What a bucket of terms adds to the distance of each two sources of two blocks; bucket 0 also has the constant part."""
    i, j, bucket = (group.column(c)[0].as_py() for c in ("i", "j", "bucket"))
    group = group.combine_chunks()
    heads = group.filter(pc.is_null(group.column("term")))
    entries = group.filter(pc.is_valid(group.column("term")))
    names, zero, mine = heads.column("source").to_pylist(), heads.column("zero").to_numpy(), heads.column("mine").to_numpy()
    terms = heads.column("terms")[0].as_py()
    place = {name: k for k, name in enumerate(names)}
    row = np.array([place[s] for s in entries.column("source").to_pylist()], np.int64)
    term = pc.dictionary_encode(entries.column("term")).combine_chunks()
    width = len(term.dictionary) if isinstance(term, pa.DictionaryArray) else 0
    column = term.indices.to_numpy() if width else np.zeros(0, np.int64)
    value = entries.column("share").to_numpy()
    order = np.lexsort((column, row))
    row, column, value = row[order], column[order], value[order]
    begins = np.searchsorted(row, np.arange(len(names) + 1))  # the sparse matrix, source by source
    full = np.flatnonzero(np.diff(begins))
    left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
    a_out, b_out, out = [], [], []
    for a in left.tolist():
        others = right[right > a] if i == j else right
        if not len(others):
            continue
        own = value[begins[a] : begins[a + 1]]
        dense = np.full(width, zero[a], np.int64)
        dense[column[begins[a] : begins[a + 1]]] = own
        base = np.abs(zero[a] - zero)
        total = np.zeros(len(names), np.int64)
        if bucket == 0:
            total += terms * base
        for at in range(0, len(own), 4096):  # where a has the term, against the constant of each other
            some = own[at : at + 4096]
            total += np.abs(some[:, None] - zero[None]).sum(axis=0) - len(some) * base
        if len(value):
            theirs = np.abs(value - dense[column]) - np.abs(zero[row] - dense[column])
            total[full] += np.add.reduceat(theirs, begins[full])
        a_out += [names[a]] * len(others)
        b_out += [names[b] for b in others.tolist()]
        out.append(total[others])
    lang = group.column("lang")[0].as_py()
    return pa.table([pa.array([lang] * len(a_out), pa.string()), pa.array(a_out, pa.string()), pa.array(b_out, pa.string()), pa.array(np.concatenate([*out, np.zeros(0, np.int64)]), pa.int64())], names=["lang", "a", "b", "value"])


def audit(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    found = Audit(docs, scratch)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return found.pairs().withColumn("part", F.lit("pair")).select(*columns).unionByName(found.over_used().withColumn("part", F.lit("term")).select(*columns))
