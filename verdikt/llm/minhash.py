"""Near-duplicates of five-word shingle sets: sketches, bands, exact verification.

1. Each text's set gets a 128-bit digest and a fast similarity sketch of ``T``
   coordinates (see ``sketch``). Documents with equal digests form a class, of
   which only the least doc_id goes on.
2. ``T / ROWS`` band keys a representative; a band's bucket has all that share
   the key. Two sets of similarity 0.75 miss each other in all 32 bands once in
   180,000 pairs. The members of a bucket are held against its least id: as many
   candidates as members, however large the bucket is.
3. Candidates are verified on the full shingle sets (100 * intersection >= 75 *
   union), and the links' components are found.
4. A bucket whose members are now in one component can add nothing. In each of
   the others all pairs from different components are compared by sketch, block
   against block of about ``BLOCK`` members and ``BLOCK_SHINGLES`` shingles, so
   that a bucket of any size is dealt out and nothing is dropped. Where sketches
   agree in ``AGREE`` coordinates or more (five standard deviations under the
   limit), the pair has to be verified. No pairs leave these tasks: the members
   that have a partner go on with their texts to a task for the two blocks, which
   finds their pairs again, verifies on full sets those that are not in one
   component by then, and gives the edges of a spanning forest.

A null text, and one without words, has an empty set, links with nothing and is
kept. A row without doc_id links with nothing. Rows that repeat a doc_id count
as one document with several texts. An empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdikt.llm.common import Scratch, batches, texts
from verdikt.llm.components import components
from verdikt.llm.sketch import bands, sketches
from verdikt.llm.words import mix, shingle_sets

SHINGLE, T, ROWS = 5, 128, 4
#: Of 100: the least similarity of a link.
LIMIT = 75
AGREE, BLOCK, BLOCK_SHINGLES = 70, 512, 1 << 21


def _digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    one, two = mix(values), mix(values ^ np.uint64(0x5851F42D4C957F2D))
    return int(one.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(two * np.uint64(0x2545F4914F6CDD1D)).view(np.int64))


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), hi, lo (digest), bands array<long>, sketch binary; the last two empty for an empty set."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(parts):
        for part in parts:
            column = part.column("text")
            for at in range(0, len(column), 128):
                sets = shingle_sets(column.slice(at, 128), SHINGLE)
                sketch = sketches(sets, T)
                keys = bands(sketch, ROWS).view(np.int64)
                short = mix(sketch).astype(np.uint16)
                rows = []
                for i, key in enumerate(part.column("doc_id").slice(at, 128).to_pylist()):
                    values = sets.values[sets.cuts[i] : sets.cuts[i + 1]]
                    full = len(values) > 0
                    rows.append((key, len(values), *(_digest(values) if full else (0, 0)), keys[i] if full else [], short[i].tobytes() if full else b""))
                yield from batches(schema, rows)

    return texts(docs, "doc_id").mapInArrow(run, "doc_id long, n long, hi long, lo long, bands array<long>, sketch binary")


def verified(pairs: DataFrame, shelf: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts' full sets reach the limit. ``shelf`` has doc_id and text."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(parts):
        for part in parts:
            for at in range(0, part.num_rows, 256):
                rows = part.slice(at, 256)
                a, b, text_a = rows.column("a").to_pylist(), rows.column("b").to_pylist(), rows.column("text_a")
                # Rows of one a come together mostly; its set is made once for each run.
                firsts, run_of, last = [], [], None
                for i, key in enumerate(a):
                    if not firsts or key != a[i - 1] or text_a[i].as_py() != last:
                        firsts.append(i)
                        last = text_a[i].as_py()
                    run_of.append(len(firsts) - 1)
                left, right = shingle_sets(text_a.take(pa.array(firsts)), SHINGLE), shingle_sets(rows.column("text_b"), SHINGLE)
                found = []
                for i, r in enumerate(run_of):
                    x, y = left.values[left.cuts[r] : left.cuts[r + 1]], right.values[right.cuts[i] : right.cuts[i + 1]]
                    if not len(x) or not len(y):
                        continue
                    both = np.concatenate([x, y])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    if 100 * shared >= LIMIT * (len(both) - shared):
                        found.append((a[i], b[i]))
                yield from batches(schema, found)

    b_side = shelf.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    a_side = shelf.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    return pairs.select("a", "b").join(b_side, "b").join(a_side, "a").mapInArrow(run, "a long, b long")


def _could(a: str, b: str):
    """Whether sizes of sets allow the similarity at all."""
    return 100 * F.least(a, b) >= LIMIT * F.greatest(a, b)


_MEMBER = "key long, i int, j int, mine int, doc_id long, n long, root long, bands array<long>, sketch binary"
_MEMBERS = pa.schema([("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("mine", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("root", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def dealt(members: DataFrame) -> DataFrame:
    """The members of buckets (key, doc_id, n, root, bands, sketch), once for each pair of blocks (i, j) that theirs is in."""
    sizes = members.groupBy("key").agg(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES).alias("size"))
    rows = members.join(sizes.select("key", F.ceil("size").cast("int").alias("blocks")), "key")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    # A block goes to its pairings with every block of its bucket: one copy for buckets of one block.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "doc_id", "n", "root", "bands", "sketch")


def partners(group: pa.Table):
    """(x, ys): rows of one pair of blocks that have to be verified with row x.

    They are of different roots, and of sizes and sketches that allow a link;
    each pair comes up in the first bucket that the two share.
    """
    key, i, j = (group.column(c)[0].as_py() for c in ("key", "i", "j"))
    mine, n, root = (group.column(c).to_numpy() for c in ("mine", "n", "root"))
    sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint16).reshape(-1, T)
    band = np.array(group.column("bands").to_pylist(), np.int64)
    band = band[:, : int(np.argmax(band[0] == key))]  # those before this bucket's
    left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
    for x in left.tolist():
        ys = right[(root[right] != root[x]) & (100 * np.minimum(n[right], n[x]) >= LIMIT * np.maximum(n[right], n[x]))]
        if i == j:
            ys = ys[ys > x]
        ys = ys[~(band[ys] == band[x]).any(axis=1)]
        ys = ys[(sketch[ys] == sketch[x]).sum(axis=1) >= AGREE]
        if len(ys):
            yield x, ys


def candidates(members: DataFrame) -> DataFrame:
    """Of the dealt members those that have partners in their pair of blocks."""

    def run(group: pa.Table) -> pa.Table:
        wanted = np.zeros(group.num_rows, bool)
        for x, ys in partners(group):
            wanted[x] = wanted[ys] = True
        return group.filter(pa.array(wanted)).select(_MEMBERS.names)

    return dealt(members).groupBy("key", "i", "j").applyInArrow(run, _MEMBER)


def confirmed(held: DataFrame, shelf: DataFrame) -> DataFrame:
    """Spanning forests (a, b) of the links among ``candidates``, by full sets; the texts meet once for each pair of blocks."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        ids, group = group.column("doc_id").to_pylist(), group.combine_chunks()
        sets = shingle_sets(group.column("text").combine_chunks(), SHINGLE)
        _, values = np.unique(sets.values, return_inverse=True)
        size, cuts = np.diff(sets.cuts), sets.cuts
        present = np.zeros(len(values) + 1, bool)
        _, tree = np.unique(group.column("root").to_numpy(), return_inverse=True)
        edges = []
        for x, ys in partners(group):
            others = ys[(size[ys] > 0) & (tree[ys] != tree[x])]
            if not len(others) or not size[x]:
                continue
            own = values[cuts[x] : cuts[x + 1]]
            present[own] = True
            at = np.concatenate([values[cuts[y] : cuts[y + 1]] for y in others])
            shared = np.add.reduceat(present[at].astype(np.int64), np.r_[0, np.cumsum(size[others])[:-1]])
            present[own] = False
            for y in others[100 * shared >= LIMIT * (size[others] + size[x] - shared)].tolist():
                if tree[y] != tree[x]:
                    edges.append((ids[x], ids[y]))
                    tree[tree == tree[y]] = tree[x]
        return pa.Table.from_batches(list(batches(schema, edges)), schema)

    return held.join(shelf, "doc_id").groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def linked(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Each row's doc_id, n_shingles, component_id, kept."""
    rows = scratch.save(sketched(docs), "sketched")
    full = rows.where("n > 0 and doc_id is not null")
    classes = scratch.save(full.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep")), "classes")
    copies = full.select("hi", "lo", "doc_id").join(classes, ["hi", "lo"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    reps = full.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    keyed = scratch.save(reps.select("doc_id", "n", F.explode("bands").alias("key")), "keyed")
    buckets = scratch.save(keyed.groupBy("key").agg(F.min_by(F.struct("doc_id", "n"), "doc_id").alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", F.col("lead.doc_id").alias("lead"), F.col("lead.n").alias("lead_n")), "buckets")
    members = scratch.save(keyed.join(buckets, "key"), "members")
    scratch.drop("keyed")
    star = scratch.save(members.where("doc_id <> lead").where(_could("n", "lead_n")).select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct(), "star")

    # Texts of the documents in buckets only: all that is ever verified.
    wanted = members.select("doc_id").distinct()
    shelf = scratch.save(texts(docs, "doc_id").join(wanted, "doc_id", "left_semi"), "shelf")
    links = scratch.save(copies.unionByName(verified(star, shelf)), "links")
    labels = components(links, scratch, "star")

    named = members.select("key", "doc_id", "n").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    named = scratch.save(named, "named")
    torn = named.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    open_members = named.join(torn, "key", "left_semi").join(reps.select("doc_id", "bands", "sketch"), "doc_id")
    more = scratch.save(confirmed(candidates(open_members), shelf), "more")
    if more.head(1):
        labels = components(labels.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more), scratch, "all")
    for table in ("classes", "buckets", "members", "star", "shelf", "links", "named", "more"):
        scratch.drop(table)
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One document of each group, with all columns: the least doc_id. Repeated rows of it all stay."""
    gone = linked(docs, scratch).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
