"""Document fingerprints: a Merkle tree over paragraphs and sections, all in SQL functions.

A text's lines are its paragraphs, the leaves, each hashed with SHA-256. A
section ends after a paragraph whose hash falls on one residue in eight (and at
the end of the text), so an edit moves no boundary but those that it touches.
A section's hash is over its paragraphs' hashes, the root over the sections'.
Equal roots mean equal texts; else sections with equal hashes are skipped, and
the paragraphs of the others show where the edits are (``differences``).

Below a paragraph are its pieces, runs that end after one of a few characters
(``ENDS``) or are ``LONGEST`` long, each a 64-bit hash that holds its length.
``likeness`` is 1 for equal roots; else it is the share of the characters of both
texts in pieces that the two have in common, each as often as both have it, and
always under 1. Equal sections and paragraphs have equal pieces, so what branches
share counts in full without being looked at one by one. Repeats of a piece are
numbered (``numbered``), which makes a set of what may be held twice; sets are met
by hashing, so that the work grows with the text and not with its square. A text and
its edited one begin alike: up to there (``kept``) all characters count, and only the
rests are met piece by piece.

``with_next`` pairs each row with the following one by ascending id without a
global sort: ids are dealt into blocks of ``BLOCK`` consecutive values, so one
shuffle and a window inside the block give all followers but those of blocks'
last rows; these meet the first row of the next block that has any, which is
found by the same step over the blocks' numbers, level by level, until the
numbers that are left are few. A block of more rows than ``BIG``, or a share of
all that bounds the number of such blocks, has ids that repeat: of its identical
rows one stands for all and the others follow each other, and each id's rows are
cut by a hash of the text, so that no id's rows have to meet in one task.

Null text is an empty text: no paragraphs, no pieces, a root of its own; two
empty texts are alike (1), an empty and another are not (0). A null id precedes
all others. Rows with the same id follow each other by a hash of their texts, and
identical rows each other. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdikt.llm.common import for_splits

#: Consecutive ids that share a block of the pairing; a level of this few block numbers is ordered at once.
BLOCK, FEW = 32, 4096
#: Rows from which a block is cut, blocks that are at most, copies of a row that are made at once.
BIG, BIG_BLOCKS, RUN = 4096, 10_000, 4096
#: One paragraph in so many ends a section.
SECTION = 8
#: Characters that end a piece, about one in 17 of Western texts: rarer letters, two digits, marks, parts of the Han block.
ENDS = r"gkqxzjvbGKQXZJVB07.,;:!?|\u3001\u3002\u5000-\u50ff\u6000-\u60ff\u7000-\u70ff"
LONGEST = 64
PIECE = rf"[^{ENDS}]{{0,{LONGEST - 1}}}[{ENDS}]|[^{ENDS}]{{1,{LONGEST}}}"
#: The same pieces, of a whole text of many lines. Java takes about a microsecond for each character of which it finds that
#: the class of all ``ENDS`` doesn't hold it, so the others are said as ranges, and pieces of ISO-8859-1 alone tried first.
_LATIN = ENDS[: ENDS.index("\\")]
_PLAIN = rf"[^\n{_LATIN}\x{{100}}-\x{{10ffff}}]"
_OTHER = rf"[{_PLAIN}\x{{100}}-\x{{3000}}\x{{3003}}-\x{{4fff}}\x{{5100}}-\x{{5fff}}\x{{6100}}-\x{{6fff}}\x{{7100}}-\x{{10ffff}}]"
_PIECE = rf"{_PLAIN}{{0,{LONGEST - 1}}}+[{_LATIN}]|{_OTHER}{{0,{LONGEST - 1}}}+[{ENDS}]|{_OTHER}{{1,{LONGEST}}}+"
#: Low bits of a piece's hash, in which its length stands.
_LENGTH = 127
#: Characters before a place in which the end of a piece is looked for.
_FAR = 1024


def lines(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def paragraphs(lines: Column) -> Column:
    """Hashes of the lines, as 64 hex digits each."""
    return F.transform(lines, lambda p: F.sha2(p, 256))


def pieces(text: Column) -> Column:
    """The pieces of all of a text's lines, ascending: 57 bits of a hash and 7 of the length."""
    hashed = lambda p: F.coalesce(F.xxhash64(p).bitwiseAND(F.lit(~_LENGTH)).bitwiseOR(F.char_length(p).cast("long")), F.lit(0))  # noqa: E731  not null, so that Spark sorts plain longs
    return F.sort_array(F.transform(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), hashed))


def numbered(parts: Column) -> Column:
    """Sorted pieces as distinct values: the k-th repeat of a piece is a value of its own, of the same length."""
    again = lambda p, k: F.xxhash64(p, k).bitwiseAND(F.lit(~_LENGTH)).bitwiseOR(p.bitwiseAND(F.lit(_LENGTH).cast("long")))

    def runs(s: Column) -> Column:
        """Of sorted repeats, which are few as a rule, each as a value of its own."""
        places = F.sequence(F.lit(0), F.size(s) - 1)
        begins = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, F.greatest(i - 1, F.lit(0)))))
        return _let(begins, lambda b: F.flatten(F.zip_with(b, F.concat(F.slice(b, 2, 1 << 30), F.array(F.size(s))), lambda at, to: F.transform(F.sequence(F.lit(1), to - at), lambda k: again(F.get(s, at), k)))))

    repeats = F.filter(parts, lambda p, i: (i > 0) & (p == F.get(parts, F.greatest(i - 1, F.lit(0)))))
    one = F.array_distinct(parts)
    return F.when(F.size(one) == F.size(parts), one).otherwise(F.concat(one, _let(repeats, runs)))


def size(text: Column) -> Column:
    """Characters in pieces: all but the ends of lines."""
    return F.char_length(F.replace(text, F.lit("\n"), F.lit(""))).cast("long")


def section_ends(leaves: Column) -> Column:
    """Places, from 1, of the paragraphs that end a section."""
    n = F.size(leaves)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    # The first hex digit's residue mod 8 is even-handed: 16 digits, two for each residue.
    return F.filter(places, lambda i: (i == n) | (F.conv(F.substring(F.get(leaves, i - 1), 1, 1), 16, 10).cast("int") % SECTION == 0))


def sections(leaves: Column, ends: Column) -> Column:
    """array<struct<node, leaves>> of the content-defined runs of paragraphs."""
    starts = F.slice(F.concat(F.array(F.lit(0)), ends), 1, F.size(ends))
    runs = F.zip_with(ends, starts, lambda end, start: F.slice(leaves, start + 1, end - start))
    return F.transform(runs, lambda run: F.struct(F.sha2(F.concat_ws("", run), 256).alias("node"), run.alias("leaves")))


def root(tree: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(tree, lambda s: s["node"])), 256)


def trees(rows: DataFrame, of: dict[str, str]) -> DataFrame:
    """The rows with a column struct<root, sections> for each text column: ``of`` has new name -> text.

    Each step is a column of its own, so that none is computed again for every
    paragraph that refers to it. Texts must not be null.
    """
    kept = rows.columns
    leaves, ends, tree = ({x: f"__{part}_{x}" for x in of} for part in ("leaves", "ends", "tree"))
    rows = rows.withColumns({leaves[x]: paragraphs(lines(F.col(text))) for x, text in of.items()})
    rows = rows.withColumns({ends[x]: section_ends(F.col(leaves[x])) for x in of})
    rows = rows.withColumns({tree[x]: sections(F.col(leaves[x]), F.col(ends[x])) for x in of})
    return rows.select(*kept, *(F.struct(root(F.col(tree[x])).alias("root"), F.col(tree[x]).alias("sections")).alias(x) for x in of))


def bags(rows: DataFrame, of: dict[str, str]) -> DataFrame:
    """The rows with a column array<long> of the numbered pieces of each text column: ``of`` has new name -> text."""
    rows = rows.withColumns({x: pieces(F.col(text)) for x, text in of.items()})
    return rows.withColumns({x: numbered(F.col(x)) for x in of})


def fingerprints(rows: DataFrame, of: dict[str, str]) -> DataFrame:
    """The rows with a column struct<root, sections, pieces, size> for each text column: ``of`` has new name -> text. Texts must not be null."""
    held = {x: f"__bag_{x}" for x in of}
    found = bags(trees(rows, of), {held[x]: text for x, text in of.items()})
    return found.withColumns({x: F.struct(f"{x}.*", F.col(held[x]).alias("pieces"), size(F.col(text)).alias("size")) for x, text in of.items()}).drop(*held.values())


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _weight(parts: Column) -> Column:
    return F.when(F.size(parts) == 0, 0).otherwise(F.aggregate(parts, F.lit(0).cast("long"), lambda sum_, p: sum_ + p.bitwiseAND(F.lit(_LENGTH).cast("long"))))


def _near(equal: Column, shared: Column, total: Column) -> Column:
    return F.when(equal, 1.0).when(total == 0, 0.0).otherwise(F.least(2 * shared / total, total / (total + 1.0)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two fingerprints; 1 exactly when the roots are equal."""
    return _near(a["root"] == b["root"], _weight(F.array_intersect(a["pieces"], b["pieces"])), a["size"] + b["size"])


def differences(a: Column, b: Column) -> Column:
    """Hashes of a's paragraphs in sections that b does not have, without those that b has elsewhere."""
    nodes = F.transform(b["sections"], lambda s: s["node"])
    return F.array_except(F.flatten(F.transform(F.filter(a["sections"], lambda s: ~F.array_contains(nodes, s["node"])), lambda s: s["leaves"])), F.flatten(F.transform(b["sections"], lambda s: s["leaves"])))


def following(keys: DataFrame) -> DataFrame:
    """(key, next_key) of the distinct longs in ``key``: the next greater one, null for the last."""
    blocks = keys.groupBy(F.floor(F.col("key") / BLOCK).cast("long").alias("block")).agg(F.min("key").alias("first"), F.sort_array(F.collect_set("key")).alias("keys"))
    if keys.limit(FEW + 1).count() > FEW:
        after = following(blocks.select(F.col("block").alias("key")))
    else:
        numbers = [r[0] for r in blocks.select("block").sort("block").limit(FEW + 1).collect()]
        rows = list(zip(numbers, [*numbers[1:], None]))
        after = keys.sparkSession.createDataFrame(rows, "key long, next_key long")
    first = blocks.select(F.col("block").alias("next_key"), F.col("first").alias("after"))
    ends = blocks.join(after.withColumnRenamed("key", "block"), "block", "left").join(first, "next_key", "left")
    # At most BLOCK distinct keys to a block.
    pairs = ends.select(F.explode(F.arrays_zip("keys", F.concat(F.slice("keys", 2, BLOCK), F.array("after")).alias("nexts"))).alias("p"))
    return pairs.select(F.col("p")["keys"].alias("key"), F.col("p")["nexts"].alias("next_key"))


def with_next(docs: DataFrame) -> DataFrame:
    """Each row (doc_id, text) with next_text: that of the next row by id, of the first for the last."""
    # A null id stands before all others, in a block of its own.
    block = F.coalesce(F.floor(F.col("doc_id") / BLOCK).cast("long"), F.lit(-(1 << 62))).alias("block")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), block)
    counts = rows.select("block", F.spark_partition_id().alias("split")).groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.max("split").alias("split"))
    total, lowest, split = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.min("block"), F.coalesce(F.max("split"), F.lit(0))).first()
    tasks = for_splits(docs.sparkSession, split + 1)
    big = counts.where(F.col("n") > max(BIG, total // BIG_BLOCKS)).select("block", F.ceil(F.log2(F.col("n") / RUN)).cast("int").alias("bits"))
    group, copies = ["block"], None
    if big.head(1):
        group = ["block", "id", "run"]
        few = F.broadcast(big)  # at most BIG_BLOCKS rows
        single = rows.join(few, "block").groupBy("block", "bits", "doc_id", "text").agg(F.count(F.lit(1)).alias("n"))
        cut = F.expr("shiftright(xxhash64(text), 64 - greatest(bits, 1))")
        whole = rows.join(few, "block", "left_anti").withColumns({"id": F.lit(0).cast("long"), "run": F.lit(0).cast("long")})
        rows = whole.unionByName(single.select("doc_id", "text", "block", F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), cut.alias("run")))
        more = single.where("n > 1").select("doc_id", "text", "n", F.explode(F.expr(f"sequence(0, (n - 2) div {RUN})")).alias("at")).repartition(tasks)
        copies = more.select("doc_id", "text", F.col("text").alias("next_text"), F.explode(F.expr(f"sequence(1, least({RUN}, n - 1 - at * {RUN}))"))).drop("col")

    # Each group and the one before it; blocks that are not cut have one group.
    after = following(counts.select(F.col("block").alias("key"))).select(F.col("key").alias("block"), F.coalesce("next_key", F.lit(lowest)).alias("then"))
    if copies is None:
        before = after.select(F.col("then").alias("block"), F.struct("block").alias("to"))
    else:
        inside = Window.partitionBy("block").orderBy("id", "run")
        placed = rows.select(*group).distinct().withColumns({"at": F.row_number().over(inside), "next": F.lead(F.struct("id", "run")).over(inside)})
        heads = placed.where("at = 1").select(F.col("block").alias("then"), F.struct("id", "run").alias("head"))
        next_, last = F.coalesce("next", "head"), F.col("next").isNull()
        before = placed.join(after, "block").join(heads, "then").select(F.when(last, F.col("then")).otherwise(F.col("block")).alias("block"), next_["id"].alias("id"), next_["run"].alias("run"), F.struct(*group).alias("to"))

    # The texts are shuffled once. Of each group the first goes to the group before it.
    dealt = rows.repartition(tasks, *group)
    first = dealt.groupBy(*group).agg(F.min_by("text", F.struct("doc_id", F.xxhash64("text"), "text")).alias("halo"))
    halo = first.join(before, group).select("to.*", "halo")
    order = Window.partitionBy(*group).orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    out = dealt.withColumn("next_text", F.lead("text").over(order)).join(halo, group).select("doc_id", "text", F.coalesce("next_text", "halo").alias("next_text"))
    return out if copies is None else out.unionByName(copies)


def edited(text: Column, after: Column) -> Column:
    """The text whose last quarter (rounded down) gives way to as much of the next one's beginning."""
    cut = F.floor(F.char_length(text) / 4).cast("int")
    return F.concat(F.left(text, F.char_length(text) - cut), F.left(after, cut))


def kept(text: Column) -> Column:
    """Characters that the text and its edited one begin with and that end with a piece or a line: those up to the last such end, or none if that is far."""
    left = F.char_length(text) - F.floor(F.char_length(text) / 4).cast("int")
    open_ = F.char_length(F.regexp_extract(F.reverse(F.right(F.left(text, left), F.lit(_FAR))), rf"\A{_OTHER}*+", 0))
    return F.when(open_ < _FAR, left - open_).otherwise(0)


def as_text(print_: Column) -> Column:
    """A fingerprint as a string: the root, then each section's node and its paragraphs, 16 hex digits each."""
    parts = F.transform(print_["sections"], lambda s: F.concat_ws("", F.substring(s["node"], 1, 16), F.lit(":"), F.concat_ws("", F.transform(s["leaves"], lambda leaf: F.substring(leaf, 1, 16)))))
    return F.concat_ws("/", print_["root"], parts)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    text, then = F.col("text"), F.col("next_text")
    rows = with_next(docs).withColumns({"edited": edited(text, then), "__kept": kept(text)})
    rest = lambda whole: F.substring(whole, F.col("__kept") + 1, F.char_length(whole))
    rows = rows.withColumns({"__rest": rest(text), "__new": rest(F.col("edited"))})
    # What both begin with is as often in one as in the other: only the rests are met piece by piece.
    rows = bags(trees(rows, {"a": "text", "b": "edited"}), {"__pieces": "text", "__next": "next_text", "__old": "__rest", "__put": "__new"})
    rows = rows.withColumns({f"__size_{x}": size(F.col(x)) for x in ("text", "edited", "next_text", "__rest")} | {"__in_edited": F.array_intersect("__old", "__put"), "__in_next": F.array_intersect("__pieces", "__next")})
    a, b, n = F.col("a"), F.col("b"), F.col("__size_text")
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(a).alias("fingerprint"),
        as_text(b).alias("edited_fingerprint"),
        _near(a["root"] == b["root"], n - F.col("__size___rest") + _weight(F.col("__in_edited")), n + F.col("__size_edited")).alias("near_edited"),
        _near(text == then, _weight(F.col("__in_next")), n + F.col("__size_next_text")).alias("near_next"),
    )
