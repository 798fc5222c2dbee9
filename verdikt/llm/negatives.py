"""Hard negatives by one-dimensional distance keys.

Components x become floor(256 * x); the score of two vectors is their inner
product in whole numbers. Inner products become distances by one more component:
a vector gets sqrt(M^2 - |x|^2), M being the greatest length of all, an anchor
gets 0, and then d^2 = M^2 + |q|^2 - 2 * score.

1. Index. Each augmented vector belongs to its nearest of a few pivots, and the
   table is stored sorted by (pivot, distance to it), cut into blocks of up to
   ``BLOCK`` vectors of one pivot, each of which is an interval of distances. Pivots
   are fitted on a bounded sample (``SAMPLE`` vectors); all vectors are indexed.
2. Search. If D is an anchor's distance to a pivot, a vector at distance k from
   the pivot is at least |k - D| and at most k + D away from the anchor. An anchor
   looks for the ``k`` best rows in an annulus, [inner, outer]: first in the blocks
   whose intervals can hold a row between the inner radius and the distance of the
   anchor's own vector, then in all that can hold one within the remaining bound, which is the outer radius or the distance of the
   worst of the k found, if that is nearer. A block that is in neither scan can hold
   no row that belongs to the answer, which so is exact. A task has a strip of
   anchors and a run of blocks, takes the blocks in the order of their bounds, and
   tightens each anchor's bound as it goes.
3. Positives are the ``POSITIVES`` best of an anchor's own label, the whole space
   being the annulus. Each of them then opens an annulus from its own score down to
   ``FLOOR`` hundredths of it, in which the ``NEGATIVES`` best of other labels are looked
   for, for all positives of an anchor in one pass over the blocks.

What a scan sends are intervals of keys for each strip and pivot, which meet the
blocks by an equi-join on the pivot: no pairs of vectors, and of a strip and a
block at most one row. A task returns k rows for each anchor and annulus, and a
window keeps the best. Where the vectors are spread evenly in all dimensions no
annulus excludes much and every anchor meets every block (products of matrices);
a vector is then sent once for every ``STRIP`` anchors.

Anchors are the rows whose vec_id is divisible by ``EVERY``. Ties go to the smaller
vec_id. A null vec_id, a null label, a null vector, and one with a null or
non-finite component take no part. Vectors of different lengths compare as if the
shorter ended in zeros; an empty one scores 0 with all. Of rows that repeat a
vec_id the least (label, vector) stands for all. An anchor without a positive, and
a positive without a negative, gives no rows; nor does an empty table. Other
columns are ignored. Scores that would not fit 62 bits are an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdikt.llm.common import Scratch, batches
from verdikt.llm.ego import component_kind

EVERY, SCALE = 100, 256.0
POSITIVES, NEGATIVES, FLOOR = 5, 5, 80
#: Vectors of a block, anchors of a strip, blocks that a task takes for it.
BLOCK, STRIP, RUN = 1024, 4096, 64
SAMPLE, PIVOTS, PER_PIVOT = 4096, 256, 8192
#: Rows of anchors whose products with a block are made at once.
AT_ONCE = 512
#: Room for rounding where distances are bounded; scores themselves are whole numbers.
SLACK = 1e-6


def valid(rows: DataFrame) -> DataFrame:
    """(vec_id, label, raw, size, most) of the rows that take part: whole components as longs, their number, squared length."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int32()), ("raw", pa.binary()), ("size", pa.int32()), ("most", pa.float64())])

    def run(parts):
        for part in parts:
            kept = []
            for key, label, vector in zip(part.column("vec_id").to_pylist(), part.column("label").to_pylist(), part.column("embedding")):
                values = vector.values if vector.is_valid else None
                if key is None or label is None or values is None or values.null_count:
                    continue
                v = values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(v).all():
                    with np.errstate(over="ignore"):
                        v = np.floor(SCALE * v)
                        most = float((v * v).sum())
                    if most >= 2.0**62:
                        raise OverflowError(f"vector {key} has scores of over 62 bits")
                    kept.append((key, (label + 1) % 10 if key % 7 == 0 else label, v.astype("<i8").tobytes(), len(v), most))
            yield from batches(schema, kept)

    embedding = F.col("embedding") if component_kind(rows) == "<f4" else F.col("embedding").cast("array<double>").alias("embedding")
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), embedding).mapInArrow(run, "vec_id long, label int, raw binary, size int, most double")


class Space:
    """The augmented space: its dimensions, M^2 and the pivots."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.exact = most < 2**53  # products of doubles, and their partial sums, are whole then
        self.pivots = np.zeros((1, size + 1))

    def vectors(self, raws: list[bytes]) -> np.ndarray:
        """Whole components, as doubles where their products are exact, else as longs."""
        if self.size and all(len(r) == 8 * self.size for r in raws):
            out = np.frombuffer(b"".join(raws), "<i8").reshape(len(raws), self.size)
        else:
            out = np.zeros((len(raws), self.size), np.int64)
            for i, r in enumerate(raws):
                v = np.frombuffer(r, "<i8")
                out[i, : len(v)] = v
        return out.astype(np.float64) if self.exact else out

    def augmented(self, vectors: np.ndarray, anchors: bool) -> np.ndarray:
        x = vectors.astype(np.float64)
        extra = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))
        return np.c_[x, extra]

    def distances(self, points: np.ndarray) -> np.ndarray:
        """To each pivot."""
        square = (points * points).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1)[None] - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def fit(self, sample: np.ndarray, k: int) -> None:
        """k-means, a few rounds, from evenly spaced rows of the sample."""
        points = self.augmented(sample, anchors=False)
        self.pivots = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)].copy()
        for _ in range(8):
            near = self.distances(points).argmin(axis=1)
            for c in np.unique(near).tolist():
                self.pivots[c] = points[near == c].mean(axis=0)

    def slack(self) -> float:
        return SLACK * (1 + math.sqrt(self.most))

    def radius(self, square: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance at which an anchor of squared length ``square`` has a row of that score."""
        return np.sqrt(np.maximum(self.most + square - 2.0 * score, 0))


def indexed(rows: DataFrame, space: Space, tasks: int) -> DataFrame:
    """Blocks in the order of (pivot, distance): part, at, pivot, low, high, ids, labels, raws."""

    def keyed(parts):
        for part in parts:
            for at in range(0, part.num_rows, 4096):
                some = part.slice(at, 4096)
                d = space.distances(space.augmented(space.vectors(some.column("raw").to_pylist()), anchors=False))
                pivot = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("vec_id", "label", "raw")), pa.array(pivot.astype(np.int32)), pa.array(d[np.arange(len(d)), pivot])], names=["vec_id", "label", "raw", "pivot", "key"])

    schema = pa.schema([("part", pa.int32()), ("at", pa.int32()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int32())), ("raws", pa.list_(pa.binary()))])

    def cut(parts):
        place, at, held = TaskContext.get().partitionId(), 0, []

        def block():
            ids, labels, raws, pivots, keys = zip(*held)
            return place, at, pivots[0], keys[0], keys[-1], list(ids), list(labels), list(raws)

        for part in parts:
            for row in zip(*(part.column(c).to_pylist() for c in ("vec_id", "label", "raw", "pivot", "key"))):
                if held and (len(held) >= BLOCK or held[0][3] != row[3]):
                    yield from batches(schema, [block()])
                    held, at = [], at + 1
                held.append(row)
        if held:
            yield from batches(schema, [block()])

    keys = rows.select("vec_id", "label", "raw").mapInArrow(keyed, "vec_id long, label int, raw binary, pivot int, key double")
    ranged = keys.repartitionByRange(tasks, "pivot", "key", "vec_id").sortWithinPartitions("pivot", "key", "vec_id")
    return ranged.mapInArrow(cut, "part int, at int, pivot int, low double, high double, ids array<long>, labels array<int>, raws array<binary>")


class Anchors:
    """A strip of anchors with what is left to find for each annulus."""

    def __init__(self, group: pa.Table, space: Space):
        self.ids, self.labels = (group.column(c).to_numpy() for c in ("vec_id", "label"))
        self.vectors = space.vectors(group.column("raw").to_pylist())
        whole = space.augmented(self.vectors, anchors=True)
        self.square, self.to_pivots = (whole * whole).sum(axis=1), space.distances(whole)
        # (anchors, annuli): scores from the ceiling down to the floor; the annulus is empty where the floor is over the ceiling.
        self.ceiling, self.floor, self.bound = (np.array(group.column(c).to_pylist(), np.int64).reshape(len(self.ids), -1) for c in ("ceiling", "floor", "bound"))

    def inner(self, space: Space) -> np.ndarray:
        return space.radius(self.square[:, None], self.ceiling)


def reach(space: Space, anchors: Anchors, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor and annulus the radii within which rows are looked for: (inner, outer)."""
    inner = anchors.inner(space)
    outer = space.radius(anchors.square[:, None], np.minimum(anchors.ceiling, anchors.square.astype(np.int64)[:, None])) if first else space.radius(anchors.square[:, None], np.maximum(anchors.floor, anchors.bound))
    empty = anchors.floor > anchors.ceiling
    return np.where(empty, np.inf, inner - space.slack()), np.where(empty, -np.inf, outer + space.slack())


def met(inner: np.ndarray, outer: np.ndarray, to_pivot: np.ndarray, low: float, high: float) -> np.ndarray:
    """Annuli that a block of distances [low, high] from a pivot may have rows of."""
    d = to_pivot[:, None]
    nearest, farthest = np.maximum(np.maximum(low - d, d - high), 0), high + d
    return (nearest <= outer) & (farthest >= inner)


_LEAST = np.iinfo(np.int64).min


def intervals(anchors: DataFrame, space: Space, first: bool) -> DataFrame:
    """(strip, pivot, low, high): distances from each pivot between which some anchor of the strip looks for rows."""
    schema = pa.schema([("strip", pa.int64()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64())])

    def run(parts):
        for part in parts:
            for at in range(0, part.num_rows, AT_ONCE):
                some = pa.Table.from_batches([part.slice(at, AT_ONCE)])
                who, strip = Anchors(some, space), some.column("strip").to_numpy()
                inner, outer = reach(space, who, first)
                found = []
                for pivot in range(len(space.pivots)):
                    d = who.to_pivots[:, pivot]
                    low = np.maximum(d[:, None] - outer, inner - d[:, None]).min(axis=1)
                    high = (d[:, None] + outer).max(axis=1)
                    for s in np.unique(strip).tolist():
                        rows = strip == s
                        if low[rows].min() <= high[rows].max():
                            found.append((s, pivot, float(low[rows].min()), float(high[rows].max())))
                yield from batches(schema, found)

    return anchors.mapInArrow(run, "strip long, pivot int, low double, high double").groupBy("strip", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def scanned(anchors: DataFrame, blocks: DataFrame, space: Space, k: int, own: bool, first: bool) -> DataFrame:
    """(anchor_id, annulus, vec_id, score): of each task the k best rows of each annulus, of the anchor's own label or of others.

    The second scan leaves out what the first has seen.
    """
    schema = pa.schema([("anchor_id", pa.int64()), ("annulus", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        who = Anchors(group.filter(pc.is_valid(group.column("raw"))), space)
        inner, outer = reach(space, who, first)
        seen = reach(space, who, True)
        held = group.filter(pc.is_valid(group.column("raws"))).select(["pivot", "low", "high", "ids", "labels", "raws"]).to_pylist()
        # The nearest blocks first, so that bounds tighten early.
        held.sort(key=lambda b: (float(np.maximum(np.maximum(b["low"] - who.to_pivots[:, b["pivot"]], who.to_pivots[:, b["pivot"]] - b["high"]), 0).mean()), b["pivot"], b["low"]))
        n, annuli = who.ceiling.shape
        best = [[(np.zeros(0, np.int64),) * 3] for _ in range(annuli)]
        bound = who.bound.copy()
        for block in held:
            ids, labels, vectors = np.array(block["ids"]), np.array(block["labels"]), space.vectors(block["raws"])
            d = who.to_pivots[:, block["pivot"]]
            wanted = met(inner, np.minimum(outer, space.radius(who.square[:, None], bound) + space.slack()), d, block["low"], block["high"])
            if not first:
                wanted &= ~met(*seen, d, block["low"], block["high"])
            for at in range(0, n, AT_ONCE):
                rows = at + np.flatnonzero(wanted[at : at + AT_ONCE].any(axis=1))
                if not len(rows):
                    continue
                scores = (who.vectors[rows] @ vectors.T).astype(np.int64)
                alike = who.labels[rows][:, None] == labels[None]
                able = alike & (who.ids[rows][:, None] != ids[None]) if own else ~alike
                for ring in range(annuli):
                    some = np.flatnonzero(wanted[rows, ring])
                    r = rows[some]
                    fits = able[some] & (scores[some] <= who.ceiling[r, ring][:, None]) & (scores[some] >= np.maximum(who.floor[r, ring], bound[r, ring])[:, None])
                    if len(ids) > k:  # of ties at the k-th place all stay
                        kept = np.where(fits, scores[some], _LEAST)
                        fits &= kept >= np.partition(kept, -k, axis=1)[:, -k][:, None]
                    x, y = np.nonzero(fits)
                    if len(x):
                        best[ring].append((r[x], ids[y], scores[some[x], y]))
                        best[ring] = [_top(best[ring], k, n, bound[:, ring])]
        out = [(ring, *best[ring][0]) for ring in range(annuli)]
        return pa.table([pa.array(np.concatenate([who.ids[r] for _, r, _, _ in out]), pa.int64()), pa.array(np.concatenate([np.full(len(r), ring, np.int32) for ring, r, _, _ in out])), pa.array(np.concatenate([i for _, _, i, _ in out]), pa.int64()), pa.array(np.concatenate([s for _, _, _, s in out]), pa.int64())], schema=schema)

    wide = intervals(anchors, space, first).withColumnsRenamed({"low": "from", "high": "to"})
    slim = blocks.select("node", "pivot", "low", "high").join(wide, "pivot").where("high >= from and low <= to").select("strip", "node")
    # A task takes the blocks whose numbers fall on its residue, so that each has near and far ones.
    spread = slim.join(slim.groupBy("strip").agg(F.ceil(F.count(F.lit(1)) / RUN).alias("runs")), "strip").withColumn("run", F.pmod("node", "runs"))
    sent = spread.select("strip", "run", "node").join(blocks, "node")
    asked = spread.select("strip", "run").distinct().join(anchors, "strip")
    rows = sent.unionByName(asked, allowMissingColumns=True)
    return rows.groupBy("strip", "run").applyInArrow(run, "anchor_id long, annulus int, vec_id long, score long")


def _top(parts: list, k: int, n: int, bound: np.ndarray) -> tuple:
    """The k best of each row of parts (row, id, score); bound becomes the k-th best score where there are k."""
    row, ids, score = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    begins = np.searchsorted(row, np.arange(n))
    kept = np.arange(len(row)) - begins[row] < k
    last = begins + k - 1
    full = np.flatnonzero((last < len(row)) & (row[np.minimum(last, len(row) - 1)] == np.arange(n)))
    bound[full] = np.maximum(bound[full], score[last[full]])
    return row[kept], ids[kept], score[kept]


def nearest(anchors: DataFrame, blocks: DataFrame, space: Space, k: int, own: bool, scratch: Scratch, name: str) -> DataFrame:
    """(anchor_id, annulus, vec_id, score, rank): the k best rows of each annulus, all if fewer."""
    order = Window.partitionBy("anchor_id", "annulus").orderBy(F.desc("score"), "vec_id")
    best = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    start = scratch.save(best(scanned(anchors, blocks, space, k, own, first=True)), f"{name}-first")
    # The k-th best so far bounds what is left; nothing bounds an annulus with fewer than k.
    worst = start.where(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("annulus", "score"))).alias("worst"))
    known = anchors.join(worst.withColumnRenamed("anchor_id", "vec_id"), "vec_id", "left")
    bound = F.transform("bound", lambda b, i: F.coalesce(F.element_at("worst", i), b))
    rest = scanned(known.withColumn("bound", F.when(F.col("worst").isNull(), F.col("bound")).otherwise(bound)).select(*anchors.columns), blocks, space, k, own, first=False)
    return scratch.save(best(start.drop("rank").unionByName(rest)), name)


def mined(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    rows = valid(vectors).groupBy("vec_id").agg(F.min(F.struct("label", "raw", "size", "most")).alias("v"))
    rows = scratch.save(rows.select("vec_id", "v.*"), "rows")
    n, size, most = rows.agg(F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.max("most"), F.lit(0.0))).first()
    space = Space(size, int(most) if most < 2**53 else int(most * (1 + 1e-12)) + 1)
    picked = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, SAMPLE / max(1, n)))).select("vec_id", "raw").sort("vec_id").limit(2 * SAMPLE).toArrow()
    if picked.num_rows:
        space.fit(space.vectors(picked.column("raw").to_pylist()), min(PIVOTS, max(4, n // PER_PIVOT)))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = scratch.save(indexed(rows, space, max(1, min(partitions, n // (4 * BLOCK)), n // (RUN * BLOCK))), "cut")
    # Blocks are numbered along the order; one count for each partition passes through the driver.
    before, starts = 0, []
    for part, held in sorted(tuple(r) for r in cut.groupBy("part").count().collect()):
        starts.append((part, before))
        before += held
    firsts = F.broadcast(spark.createDataFrame(starts, "part int, first long"))
    blocks = scratch.save(cut.join(firsts, "part").withColumn("node", F.col("first") + F.col("at")).drop("part", "at", "first"), "blocks")

    # Anchors near each other share a strip, so that their intervals overlap.
    seats = blocks.select("node", F.explode(F.filter("ids", lambda i: i % EVERY == 0)).alias("vec_id"))
    placed = seats.join(rows.where(F.col("vec_id") % EVERY == 0), "vec_id")
    counts = placed.groupBy("node").count().withColumn("group", F.floor(F.col("node") / 4096))
    groups = counts.groupBy("group").agg(F.sum("count").alias("n")).withColumn("start", F.sum("n").over(Window.orderBy("group")) - F.col("n"))
    place = F.sum("count").over(Window.partitionBy("group").orderBy("node")) - F.col("count") + F.col("start")
    strips = counts.join(groups, "group").select("node", F.floor(place / STRIP).alias("strip"))
    ends = [F.array(F.lit(x).cast("long")).alias(c) for c, x in (("ceiling", space.most), ("floor", -space.most), ("bound", -space.most))]
    anchors = scratch.save(placed.join(strips, "node").select("strip", "vec_id", "label", "raw", *ends), "anchors")

    positives = nearest(anchors, blocks, space, POSITIVES, True, scratch, "positives")
    # 100 * score >= FLOOR * positive, so the least score is the ceiling of FLOOR / 100 of it.
    least = -F.floor(-(F.col("score").cast("decimal(20,0)") * FLOOR) / 100).cast("long")
    rings = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("rank", "score", least.alias("least")))).alias("r"))
    pad = lambda c, fill: F.concat(F.transform("r", lambda x: x[c]), F.array_repeat(F.lit(fill).cast("long"), F.lit(POSITIVES) - F.size("r")))
    around = anchors.select("strip", "vec_id", "label", "raw").join(rings, "vec_id")
    around = around.select("strip", "vec_id", "label", "raw", pad("score", -space.most).alias("ceiling"), pad("least", space.most + 1).alias("floor"))
    around = scratch.save(around.withColumn("bound", F.col("floor")), "annuli")
    negatives = nearest(around, blocks, space, NEGATIVES, False, scratch, "negatives")
    told = positives.select("anchor_id", (F.col("rank") - 1).alias("annulus"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(told, ["anchor_id", "annulus"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
