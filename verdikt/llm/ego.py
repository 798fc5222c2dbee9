"""Near-duplicate embeddings by an epsilon grid order join.

Vectors are normalised, so that a cosine of at least ``COSINE`` is a Euclidean
distance of at most epsilon. Those of the commonest length are turned onto their
principal axes (which keeps distances), the others keep their own axes. The
``LEADING`` first axes carry a grid of cells epsilon wide; rows are sorted by
length and then by cell in lexicographic order, the epsilon grid order, and cut
into intervals of vectors of one length, up to ``INTERVAL`` of them, with a
bounding box each: the length, which sets lengths far apart, and the first
``BOX`` axes.

The join is recursive. ``FAN`` neighbouring intervals, or nodes of the level
below, make a node. From the pair of the root with itself on down, each pair of
nodes is replaced by the pairs of their children, and pairs whose boxes are
provably over epsilon apart are skipped; both steps are equi-joins on the
parents' numbers and carry no vectors. What is left meets strip by strip: a strip
is a run of intervals, a task has two strips and the pairs of intervals that are
left between them, and halves each pair further in the same way. It computes the
cosines of what remains in double precision, so nothing but provably distant
pairs goes uncompared. There are ``STRIPS`` strips, and more only where one would
be longer than a task should hold, so that a vector is sent about as often
however many there are, up to ``STRIPS * STRIP_INTERVALS`` intervals.

Equal vectors form a class first, whose least vec_id is compared for all. A
task returns, of its links, how many each class has (copies counted) and a
spanning forest, not the links themselves: no group of copies or neighbours
comes out squared.

Components may be floats or doubles of any size; only vectors of one length are
compared. A vector that is null, empty, zero, or holds a null or a component
that is not finite links with nothing, and neither do rows with a null vec_id.
Rows that repeat a vec_id stay one vector in components, but each is counted. An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdikt.llm.common import Scratch, batches
from verdikt.llm.components import components

COSINE = 0.95
LEADING, INTERVAL, FAN, BOX = 6, 2048, 8, 64
#: Strips of a small table, and the intervals and bytes that one has at most in a large one.
STRIPS, STRIP_INTERVALS, STRIP_BYTES = 8, 32, 32 << 20
#: Intervals are halved down to this many vectors inside a task.
LEAF = 256
#: Room for rounding where distances are bounded; it never decides a link.
SLACK = 1e-6
#: Between the boxes of two lengths; no two vectors are so far apart.
APART = 4.0


def epsilon(cosine: float) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK


def units(raw: bytes | list[bytes], kind: str, n: int | None = None) -> np.ndarray:
    """Rows of length one, double precision: of n vectors one after another, or of a list."""
    if n is None:
        n, raw = len(raw), b"".join(raw)
    matrix = np.frombuffer(raw, kind).reshape(n, -1).astype(np.float64)
    scale = np.abs(matrix).max(axis=1, keepdims=True)
    matrix = matrix / scale  # so that squares neither overflow nor vanish
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def component_kind(rows: DataFrame) -> str:
    """How components are kept: as 32-bit floats only where they come as such."""
    kind = rows.schema["embedding"].dataType
    return "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"


def valid(rows: DataFrame) -> DataFrame:
    """(vec_id, size, raw) of the usable vectors; size is the number of components, raw holds them."""
    schema, kind = pa.schema([("vec_id", pa.int64()), ("size", pa.int32()), ("raw", pa.binary())]), component_kind(rows)

    def run(parts):
        for part in parts:
            kept = []
            for key, vector in zip(part.column("vec_id").to_pylist(), part.column("embedding")):
                values = vector.values if vector.is_valid else None
                if key is None or values is None or not len(values) or values.null_count:
                    continue
                v = values.to_numpy(zero_copy_only=False).astype(kind)
                if np.isfinite(v).all() and v.any():
                    kept.append((key, len(v), (v + 0).tobytes()))  # -0.0 becomes 0.0
            yield from batches(schema, kept)

    embedding = F.col("embedding") if kind == "<f4" else F.col("embedding").cast("array<double>").alias("embedding")
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), embedding).mapInArrow(run, "vec_id long, size int, raw binary")


def axes(classes: DataFrame, size: int, kind: str) -> np.ndarray:
    """Principal axes, as columns, from the second moments of all vectors of a length; tasks return one matrix each."""

    def run(parts):
        total = np.zeros((size, size))
        for part in parts:
            for at in range(0, part.num_rows, 4096):
                m = units(part.column("raw").slice(at, 4096).to_pylist(), kind)
                total += m.T @ m
        n = np.arange(size * size)
        yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(total.ravel())], names=["k", "v"])

    sums = classes.where(F.col("size") == size).select("raw").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v")).collect()
    moment = np.zeros(size * size)
    for k, v in sums:
        moment[k] = v
    return np.linalg.eigh(moment.reshape(size, size))[1][:, ::-1]


class Axes:
    """Coordinates of unit vectors: on the principal axes for the commonest length, else on their own."""

    def __init__(self, kind: str, turn: np.ndarray):
        self.kind, self.turn = kind, turn

    def turned(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.turn if vectors.shape[1] == len(self.turn) else vectors

    def box(self, vectors: np.ndarray) -> tuple[list[float], list[float]]:
        """(low, high) of APART * length and the first BOX axes."""
        x = np.zeros((len(vectors), BOX + 1))
        x[:, 0] = APART * vectors.shape[1]
        some = self.turned(vectors)[:, :BOX]
        x[:, 1 : 1 + some.shape[1]] = some
        return x.min(axis=0).tolist(), x.max(axis=0).tolist()


def ordered(classes: DataFrame, grid: Axes, eps: float, n: int) -> DataFrame:
    """Intervals in epsilon grid order: part, at, ids, weights, raw (arrays), low, high (the box)."""

    def cells(parts):
        for part in parts:
            size, raw = part.column("size").to_numpy(), part.column("raw").to_pylist()
            cell = np.zeros((len(raw), LEADING), np.int32)
            for s in np.unique(size).tolist():
                rows = np.flatnonzero(size == s)
                some = grid.turned(units([raw[i] for i in rows], grid.kind))[:, :LEADING]
                cell[rows, : some.shape[1]] = np.floor(some / eps)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("rep", "weight", "size", "raw")), pa.array([*cell], pa.list_(pa.int32()))], names=["rep", "weight", "size", "raw", "cell"])

    def cut(parts):
        held: list[tuple] = []
        place, at = TaskContext.get().partitionId(), 0

        def interval(rows):
            ids, weights, _, raw = zip(*rows)
            return place, at, list(ids), list(weights), b"".join(raw), *grid.box(units(list(raw), grid.kind))

        schema = pa.schema([("part", pa.int32()), ("at", pa.int32()), ("ids", pa.list_(pa.int64())), ("weights", pa.list_(pa.int64())), ("raw", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])
        most = 1
        for part in parts:
            for row in zip(*(part.column(c).to_pylist() for c in ("rep", "weight", "size", "raw"))):
                if held and (len(held) >= most or held[0][2] != row[2]):
                    yield from batches(schema, [interval(held)])
                    held, at = [], at + 1
                if not held:
                    most = max(1, min(INTERVAL, STRIP_BYTES // STRIP_INTERVALS // len(row[3])))
                held.append(row)
        if held:
            yield from batches(schema, [interval(held)])

    keyed = classes.select("rep", "weight", "size", "raw").mapInArrow(cells, "rep long, weight long, size int, raw binary, cell array<int>")
    ranged = keyed.repartitionByRange(n, "size", "cell", "rep").sortWithinPartitions("size", "cell", "rep")
    return ranged.select("rep", "weight", "size", "raw").mapInArrow(cut, "part int, at int, ids array<long>, weights array<long>, raw binary, low array<double>, high array<double>")


def _gap(a: str, b: str):
    """Squared distance of two boxes."""
    apart = F.zip_with(F.zip_with(f"{a}_low", f"{b}_high", lambda x, y: x - y), F.zip_with(f"{b}_low", f"{a}_high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(apart, F.lit(0.0), lambda total, x: total + x * x)


def _named(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.select(F.col("up").alias(f"{side}_up"), F.col("node").alias(side), F.col("low").alias(f"{side}_low"), F.col("high").alias(f"{side}_high"))


def near_pairs(boxes: DataFrame, eps: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b), a <= b, of the boxes' nodes that are not provably over eps apart. ``boxes``: node 0.., low, high."""
    levels, size, dims = [boxes.withColumn("up", F.floor(F.col("node") / FAN).cast("long"))], boxes.count(), BOX + 1
    while size > 1:
        up = levels[-1].groupBy("up").agg(*(F.min(F.get("low", F.lit(d))).alias(f"l{d}") for d in range(dims)), *(F.max(F.get("high", F.lit(d))).alias(f"h{d}") for d in range(dims)))
        up = up.select(F.col("up").alias("node"), F.array(*(f"l{d}" for d in range(dims))).alias("low"), F.array(*(f"h{d}" for d in range(dims))).alias("high"))
        levels.append(scratch.save(up.withColumn("up", F.floor(F.col("node") / FAN).cast("long")), f"level-{len(levels)}"))
        size = -(-size // FAN)
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for depth, level in enumerate(reversed(levels[:-1])):
        below = pairs.select(F.col("a").alias("a_up"), F.col("b").alias("b_up")).join(_named(level, "a"), "a_up").join(_named(level, "b"), "b_up")
        pairs = scratch.save(below.where("a <= b").where(_gap("a", "b") <= eps * eps).select("a", "b"), f"near-{depth}")
    return pairs


def join_blocks(a: np.ndarray, b: np.ndarray, same: bool, grid: Axes, cosine: float, found) -> None:
    """Calls found(i, j, links) for every part of a x b that may hold a link; links is a boolean matrix."""
    eps, ta = epsilon(cosine), grid.turned(a)
    tb = ta if same else grid.turned(b)

    def halve(i0: int, i1: int, j0: int, j1: int) -> None:
        if same and j1 <= i0:  # the other triangle
            return
        x, y = ta[i0:i1], tb[j0:j1]
        apart = np.maximum(np.maximum(x.min(axis=0) - y.max(axis=0), y.min(axis=0) - x.max(axis=0)), 0)
        if (apart * apart).sum() > eps * eps:
            return
        if i1 - i0 <= LEAF and j1 - j0 <= LEAF:
            links = a[i0:i1] @ b[j0:j1].T >= cosine
            if same:
                links &= np.arange(i0, i1)[:, None] < np.arange(j0, j1)[None]
            if links.any():
                found(i0, j0, links)
        elif i1 - i0 >= j1 - j0:
            m = (i0 + i1) // 2
            halve(i0, m, j0, j1)
            halve(m, i1, j0, j1)
        else:
            m = (j0 + j1) // 2
            halve(i0, i1, j0, m)
            halve(i0, i1, m, j1)

    if len(a) and len(b):
        halve(0, len(a), 0, len(b))


class Forest:
    """Union-find over a task's rows, which keeps the edges that joined two trees."""

    def __init__(self, n: int):
        self._parent, self.edges = np.arange(n), []

    def roots(self, rows: np.ndarray) -> np.ndarray:
        up = self._parent[rows]
        while (self._parent[up] != up).any():
            up = self._parent[up]
        self._parent[rows] = up
        return up

    def tie(self, links: np.ndarray, i: int, j: int) -> None:
        """Joins row i + x with row j + y wherever links[x, y]; each turn adds one open link of every row."""
        rows, columns = i + np.arange(links.shape[0]), j + np.arange(links.shape[1])
        while True:
            left, right = self.roots(rows), self.roots(columns)
            if left[0] == right[0] and (left == left[0]).all() and (right == left[0]).all():
                return
            opened = links & (left[:, None] != right[None])
            some = np.flatnonzero(opened.any(axis=1))
            if not len(some):
                return
            for x, y in zip(some.tolist(), opened[some].argmax(axis=1).tolist()):
                a, b = self.roots(np.array([i + x, j + y])).tolist()
                if a != b:
                    self._parent[max(a, b)] = min(a, b)
                    self.edges.append((i + x, j + y))


def joined(pairs: DataFrame, intervals: DataFrame, per_strip: int, grid: Axes, cosine: float) -> DataFrame:
    """(rep, n, other): links of a class within one pair of strips, copies counted; n is null on rows of the forest."""
    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        known = group.filter(group.column("raw").is_valid())
        nodes = known.column("node").to_pylist()
        ids = [np.array(x) for x in known.column("ids").to_pylist()]
        weights = [np.array(x) for x in known.column("weights").to_pylist()]
        vectors = [units(raw, grid.kind, len(i)) for raw, i in zip(known.column("raw").to_pylist(), ids)]
        counts, place = [np.zeros(len(i), np.int64) for i in ids], {node: k for k, node in enumerate(nodes)}
        first = np.cumsum([0, *map(len, ids)])
        forest = Forest(int(first[-1]))
        left = group.filter(group.column("a").is_valid())
        for x, y in sorted(zip(left.column("a").to_pylist(), left.column("b").to_pylist())):
            p, q = place[x], place[y]

            def found(i, j, links, p=p, q=q):
                r, c = links.shape
                counts[p][i : i + r] += links @ weights[q][j : j + c]
                counts[q][j : j + c] += weights[p][i : i + r] @ links
                forest.tie(links, int(first[p]) + i, int(first[q]) + j)

            join_blocks(vectors[p], vectors[q], p == q, grid, cosine, found)
        every, total = np.concatenate(ids), np.concatenate(counts)
        some = np.flatnonzero(total)
        edges = np.array(forest.edges, np.int64).reshape(-1, 2)
        return pa.table(
            [
                pa.array(np.r_[every[some], every[edges[:, 0]]], pa.int64()),
                pa.concat_arrays([pa.array(total[some], pa.int64()), pa.nulls(len(edges), pa.int64())]),
                pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(every[edges[:, 1]], pa.int64())]),
            ],
            schema=schema,
        )

    strip = lambda c: F.floor(F.col(c) / per_strip).cast("long")
    met = pairs.select(strip("a").alias("i"), strip("b").alias("j"), "a", "b")
    # An interval goes once to each pair of strips where it has any partner.
    wanted = met.select("i", "j", F.explode(F.array("a", "b")).alias("node")).distinct()
    sent = wanted.join(intervals.select("node", "ids", "weights", "raw"), "node")
    rows = sent.unionByName(met, allowMissingColumns=True)
    return rows.groupBy("i", "j").applyInArrow(run, "rep long, n long, other long")


def linked(vectors: DataFrame, scratch: Scratch, cosine: float = COSINE) -> DataFrame:
    """Each row's vec_id, n_links, component_id, kept."""
    spark, kind = vectors.sparkSession, component_kind(vectors)
    rows = scratch.save(valid(vectors), "valid")
    classes = scratch.save(rows.groupBy("size", "raw").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "classes")
    # Lengths with their numbers of classes: the commonest, then how many bytes there are.
    sizes = classes.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), "size").limit(1).collect()
    count, values = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0))).first()
    copies = scratch.save(rows.join(classes, ["size", "raw"]).select("vec_id", "rep", "weight"), "copies")
    grid = Axes(kind, axes(classes, common[0]["size"], kind) if common else np.eye(1))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(partitions, count // INTERVAL), values * int(kind[-1]) // (2 * STRIP_BYTES))
    cut = scratch.save(ordered(classes, grid, epsilon(cosine), n), "cut")
    # The intervals' numbers along the order: one count for each partition is summed on the driver.
    before, starts = 0, []
    for part, held in sorted(tuple(r) for r in cut.groupBy("part").count().collect()):
        starts.append((part, before))
        before += held
    first = spark.createDataFrame(starts, "part int, first long")
    intervals = scratch.save(cut.join(F.broadcast(first), "part").withColumn("node", F.col("first") + F.col("at")).drop("part", "at", "first"), "intervals")
    pairs = near_pairs(intervals.select("node", "low", "high"), epsilon(cosine), scratch)
    per_strip = max(1, min(STRIP_INTERVALS, -(-before // STRIPS)))
    links = scratch.save(joined(pairs, intervals, per_strip, grid, cosine), "links")

    edges = links.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    edges = edges.unionByName(copies.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    labels = components(edges, scratch, "ego")
    for table in ("valid", "classes", "cut", "intervals"):
        scratch.drop(table)
    counts = links.where("n is not null").groupBy("rep").agg(F.sum("n").alias("n"))
    known = copies.join(counts, "rep", "left").select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    rest = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).exceptAll(known.select("vec_id")).withColumn("n_links", F.lit(0).cast("long"))
    out = known.unionByName(rest).join(labels.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", "n_links", F.coalesce("root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
