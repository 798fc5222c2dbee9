"""Packing documents into windows of tokens by lexical retrieval.

Documents are tokenised once, into a table of ids in the shared scratch folder;
each task adds to it one row of document frequencies, so that counting over all
documents costs no second pass. The documents are sorted by a sketch of their
tokens: tasks take ranges of sketches, sort them and cut them into shards of about
``SHARD_TOKENS`` ids one after another, so that like documents meet however many
shards there are (``routes``). In each shard a BM25 inverted index,
whose terms are the tokens, returns for the document that a window began with
(its seed) the unused documents most like it; they fill the window in that
order. Neighbours that the sketch sends to another shard are not seen. A document
longer than the space left is cut, and its rest opens the next window as its
seed. When the seed has no unused neighbour left, the next unused document
follows. Frequencies, the number of documents and their mean length are those of
all documents, so every shard weighs tokens alike; what reaches the tasks is one
weight for each token of the vocabulary and one bound for each of at most
``RANGES`` ranges.

All windows of a shard but the last are full. What is left at its end is cut
into windows whose lengths are powers of two, which take no padding.

A null text is an empty document, one end id long; a null doc_id is kept as it
is; repeated rows are packed one by one; an empty table gives no rows; other
columns are ignored. One document, however long, is held whole in a task, as is one
shard, which a longer document fills alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdikt.llm.bpe import SLICE, file_encoder
from verdikt.llm.common import Scratch, batches, packed, slices, tasks, texts
from verdikt.llm.words import distinct

SHARD_TOKENS = 400_000
K1, B = 1.2, 0.75
#: In a shard of up to AT_ONCE documents, tokens in more than one of DENSE are scored by a matrix of up to CELLS, the others by postings.
AT_ONCE, DENSE, CELLS = 2000, 64, 1 << 21
#: Ranges of sketches at most, and documents for each that give the ranges' bounds, on average.
RANGES, BOUND_SAMPLE = 1 << 15, 64
#: Parts of a sketch, 16 bits each.
PARTS = 4
#: Rows of frequencies that are summed by one task, until so few are left for the driver.
SUMS = 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"
ROUTED = "doc_id long, place long, ids binary, sketch long, `range` int"
TOKENS = "doc_id long, place long, ids binary, df binary, documents long, tokens long"


def vocabulary_size(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size()


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """TOKENS: a row for each document with its ids, and one for each task with its frequencies."""
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("ids", pa.binary()), ("df", pa.binary()), ("documents", pa.int64()), ("tokens", pa.int64())])
    kind = _width(size)

    def run(parts):
        encoder, df, documents, tokens = file_encoder(tokenizer), np.zeros(size, np.int64), 0, 0
        for part in parts:
            for some in slices(part, "text", SLICE):
                flat, cuts = encoder.encode_flat(some.column("text"))
                flat = flat.astype(kind)
                df += np.bincount(distinct(_keys(np.diff(cuts), flat, size)) % size, minlength=size)
                documents, tokens = documents + some.num_rows, tokens + len(flat)
                ids = packed(np.insert(flat, cuts[1:], end_id), cuts + np.arange(len(cuts)))
                none = [pa.nulls(some.num_rows, t) for t in schema.types[3:]]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("place"), ids, *none], schema=schema)
        yield from batches(schema, [(None, None, None, df.tobytes(), documents, tokens)])

    # A row's place in the input tells repeated rows apart.
    return texts(docs, "doc_id").withColumn("place", F.monotonically_increasing_id()).mapInArrow(run, TOKENS)


def _keys(length: np.ndarray, flat: np.ndarray, size: int) -> np.ndarray:
    """document * size + token for the tokens of documents one after another."""
    kind = np.uint32 if len(length) * size < 1 << 32 else np.uint64
    return np.repeat(np.arange(len(length), dtype=kind) * kind(size), length) + flat.astype(kind)


def _width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def statistics(rows: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """(documents that hold each token, documents, tokens without end ids) over all documents.

    ``rows`` has one row for each task that tokenised. They are added up by
    SUMS at a time, level by level, until SUMS are left.
    """

    def run(parts):
        df, documents, tokens = np.zeros(size, np.int64), 0, 0
        for part in parts:
            for row in part.to_pylist():
                df, documents, tokens = df + np.frombuffer(row["df"], np.int64), documents + row["documents"], tokens + row["tokens"]
        if documents:
            yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()], pa.binary()), pa.array([documents]), pa.array([tokens])], names=["df", "documents", "tokens"])

    n = rows.count()
    while n > SUMS:
        n = -(-n // SUMS)
        rows = rows.repartition(n).mapInArrow(run, "df binary, documents long, tokens long")
    sums = rows.collect()
    df = sum((np.frombuffer(r["df"], np.int64) for r in sums), np.zeros(size, np.int64))
    return df, sum(r["documents"] for r in sums), sum(r["tokens"] for r in sums)


def rankings(df: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """PARTS random orders of the tokens, in which heavy ones come early and those that no two documents share last."""
    draws = np.random.default_rng(0).exponential(size=(PARTS, len(idf)))
    late = np.where(df > 1, draws / np.maximum(idf, 1e-12), np.inf)
    ranks = np.argsort(np.argsort(late, axis=1, kind="stable"), axis=1, kind="stable")
    return np.minimum(np.where(df > 1, ranks, 0xFFFF), 0xFFFF).astype(np.uint16)


def sketches(ids: list[bytes], kind: str, ranks: np.ndarray) -> np.ndarray:
    """A 63-bit number for each document: its first token in each of the orders.

    Two documents have a part in common about as often as the share, by idf, of
    all their tokens that both hold.
    """
    flat = np.frombuffer(b"".join(ids), kind)
    starts = np.cumsum([0, *(len(i) for i in ids)])[:-1] // np.dtype(kind).itemsize  # an end id each: none is empty
    out = np.zeros(len(ids), np.uint64)
    for rank in ranks if len(ids) else ():
        out = (out << np.uint64(16)) | np.minimum.reduceat(rank[flat], starts).astype(np.uint64)
    return (out >> np.uint64(1)).astype(np.int64)


def dealt(sketch: np.ndarray, place: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range of each document; a sketch that fills several is dealt among them by place."""
    low, high = np.searchsorted(bounds, sketch, "left"), np.searchsorted(bounds, sketch, "right")
    salt = (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return low + (salt % np.maximum(high - low, 1).astype(np.uint64)).astype(np.int64)


def routes(documents: DataFrame, kind: str, ranks: np.ndarray, n: int, ranges: int) -> DataFrame:
    """ROUTED: documents (doc_id, place, ids), ``ranges`` partitions by sketch with about as many ids each, in order.

    The bounds are quantiles of a sample by a hash of the place, BOUND_SAMPLE
    documents for each of at most RANGES ranges: what the driver holds has a size
    that does not depend on the input. A range holds any number of shards.
    """
    shared = documents.sparkSession.sparkContext.broadcast(ranks)

    def measured(parts):
        for part in parts:
            ids = part.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(sketches(ids, kind, shared.value), pa.int64()), pa.array([len(i) for i in ids], pa.int64())], names=["sketch", "bytes"])

    share = min(1.0, ranges * BOUND_SAMPLE / max(n, 1))
    few = documents.where(F.pmod(F.xxhash64("place"), F.lit(1 << 40)) < int((1 << 40) * share))
    seen = few.select("ids").mapInArrow(measured, "sketch long, bytes long").toArrow()
    sketch, size = seen.column("sketch").to_numpy(), seen.column("bytes").to_numpy()
    order = np.argsort(sketch, kind="stable")
    upto = np.cumsum(size[order])
    cuts = np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges) if len(upto) else np.zeros(0, np.int64)
    bounds = documents.sparkSession.sparkContext.broadcast(sketch[order][cuts])

    def run(parts):
        for part in parts:
            sketch = sketches(part.column("ids").to_pylist(), kind, shared.value)
            place = dealt(sketch, part.column("place").to_numpy(), bounds.value)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sketch, pa.int64()), pa.array(place, pa.int32())], names=["doc_id", "place", "ids", "sketch", "range"])

    return documents.mapInArrow(run, ROUTED).repartitionById(ranges, "range").sortWithinPartitions("sketch", "place")


def shards(parts, shard_bytes: int):
    """Runs of a range's sorted documents with about ``shard_bytes`` of ids, one at a time, as (doc_id, ids) lists."""
    keys, ids, total = [], [], 0
    for part in parts:
        for key, raw in zip(part.column("doc_id").to_pylist(), part.column("ids").to_pylist()):
            if ids and total + len(raw) > shard_bytes:
                yield keys, ids
                keys, ids, total = [], [], 0
            keys.append(key)
            ids.append(raw)
            total += len(raw)
    if ids:
        yield keys, ids


class Index:
    """BM25 over the documents of one shard: postings by token, in numpy.

    All tokens of a seed count; common ones are scored for all seeds at once by a
    matrix product, which makes no difference but for speed.
    """

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean_tokens: float):
        n, size = len(ids), len(idf)
        length = np.array([len(i) for i in ids], np.int64)
        keys = np.sort(_keys(length, np.concatenate([*ids, np.zeros(0, np.uint16)]), size))
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        tf = np.diff(np.r_[first, len(keys)])
        doc, token = (x.astype(np.int64) for x in divmod(keys[first], keys.dtype.type(size)))
        weight = idf[token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / max(mean_tokens, 1e-9)))
        order = np.argsort(token, kind="stable")
        self._docs, self._weights = doc[order], weight[order]
        shared = np.bincount(token, minlength=size)
        self._cuts = np.r_[0, np.cumsum(shared)]
        self._n, self._token = n, token
        most = min(np.count_nonzero(shared * DENSE > n), CELLS // n) if 0 < n <= AT_ONCE else 0
        common = np.argsort(-shared, kind="stable")[:most]
        self._row = np.full(size, -1, np.int32)
        self._row[common] = np.arange(most)
        self._row[shared <= 1] = -2  # a token of one document finds nothing
        row = self._row[token]
        matrix = np.zeros((most, n))
        matrix[row[row >= 0], doc[row >= 0]] = weight[row >= 0]
        self._scores = (matrix > 0).T.astype(float) @ matrix if most else None
        self._of = np.searchsorted(doc, np.arange(n + 1))

    def ranked(self, seed: int) -> np.ndarray:
        """Documents that share tokens with the seed, best first, ties by their order in the shard."""
        tokens = self._token[self._of[seed] : self._of[seed + 1]]
        row = self._row[tokens]
        score = np.zeros(self._n) if self._scores is None else self._scores[seed]
        spans = [slice(self._cuts[t], self._cuts[t + 1]) for t in tokens[row == -1].tolist()]
        if spans:
            score = score + np.bincount(np.concatenate([self._docs[s] for s in spans]), np.concatenate([self._weights[s] for s in spans]), self._n)
        found = np.flatnonzero(score)
        # Equal documents tie, whatever the order in which their weights were summed.
        return found[np.argsort(-np.round(score[found], 9), kind="stable")]


def fill(lengths: list[int], ranked, window: int):
    """(document, start, length, sequence, offset) of every piece, in order."""
    used, nxt, sequence, offset = bytearray(len(lengths)), 0, 0, 0
    total, left = sum(lengths), None
    queue: list[int] | None = None
    seen = 0

    def room() -> int:
        """Length of the window that opens now: full, or a power of two at the end."""
        rest = total - seen
        return window if rest >= window else 1 << (rest.bit_length() - 1) if rest else 0

    size = room()
    while seen < total:
        if left is None:  # the next document: the best unused neighbour of the seed, or the next unused
            doc = None
            while queue:
                if not used[d := queue.pop()]:
                    doc = d
                    break
            if doc is None:
                while used[nxt]:
                    nxt += 1
                doc, queue = nxt, None
            used[doc] = 1
            left = (doc, 0)
        doc, start = left
        take = min(lengths[doc] - start, size - offset)
        if take:
            yield doc, start, take, sequence, offset
        seen, offset = seen + take, offset + take
        left = (doc, start + take) if start + take < lengths[doc] else None
        if offset == size:
            sequence, offset, size, queue = sequence + 1, 0, room(), None
        elif queue is None:
            queue = ranked(doc)[::-1].tolist()


def pack(docs: DataFrame, tokenizer: str, end_id: int, scratch: Scratch, window: int = 1024, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
    size = max(vocabulary_size(tokenizer), end_id + 1)
    kind = _width(size)
    table = scratch.save(tokenised(docs, tokenizer, end_id, size), "tokens")
    df, n, tokens = statistics(table.where("df is not null").select("df", "documents", "tokens"), size)
    idf, mean_tokens = np.log1p((n - df + 0.5) / (df + 0.5)), tokens / max(n, 1)
    ranges = max(1, min(-(-(tokens + n) // shard_tokens), tasks(table), RANGES))
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(parts):
        at = TaskContext.get().partitionId()
        for number, (keys, raw) in enumerate(shards(parts, shard_tokens * np.dtype(kind).itemsize)):
            ids = [np.frombuffer(r, kind) for r in raw]
            lengths = [len(i) for i in ids]
            index = Index([i[:-1] for i in ids], shared.value, mean_tokens)
            first = (at << 46) + (number << 24)
            pieces = ((keys[d], s, m, zlib.crc32(ids[d][s : s + m].astype("<u4").tobytes()), lengths[d], first + q, o) for d, s, m, q, o in fill(lengths, index.ranked, window))
            yield from batches(schema, pieces, 8192)

    documents = table.where("ids is not null").select("doc_id", "place", "ids")
    return routes(documents, kind, rankings(df, idf), n, ranges).select("doc_id", "ids").mapInArrow(run, SCHEMA)
