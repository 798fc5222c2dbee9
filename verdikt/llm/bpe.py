"""Byte-level BPE: encoding with a local rank file or tokenizer file, and decoding.

``UnitEncoder`` cuts texts at boundaries that no pre-token crosses, so what the
library gets at once is no longer than the longest pre-token, or stretch without
a lone space, of the text. All ids come from the named library. Workers read the
vocabulary file themselves, once each.

Null text counts as empty and has no ids. A text may be very long, in one run of
any character too. Repeated rows, and rows with equal or null ids, each get their
own row; an empty table gives no rows; columns other than doc_id and text (or
ids) are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from verdikt.llm.common import batches, texts
from verdikt.llm.units import UnitEncoder


#: A pattern that takes a whole text for one pre-token.
WHOLE = r"[\s\S]+"
#: Bytes of texts that are encoded at a time, where they are not looked at one by one; a longer text stands alone.
SLICE = 1 << 20
#: Words that the model gets in one string.
TOGETHER = 32


@functools.cache
def rank_encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file: base64 token and rank on each line."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def rank_encoder(path: str, pattern: str) -> UnitEncoder:
    encode = rank_encoding(path, pattern).encode_ordinary
    return UnitEncoder(lambda units: [np.array(encode(u), "<u4") for u in units], lambda piece: np.array(rank_encoding(path, WHOLE).encode_ordinary(piece), "<u4"))


@functools.cache
def file_encoder(path: str) -> UnitEncoder:
    """The encoder of a ``tokenizers`` file; special tokens' strings are ordinary text."""
    encode = file_tokenizer(path).encode_batch_fast
    return UnitEncoder(
        lambda units: [np.array(e.ids, "<u4") for e in encode(list(units), add_special_tokens=False)],
        lambda piece: np.array(file_tokenizer(path, whole=True).encode(piece, add_special_tokens=False).ids, "<u4"),
        encode_word=word_encoder(path),
    )


def word_encoder(path: str) -> Callable[[list[str], str], list[bytes]] | None:
    """Ids of words of letters up to U+00FF, each with a space or line break before it, by the library's model alone.

    That spares the library its normalised strings and offsets. The model gets
    TOGETHER of them in one string: a word's ids begin where a token has the space or
    break, since no token of the vocabulary, and so no merge, has that after letters.
    None where the file's steps before the model are not those of plain
    byte-level BPE, or its vocabulary or model is not such.
    """
    import json

    with open(path, encoding="utf-8") as file:
        steps = json.load(file)
    before, model = steps["pre_tokenizer"] or {}, steps["model"]
    if steps["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or any(t["content"].strip().isalpha() for t in steps["added_tokens"] or ()):
        return None
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    tokenize = file_tokenizer(path).model.tokenize
    # Characters that stand for bytes: the printable ones for themselves, the others, in order, from U+0100 on.
    other = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
    sign = "".join(chr(256 + other.index(b)) if b in other else chr(b) for b in range(256))
    byte, letter = {c: b for b, c in enumerate(sign)}, lambda c: c.isalpha() or c == "\ufffd"
    for token in model["vocab"]:
        text = bytes([byte.get(c, 0xFF) for c in token]).decode(errors="replace")  # a part of a character counts as a letter
        if any(b in " \n" and letter(a) or a == "\n" and letter(b) for a, b in zip(text, text[1:])):
            return None
    opens = np.zeros(max(model["vocab"].values()) + 1, bool)
    opens[[n for t, n in model["vocab"].items() if t[:1] in (sign[32], sign[10])]] = True

    def ids(words: list[str], lead: str) -> list[bytes]:
        found = array("I")
        for at in range(0, len(words), TOGETHER):
            signs = codecs.charmap_decode((lead + lead.join(words[at : at + TOGETHER])).encode(), "strict", sign)[0]
            found.extend([token.id for token in tokenize(signs)])
        raw = found.tobytes()
        cuts = [*(4 * np.flatnonzero(opens[np.frombuffer(raw, "<u4")])).tolist(), len(raw)]
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    return ids


@functools.cache
def file_tokenizer(path: str, whole: bool = False):
    """The tokenizer of a file; ``whole``: it takes each text for one pre-token."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    if whole:
        tokenizer.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
    return tokenizer


def slices(column: pa.Array, rows: int = 256) -> Iterator[tuple[int, list[str]]]:
    """Texts of an Arrow column, a bounded number at a time."""
    for at in range(0, len(column), rows):
        yield at, column.slice(at, rows).to_pylist()


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Each document's ids: doc_id, ids array<int>."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(parts):
        encoder = rank_encoder(path, pattern)
        for part in parts:
            for at, some in slices(part.column("text")):
                keys = part.column("doc_id").slice(at, len(some)).to_pylist()
                yield from batches(schema, ((k, np.frombuffer(i, "<i4")) for k, i in zip(keys, encoder.encode(some))))

    return texts(docs, "doc_id").mapInArrow(run, "doc_id long, ids array<int>")


def _decoded(part: pa.RecordBatch, decode_bytes):
    """(doc_id, bytes) of each row, of which one at a time has its ids as Python numbers: those take ten times the column's bytes."""
    for key, ids in zip(part.column("doc_id"), part.column("ids")):
        yield key.as_py(), decode_bytes(ids.as_py() or [])


def decode(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """Raw bytes of each id list: doc_id, raw binary. Ids need not be valid UTF-8 when decoded."""
    schema = pa.schema([("doc_id", pa.int64()), ("raw", pa.binary())])

    def run(parts):
        encoding = rank_encoding(path, pattern)
        for part in parts:
            yield from batches(schema, _decoded(part, encoding.decode_bytes), 256)

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes, decodes and digests: doc_id, n_tokens, ids_sha256, decoded_sha256, exact.

    ids_sha256 is over the decimal ids joined by one space, decoded_sha256 over
    the decoded bytes; ``exact`` tells whether these equal the text's UTF-8.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("exact", pa.bool_())])

    def run(parts):
        encoding, encoder = rank_encoding(path, pattern), rank_encoder(path, pattern)
        decimal = [str(i) for i in range(encoding.max_token_value + 1)]

        def row(key, text, raw_ids):
            ids = np.frombuffer(raw_ids, "<u4").tolist()
            raw = encoding.decode_bytes(ids)
            joined = " ".join([decimal[i] for i in ids])
            return key, len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(raw).hexdigest(), raw == text.encode()

        for part in parts:
            for at, some in slices(part.column("text")):
                keys = part.column("doc_id").slice(at, len(some)).to_pylist()
                yield from batches(schema, (row(*x) for x in zip(keys, some, encoder.encode(some))))

    return texts(docs, "doc_id").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")
