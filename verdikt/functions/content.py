"""Column functions over file contents and names.

Everything but ``is_text`` is built-in expressions, so filters and projections
stay inside generated code. Contents are read as ISO-8859-1 where text
functions are needed: each byte is one character, and none is lost.
"""

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

ARCHIVES = ("zip", "gzip", "bzip2", "xz", "tar")
EXECUTABLES = ("pe", "elf", "macho")
#: Containers that only another engine could open.
SEALED = ("7z", "rar", "cab", "iso")
#: Every file type.
FILE_TYPES = (*EXECUTABLES, "ole", "zip", "gzip", "bzip2", "xz", "7z", "rar", "cab", "lnk", "rtf", "image", "tar", "iso", "pdf", "text", "unknown")
#: Bytes that decide whether a content is text.
SAMPLE = 8192


def latin1(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def ascii_lower(text: Column) -> Column:
    """A to Z only; no other character changes and lengths stay."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _starts(content: Column, *magics: str) -> Column:
    """Whether the content starts with one of the hex strings."""
    found = [F.substring(content, 1, len(m) // 2) == F.lit(bytes.fromhex(m)) for m in magics]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


_CONTROL = bytes(c for c in range(0x20) if c not in (9, 10, 12, 13, 27))


def looks_like_text(sample: bytes, whole: bool) -> bool:
    """The sample's share of broken UTF-8 and control characters is under a twentieth."""
    if not sample:
        return False
    if sample[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return True
    if 0 in sample:
        return False
    try:
        sample.decode()
        return 20 * (len(sample) - len(sample.translate(None, _CONTROL))) < len(sample)
    except UnicodeDecodeError:
        text = sample.decode("utf-8", "surrogateescape")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    broken = (codes >= 0xDC80) & (codes <= 0xDCFF)
    if not whole:  # what is broken within the last three bytes may be a character that the sample cuts off
        ends = np.cumsum((1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))[::-1] * ~broken[::-1] + broken[::-1])[::-1]
        cut = np.flatnonzero(broken & (ends < 4))
        if len(cut):
            codes, broken = codes[: cut[0]], broken[: cut[0]]
    control = (codes < 0x20) & ~np.isin(codes, (9, 10, 12, 13, 27))
    return int((broken | control).sum()) * 20 < len(sample)


def _text_flags(samples: pa.Array, wholes: pa.Array) -> pa.Array:
    return pa.array((s.is_valid and looks_like_text(s.as_py(), bool(w.as_py())) for s, w in zip(samples, wholes)), pa.bool_())


def is_text(content: Column) -> Column:
    """Sampled from the first bytes; contents that need no look send none of theirs to Python."""
    return F.arrow_udf(_text_flags, BooleanType())(F.substring(content, 1, SAMPLE), F.octet_length(content) <= SAMPLE)


# First bytes of file types, in the order of the tests.
MAGICS = (
    ("pe", ("4d5a",)),
    ("elf", ("7f454c46",)),
    ("macho", ("feedface", "feedfacf", "cefaedfe", "cffaedfe", "cafebabe")),
    ("ole", ("d0cf11e0a1b11ae1",)),
    ("zip", ("504b0304", "504b0506")),
    ("gzip", ("1f8b08",)),
    ("bzip2", ("425a68",)),
    ("xz", ("fd377a585a00",)),
    ("7z", ("377abcaf271c",)),
    ("rar", ("526172211a07",)),
    ("cab", ("4d53434600000000",)),
    ("lnk", ("4c00000001140200",)),
    ("rtf", ("7b5c7274",)),
    ("image", ("89504e470d0a1a0a", "ffd8ff", "47494638")),
)


def magic_type(content: Column) -> Column:
    """The file type by its magic bytes, tests in a fixed order; null where none fits."""
    n = F.octet_length(content)
    fat = (F.substring(content, 5, 3) == F.lit(b"\0\0\0")) & F.substring(content, 8, 1).between(F.lit(b"\x01"), F.lit(b"\x13")) & (n >= 8)
    further = {"macho": ~_starts(content, "cafebabe") | fat, "bzip2": F.substring(content, 4, 1).between(F.lit(b"1"), F.lit(b"9"))}
    out = F
    for kind, magics in MAGICS:
        out = out.when(_starts(content, *magics) & further.get(kind, F.lit(True)), kind)
    return (
        out.when((n > 262) & (F.substring(content, 258, 5) == F.lit(b"ustar")), "tar")
        .when((n > 0x8006) & (F.substring(content, 0x8002, 5) == F.lit(b"CD001")), "iso")
        .when(F.substring(content, 1, 1024).contains(F.lit(b"%PDF-")), "pdf")
    )


def container(data: bytes) -> str | None:
    """The type of a content that may hold others (an archive or pdf), as ``magic_type`` has it; None for all other types."""
    for kind, magics in MAGICS:
        if any(data.startswith(bytes.fromhex(m)) for m in magics):
            if kind == "macho" and data[:4] == b"\xca\xfe\xba\xbe" and not (len(data) >= 8 and data[4:7] == b"\0\0\0" and 1 <= data[7] <= 0x13):
                continue
            if kind == "bzip2" and data[3:4] not in [b"%d" % i for i in range(1, 10)]:
                continue
            return kind if kind in ARCHIVES else None
    if len(data) > 262 and data[257:262] == b"ustar":
        return "tar"
    if len(data) > 0x8006 and data[0x8001:0x8006] == b"CD001":
        return None
    return "pdf" if b"%PDF-" in data[:1024] else None


def file_type(content: Column) -> Column:
    """One of FILE_TYPES; only contents without a magic are tested for text."""
    magic = magic_type(content)
    text = is_text(F.when(magic.isNull(), content))
    return F.coalesce(magic, F.when(text, "text"), F.lit("unknown"))


def is_archive(kind: Column) -> Column:
    return kind.isin(*ARCHIVES)


def is_executable(kind: Column) -> Column:
    return kind.isin(*EXECUTABLES)


def base_name(path: Column) -> Column:
    """The last element of a path: '.' for an empty one, '/' for slashes alone."""
    last = F.regexp_extract(F.regexp_replace(path, "/+$", ""), "[^/]*$", 0)
    return F.when(path == "", ".").when(last == "", "/").otherwise(last)


def upload_name(name: Column) -> Column:
    base = base_name(F.replace(name, F.lit("\\"), F.lit("/")))
    return F.when(base.isin(".", "/"), "upload").otherwise(base)


def unsafe_path(name: Column) -> Column:
    """Whether extraction would leave its folder."""
    plain = F.replace(name, F.lit("\\"), F.lit("/"))
    return plain.startswith("/") | F.concat(F.lit("/"), plain, F.lit("/")).contains("/../")


def inner_name(base: Column, *suffixes: str) -> Column:
    """Name of the one member of a compressed stream called ``base``."""
    low = F.lower(base)
    out = F.when(base.isin("", ".", "/"), "data").otherwise(F.concat(base, F.lit(".decompressed")))
    for s in reversed(suffixes):
        stem = F.left(base, F.char_length(base) - len(s))
        out = F.when(low.endswith(s), F.concat(stem, F.lit(".tar")) if s.startswith(".t") and len(s) > 3 else stem).otherwise(out)
    return out


def expansion_ratio(out: Column, into: Column) -> Column:
    return F.floor(out / F.greatest(into, F.lit(1))).cast("long")


def entropy(counts: Column) -> Column:
    """Shannon entropy, in bits, of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)
    return F.when(total == 0, 0.0).otherwise(F.aggregate(counts, F.lit(0.0), lambda a, c: a - F.when(c > 0, c / total * F.log2(c / total)).otherwise(0.0)))


def byte_entropy(data: bytes) -> float:
    if not data:
        return 0.0
    p = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = p[p > 0] / len(data)
    return float(-(p * np.log2(p)).sum())


def _bits(values: pa.Array) -> pa.Array:
    return pa.array((byte_entropy(v.as_py()) for v in values), pa.float64())


def content_entropy(content: Column) -> Column:
    """Shannon entropy of a content's bytes, in bits; contents must not be null."""
    return F.arrow_udf(_bits, DoubleType())(content)


def hashes(content: Column) -> dict[str, Column]:
    return {"sha256": F.sha2(content, 256), "md5": F.md5(content), "size": F.octet_length(content).cast("long")}


def test_file_marker() -> str:
    """The anti-malware test string, put together so that this file isn't taken for it."""
    return "X5O!P%@AP[4\\PZX54(P^)7CC)7}$" + "EICAR-STANDARD-ANTIVIRUS-" + "TEST-FILE!$H+H*"


def is_test_file(content: Column) -> Column:
    return (F.octet_length(content) <= 4096) & content.contains(F.lit(test_file_marker().encode()))


def is_encrypted_office(content: Column) -> Column:
    return _starts(content, "d0cf11e0a1b11ae1") & content.contains(F.lit("EncryptedPackage".encode("utf-16-le")))
