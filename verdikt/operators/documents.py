"""Macros and PDF streams: small readers for the tasks of ``dissect``."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

VBA_PROJECT = "_VBA_PROJECT".encode("utf-16-le")
#: Bounds: modules of an object, bytes of a module; bytes of all and of one PDF stream, streams.
MODULES, MODULE_BYTES = 256, 4 << 20
STREAM_BYTES, ONE_STREAM, STREAMS = 64 << 20, 32 << 20, 4096
#: Bytes that a stream is inflated by, so that what comes before damage is kept.
STEP = 256
_NAME = re.compile(rb"/[A-Za-z0-9]*#[0-9A-Fa-f]{2}[A-Za-z0-9#]*")
_ESCAPE = re.compile(rb"#([0-9A-Fa-f]{2})")
#: The first line of a module's source, as its compressed container begins.
_MODULE = re.compile(rb"(?<=\x01..)\0Attribut", re.DOTALL)
#: Magic bytes of streams that are objects of their own.
OBJECT_MAGIC = (b"MZ", b"\x7fELF", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"PK\x03\x04", b"PK\x05\x06", b"{\\rt", b"\xfe\xed\xfa\xce", b"\xfe\xed\xfa\xcf", b"\xce\xfa\xed\xfe", b"\xcf\xfa\xed\xfe")


def _chunks(container: bytes) -> Iterator[tuple[bool, bytes]]:
    """(compressed, data) of a container's chunks (MS-OVBA 2.4.1.1.4), up to the first whose signature is wrong."""
    at = 1
    while at + 2 <= len(container):
        (header,) = struct.unpack_from("<H", container, at)
        if header >> 12 & 7 != 3:
            return
        packed = bool(header & 0x8000)
        size = (header & 0xFFF) + 1 if packed else 4096
        yield packed, container[at + 2 : at + 2 + size]
        at += 2 + size


def _expanded(chunk: bytes) -> tuple[bytes, bool]:
    """(text of a compressed chunk, whether all of it made sense): literals, and copies of what the chunk gave before."""
    out, left = bytearray(), memoryview(chunk)
    while len(left):
        flags, left = left[0], left[1:]
        for bit in range(8):
            if flags >> bit & 1 == 0:
                out += left[:1]
                left = left[1:]
                continue
            if len(left) < 2:
                return bytes(out), True
            token, left = int.from_bytes(left[:2], "little"), left[2:]
            # The more there is to copy from, the more bits say from where and the fewer how much.
            low = 16 - min(12, max(4, (len(out) - 1).bit_length()))
            back, length = (token >> low) + 1, (token & (1 << low) - 1) + 3
            if back > len(out):
                return bytes(out), False
            window = bytes(out[-back:])
            out += (window * (length // back + 1))[:length]
    return bytes(out), True


def decompressed(container: bytes, limit: int) -> bytes | None:
    """The source in a compressed VBA container, as far as it is sound; None where there is none."""
    if container[:1] != b"\1":
        return None
    out = bytearray()
    for packed, data in _chunks(container):
        text, sound = _expanded(data) if packed else (data, True)
        out += text
        if not sound or len(out) >= limit:
            break
    return bytes(out) or None


def modules(data: bytes) -> tuple[list[str], bool]:
    """(sources of the VBA modules anywhere in the data, whether all of them were read)."""
    starts = [m.start() - 3 for m in islice(_MODULE.finditer(data), MODULES + 1)]
    texts = [text for at in starts[:MODULES] if (text := decompressed(data[at : at + 2 * MODULE_BYTES], MODULE_BYTES)) and text.startswith(b"Attribut")]
    return [text.decode("latin-1") for text in texts], len(starts) <= MODULES and all(len(text) < MODULE_BYTES for text in texts)


def plain_names(data: bytes) -> tuple[bytes, bool]:
    """The PDF with #xx escapes in names undone, and whether there were any."""
    changed = False

    def undo(match: re.Match[bytes]) -> bytes:
        nonlocal changed
        changed = True
        return _ESCAPE.sub(lambda e: bytes([int(e[1], 16)]), match[0])

    return _NAME.sub(undo, data), changed


def _bodies(data: bytes) -> Iterator[bytes]:
    """What stands between the keywords stream, with its line end, and endstream."""
    for piece in data.split(b"endstream")[:-1]:
        _, keyword, body = piece.partition(b"stream")
        if keyword:
            yield body.removeprefix(b"\r").removeprefix(b"\n")


def _inflated(body: bytes, limit: int) -> bytes:
    """At most ``limit`` bytes of a deflated stream; of a damaged one, what comes before the damage."""
    reader, out = zlib.decompressobj(), bytearray()
    try:
        for at in range(0, len(body), STEP):
            out += reader.decompress(body[at : at + STEP], limit - len(out))
            if len(out) >= limit or reader.eof:
                break
    except zlib.error:
        pass
    return bytes(out)


def streams(data: bytes) -> tuple[list[bytes], bool]:
    """(the PDF's inflated streams, whether all of them were read)."""
    out, left = [], STREAM_BYTES
    for body in _bodies(data):
        if left <= 0 or len(out) >= STREAMS:
            return out, False
        if plain := _inflated(body, min(left, ONE_STREAM)):
            out.append(plain)
            left -= len(plain)
    return out, True
