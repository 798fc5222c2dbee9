"""An antivirus daemon as a further engine: contents are streamed to it from the tasks.

The daemon speaks a line protocol over a socket: a command, then the content in
pieces that begin with their length, then a length of zero. What it could not
look at (too large, beyond its limits, encrypted) is a problem, not a clean
result; and so is a daemon that cannot be reached.
"""

from __future__ import annotations

import socket
import struct

import pyarrow as pa
from pyspark.sql import DataFrame

ENGINE = "clamav"
PIECE = 32 << 10
TOO_LARGE = "ClamAV rejected the file as too large; raise StreamMaxLength, MaxFileSize and MaxScanSize in clamd.conf"


def connected(address: str, timeout: float) -> socket.socket:
    """A socket to a path, or to host:port."""
    if address.startswith("/"):
        link = socket.socket(socket.AF_UNIX, socket.SOCK_STREAM)
        link.settimeout(timeout)
        link.connect(address)
        return link
    host, _, port = address.rpartition(":")
    return socket.create_connection((host, int(port)), timeout)


def pieces(content: bytes | None, file: str | None = None):
    """A content, or that of a file too large to hold, bit by bit."""
    if content is not None:
        for at in range(0, len(content), PIECE):
            yield content[at : at + PIECE]
    elif file is not None:
        with open(file, "rb") as f:
            while piece := f.read(PIECE):
                yield piece


def asked(address: str, command: bytes, content: bytes | None = None, timeout: float = 60, file: str | None = None) -> str:
    """The daemon's reply; it may come before all of the content was taken."""
    with connected(address, timeout) as link:
        try:
            link.sendall(b"z" + command + b"\0")
            if content is not None or file is not None:
                for piece in pieces(content, file):
                    link.sendall(struct.pack(">I", len(piece)) + piece)
                link.sendall(b"\0\0\0\0")
        except (BrokenPipeError, ConnectionResetError):
            pass
        reply = b""
        while not reply.endswith(b"\0") and (more := link.recv(4096)):
            reply += more
    return reply.rstrip(b"\0\n").decode("utf-8", "replace")


def ping(address: str, timeout: float = 5) -> None:
    """Returns where the daemon answers; ValueError for another reply, OSError where there is none."""
    if (reply := asked(address, b"PING", timeout=timeout)) != "PONG":
        raise ValueError(f"unexpected PING reply {reply!r}")


def version(address: str, timeout: float = 5) -> str:
    """Engine and database version; ValueError where the daemon does not tell."""
    reply = asked(address, b"VERSION", timeout=timeout)
    if not reply.startswith("ClamAV"):
        raise ValueError(f"clamd: {reply}")
    return reply


def described(mode: str, address: str) -> str:
    """The daemon's state for a status report: disabled, its version, or why it does not answer."""
    if mode == "off":
        return "disabled"
    try:
        return f"{address}, {version(address)}"
    except (OSError, ValueError) as e:
        why = e
    try:
        ping(address)
        return f"{address}, version unknown"
    except (OSError, ValueError):
        return f"{address or 'no address'} cannot be reached: {why}"


def outcome(reply: str) -> tuple[str | None, str | None]:
    """(signature, problem) of a reply: both are None for a clean content."""
    text = reply.partition(": ")[2] or reply
    if text.endswith(" FOUND"):
        name = text[: -len(" FOUND")]
        if name.startswith("Heuristics.Limits.Exceeded"):
            return None, f"ClamAV could not scan all content ({name}); raise MaxFileSize, MaxScanSize and MaxRecursion in clamd.conf"
        if name.startswith("Heuristics.Encrypted"):
            return None, f"ClamAV found encrypted content it cannot inspect ({name})"
        return name, None
    if text == "OK":
        return None, None
    return None, TOO_LARGE if "size limit exceeded" in text else f"ClamAV: {text or 'no reply'}"


def scanned(objects: DataFrame, address: str, timeout: float = 60) -> DataFrame:
    """(file_id, ord, round, signature, problem) of objects with content, or with a ``file`` that holds it."""
    schema = pa.schema([("file_id", pa.int64()), ("ord", pa.list_(pa.int32())), ("round", pa.int32()), ("signature", pa.string()), ("problem", pa.string())])

    def run(parts):
        for part in parts:
            for i in range(part.num_rows):
                file_id, ord_, round_, content, file = (part.column(c)[i].as_py() for c in ("file_id", "ord", "round", "content", "file"))
                try:
                    signature, problem = outcome(asked(address, b"INSTREAM", content, timeout, file))
                except (OSError, ValueError) as e:
                    signature, problem = None, f"ClamAV at {address or 'no address'} cannot be reached: {e}"
                yield pa.RecordBatch.from_pylist([{"file_id": file_id, "ord": ord_, "round": round_, "signature": signature, "problem": problem}], schema=schema)

    return objects.select("file_id", "ord", "round", "content", "file").mapInArrow(run, "file_id long, ord array<int>, round int, signature string, problem string")
