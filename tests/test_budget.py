"""Archives of a file share a budget that is spent depth first; what is shut frees its share."""

import hashlib
import io
import os
import random
import socketserver
import threading
import zipfile

from pyspark.sql import functions as F
from test_scan import PASSWORD, locked_zip, run, zipped

from verdikt.config import Config
from verdikt.functions.content import container, magic_type
from verdikt.operators import scan as S
from verdikt.plans.samples import MAGICS


def depth_first(path, data, budget, config, shut, depth=0):
    """[(path, size)] of what a reader sees that takes an archive's members one by one and each of them apart before the next."""
    out = [(path, len(data))]
    if hashlib.sha256(data).hexdigest() in shut or data[:2] != b"PK" or depth >= config.max_archive_depth:
        return out
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return out
    for entry in archive.infolist():
        if budget["files"] <= 0 or budget["bytes"] <= 0:
            break
        content = archive.read(entry)[: min(config.max_file_size, budget["bytes"])]
        budget["bytes"] -= len(content)
        budget["files"] -= 1
        out += depth_first(f"{path}!{entry.filename}", content, budget, config, shut, depth + 1)
    return out


def grown(rng, depth, boxes):
    members = []
    for i in range(rng.randint(1, 5)):
        if depth < 4 and rng.random() < 0.55:
            box = grown(rng, depth + 1, boxes)
            boxes.append(box)
            members.append((f"b{i}.zip", box))
        else:
            members.append((f"f{i}", rng.randbytes(rng.randint(0, 900))))
    return zipped(*members)


def test_equal_to_a_depth_first_reader(spark):
    rng = random.Random(12)
    config = Config(max_file_size=20_000, max_total_extract=20_000, max_archive_files=12, max_compress_ratio=10_000)
    files, shut = [], set()
    for i in range(60):
        boxes = []
        files.append((f"f{i}.zip", zipped(*((f"top{k}.zip", grown(rng, 1, boxes)) for k in range(2)))))
        # Known archives inside, of which only some are met before the budget ends.
        shut |= {hashlib.sha256(b).hexdigest() for b in boxes[: rng.choice([0, 2, 5])]}
    spec = "file_id long, name string, content binary"
    rows = spark.createDataFrame([(i, n, bytearray(c)) for i, (n, c) in enumerate(files)], spec)
    known = spark.createDataFrame([("sha256", h, "feed") for h in sorted(shut)], "algo string, hash string, source string")
    scanned = S.scan(rows, config, known)
    got = sorted((r["file_id"], r["path"], r["size"]) for r in scanned.objects.collect())
    full = lambda: {"files": config.max_archive_files, "bytes": config.max_total_extract}
    expected = {i: depth_first(n, c, full(), config, shut) for i, (n, c) in enumerate(files)}
    assert got == sorted((i, *x) for i, rows_ in expected.items() for x in rows_)
    without = {i: depth_first(n, c, full(), config, set()) for i, (n, c) in enumerate(files)}
    assert sum({p for p, _ in expected[i]} - {p for p, _ in without[i]} != set() for i in expected) > 5  # files where a shut archive lets others be seen
    scanned.release()


def test_the_order_decides_which_members_are_kept(spark):
    """The first inner archive takes what the members after it would have had."""
    config = Config(max_archive_files=4)
    first = zipped(*((f"x{i}", b"%d" % i) for i in range(5)))
    got = run(spark, [("a.zip", zipped(("in.zip", first), ("last", b"z"))), ("b.zip", zipped(("last", b"z"), ("in.zip", first)))], config).collect()
    assert [r["objects_scanned"] for r in got] == [5, 5] and [r["verdict"] for r in got] == ["error", "error"]
    assert [n["object"] for n in got[0]["unscannable"]] == ["a.zip", "a.zip!in.zip"] and [n["object"] for n in got[1]["unscannable"]] == ["b.zip!in.zip"]


class Daemon(socketserver.StreamRequestHandler):
    seen: list[bytes] = []

    def handle(self):
        self.rfile.read(10)
        data = b""
        while n := int.from_bytes(self.rfile.read(4), "big"):
            data += self.rfile.read(n)
        Daemon.seen.append(data)
        self.wfile.write(b"stream: " + (b"Fake.Sig FOUND" if b"BADMARK" in data else b"Heuristics.Encrypted.Zip FOUND" if b"SECRET" in data else b"OK") + b"\0")


def test_decrypted_members_go_to_the_daemon(spark, tmp_path):
    """What only the password opens is sent by itself, and what is inside it is covered by that answer, not by the file's."""
    sealed = b"7z\xbc\xaf\x27\x1c" + b"\0" * 64
    stored = io.BytesIO()
    with zipfile.ZipFile(stored, "w", zipfile.ZIP_STORED) as z:
        z.writestr("note", b"SECRET")
        z.writestr("a.7z", sealed)
    files = [("bad.zip", locked_zip(b"x BADMARK x", "classic")), ("in.zip", locked_zip(zipped(("a.7z", sealed)), "classic")), ("no.zip", locked_zip(stored.getvalue(), "classic")), ("plain.zip", zipped(("a.7z", sealed)))]
    config = Config(clamav="required", clamav_address=str(tmp_path / "clamd"))
    Daemon.seen.clear()
    with socketserver.ThreadingUnixStreamServer(config.clamav_address, Daemon) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        got = run(spark, files, config, password=PASSWORD).collect()
        server.shutdown()
    assert (got[0]["verdict"], got[0]["detections"][0]["engine"], got[0]["detections"][0]["object"]) == ("malicious", "clamav", "bad.zip!m.txt")
    assert got[1]["verdict"] == got[3]["verdict"] == "safe" and len(Daemon.seen) == 7
    assert got[2]["verdict"] == "error" and {n["object"] for n in got[2]["unscannable"]} == {"no.zip!m.txt", "no.zip!m.txt!a.7z"}
    auto = run(spark, [("in.zip", files[1][1])], Config(), password=PASSWORD).first()
    assert auto["verdict"] == "error" and "7z containers" in auto["error"]


def joined_columns(node, out):
    """Columns that enter a join, an aggregate or a shuffle of a plan."""
    children = node.children()
    for i in range(children.size()):
        child = children.apply(i)
        if node.nodeName() in ("Join", "Aggregate", "RepartitionByExpression", "Sort", "Window"):
            out |= set(child.output().mkString(",").replace("#", ",").split(","))
        joined_columns(child, out)
    return out


def test_no_step_joins_contents_and_nothing_is_left(spark, monkeypatch):
    met, roots, save = set(), [], S.Scratch.save

    def watched(self, df, name):
        joined_columns(df._jdf.queryExecution().optimizedPlan(), met)
        roots.append(self.root)
        return save(self, df, name)

    monkeypatch.setattr(S.Scratch, "save", watched)
    files = spark.createDataFrame([(0, "a.zip", bytearray(zipped(("x", b"1"), ("in.zip", zipped(("y", b"22"))))))], "file_id long, name string, content binary")
    scanned = S.scan(files, Config(), spark.createDataFrame([("sha256", "0" * 64, "feed")], "algo string, hash string, source string"))
    assert scanned.objects.count() == 4
    assert "ord" in met and "content" not in met
    folder = roots[0].removeprefix("file:")
    assert os.path.isdir(folder)
    scanned.release()
    assert not os.path.exists(folder)


def test_containers_are_those_of_the_type_expression(spark):
    cases = [bytes.fromhex(h) + b"\0" * n for _, h, n in MAGICS] + [b"x" * 257 + b"ustar" + b"\0" * 300, b"MZ" + b"x" * 255 + b"ustar" + b"\0" * 300, b"\0" * 0x8001 + b"CD001" + b"\0" * 9, b"junk %PDF-1.4", b"\xca\xfe\xba\xbe\0\0\0\x34 %PDF-", b"\xca\xfe\xba\xbe\0\0\0\2 %PDF-", b"BZh0 %PDF-", b"x" * 1020 + b"%PDF-"]
    rows = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, content binary")
    kinds = {r["i"]: r["kind"] for r in rows.select("i", magic_type(F.col("content")).alias("kind")).collect()}
    holding = ("zip", "gzip", "bzip2", "xz", "tar", "pdf")
    assert [container(c) for c in cases] == [kinds[i] if kinds[i] in holding else None for i in range(len(cases))]
