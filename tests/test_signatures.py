import hashlib
import json
import os
import re
import struct

import pytest

from verdikt.config import Config, Feed, load, seconds
from verdikt.operators import refresh as U
from verdikt.operators import signatures as S
from verdikt.sources.feeds import list_lines
from verdikt.sources.packed import Packed, Records, read_packed, write_packed
from verdikt.sources.signature_store import Store, replace_file


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def test_parse_lines(spark):
    lines = ["# " + sha("a"), f'"{sha("")}"', f"2024,{md5('b')},{sha('b')}", "junk", f" {md5('c').upper()} x", sha("d")[:63] + "g"]
    rows = spark.createDataFrame([("feed", x) for x in lines], "source string, line string")
    assert {(r["algo"], r["hash"]) for r in S.parse(rows).collect()} == {("sha256", sha("b")), ("md5", md5("c"))}


def test_packed_file(spark, tmp_path):
    rows = [("sha256", sha(str(i)), i % 2, f"feed{i % 2}") for i in range(500)] + [("md5", md5(str(i)), 1, "feed1") for i in range(300)]
    path = str(tmp_path / "db.bin")
    assert write_packed(spark.createDataFrame(rows, "algo string, hash string, src_idx int, source string"), path, created=7) == {"sha256": 500, "md5": 300}
    assert Packed(path).created == 7
    assert sorted(map(tuple, read_packed(spark, path, per_task=77).collect())) == sorted(rows)
    old = b"FGHDB\0\0\1" + struct.pack("<qHH", 0, 1, 1) + b"s" + struct.pack("<Q", 1) + bytes.fromhex(sha("a")) + b"\5"
    (tmp_path / "v1").write_bytes(old)
    assert [tuple(r) for r in read_packed(spark, str(tmp_path / "v1")).collect()] == [("sha256", sha("a"), 5, "unknown")]
    for bad in (b"", b"garbage" * 10, old[:-1]):
        (tmp_path / "bad").write_bytes(bad)
        with pytest.raises(ValueError):
            Packed(str(tmp_path / "bad"))


def test_local_list(spark, tmp_path):
    (tmp_path / "a.txt").write_text(f"# note\n{sha('x')} First Name\n{md5('y')}\nnothex\n")
    (tmp_path / "b.txt").write_text(f"{sha('x').upper()}   Later\n")
    (tmp_path / "c.lst").write_text(sha("z"))
    got = {(r["algo"], r["hash"], r["name"]) for r in S.local_entries(list_lines(spark, str(tmp_path))).collect()}
    assert got == {("sha256", sha("x"), "Later"), ("md5", md5("y"), "a")}
    assert S.local_entries(list_lines(spark, str(tmp_path / "none"))).count() == 0


def test_update_lifecycle(spark, tmp_path):
    web, folder = tmp_path / "web", tmp_path / "db"
    web.mkdir()

    def feed(name, refresh, *hashes, **more):
        (web / name).write_text("\n".join(hashes))
        return Feed(name, "text", refresh, url=f"file://{web / name}", **more)

    full = feed("full", "full", sha("1"), sha("2"), md5("3"))
    recent = feed("recent", "incremental", sha("4"), sha("2"))
    shards = Feed("shards", "text", "append", url=f"file://{web}/shard-%d")
    (web / "shard-0").write_text(md5("5"))
    config = Config(feeds=(full, recent, shards))
    store = Store(spark, str(folder))
    now = 1_000_000.0
    assert U.due(store, U.load_state(str(folder)), config, now)
    report = U.update(spark, store, config, now=now)
    assert report.full and {(r["hash"], r["source"]) for r in store.read("base").collect()} == {(sha("1"), "full"), (sha("2"), "full"), (md5("3"), "full"), (sha("4"), "recent"), (md5("5"), "shards")}
    assert not U.update(spark, store, config, now=now + 10).changed  # nothing new anywhere
    (web / "recent").write_text("\n".join([sha("4"), sha("6")]))
    (web / "shard-1").write_text(md5("7"))
    report = U.update(spark, store, config, now=now + 20)
    assert report.changed and not report.full and {r["hash"] for r in store.read("delta").collect()} == {sha("6"), md5("7")}
    # A full refresh replaces a full feed's rows, keeps those of one that failed and of incremental feeds.
    (web / "full").write_text(sha("9"))
    U.update(spark, store, config, force=True, now=now + 30)
    assert {r["hash"] for r in store.read("base").collect()} == {sha("9"), sha("4"), sha("6"), md5("5"), md5("7")} and store.read("delta").count() == 0
    os.rename(web / "full", web / "gone")
    report = U.update(spark, store, config, force=True, now=now + 40)
    assert "NotFound" in report.feeds["full"] and sha("9") in {r["hash"] for r in store.read("base").collect()}
    # A disabled source's rows go.
    U.update(spark, store, Config(feeds=(full._replace(enabled=False), recent, shards)), force=True, now=now + 50)
    assert {r["source"] for r in store.read("base").collect()} == {"recent", "shards"}
    os.rename(web / "recent", web / "gone2")
    with pytest.raises(RuntimeError):
        U.update(spark, store, Config(feeds=(full, recent)), force=True, now=now + 60)
    assert U.load_state(str(folder))["last_error"]
    assert store.point_lookup("base", sha("4")).count() == 1
    assert {r["source"]: r["n"] for r in U.status(store).groupBy("source").sum("n").withColumnRenamed("sum(n)", "n").collect()} == {"recent": 2, "shards": 2}


def test_zip_feeds(spark, tmp_path):
    """Members' lines, piece by piece; a zip without any hash is an error of its feed and leaves its old rows."""
    import zipfile

    def write(*lines):
        with zipfile.ZipFile(tmp_path / "z", "w") as z:
            z.writestr("folder/", "")
            for i, text in enumerate(lines):
                z.writestr(f"{i}.csv", text)

    config = Config(feeds=(Feed("z", "zip", "full", url=f"file://{tmp_path / 'z'}"),))
    store = Store(spark, str(tmp_path / "db"))
    write("# note\n" + sha("1"), f'"x","{md5("2")}"\r\n')
    assert store.created() == 0
    U.update(spark, store, config, now=1e6)
    assert {r["hash"] for r in store.read("base").collect()} == {sha("1"), md5("2")} and store.created() > 0
    write("# " + sha("3"), "nothing")
    with pytest.raises(RuntimeError):
        U.update(spark, store, config, force=True, now=2e6)
    assert {r["hash"] for r in store.read("base").collect()} == {sha("1"), md5("2")}
    summary = S.set_summary(store.read("base"), store.read("delta")).first()
    assert (summary["n"], summary["sources"]) == (2, ["z"])


def test_readiness():
    config, state = Config(), {"last_error": "", "last_attempt": 0.0, "last_update": 0.0}
    ask = lambda n=1, age=0, locked=False, **s: U.readiness(config, n, 1000.0 - age, locked, state | s, 1000.0).state
    assert ask(0) == "need_update" and ask() == "ready" and ask(age=90_000) == "need_update" and ask(0, locked=True) == "updating"
    assert ask(0, last_error="x", last_attempt=900.0) == "error" and ask(0, last_error="x", last_attempt=100.0) == "need_update"
    assert U.readiness(Config(require_signatures=False), 0, 0, False, state, 1e9).state == "ready"


def test_config(tmp_path):
    assert seconds("1h30m") == 5400 and seconds(15) == 15 and seconds("500ms") == 0.5
    assert load(tmp_path / "none") == Config() and Config(threshold=0).threshold == 100
    (tmp_path / "c.json").write_text(json.dumps({"threshold": 50, "max_signature_age": "2h", "feeds": [{"name": "f", "refresh": "incremental"}]}))
    config = load(tmp_path / "c.json")
    assert config.max_signature_age == 7200 and config.enabled_sources == ["f"]
    for bad in ({"unscannable": "x"}, {"clamav": "maybe"}, {"nope": 1}, {"feeds": [{"name": "f", "refresh": "append", "url": "u"}]}):
        (tmp_path / "c.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            load(tmp_path / "c.json")


def written_out(rows, sources, created):
    """A packed file of version 2 by its description."""
    out = b"FGHDB\0\0\2" + struct.pack("<qH", created, len(sources)) + b"".join(struct.pack("<H", len(s)) + s.encode() for s in sources)
    kinds = [sorted((bytes.fromhex(h), sources.index(s)) for a, h, _, s in rows if a == algo) for algo in ("sha256", "md5")]
    return out + struct.pack("<QQ", *map(len, kinds)) + b"".join(h + bytes([p]) for k in kinds for h, p in k)


def test_packed_file_is_written_by_tasks(spark, tmp_path, monkeypatch):
    """Byte for byte what its description says, from many tasks, with no row on the driver; mode of a replaced file stays."""
    import pyspark.sql.classic.dataframe as frames

    rows = [("sha256", sha(str(i)), i % 3, f"s{i % 3}") for i in range(400)] + [("md5", md5(str(i)), 1, "s1") for i in range(250)]
    df = spark.createDataFrame(rows, "algo string, hash string, src_idx int, source string").repartition(7)
    path = str(tmp_path / "p")
    (tmp_path / "p").write_bytes(b"old")
    os.chmod(path, 0o640)
    monkeypatch.setattr(frames.DataFrame, "toLocalIterator", None)
    assert write_packed(df, path, created=9) == {"sha256": 400, "md5": 250}
    assert (tmp_path / "p").read_bytes() == written_out(rows, ["s0", "s1", "s2"], 9)
    assert os.stat(path).st_mode & 0o777 == 0o640 and os.listdir(tmp_path) == ["p"]
    assert write_packed(df.limit(0), str(tmp_path / "e"), created=9) == {} and read_packed(spark, str(tmp_path / "e")).count() == 0
    with pytest.raises(Exception, match="one row a hash"):
        write_packed(df.unionByName(df.limit(1)), path)
    assert (tmp_path / "p").read_bytes() == written_out(rows, ["s0", "s1", "s2"], 9) and sorted(os.listdir(tmp_path)) == ["e", "p"]
    replace_file(path, b"new")
    assert os.stat(path).st_mode & 0o777 == 0o640


def test_packed_lookups_are_pushed_down(spark, tmp_path):
    rows = [("sha256", sha(str(i)), 0, "s") for i in range(5000)] + [("md5", md5(str(i)), 0, "s") for i in range(3000)]
    path = str(tmp_path / "p")
    write_packed(spark.createDataFrame(rows, "algo string, hash string, src_idx int, source string"), path)
    table = read_packed(spark, path)
    asked = [sha("17"), md5("2999"), sha("none"), "not a hash", md5("0").upper()]
    found = table.where(table.hash.isin(asked))
    assert sorted(r["hash"] for r in found.collect()) == sorted([sha("17"), md5("2999")])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter ", plan) and found.rdd.getNumPartitions() == 2
    assert [tuple(r) for r in table.where(table.hash == sha("4")).collect()] == [("sha256", sha("4"), 0, "s")]
    assert table.where(table.hash == sha("nothing")).count() == 0 and table.where("algo = 'md5'").count() == 3000
    assert table.where("algo = 'md5' and source = 's' and hash > 'f'").count() == sum(md5(str(i)) > "f" for i in range(3000))
    file = Packed(path)
    with open(path, "rb") as f:
        for algo, keys in (("sha256", [sha(str(i)) for i in range(300)]), ("md5", [md5(str(i)) for i in range(300)])):
            records = Records(f, *file.table(algo))
            assert all(records.find(bytes.fromhex(k)) == 0 for k in keys) and records.find(b"\0" * 8) is None and records.find(b"\xff" * 40) is None
            assert records.reads <= 302 * 13  # of 5,000 records 13 halvings at most


def test_lookups_do_not_shuffle_the_table(spark, tmp_path):
    """Tiers are bucketed on disk: a look-up shuffles hashes that are asked for, not the table's, and base wins over delta."""
    store = Store(spark, str(tmp_path))
    table = lambda rows: spark.createDataFrame(rows, "algo string, hash string, src_idx int, source string")
    base = [("sha256", sha(str(i)), 0, "b") for i in range(3000)] + [("md5", md5(str(i)), 0, "b") for i in range(100)]
    store.write({"base": table(base), "delta": table([("sha256", sha("new"), 1, "d"), ("sha256", sha("5"), 1, "d")])})
    rows = [(0, sha("5"), md5("x"), 1), (1, sha("none"), md5("7"), 1), (2, sha("new"), md5("none"), 1), (3, sha("zz"), md5("zz"), 1), (4, sha("6"), md5("6"), 0), (5, None, None, 1)]
    objects = spark.createDataFrame(rows, "i int, sha256 string, md5 string, size long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = S.looked_up(objects, store.tiers(), None, spark.createDataFrame([("sha256", sha("new"), "ok")], "algo string, hash string, name string"))
        assert {r["i"]: (r["allowed"], r["hit"]) for r in found.collect()} == {0: (False, "Malware.SHA256.b"), 1: (False, "Malware.MD5.b"), 2: (True, None), 3: (False, None), 4: (False, None), 5: (False, None)}
        assert "Bucketed: true" in found._jdf.queryExecution().executedPlan().toString()
        shuffled = exchanges_over(found._jdf.queryExecution().executedPlan().initialPlan(), "base-")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled == 0
    # The snapshot is the same rows in another session, where no table is known yet.
    again = Store(spark.newSession(), str(tmp_path))
    assert sorted(map(tuple, again.read("base").collect())) == sorted(base) and again.point_lookup("base", sha("9")).count() == 1


def exchanges_over(node, name):
    """Shuffles that stand between a join and a scan of the table."""
    if node.nodeName() == "Exchange":
        return int(any(name in line for line in node.toString().splitlines()) and "Join" not in node.toString())
    children = node.children()
    return sum(exchanges_over(children.apply(i), name) for i in range(children.size()))


def test_replaced_snapshots_go_when_no_reader_is_left(spark, tmp_path):
    """A reader with a lease finishes during two refreshes; then the files go. Without one they stay for the grace time."""
    store = Store(spark, str(tmp_path / "db"))
    table = lambda *keys: spark.createDataFrame([("sha256", sha(k), 0, "s") for k in keys], "algo string, hash string, src_idx int, source string")
    snapshots = lambda: {n for n in os.listdir(tmp_path / "db") if n.startswith(("base-", "delta-"))}
    store.write({"base": table("1", "2"), "delta": table("3")})
    first = snapshots()
    with store.lease() as (base, delta):
        store.write({"base": table("4"), "delta": None})
        second = snapshots() - first
        store.write({"base": table("5")})
        assert store.vacuum() == [] and store.vacuum(grace=0) == sorted(second)
        assert snapshots() & first == first and not snapshots() & second
        assert {r["hash"] for r in base.unionByName(delta).collect()} == {sha("1"), sha("2"), sha("3")}
    assert set(store.vacuum(grace=0)) == first and len(snapshots()) == 1 and store.vacuum(grace=0) == []
    assert [r["hash"] for r in store.read("base").collect()] == [sha("5")]
    with store.lease(seconds=-1):  # a process that died in its block
        store.write({"base": table("6")})
        assert len(store.vacuum(grace=0)) == 1
    assert not any(n.startswith("lease-") for n in os.listdir(tmp_path / "db"))
