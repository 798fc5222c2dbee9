import hashlib
import shutil

import pytest

from verdikt.config import Feed
from verdikt.sources.signature_store import Store
from verdikt.streaming import shards


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_shards_are_folded_once(spark, tmp_path, monkeypatch):
    """New shards come on each run; a run that dies after a fold, and is run again, leaves every shard there once."""
    web, store = tmp_path / "web", Store(spark, str(tmp_path / "db"))
    web.mkdir()
    feed = Feed("shards", "text", "append", url=f"file://{web}/s-%05d")
    write = lambda i, *keys: (web / f"s-{i:05d}").write_text("# note\n" + "\r\n".join(md5(k) for k in keys) + "\n")
    rows = lambda: sorted((r["hash"], r["source"]) for r in store.read("base").collect())
    run = lambda: shards.fold_shards(spark, store, feed, ["shards"], str(tmp_path / "checkpoint")).awaitTermination()
    expected = lambda *keys: sorted((md5(k), "shards") for k in keys)
    write(0, "a", "b")
    write(1, "b", "c")
    write(3, "later")
    run()
    assert rows() == expected("a", "b", "c")
    run()
    assert rows() == expected("a", "b", "c")
    write(2, "d")
    fold, calls = shards.folded, []

    def dies(*args):
        fold(*args)
        calls.append(1)
        raise RuntimeError("killed after the fold")

    monkeypatch.setattr(shards, "folded", dies)
    with pytest.raises(Exception, match="killed after the fold"):
        run()
    assert calls and rows() == expected("a", "b", "c", "d", "later")
    monkeypatch.setattr(shards, "folded", fold)
    run()
    assert rows() == expected("a", "b", "c", "d", "later")
    write(4, "e")
    run()
    assert rows() == expected("a", "b", "c", "d", "later", "e")
    shutil.rmtree(web)


def test_offsets_and_partitions(tmp_path):
    for i in range(5):
        (tmp_path / f"{i}").write_text(f"{i}\n")
    reader = shards.ShardReader("f", f"file://{tmp_path}/%d", 0, 2, 5)
    assert reader.initialOffset() == {"shard": 0}
    assert [reader.latestOffset()["shard"] for _ in range(4)] == [2, 4, 5, 5]
    parts = reader.partitions({"shard": 1}, {"shard": 4})
    assert [p.value for p in parts] == [1, 2, 3]
    assert [b.to_pydict() for b in reader.read(parts[1])] == [{"source": ["f"], "shard": [2], "line": ["2"]}]
    with pytest.raises(ValueError):
        shards.Shards({"source": "f", "url": "http://x/"}).streamReader(None)
