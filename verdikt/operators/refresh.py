"""Refreshing the signature table, and whether a scan may go ahead.

``update`` decides between a full and an incremental refresh, downloads the
feeds that are due, and puts new snapshots in force. Feeds fail one by one: the
old rows of a feed that failed stay. The state is a small JSON file.
"""

from __future__ import annotations

import fcntl
import json
import os
import tempfile
import time
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from verdikt.config import Config, Feed
from verdikt.operators import signatures as S
from verdikt.sources import feeds as sources
from verdikt.sources.signature_store import Store, replace_file

#: Seconds for which a failed attempt is reported as an error.
FAILURE_WINDOW = 600


def load_state(folder: str) -> dict:
    try:
        with open(f"{folder}/state.json") as f:
            state = json.load(f)
    except (OSError, ValueError):
        state = {}
    return {"last_attempt": 0.0, "last_update": 0.0, "last_full": 0.0, "last_error": "", "feeds": {}} | state


def save_state(folder: str, state: dict) -> None:
    replace_file(f"{folder}/state.json", json.dumps(state, indent=2).encode())


@contextmanager
def locked(folder: str):
    """Holds the update lock; BlockingIOError where another process does."""
    with open(f"{folder}/.update.lock", "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        yield


def is_locked(folder: str) -> bool:
    try:
        with locked(folder):
            return False
    except BlockingIOError:
        return True


def due(store: Store, state: dict, config: Config, now: float) -> bool:
    return not store.exists("base") or now - state["last_attempt"] >= config.update_interval


def wants_full(store: Store, state: dict, config: Config, now: float, force: bool) -> bool:
    return force or not store.exists("base") or now - state["last_full"] >= config.full_refresh_interval


class Report(NamedTuple):
    full: bool
    changed: bool
    feeds: dict[str, str]  # name -> "ok", "not modified", "skipped", or what went wrong


def _shards(feed: Feed, state: dict, folder: str) -> tuple[list[str], str]:
    """New shards of an append feed, up to the first that isn't there yet."""
    paths, at = [], state["feeds"].setdefault(feed.name, {}).get("next_shard", 0)
    while True:
        try:
            paths.append(sources.fetch(feed, folder, at)[0])
        except sources.NotFound:
            return paths, "ok"
        except Exception as e:  # this feed's failure only
            return paths, f"{type(e).__name__}: {e}"
        at += 1
        state["feeds"][feed.name]["next_shard"] = at


def update(spark: SparkSession, store: Store, config: Config, force: bool = False, now: float | None = None) -> Report:
    """One refresh; RuntimeError where every feed failed, which changes nothing but the state."""
    now = time.time() if now is None else now
    with locked(store.folder), tempfile.TemporaryDirectory(prefix="landing-", dir=store.folder) as landing:
        state = load_state(store.folder)
        full = wants_full(store, state, config, now, force)
        if not store.exists("base"):
            for kept in state["feeds"].values():
                kept["next_shard"] = 0
        state["last_attempt"] = now
        landed: dict[str, list[str]] = {}
        said: dict[str, str] = {}
        for feed in (f for f in config.feeds if f.enabled):
            kept = state["feeds"].setdefault(feed.name, {})
            if feed.refresh == "append":
                landed[feed.name], said[feed.name] = _shards(feed, state, landing)
            elif feed.refresh == "full" and not full:
                said[feed.name] = "skipped"
            else:
                condition = {} if full else {"etag": kept.get("etag", ""), "modified": kept.get("modified", "")}
                try:
                    path, kept["etag"], kept["modified"] = sources.fetch(feed, landing, **condition)
                    landed[feed.name], said[feed.name] = [path], "ok"
                except sources.NotModified:
                    said[feed.name] = "not modified"
                except Exception as e:  # this feed's failure only
                    said[feed.name] = f"{type(e).__name__}: {e}"
        plain = [f for f in config.feeds if f.enabled and f.refresh != "append" and said[f.name] != "skipped"]
        good = [f.name for f in plain if said[f.name] in ("ok", "not modified")]
        if (full or plain) and not good and not (not full and any(landed.values())):
            state["last_error"] = "all signature feeds failed"
            save_state(store.folder, state)
            raise RuntimeError(state["last_error"])
        fetched = S.parse(sources.lines(spark, landed))
        base, delta, enabled = store.read("base"), store.read("delta"), config.enabled_sources
        if full:
            replaced = [f.name for f in plain if f.refresh == "full" and f.name in good]
            store.write({"base": S.full_refresh(fetched, base, delta, enabled, replaced), "delta": None})
            changed = True
            if all(f.name in good for f in plain if f.refresh == "full"):
                state["last_full"] = now
        else:
            new = fetched.join(base.select("algo", "hash"), ["algo", "hash"], "left_anti")
            changed = bool(new.head(1))
            if changed:
                store.write({"delta": S.incremental_refresh(fetched, base, delta, enabled)})
        store.vacuum()
        failed = [f"{n}: {s}" for n, s in said.items() if s not in ("ok", "not modified", "skipped")]
        state |= {"last_update": now, "last_error": "; ".join(failed)}
        save_state(store.folder, state)
        return Report(full, changed, said)


class Readiness(NamedTuple):
    state: str  # ready, need_update, updating or error
    reason: str = ""


def readiness(config: Config, signatures: int, last_refresh: float, locked_now: bool, state: dict, now: float) -> Readiness:
    """Whether a scan may use the table: it must be there and young enough, if one is required."""
    if not config.require_signatures:
        return Readiness("ready")
    if signatures == 0:
        reason = "signature database is not downloaded yet"
    elif 0 < config.max_signature_age < now - last_refresh:
        reason = f"signature database is older than {config.max_signature_age:g} seconds"
    else:
        return Readiness("ready")
    if locked_now:
        return Readiness("updating", f"{reason}; an update is in progress")
    if state["last_error"] and state["last_attempt"] > state["last_update"] and now - state["last_attempt"] < FAILURE_WINDOW:
        return Readiness("error", f"{reason} and the last update attempt failed: {state['last_error']}")
    return Readiness("need_update", f"{reason}; an update is needed")


def status(store: Store) -> DataFrame:
    """(source, algo, n) of the tables in force."""
    return S.set_counts(store.read("base"), store.read("delta"))
