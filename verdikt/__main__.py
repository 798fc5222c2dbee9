"""Command line: python -m verdikt scan | update | status | config | version.

Exit codes of ``scan``: 0 nothing found, 1 malicious files, 2 files that could
not be judged, 3 the signature table isn't ready.
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys
import time

from pyspark.sql import SparkSession

from verdikt.config import Config, config_path, data_folder, load
from verdikt.operators import clamd, refresh
from verdikt.operators import signatures as S
from verdikt.operators.scan import scan
from verdikt.operators.verdict import exit_code, result_json, result_text, results
from verdikt.sources.feeds import list_lines
from verdikt.sources.files import read_files, read_stream
from verdikt.sources.scratch import Scratch
from verdikt.sources.signature_store import Store

VERSION = "0.1.0"


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="verdikt")
    parser.add_argument("--config", help="settings; default: $VERDIKT_CONFIG, else the system's or the user's file")
    parser.add_argument("--data", help="folder of the signature table and local lists, shared by all executors; default: the system's or the user's")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("scan")
    one.add_argument("paths", nargs="+", help="files and folders; - is standard input")
    one.add_argument("--name", default="stdin", help="file name to assume for standard input")
    one.add_argument("-v", "--verbose", action="store_true", help="print all detections, issues and warnings")
    one.add_argument("--no-clamav", action="store_true")
    one.add_argument("--json", action="store_true")
    one.add_argument("--quiet", action="store_true", help="print only malicious and failed files")
    one.add_argument("--no-heuristics", action="store_true")
    one.add_argument("--allow-no-signatures", action="store_true")
    one.add_argument("--password")
    commands.add_parser("update").add_argument("--force", action="store_true")
    for name in ("status", "config", "version"):
        commands.add_parser(name)
    return parser.parse_args(argv)


def scan_paths(spark: SparkSession, args: argparse.Namespace, config: Config) -> int:
    store = Store(spark, args.data)
    with store.lease() as known:
        count = sum(tier.count() for tier in known)
        state = refresh.load_state(args.data)
        ready = refresh.readiness(config, count, state["last_update"], refresh.is_locked(args.data), state, time.time())
        if ready.state != "ready":
            print(ready.reason, file=sys.stderr)
            return 3
        scratch = Scratch(spark, "scan")
        files = read_files(spark, [p for p in args.paths if p != "-"], config.max_file_size)
        if "-" in args.paths:
            files = read_stream(spark, sys.stdin.buffer, args.name, config.max_file_size).unionByName(files)
        files = scratch.save(files, "files")
        lists = {name: S.local_entries(list_lines(spark, f"{args.data}/{name}.d")) for name in ("custom", "allow")}
        scanned = scan(files, config, known, lists["custom"], lists["allow"], args.password)
        rows = scratch.save(results(files.drop("content"), scanned, config, count), "results")
        scanned.release()
    shown = rows.where("verdict <> 'safe'") if args.quiet else rows
    column, lines = ("json", result_json(shown)) if args.json else ("line", result_text(shown, args.verbose))
    for row in lines.sort("file_id").toLocalIterator():
        print(row[column])
    return exit_code(rows).first()[0]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _arguments(argv)
    args.config = config_path(args.config)
    args.data = args.data or str(data_folder(args.config))
    config = load(args.config)
    if args.command == "version":
        print(VERSION)
        return 0
    if args.command == "config":
        print(json.dumps(dataclasses.asdict(config), indent=2))
        return 0
    spark = spark or SparkSession.builder.appName("verdikt").getOrCreate()
    if args.command == "update":
        for name, said in refresh.update(spark, Store(spark, args.data), config, args.force).feeds.items():
            print(f"{name}: {said}")
        return 0
    if args.command == "status":
        store = Store(spark, args.data)
        for row in refresh.status(store).sort("source", "algo").collect():
            print(f"{row['source']} {row['algo']} {row['n']}")
        summary = S.set_summary(store.read("base"), store.read("delta")).first()
        made = time.strftime("%Y-%m-%d %H:%M:%S UTC", time.gmtime(store.created())) if store.created() else "never"
        print(f"{summary['n']} signatures of {len(summary['sources'])} sources ({', '.join(summary['sources'])}), made {made}")
        print(f"antivirus daemon: {clamd.described(config.clamav, config.clamav_address)}")
        return 0
    changes = {"clamav": "off"} if args.no_clamav else {}
    changes |= {"heuristics": config.heuristics and not args.no_heuristics, "require_signatures": config.require_signatures and not args.allow_no_signatures}
    return scan_paths(spark, args, dataclasses.replace(config, **changes))


if __name__ == "__main__":
    sys.exit(main())
