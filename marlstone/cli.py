"""A thin command line: index a folder or bring an index up to date, step by step or at once; search it, summarise it, keep hints, list operators.

Exit codes: 2 for bad arguments and searches without results, 3 for a missing index.
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession

from marlstone.operators import fts, hints, units
from marlstone.plans.library import Library
from marlstone.plans.registry import default_registry
from marlstone.sources import files


def session() -> SparkSession:
    return SparkSession.builder.appName("marlstone").getOrCreate()


def index(spark: SparkSession, root: str, target: str, most: int = 2000) -> dict:
    """Handles, Markdown, chunks and the term index of a folder, written below target, or brought up to date there."""
    Library(spark, target).update(root, most=most)
    return {t: spark.read.parquet(f"{target}/{t}").count() for t in ("files", "derivatives", "chunks")}


def search(spark: SparkSession, target: str, query: str, limit: int = 10) -> list[dict]:
    hits = fts.search(fts.read_index(spark, f"{target}/index"), query, limit)
    rows = hits.join(spark.read.parquet(f"{target}/chunks").select("chunk_id", "path", "content"), "chunk_id").orderBy("score", "chunk_id")
    return [{"chunk_id": r.chunk_id, "path": r.path, "score": r.score, "content": r.content[:2000]} for r in rows.collect()]


def summary(spark: SparkSession, target: str) -> list[dict]:
    return [r.asDict() for r in Library(spark, target).summary().orderBy("what", "value").collect()]


def hint(spark: SparkSession, target: str, action: str, value: str, at: str) -> list[dict]:
    """Add a hint, delete the one of an id, clear all, or list the active ones."""
    library = Library(spark, target)
    log = library.read("hints", hints.SCHEMA)
    if action != "list":
        new = hints.add(log, value, at) if action == "add" else hints.delete(log, int(value), at) if action == "delete" else hints.clear(log, at)
        log = library.replace("hints", new)
    return [r.asDict() for r in log.filter("status = 'active'").orderBy("id").collect()]


def shown_units(path: str) -> list[dict]:
    """The units of one file, as they are parsed."""
    content = Path(path).read_text(encoding="utf-8", errors="replace")
    found = units.python_units(content, path) if path.endswith(".py") else units._fallback(content, path)
    return [{"unit_id": r[0], "kind": r[3], "start_line": r[4], "end_line": r[5]} for r in found]


def doctor() -> dict[str, str]:
    """Versions of what the library runs on."""
    return {m: __import__(m).__version__ for m in ("pyspark", "pyarrow", "numpy")} | {"python": sys.version.split()[0]}


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("marlstone")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, extra in (("index", ["root"]), ("search", ["query"]), ("summary", [])):
        p = commands.add_parser(name)
        p.add_argument("target")
        for x in extra:
            p.add_argument(x)
        if name == "search":
            p.add_argument("--limit", type=int, default=10)
    steps = commands.add_parser("sync")
    steps.add_argument("step", choices=["sources", "extract", "materialize", "summary", "run"])
    steps.add_argument("target")
    steps.add_argument("root", nargs="?")
    notes = commands.add_parser("hints")
    notes.add_argument("action", choices=["add", "list", "delete", "clear"])
    notes.add_argument("target")
    notes.add_argument("value", nargs="?", default="")
    commands.add_parser("units").add_argument("path")
    commands.add_parser("cleanup").add_argument("target")
    commands.add_parser("doctor")
    tools = commands.add_parser("tools")
    tools.add_argument("name", nargs="?")
    tools.add_argument("arguments", nargs="?", default="{}")
    got = parser.parse_args(arguments)
    if got.command == "tools":
        registry = default_registry("extensions")
        print(json.dumps(registry.call(got.name, got.arguments) if got.name else registry.names()))
        return 0
    if got.command in ("doctor", "units"):
        print(json.dumps(doctor() if got.command == "doctor" else shown_units(got.path)))
        return 0
    spark = session()
    if got.command == "sync":
        library = Library(spark, got.target)
        if got.step in ("sources", "run") and not got.root:
            parser.error(f"sync {got.step} needs a root")
        done = {"sources": lambda: library.sources(got.root), "extract": library.extract, "materialize": library.materialize, "run": lambda: library.update(got.root), "summary": lambda: summary(spark, got.target)}[got.step]()
        print(json.dumps(done))
        return 0
    if got.command == "hints":
        print(json.dumps(hint(spark, got.target, got.action, got.value, datetime.now(timezone.utc).isoformat(timespec="seconds"))))
        return 0
    if got.command == "cleanup":
        Library(spark, got.target).cleanup()
        return 0
    if got.command == "index":
        print(json.dumps(index(spark, got.root, got.target)))
        return 0
    if files.load_table(spark, f"{got.target}/chunks", "chunk_id string").isEmpty():
        print("there is no index", file=sys.stderr)
        return 3
    rows = search(spark, got.target, got.query, got.limit) if got.command == "search" else summary(spark, got.target)
    print(json.dumps(rows, ensure_ascii=False))
    return 0 if rows else 2


if __name__ == "__main__":
    sys.exit(main())
