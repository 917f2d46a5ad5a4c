"""The command line: ``python -m verlog --data DIR COMMAND ...``. Exit codes are those of ``verlog.errors``."""

from __future__ import annotations

import argparse
import json
import sys

from .engine import Store
from .errors import NotFound, StoreError


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="verlog")
    top.add_argument("--data", default="./data")
    top.add_argument("--json", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)
    shapes = {"put": ["key", "value"], "get": ["key"], "delete": ["key"], "scan": ["prefix"], "versions": ["prefix"], "flush": [], "compact": [], "stats": [], "backup": ["out"], "install": ["snapshot"], "watermark": ["ts"]}
    for name, arguments in shapes.items():
        command = commands.add_parser(name)
        for a in arguments:
            command.add_argument(a)
        if name in ("get", "scan"):
            command.add_argument("--at", type=int)
    shapes = {"create": ["name", "prefix"], "list": [], "drop": ["name"], "scan": ["name", "value_prefix"]}
    parts = commands.add_parser("index").add_subparsers(dest="part", required=True)
    for name, arguments in shapes.items():
        command = parts.add_parser(name)
        for a in arguments:
            command.add_argument(a, **({"nargs": "?", "default": ""} if a == "value_prefix" else {}))
        if name == "create":
            command.add_argument("--extractor", nargs="+", default=["whole"])
    return top


def run(store: Store, a: argparse.Namespace):
    """The command's result: rows as a DataFrame, or a plain value."""
    if a.command == "get":
        value = store.get(a.key, a.at)
        if value is None:
            raise NotFound(a.key)
        return value
    if a.command == "index":
        if a.part == "create":
            return store.create_index(a.name, a.prefix, *a.extractor)
        return {"list": store.indexes, "drop": lambda: store.drop_index(a.name), "scan": lambda: store.scan_index(a.name, a.value_prefix)}[a.part]()
    return {
        "put": lambda: store.put(a.key, a.value), "delete": lambda: store.delete(a.key), "scan": lambda: store.scan(a.prefix, a.at).orderBy("key"), "versions": lambda: store.versions(a.prefix),
        "flush": store.flush, "compact": store.compact, "stats": store.stats, "backup": lambda: store.backup(a.out), "install": lambda: store.install(a.snapshot), "watermark": lambda: store.set_watermark(int(a.ts)),
    }[a.command]()


def main(arguments: list[str] | None = None, spark=None) -> int:
    from pyspark.sql import DataFrame, SparkSession

    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("verlog").getOrCreate()
    try:
        out = run(Store(spark, a.data), a)
    except StoreError as e:
        print(json.dumps({"error": type(e).__name__, "message": str(e)}) if a.json else f"{type(e).__name__}: {e}", file=sys.stderr)
        return e.code
    rows = (r.asDict() for r in out.toLocalIterator()) if isinstance(out, DataFrame) else [] if out is None else [out]
    for row in rows:  # as rows come, never all at once
        print(json.dumps(row) if a.json or isinstance(row, dict) else row)
    return 0


if __name__ == "__main__":
    sys.exit(main())
