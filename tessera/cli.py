"""Commands over a knowledge base: python -m tessera.cli ROOT COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tessera.api import PaperBase


def year_range(text: str) -> tuple[int, int]:
    """2015-2025 or 2020."""
    low, _, high = text.partition("-")
    return int(low), int(high or low)


COMMANDS = {
    "scan": (["folder"], lambda b, a: b.scan_folder(a.folder)),
    "ingest": (["folder"], lambda b, a: b.ingest_folder(a.folder)),
    "sync": (["folder"], lambda b, a: b.ingest_folder(a.folder)),
    "search": (["query"], lambda b, a: b.search(a.query, a.limit, years=year_range(a.year) if a.year else None, excluded=[(None, x) for x in a.exclude], explain=a.explain)),
    "context": (["query"], lambda b, a: b.retrieve_context(a.query, a.budget)),
    "get": (["key"], lambda b, a: b.get_paper(a.key)),
    "inspect": (["key"], lambda b, a: b.describe_paper(a.key)),
    "markdown": (["key"], lambda b, a: b.get_markdown(a.key)),
    "equations": (["id"], lambda b, a: b.get_equations(int(a.id))),
    "methods": (["query"], lambda b, a: b.find_methods(a.query, a.limit)),
    "method": (["id"], lambda b, a: b.get_methods(int(a.id))),
    "tags": ([], lambda b, a: b.list_tags()),
    "aliases": (["name"], lambda b, a: b.get_tag_aliases(a.name)),
    "related": (["id"], lambda b, a: b.get_related(int(a.id), a.limit)),
    "topic": (["name", "query"], lambda b, a: b.build_topic(a.name, a.query, a.limit)),
    "compare": (["ids", "axes"], lambda b, a: b.compare_methods([int(x) for x in a.ids.split(",")], a.axes.split(","))),
    "export": ([], lambda b, a: b.get_bibtex()),
    "missing": (["field"], lambda b, a: b.find_missing(a.field)),
    "runs": ([], lambda b, a: b.processing_status()),
    "status": ([], lambda b, a: b.status()),
    "check": ([], lambda b, a: b.tables.violations()),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None):
    parser = argparse.ArgumentParser(prog="tessera")
    parser.add_argument("root")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (positional, _) in COMMANDS.items():
        p = commands.add_parser(name)
        for x in positional:
            p.add_argument(x)
        p.add_argument("--limit", type=int, default=10)
        p.add_argument("--budget", type=int, default=24_000)
        p.add_argument("--year")
        p.add_argument("--exclude", action="append", default=[])
        p.add_argument("--explain", action="store_true")
    args = parser.parse_args(argv)
    base = PaperBase(spark or SparkSession.builder.appName("tessera").getOrCreate(), args.root)
    rows = COMMANDS[args.command][1](base, args)
    rows.show(args.limit, truncate=80)
    return rows


if __name__ == "__main__":
    main()
