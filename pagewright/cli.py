"""Command line over the facade: convert layout tables, translate EPUB files, run queries, check outputs, list smoke matrices."""

from __future__ import annotations

import argparse
import json
from importlib import import_module
from pathlib import Path

from pagewright import runs
from pagewright.api import Conversion
from pagewright.functions import markup
from pagewright.plans import registry
from pagewright.session import drop_stored, local_session
from pagewright.sources.epub import translate_epubs


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pagewright", description=__doc__)
    todo = parser.add_subparsers(dest="command", required=True)
    convert = todo.add_parser("convert", help="layout rows in Parquet to Markdown or EPUB, one row per book")
    convert.add_argument("layouts")
    convert.add_argument("output")
    convert.add_argument("--to", choices=("markdown", "epub"), default="markdown")
    query = todo.add_parser("query", help="run a query over a folder of tables")
    query.add_argument("name")
    query.add_argument("tables")
    query.add_argument("output")
    todo.add_parser("list", help="names of all queries")
    check = todo.add_parser("check", help="faults of a Markdown, EPUB or PDF file; exit status 1 if there are any")
    check.add_argument("file", type=Path)
    smoke = todo.add_parser("smoke", help="runs of a matrix in JSON, listed, or reported below a folder without running them")
    smoke.add_argument("matrix", type=Path)
    smoke.add_argument("--folder", type=Path)
    epub = todo.add_parser("translate-epub", help="books under a path, by a function `module:name` that makes a translator of lists of texts")
    epub.add_argument("books")
    epub.add_argument("output")
    epub.add_argument("--by", required=True)
    epub.add_argument("--mode", choices=(markup.REPLACE, markup.APPEND_TEXT, markup.APPEND_BLOCK), default=markup.REPLACE)
    epub.add_argument("--language")
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(registry.QUERIES))
        return 0
    if args.command == "check":
        kind, data = args.file.suffix.lower(), args.file.read_bytes()
        found = runs.epub_faults(data) if kind == ".epub" else runs.pdf_faults(data) if kind == ".pdf" else runs.markdown_faults(data.decode(), [str(p.relative_to(args.file.parent)) for p in args.file.parent.rglob("*")])
        print("\n".join(found))
        return int(bool(found))
    if args.command == "smoke":
        cells = runs.expand(json.loads(args.matrix.read_text()))
        routes = {c.route: lambda run, folder: [] for c in cells}
        print("\n".join(f"{c.asset} {c.route} {c.backend}".strip() for c in cells))
        if args.folder:
            runs.smoke(cells, routes, args.folder, dry=True)
        return 0
    spark = local_session()
    if args.command == "translate-epub":
        module, _, name = args.by.partition(":")
        make = getattr(import_module(module), name)
        translate_epubs(spark, args.books, make, args.mode, args.language).write.parquet(args.output)
        return 0
    if args.command == "query":
        if args.name not in registry.QUERIES:
            parser.error(f"no query {args.name}")
        registry.QUERIES[args.name](spark, args.tables).write.parquet(args.output)
    else:
        made = Conversion(spark.read.parquet(args.layouts))
        (made.markdown() if args.to == "markdown" else made.epub()).write.parquet(args.output)
        drop_stored(spark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
