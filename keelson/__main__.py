"""Command line: contract text to SQL, SQL to contract text, a live catalog to contract text."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .model import ContractError
from .sinks.ddl import DIALECTS, export_sql
from .sinks.json import export_json
from .sinks.language import export_language
from .sources import ddl
from .sources.project import FolderLayout, compile_project


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="keelson")
    commands = parser.add_subparsers(dest="command", required=True)
    to_sql = commands.add_parser("to-sql", help="contract text to SQL or JSON")
    to_sql.add_argument("files", nargs="+")
    to_sql.add_argument("--to", choices=[*DIALECTS, "json"], default="postgres")
    from_sql = commands.add_parser("from-sql", help="SQL DDL to contract text")
    from_sql.add_argument("files", nargs="+")
    from_sql.add_argument("--from", dest="dialect", choices=ddl.DIALECTS, default="postgres")
    live = commands.add_parser("from-database", help="a live catalog to contract text")
    live.add_argument("dialect")
    live.add_argument("connection")
    for p in (to_sql, from_sql, live):
        p.add_argument("-o", "--out", help="file to write instead of the console")
    args = parser.parse_args(argv)
    try:
        if args.command == "to-sql":
            parts = []
            for f in map(Path, args.files):
                db = compile_project(FolderLayout(f.parent), f.name).result()
                parts.append(export_json(db) if args.to == "json" else export_sql(db, args.to))
        elif args.command == "from-sql":
            parts = [export_language(ddl.import_sql(Path(f).read_text(), args.dialect).result()) for f in args.files]
        else:
            from pyspark.sql import SparkSession

            from .sources.introspect import read_catalog, to_model

            parts = [export_language(to_model(read_catalog(SparkSession.builder.getOrCreate(), args.connection, args.dialect)))]
    except (ContractError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    text = "\n".join(parts)
    if args.out:
        Path(args.out).write_text(text)
    else:
        print(text, end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
