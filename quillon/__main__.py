"""Command line: python -m quillon index | search | suggest | stats."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from quillon.plans.engine import Searcher
from quillon.plans.index import Index
from quillon.session import ship
from quillon.sources.corpora import read_json_lines


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quillon")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="index a file or folder of JSON lines")
    index.add_argument("--input", "-i", required=True)
    index.add_argument("--output", "-o", default="corpus.idx")
    search, suggest, stats = (commands.add_parser(name) for name in ("search", "suggest", "stats"))
    for command in (search, suggest, stats):
        command.add_argument("--index", "-i", required=True)
    for command in (search, suggest):
        command.add_argument("--k", "-k", type=lambda x: max(1, min(1000, int(x))), default=10)
    search.add_argument("--query", "-q", required=True)
    search.add_argument("--fuzzy", "-f", type=int, default=0)
    search.add_argument("--mode", choices=("auto", "regex", "substring", "fuzzy"), default="auto")
    suggest.add_argument("--prefix", "-p", required=True)
    suggest.add_argument("--fuzzy", action="store_true")
    suggest.add_argument("--max-dist", type=int, default=2)
    return parser


def main(arguments: list[str] | None = None) -> int:
    asked = _arguments().parse_args(arguments)
    spark = SparkSession.builder.appName("quillon").getOrCreate()
    ship(spark)
    try:
        if asked.command == "index":
            with Searcher(Index.build(read_json_lines(spark, asked.input).select("ord", "ext_id", "title", "text"), asked.output)) as built:
                print(json.dumps(built.stats()))
            return 0
        with Searcher(Index.load(spark, asked.index), straddling=True) as opened:
            if asked.command == "search":
                print(opened.search_json(asked.query, asked.k, asked.mode, asked.fuzzy))
            elif asked.command == "suggest":
                print(opened.suggest_json(asked.prefix, asked.k, asked.fuzzy, asked.max_dist))
            else:
                print(json.dumps(opened.stats()))
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
