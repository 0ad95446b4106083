"""Command line: ``python -m chronofold list``, ``verify DIR`` (the ledger), ``status DIR`` (the projections), ``query NAME DIR [OUT]`` (Parquet, or JSON lines on the console).

``verify`` ends with 1 if a stream fails.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from chronofold.plans import catalog


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="chronofold")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    for name in ("verify", "status"):
        sub.add_parser(name).add_argument("folder")
    query = sub.add_parser("query")
    query.add_argument("name", choices=sorted(catalog.QUERIES))
    query.add_argument("folder")
    query.add_argument("out", nargs="?")
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    spark = spark or SparkSession.builder.appName("chronofold").getOrCreate()
    name = {"verify": "ledger_verify", "status": "projection_status"}.get(args.command) or args.name
    result = catalog.QUERIES[name](spark, args.folder)
    if args.command == "query" and args.out:
        result.write.parquet(args.out)
        return 0
    failed = False
    for line in result.toJSON().toLocalIterator():
        failed = True
        print(line)
    return int(failed and args.command == "verify")


if __name__ == "__main__":
    sys.exit(main())
