"""Command line: lists the registered queries, or runs one and writes its result.

    python -m gridloom list
    python -m gridloom run household_metrics --input /data/sf0.1 --output /out/metrics
    python -m gridloom run household_metrics --input /data/sf0.1 --check-only
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from gridloom import catalog


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="gridloom", description="Runs registered queries over Parquet tables.")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries, and whether SQL tells the same")
    run = commands.add_parser("run", help="run one query")
    run.add_argument("query", choices=sorted(catalog.queries()), metavar="QUERY")
    run.add_argument("--input", required=True, help="folder of the Parquet tables, by any scheme that Spark reads")
    run.add_argument("--output", help="place of the result")
    run.add_argument("--format", choices=("parquet", "csv", "json"), default="parquet")
    run.add_argument("--overwrite", action="store_true", help="replace what is at the output")
    run.add_argument("--check-only", action="store_true", help="plan the query and print its schema; read and write no rows")
    found = parser.parse_args(argv)
    if found.command == "run" and not found.check_only and not found.output:
        parser.error("run needs --output or --check-only")
    return found


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs in the given session, else in one that it makes from the settings of spark-submit."""
    args = arguments(argv)
    if args.command == "list":
        told = catalog.oracle_sql()
        for name in sorted(catalog.queries()):
            print(name if name in told else f"{name} (no SQL)")
        return 0
    own = spark is None
    spark = spark or SparkSession.builder.appName(f"gridloom {args.query}").getOrCreate()
    try:
        df = catalog.queries()[args.query](spark, args.input)
        if args.check_only:
            for column, kind in df.dtypes:
                print(f"{column} {kind}")
        else:
            writer = df.write.mode("overwrite" if args.overwrite else "errorifexists").format(args.format)
            (writer.option("header", True) if args.format == "csv" else writer).save(args.output)
    finally:
        if own:
            spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
