"""Command line: ``python -m facetql -d events=/data/events.parquet:ts "from events 1d today group by event_type"``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import results
from .errors import QueryError
from .lang import ast
from .service import Engine


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="facetql", description="Run a statement over Parquet datasets.")
    parser.add_argument("-d", "--dataset", action="append", default=[], metavar="NAME=PATH[:TIME]", help="a dataset and its time column")
    parser.add_argument("-f", "--format", choices=("tsv", "csv", "events"), default="tsv")
    parser.add_argument("--dimensions", action="append", default=[], metavar="NAME=FILE", help="a metric file of a dataset")
    parser.add_argument("query")
    own = parser.parse_args(args)
    spark = SparkSession.builder.appName("facetql").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    engine = Engine(spark)
    for text in own.dataset:
        name, _, path = text.partition("=")
        path, colon, time = path.rpartition(":") if ":" in path.rsplit("/", 1)[-1] else (path, "", "")
        engine.register(name, spark.read.parquet(path), time=time or None)
    for text in own.dimensions:
        name, _, path = text.partition("=")
        for warning in engine.catalog.find(name).read_dimensions(path):
            print(warning, file=sys.stderr)
    try:
        if isinstance(engine.parse(own.query), ast.Select):
            sys.stdout.writelines(engine.stream(own.query, own.format))
        else:
            sys.stdout.writelines(results.tsv(engine.query(own.query)))
    except QueryError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
