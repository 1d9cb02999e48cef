"""Command line: list the registered queries, run one to a folder, or explain its plan."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans import catalogue
from .session import ship


def session(name: str = "roadsift") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="roadsift", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    for name in ("run", "explain"):
        p = sub.add_parser(name)
        p.add_argument("query")
        p.add_argument("data")
        if name == "run":
            p.add_argument("out")
            p.add_argument("--format", default="parquet", choices=("parquet", "csv", "json", "orc"))
    a = parser.parse_args(args)
    found = catalogue.queries()
    if a.command == "list":
        print("\n".join(sorted(found)))
        return 0
    if a.query not in found:
        print(f"unknown query {a.query}", file=sys.stderr)
        return 2
    spark = session()
    ship(spark)
    df = found[a.query](spark, a.data)
    if a.command == "explain":
        df.explain("formatted")
    else:
        df.write.mode("overwrite").format(a.format).option("header", True).save(a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
