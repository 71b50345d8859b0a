"""python -m folioscan PATH [--json] [--strict N] [--filename]: rows of a file, or of all files below a folder."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession

from folioscan.options import Options
from folioscan.plans import extract
from folioscan.sources import sinks


def rows(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    from pyspark.sql import functions as F

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(os.path.abspath(args.path))
    files = found.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
    return extract.everything(files, Options(strict=args.strict), by_name=args.filename)


def parsed(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser("folioscan")
    p.add_argument("path")
    p.add_argument("--json", action="store_true")
    p.add_argument("--strict", type=int, default=3)
    p.add_argument("--filename", action="store_true")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = parsed(argv)
    spark = SparkSession.builder.getOrCreate()
    out = rows(spark, args)
    if args.json:
        for r in sinks.as_json(out).toLocalIterator():
            print(r.value)
    else:
        out.show(1000, truncate=False)


if __name__ == "__main__":
    main()
