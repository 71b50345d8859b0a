"""Sinks. Moves and removals are plans until they are applied here, on purpose; both return what they did."""

from __future__ import annotations

import hashlib
import os
import shutil
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CACHE = "size long, mtime_ns long, path string, md5_hex string, last_used double"


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def move(plan: DataFrame, success: str, failed: str) -> DataFrame:
    """plan (path, folder, name): moves each file; dst, error. A file that has gone where it should is left there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, folder, name in zip(b["path"], b["folder"], b["name"]):
                dst, error = Path(success if folder == "success" else failed) / name, None
                try:
                    dst.parent.mkdir(parents=True, exist_ok=True)
                    if os.path.exists(path):
                        shutil.move(path, dst)
                    elif not dst.exists():
                        error = "missing"
                except OSError as e:
                    error = f"move_failed: {e.strerror}"
                rows.append((path, str(dst), error))
            yield pd.DataFrame(rows, columns=["path", "dst", "error"])

    return plan.select("path", "folder", "name").mapInPandas(run, "path string, dst string, error string")


def remove(plan: DataFrame, trash: str | None = None) -> DataFrame:
    """plan (path, size): path, reclaimed, error. trash: a folder to which files go instead, under a name that no other has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, size in zip(b["path"], b["size"]):
                try:
                    if trash is None:
                        os.unlink(path)
                    else:
                        os.stat(path)
                        os.makedirs(trash, exist_ok=True)
                        shutil.move(path, os.path.join(trash, hashlib.md5(path.encode()).hexdigest()[:12] + "_" + os.path.basename(path)))
                    rows.append((path, int(size), None))
                except OSError as e:
                    rows.append((path, 0, e.strerror))
            yield pd.DataFrame(rows, columns=["path", "reclaimed", "error"])

    return plan.select("path", "size").mapInPandas(run, "path string, reclaimed long, error string")


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """The digest cache (size, mtime_ns, path, md5_hex, last_used) of a folder; empty if there is none yet."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], CACHE)


def save_cache(cache: DataFrame, path: str) -> None:
    """Replaces the cache of a folder, which cache may be read from: written beside it first, then put in its place."""
    spark = cache.sparkSession
    cache.select(*[c.split()[0] for c in CACHE.split(", ")]).write.mode("overwrite").parquet(path + "-new")
    spark.read.schema(CACHE).parquet(path + "-new").write.mode("overwrite").parquet(path)
