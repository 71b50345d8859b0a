"""Files and the members of archives as tables."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions.meta import suffix
from folioscan.functions.naming import kind

MEMBERS = "archive string, ordinal int, name string, size long, encrypted boolean, content binary, error string"


def root(path: str) -> str:
    """A folder's absolute path; it has to be one."""
    p = Path(path).expanduser().resolve()
    if not p.is_dir():
        raise NotADirectoryError(path)
    return str(p)


def scan(spark: SparkSession, path: str, recursive: bool = True, include: tuple[str, ...] = (), exclude_dirs: tuple[str, ...] = (), exclude_paths: tuple[str, ...] = ()) -> DataFrame:
    """path, size, modified (ns), content; content is only read where it is selected, and length is pushed down."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    plain = F.regexp_replace("path", "^file:/*", "/")
    out = files.select(plain.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("modified"), "content")
    if include:
        out = out.where(suffix("path").isin(*[e.lower().lstrip(".") for e in include]))
    for d in exclude_dirs:
        out = out.where(~F.col("path").contains(f"/{d}/"))
    for p in exclude_paths:
        out = out.where(~F.col("path").startswith(p.rstrip("/") + "/"))
    return out


LISTED = "path string, size long, accessed long, modified long, changed long, dev long, ino long, error string"


def listing(spark: SparkSession, path: str, recursive: bool = True, follow_symlinks: bool = False) -> DataFrame:
    """LISTED: the files below a folder with their times (ns), and a row with an error for each that can't be read. Folders
    right below it are walked by tasks of their own, and nothing is opened."""

    def rows(folder: str, deep: bool) -> Iterator[tuple]:
        todo = [folder]
        seen: set[tuple[int, int]] = set()
        while todo:
            at = todo.pop()
            try:
                entries = sorted(os.scandir(at), key=lambda e: e.name)
            except OSError as e:
                yield (at, None, None, None, None, None, None, e.strerror)
                continue
            for entry in entries:
                try:
                    if entry.is_symlink() and not follow_symlinks:
                        continue
                    if entry.is_dir():
                        s = entry.stat()
                        if deep and (s.st_dev, s.st_ino) not in seen:  # links may lead in a circle
                            seen.add((s.st_dev, s.st_ino))
                            todo.append(entry.path)
                    elif entry.is_file():
                        s = os.stat(entry.path)
                        yield (entry.path, s.st_size, s.st_atime_ns, s.st_mtime_ns, s.st_ctime_ns, s.st_dev, s.st_ino, None)
                except OSError as e:
                    yield (entry.path, None, None, None, None, None, None, e.strerror)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in LISTED.split(", ")]
        for b in batches:
            for folder, deep in zip(b["folder"], b["deep"]):
                got = pd.DataFrame(list(rows(folder, deep)), columns=names)
                yield got.astype({c: "Int64" for c in names[1:-1]})

    base = root(path)
    inner = [(e.path, True) for e in os.scandir(base) if e.is_dir() and (follow_symlinks or not e.is_symlink())] if recursive else []
    folders = spark.createDataFrame([(base, False), *inner], "folder string, deep boolean")
    return folders.repartition(max(1, min(len(inner) + 1, spark.sparkContext.defaultParallelism * 4))).mapInPandas(run, LISTED)


def with_kind(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that some reader takes, and the others with their error."""
    marked = files.withColumn("kind", kind("path"))
    return marked.where("kind IS NOT NULL"), marked.where("kind IS NULL").withColumn("error", F.lit("unsupported_suffix"))


def zip_members(files: DataFrame, longest: int = 50 << 20) -> DataFrame:
    """The members of zip, uvz and epub files (path, content), content of up to longest bytes; MEMBERS."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in MEMBERS.split(", ")]
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                        for k, m in enumerate(z.infolist()):
                            locked = bool(m.flag_bits & 1)
                            rows.append((path, k, m.filename, m.file_size, locked, None if locked or m.is_dir() or m.file_size > longest else z.read(m), None))
                except (zipfile.BadZipFile, NotImplementedError, OSError, RuntimeError, TypeError, ValueError):
                    rows = [(path, -1, None, None, None, None, "corrupt")]
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(read, MEMBERS)
