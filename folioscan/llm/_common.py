"""What the operators share: written intermediate tables, distributed ranks, connected components, Arrow helpers."""

from __future__ import annotations

import ctypes
import functools
import inspect
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Edges up to this number (16 bytes each) are united in one task; beyond it, by star contraction.
ONE_TASK_EDGES = 2_000_000
#: Arrow batches to Python hold at most so many bytes, or one row; so many rows of any length bound no memory.
BATCH_BYTES, _BATCH = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: What a worker keeps from task to task, by name. Functions that are frugal() drop it before they run.
KEPT: dict = {}


def release() -> None:
    """Gives freed memory back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def frugal(run):
    """run, a function over batches or one group, that releases memory when it's done."""
    if inspect.isgeneratorfunction(run):

        @functools.wraps(run)
        def over(batches):
            KEPT.clear()
            yield from run(batches)
            release()

        return over

    @functools.wraps(run)
    def once(*args):
        KEPT.clear()
        out = run(*args)
        release()
        return out

    return functools.wraps(run)(lambda x: once(x)) if run.__code__.co_argcount == 1 else functools.wraps(run)(lambda x, y: once(x, y))


def session(df: DataFrame) -> SparkSession:
    """df's session, whose Arrow batches hold BATCH_BYTES at most from now on, unless it already asks for less."""
    spark = df.sparkSession
    now = spark.conf.get(_BATCH)
    if not 0 < int(re.sub(r"\D", "", now)) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset: in local mode, which is for tests, one in the temporary
    folder; on a cluster that's an error, as executors don't share such a folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (base or "file://" + os.path.join(tempfile.gettempdir(), "folioscan-shared")).rstrip("/")


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder that Spark wrote, and the folder's path in it."""
    return pyarrow.fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: cuts the lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/folioscan-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def place(df: DataFrame, name: str) -> int:
    """Where df has the column: that of exactly this name, else the only one in another case."""
    for same in ([i for i, c in enumerate(df.columns) if c == name], [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]):
        if len(same) == 1:
            return same[0]
    raise ValueError(f"{name} is {'ambiguous' if same else 'missing'} among {df.columns}")


def masked(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """df with the columns c0, c1, ..., which no name of an operator's own meets, whatever df's are; and the names so of some."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), [f"c{place(df, n)}" for n in names]


def filed(df: DataFrame) -> DataFrame:
    """df, if it is a scan of files and nothing else, so that monotonically_increasing_id() numbers its rows alike each time; else a
    written copy, which is one."""
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return df if all(re.match(r"[\s:+-]*(Project|Relation) ", x) for x in plan) else written(df, "docs")


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns (see place()), whatever else df has."""
    plain, own = masked(df, *names)
    return plain.select(*[F.col(c).alias(n) for c, n in zip(own, names)])


def spread(count: int, partitions_: int) -> list[int]:
    """count whole numbers, of which a hash exchange over so many partitions gives each partition equally many, or one
    more. A group for a task is keyed by these, since few keys as they come would meet in some and leave others empty."""
    each, out, k = [0] * partitions_, [], 0
    most = -(-count // partitions_)
    while len(out) < count:
        at = _hashed(np.arange(k, k + 4096, dtype=np.uint32)) % partitions_
        for i, p in enumerate(at.tolist(), k):
            if each[p] < most and len(out) < count:
                each[p] += 1
                out.append(i)
        k += 4096
    return out


def _hashed(x: np.ndarray) -> np.ndarray:
    """Spark's hash() of ints (Murmur3, 32 bits, seed 42)."""
    u, turn = np.uint32, lambda v, r: (v << np.uint32(r)) | (v >> np.uint32(32 - r))
    h = turn(u(42) ^ (turn(x * u(0xCC9E2D51), 15) * u(0x1B873593)), 13) * u(5) + u(0xE6546B64)
    h ^= u(4)
    h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
    h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
    return (h ^ (h >> u(16))).view(np.int32).astype(np.int64)


def ranked(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """df with rank (from 0) within group by order. No group is ever in one task: rows are range-partitioned by
    group and order; each partition's rows are counted, and the counts before it added. group: not null."""
    spark = df.sparkSession
    keys = [F.col(group), *map(F.col, order)]
    placed = df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed.withColumn("_part", F.shiftright("_at", 33)), name)
    runs = placed.groupBy("_part", group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition that has the group
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return placed.join(runs, ["_part", group]).withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before")


def united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n vertices the smallest vertex that the edges a-b connect it with."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        new = label.copy()
        np.minimum.at(new, la, low)
        np.minimum.at(new, lb, low)
        while (again := new[new]).tobytes() != new.tobytes():
            new = again
        if (new == label).all():
            return label
        label = new


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and for each the smallest vertex of its component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    return ids, ids[united(len(ids), at[: len(a)], at[len(a) :])]


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    got = [x for x in batches if len(x)]
    if got:
        v, c = forest(np.concatenate([x.a.to_numpy() for x in got]), np.concatenate([x.b.to_numpy() for x in got]))
        yield pd.DataFrame({"v": v, "c": c})


def components(edges: DataFrame, name: str, one_task: int = ONE_TASK_EDGES, reduced: bool = False) -> DataFrame:
    """(v, c): c is the smallest vertex that edges (a long, b long) connect v with. Each partition first reduces its
    edges to a forest (reduced: they are). Up to one_task edges that remain are united in one task, more by alternating
    large and small stars, whose joins AQE splits where a hub is large."""
    if not reduced:
        edges = edges.mapInPandas(_forest, "v long, c long").toDF("a", "b")
    edges = written(edges.select("a", "b").distinct(), name)
    if (count := edges.count()) <= one_task:
        return edges.coalesce(1).mapInPandas(_forest, "v long, c long")
    seen = None
    while True:
        both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = written(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), name)
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = written(small.where("a <> b").distinct(), name)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if now == seen:
            break
        seen = now
    ends = edges.select(F.col("a").alias("v"), F.col("b").alias("c"))
    return ends.union(edges.select(F.col("b").alias("v"), F.col("b").alias("c"))).distinct()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_slices(texts: pa.Array, size: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows from, to, the UTF-8 bytes of their texts, and where in these each text starts and the last ends. null: empty.
    A slice has size bytes at most, or one text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j, data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        i = j


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each run of bytes other than space and 9 to 13."""
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:-1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(at, s, "right") - 1
