"""6. Sharding: a uniform shuffle with exact shard sizes, by a hypergeometric communication matrix.

Shard sizes differ by one at most (law `rows`). How many rows each partition sends to each shard is drawn exactly, as
the counts of a uniform shuffle have it: multivariate hypergeometric, partition after partition, from what the shards
still take. Each partition permutes its rows and deals them by its line of the matrix; the rows are exchanged, and each
shard permutes again: by random keys of 64 bits, ranked across partitions, so that no shard has to fit one task.
Rows of equal texts are dealt like any others; only ids, sizes and keys are moved.

Defined cases: null text has no bytes (size 1) and the crc32 of no bytes, 0; repeated rows and null ids are rows of their
own; an empty table gives an empty result; further columns are ignored. A seed gives the same shuffle again as long as
the input's partitions are the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm._common import columns, mixed, ranked, session, spread, written


def matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows that each partition (by its count) sends to each shard."""
    rng, total = np.random.default_rng([seed, 17]), sum(counts)
    left = np.full(shards, total // shards, np.int64)
    left[rng.permutation(shards)[: total % shards]] += 1
    out = np.zeros((len(counts), shards), np.int64)
    for i, n in enumerate(counts):
        rest, want = int(left.sum()), n
        for k in range(shards):
            rest -= int(left[k])
            out[i, k] = want if not rest else hypergeometric(rng, int(left[k]), rest, want)
            want -= out[i, k]
        left -= out[i]
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int, most: int = 1_000_000_000) -> int:
    """How many of n drawn from good + bad are good. numpy's sampler takes fewer than most (10^9) of each; beyond, the same
    law is drawn by inversion: probabilities relative to the mode's, by the ratios of neighbours, over 40 standard
    deviations and more to each side, which leaves out less than 10^-300."""
    if max(good, bad) < most:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    deviation = (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5
    a, b = max(low, mode - int(40 * deviation) - 40), min(high, mode + int(40 * deviation) + 40)
    k = np.arange(a, b, dtype=np.float64)
    up = np.log((good - k) / (k + 1)) + np.log((n - k) / (bad - n + k + 1))
    p = np.concatenate([[0.0], np.cumsum(up)])
    p = np.cumsum(np.exp(p - p[mode - a]))
    return a + int(min(np.searchsorted(p, rng.random() * p[-1], "right"), b - a))


def _permuted(seed: int):
    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("at", ignore_index=True)
        rng = np.random.default_rng([seed, int(x.part.iloc[0])])
        shard = np.repeat(np.arange(len(x.sends.iloc[0])), x.sends.iloc[0])
        key = mixed(rng.integers(0, 1 << 63, len(x)).astype(np.uint64)).view(np.int64)
        return pd.DataFrame({"doc_id": x.doc_id, "size": x["size"], "text_crc32": x.text_crc32, "at": x["at"], "shard": rng.permutation(shard).astype(np.int32), "key": key})

    return run


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: int = 8, seed: int = 1) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per row of docs."""
    spark = session(docs)
    plain = columns(docs, id_col, text_col).toDF("id", "text")
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = plain.select(F.col("id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = written(rows.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "shard-rows")
    # A number for each partition: as many as there are input splits.
    parts = rows.groupBy("part").count().orderBy("part").collect()
    sends = matrix([r["count"] for r in parts], count, seed)
    keys = spread(len(parts), int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines = spark.createDataFrame([(r.part, k, s) for r, k, s in zip(parts, keys, sends.tolist())], "part long, key int, sends array<long>")
    dealt = rows.join(lines, "part").groupBy("key").applyInPandas(_permuted(seed), "doc_id long, size long, text_crc32 long, at long, shard int, key long")
    placed = ranked(dealt, "shard", ["key", "at"], "shards")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
