"""9. Approximate nearest neighbours by largest inner product: a hierarchical navigable small-world graph per shard.

Each shard of vectors (by hash; SHARDS at least, and so many that none holds more than SHARD_ROWS in expectation) gets its
own graph: one row of flat arrays, namely ids, vectors, and per layer the padded neighbour lists. Vectors are extended by
sqrt(max norm^2 - norm^2), which turns the largest inner product into the least distance. Nodes are inserted in a random
order with geometric levels: each links to the nearest of the earlier ones, found exactly with blocked products, as a
shard is bounded, thinned by the usual rule (a neighbour goes if it is nearer to one that is kept than to the node), and
both ways. A node that the links would leave unreachable is linked from an earlier one. All queries of a block search a
shard's graph together: greedily down the layers, then with a beam of EF on the lowest. Found rows are scored with the
original vectors in double precision, and the shards' best merged.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components are neither queries nor
candidates; vectors of unlike lengths are filled with zeros; repeated rows are candidates of their own, a row is never
its own neighbour; null ids are candidates but not queries; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.llm._common import columns, partitions, session, spread, written
from folioscan.llm.vectors import unit, usable

SHARDS, SHARD_ROWS = 8, 40_000
M, EF, CANDIDATES = 16, 160, 48
BLOCK = 4096


def _thinned(x: np.ndarray, node: np.ndarray, ids: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """Of each node's candidates (ids by distance, -1 for none), those that the usual rule keeps, then the nearest others."""
    out = np.full((len(node), most), -1, np.int32)
    for i in range(0, len(node), 256):
        c, d = ids[i : i + 256], far[i : i + 256]
        v = x[np.maximum(c, 0)]
        n2 = (v * v).sum(2)
        between = n2[:, :, None] + n2[:, None, :] - 2 * v @ v.transpose(0, 2, 1)
        closest = np.full(c.shape, np.inf, np.float32)  # to a kept one
        kept = np.zeros(c.shape, bool)
        for k in range(c.shape[1]):
            kept[:, k] = (c[:, k] >= 0) & (d[:, k] < closest[:, k]) & (kept.sum(1) < most)
            closest = np.where(kept[:, k][:, None], np.minimum(closest, between[:, k]), closest)
        rank = np.where(c < 0, 2 * c.shape[1] + 1, np.arange(c.shape[1]) + np.where(kept, 0, c.shape[1]))
        order = np.argsort(rank, 1)[:, :most]
        out[i : i + 256, : order.shape[1]] = np.take_along_axis(c, order, 1)
    return out


def _layer(x: np.ndarray, most: int) -> np.ndarray:
    """Neighbour lists of one layer; x in the order of insertion."""
    n = len(x)
    width = min(CANDIDATES, max(1, n - 1))
    ids, far = np.full((n, width), -1, np.int32), np.full((n, width), np.inf, np.float32)
    half = (x * x).sum(1)
    for i in range(0, n, 512):
        j = min(n, i + 512)
        d = half[i:j, None] + half[None, :j] - 2 * x[i:j] @ x[:j].T
        d[np.arange(j)[None, :] >= np.arange(i, j)[:, None]] = np.inf
        k = min(width, j)
        top = np.argpartition(d, k - 1, 1)[:, :k]
        dist = np.take_along_axis(d, top, 1)
        order = np.argsort(dist, 1)
        top, dist = np.take_along_axis(top, order, 1), np.take_along_axis(dist, order, 1)
        ids[i:j, :k], far[i:j, :k] = np.where(np.isfinite(dist), top, -1), dist
    ahead = _thinned(x, np.arange(n), ids, far, M)
    first = ids[:, 0].copy()
    # Both ways: of all that link with a node, the nearest; then thinned.
    a = np.repeat(np.arange(n), ahead.shape[1])
    b = ahead.ravel()
    a, b = a[b >= 0], b[b >= 0]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    d = np.concatenate([((x[a[k : k + 200_000]] - x[b[k : k + 200_000]]) ** 2).sum(1) for k in range(0, len(a), 200_000)] or [np.zeros(0, np.float32)])
    order = np.lexsort((d, a))
    a, b, d = a[order], b[order], d[order]
    at = np.arange(len(a)) - np.searchsorted(a, a)
    width = max(1, min(4 * M, int(at.max(initial=0)) + 1))
    some = at < width
    ids, far = np.full((n, width), -1, np.int32), np.full((n, width), np.inf, np.float32)
    ids[a[some], at[some]], far[a[some], at[some]] = b[some], d[some]
    links = np.concatenate([_thinned(x, np.arange(n), ids, far, most), np.full((n, 8), -1, np.int32)], 1)
    # Every node is reached from the first.
    seen = np.zeros(n, bool)
    room = (links >= 0).sum(1)

    def reach(front: np.ndarray) -> None:
        while len(front):
            seen[front] = True
            near = np.unique(links[front])
            near = near[near >= 0]
            front = near[~seen[near]]

    reach(np.zeros(1, int))
    last: dict[int, int] = {}
    for u in np.flatnonzero(~seen).tolist():
        if seen[u]:
            continue
        p = int(first[u])
        while room[p] >= links.shape[1]:
            p = last.get(p, int(first[p]) if first[p] >= 0 else int(np.flatnonzero(seen & (room < links.shape[1]))[0]))
        links[p, room[p]] = u
        room[p] += 1
        last[int(first[u])] = u
        reach(np.array([u]))
    return links


def build(x: np.ndarray, seed: int) -> dict:
    """The graph of the rows of x (doubles): order of insertion, extended vectors, and for each layer its nodes and links."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    level = np.sort(np.floor(-np.log(1 - rng.random(len(x))) / math.log(M)).astype(int))[::-1]  # the order is random anyway; upper nodes come first
    x = x / np.abs(x).max()  # the order of inner products stays
    n2 = (x * x).sum(1)
    y = np.concatenate([x, np.sqrt(np.maximum(n2.max() - n2, 0))[:, None]], 1)[order].astype(np.float32)
    layers = []
    for k in range(int(level[0]) + 1):
        count = int((level >= k).sum())
        layers.append(_layer(y[:count], 2 * M if k == 0 else M))
    return {"order": order, "y": y, "layers": layers}


def search(graph: dict, q: np.ndarray, ef: int) -> np.ndarray:
    """For each query ids of nodes, -1 for none, at most ef."""
    y = graph["y"]
    q = unit(q)
    q = np.concatenate([q, np.zeros((len(q), 1))], 1).astype(np.float32)
    out = []
    for i in range(0, len(q), 256):
        part = q[i : i + 256]
        start = np.zeros(len(part), np.int32)
        for links in graph["layers"][:0:-1]:
            start = _beam(y, links, part, start[:, None], min(8, len(links)))[:, 0]
        out.append(_beam(y, graph["layers"][0], part, start[:, None], ef))
    return np.concatenate(out) if out else np.zeros((0, ef), np.int32)


def _beam(y: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int) -> np.ndarray:
    """The ef best nodes found, best first. Distances leave out the query's norm, which is the same for all."""
    n, at = len(q), np.arange(len(q))[:, None]
    half = (y[: len(links)] ** 2).sum(1) / 2
    seen = np.zeros((n, len(links) + 1), bool)
    seen[:, -1] = True
    ids = np.full((n, ef), -1, np.int32)
    far = np.full((n, ef), np.inf, np.float32)
    done = np.ones((n, ef), bool)
    first = np.concatenate([start, np.zeros_like(start)], 1)
    first[first[:, 1] == first[:, 0], 1] = -1
    new = first
    while True:
        seen[at, new] = True
        v = y[np.maximum(new, 0)]
        d = np.where(new >= 0, half[np.maximum(new, 0)] - np.einsum("bd,bkd->bk", q, v), np.inf)
        ids, far, done = np.concatenate([ids, new], 1), np.concatenate([far, d], 1), np.concatenate([done, new < 0], 1)
        top = np.argpartition(far, ef - 1, 1)[:, :ef]
        ids, far, done = np.take_along_axis(ids, top, 1), np.take_along_axis(far, top, 1), np.take_along_axis(done, top, 1)
        open_far = np.where(done, np.inf, far)
        w = min(3, ef)
        pick = np.argpartition(open_far, w - 1, 1)[:, :w]
        ok = np.isfinite(np.take_along_axis(open_far, pick, 1))
        if not ok.any():
            break
        done[at, pick] = True
        nodes = np.where(ok, np.take_along_axis(ids, pick, 1), -1)
        new = np.where((nodes >= 0)[:, :, None], links[np.maximum(nodes, 0)], -1).reshape(n, -1)
        new = np.where(seen[at, new], -1, new)
        new = np.sort(new, 1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        keep = -(-int((new >= 0).sum(1).max()) // 8) * 8 or 1
        if keep < new.shape[1]:
            new = -np.sort(-new, 1)[:, :keep]
    order = np.argsort(far, 1)
    return np.take_along_axis(ids, order, 1)


_INDEX = "shard int, uids binary, ids binary, vecs binary, y binary, layers array<binary>"


def _vectors(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = usable(batch.column(1), dims)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)).cast(pa.int64()), pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "vec"])

    return run


def _built(x: pd.DataFrame) -> pd.DataFrame:
    x = x.sort_values("uid", ignore_index=True)
    v = np.frombuffer(b"".join(x.vec), np.float64).reshape(len(x), -1)
    g = build(v, int(x.shard.iloc[0]) + 1)
    x = x.iloc[g["order"]]
    has = x.vec_id.notna()
    ids = np.where(has, x.vec_id.fillna(-1).astype(np.int64), np.iinfo(np.int64).max)
    return pd.DataFrame({"shard": [int(x.shard.iloc[0])], "uids": [x.uid.to_numpy(np.int64).tobytes()], "ids": [ids.tobytes()], "vecs": [v[g["order"]].tobytes()], "y": [g["y"].tobytes()], "layers": [[a.tobytes() for a in g["layers"]]]})


def _found(dims: int, top: int, ef: int):
    def run(ix: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"uid": [], "query_id": [], "vec_id": [], "score": []})
        if not len(ix) or not len(q):
            return none
        row = ix.iloc[0]
        y = np.frombuffer(row.y, np.float32).reshape(-1, dims + 1)
        uids, ids, vecs = np.frombuffer(row.uids, np.int64), np.frombuffer(row.ids, np.int64), np.frombuffer(row.vecs, np.float64).reshape(-1, dims)
        widths = [2 * M + 8, *[M + 8] * 99]
        graph = {"y": y, "layers": [np.frombuffer(b, np.int32).reshape(-1, widths[k]) for k, b in enumerate(row.layers)]}
        qv = np.frombuffer(b"".join(q.vec), np.float64).reshape(len(q), -1)
        got = search(graph, qv, min(max(ef, top + 1), len(y)))
        who, _ = np.nonzero(got >= 0)
        node = got[got >= 0]
        other = uids[node] != q.uid.to_numpy()[who]
        who, node = who[other], node[other]
        score = np.concatenate([np.einsum("ij,ij->i", qv[who[k : k + 50_000]], vecs[node[k : k + 50_000]]) for k in range(0, len(who), 50_000)] or [np.zeros(0)])
        order = np.lexsort((ids[node], -score, who))
        who, node, score = who[order], node[order], score[order]
        best = np.arange(len(who)) - np.searchsorted(who, who) < top
        who, node, score = who[best], node[best], score[best]
        return pd.DataFrame({"uid": q.uid.to_numpy()[who], "query_id": q.vec_id.to_numpy()[who].astype(np.int64), "vec_id": ids[node], "score": score})

    return run


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, top: int = 20, ef: int = EF) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by every the top rows by inner product."""
    spark = session(df)
    df = columns(df, id_col, vec_col).toDF("vec_id", "vec_in")
    dims = max(1, df.agg(F.max(F.size("vec_in"))).first()[0] or 0)
    rows = written(df.mapInArrow(_vectors(dims), "vec_id long, vec binary").withColumn("uid", F.monotonically_increasing_id()), "hnsw-rows")
    count = rows.count()
    shards = max(1, min(SHARDS, count), math.ceil(count / SHARD_ROWS))
    # Groups for tasks are keyed so that they fill the tasks evenly.
    keys = lambda n: F.array(*map(F.lit, spread(n, partitions(spark)))) if n <= 1000 else F.sequence(F.lit(0), F.lit(n - 1))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int"))
    index = written(rows.withColumn("key", F.get(keys(shards), F.col("shard"))).groupBy("key").applyInPandas(_built, _INDEX), "hnsw-index")
    asks = rows.where(F.pmod("vec_id", F.lit(every)) == 0).drop("shard")
    blocks = max(1, math.ceil(asks.count() / BLOCK))
    pair = F.get(keys(shards * blocks), F.col("shard") * blocks + F.col("block"))
    asks = asks.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    placed = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("i_pair", pair).drop("block")
    found = placed.groupBy("i_pair").cogroup(asks.withColumn("pair", pair).drop("shard", "block").groupBy("pair")).applyInPandas(_found(dims, top, ef), "uid long, query_id long, vec_id long, score double")
    best = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    merged = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return merged.select("query_id", "rank", F.when(F.col("vec_id") < F.lit((1 << 63) - 1), F.col("vec_id")).alias("vec_id"), "score")
