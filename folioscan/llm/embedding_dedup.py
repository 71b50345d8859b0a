"""2. Embedding near-dedup: pairs of vectors with a cosine of at least the threshold, by product quantisation.

Equal vectors first become one class with a weight. Coarse centroids and the codebooks of the subspaces of the residuals
are fitted on a bounded sample (SAMPLE rows, those of the least hashes); every vector is indexed. A vector lies in the
inverted list of its nearest centroid, as codes of its residual, with the norm of what the codes miss.

Lists are probed by bounds, never by number. A vector within the radius of a query lies in a list only if the query is
within the list's reach (the distance of its farthest member from the centroid) plus the radius, and no farther than the
radius beyond the half-way plane between its own centroid and the list's. Within a list, table lookups give the distance
to each member's coded place (taken together, as one product of a block's queries with the places that the codes give), and
a member whose coded distance is within the radius plus its own coding error stays. So neither lists nor codes lose a
pair, and the exact cosine in double precision decides. Where bounds exclude little (vectors that form no clusters), or
clusters outgrow the lists (of which the sample supports SAMPLE / 4 at most, from 1.6 million vectors on), the work grows
with the square of the number of vectors; pairs are lost in neither case.

Lists that lie near each other are written together as blocks of about MEMBERS rows, a list of more as several. Each
pair of blocks is one unit of work, unless bounds exclude it; it reads both blocks from the shared folder, so vectors
are never copied from list to list, and counts links for both. Edges are reduced to a forest, so a group of near copies
never becomes a list of pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
unlike lengths are filled with zeros; repeated rows, also of one vec_id, are vectors of their own; component_id ignores
null ids; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm._common import columns, components, forest, opened, partitions, session, shared_folder, written
from folioscan.llm.vectors import unit, usable

SAMPLE = 20_000
SUBSPACES = 8
CODEWORDS = 256
MEMBERS = 2048
#: Added to the radius in bounds, for rounding.
SLACK = 1e-4


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        near = _near(x, c)
        n = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        some = np.flatnonzero(n)
        sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n[some])[:-1]]))
        c = c.copy()
        c[some] = sums / n[some][:, None]
    return c


def _near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, 1) for i in range(0, len(x), 4096)] or [np.zeros(0, int)])


class Index:
    """Centroids, the bounds of the subspaces and their codebooks."""

    def __init__(self, sample: np.ndarray, count: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        lists = max(1, min(int(4 * math.sqrt(count)), len(sample) // 4))
        self.centroids = _means(sample, lists, 6, rng)
        rest = sample - self.centroids[_near(sample, self.centroids)]
        d = sample.shape[1]
        cuts = np.linspace(0, d, min(SUBSPACES, d) + 1).astype(int)
        self.cuts = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        self.books = [_means(rest[:, a:b], max(1, min(CODEWORDS, len(rest) // 4)), 5, rng) for a, b in self.cuts]

    def coded(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest = x - self.centroids[at]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        missed = np.zeros(len(x))
        for k, ((a, b), book) in enumerate(zip(self.cuts, self.books)):
            codes[:, k] = _near(rest[:, a:b], book)
            missed += ((rest[:, a:b] - book[codes[:, k]]) ** 2).sum(1)
        return codes, np.sqrt(missed)


def _plain(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = usable(batch.column(1), dims)
            vecs: list = [None] * batch.num_rows
            for i, v in zip(rows.tolist(), x):
                vecs[i] = v.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(vecs, pa.binary())], ["vec_id", "vec"])

    return run


def _unit(vecs) -> np.ndarray:
    return unit(np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), -1))


def _assigned(index):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = index.value
        for whole in batches:
            for i in range(0, len(whole), 2048):
                b = whole.iloc[i : i + 2048]
                x = _unit(list(b.vec))
                at = _near(x, ix.centroids)
                codes, missed = ix.coded(x, at)
                reach = np.sqrt(((x - ix.centroids[at]) ** 2).sum(1))
                yield pd.DataFrame({"cls": b.cls.to_numpy(), "weight": b.weight.to_numpy(), "list": at.astype(np.int32), "reach": reach, "vec": [v.tobytes() for v in x], "codes": [c.tobytes() for c in codes], "missed": missed})

    return run


def _side_by_side(c: np.ndarray) -> np.ndarray:
    """An order of centroids that keeps near ones together: halves along the widest direction, recursively."""
    if len(c) < 3:
        return np.arange(len(c))
    rest = c - c.mean(0)
    order = np.argsort(rest @ np.linalg.eigh(rest.T @ rest)[1][:, -1], kind="stable")
    a, b = order[: len(c) // 2], order[len(c) // 2 :]
    return np.concatenate([a[_side_by_side(c[a])], b[_side_by_side(c[b])]])


class Blocks:
    """Which lists are written together: for each list its group, the groups' first block, and how many they have."""

    def __init__(self, index: Index, lists: np.ndarray, sizes: np.ndarray, reach: np.ndarray, threshold: float):
        self.radius = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
        self.reach = np.zeros(len(index.centroids))
        self.reach[lists] = reach
        order = _side_by_side(index.centroids[lists])
        self.lists, sizes = lists[order], sizes[order]
        group, held = [], 0
        for n in sizes.tolist():
            new = not group or held + n > MEMBERS
            group.append((group[-1] if group else -1) + 1 if new else group[-1])
            held = n if new else held + n
        self.group = np.array(group)
        self.parts = np.maximum(1, -(-np.bincount(self.group, sizes).astype(np.int64) // MEMBERS))
        self.first = np.cumsum(self.parts) - self.parts
        self.start = np.flatnonzero(np.diff(self.group, prepend=-1))

    def pairs(self, index: Index, g: int) -> np.ndarray:
        """Groups from g on that may hold a vector within the radius of one of group g."""
        c, reach = index.centroids[self.lists], self.reach[self.lists]
        own = self.group == g
        far = np.sqrt(np.maximum(0, ((c[own] ** 2).sum(1)[:, None] - 2 * c[own] @ c.T + (c * c).sum(1))))
        near = (far <= reach[own][:, None] + reach + self.radius).any(0)
        some = np.flatnonzero(np.logical_or.reduceat(near, self.start))
        return some[some >= g]


def _units(index, blocks):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g in batch.id.tolist():
                first, parts = blocks.value.first, blocks.value.parts
                for h in blocks.value.pairs(index.value, g).tolist():
                    a, b = (x.ravel() for x in np.meshgrid(first[g] + np.arange(parts[g]), first[h] + np.arange(parts[h]), indexing="ij"))
                    yield pd.DataFrame({"a": a[a <= b], "b": b[a <= b]})

    return run


class _Block:
    """A block's rows, ordered by list."""

    def __init__(self, fs, path: str):
        t = pq.read_table(path, filesystem=fs, partitioning=None).sort_by([("list", "ascending"), ("cls", "ascending")])
        n = len(t)
        matrix = lambda name, kind: np.frombuffer(b"".join(t[name].to_pylist()), kind).reshape(n, -1)
        self.cls, self.weight, self.missed, self.list = (t[k].to_numpy() for k in ("cls", "weight", "missed", "list"))
        self.vec, self.codes = matrix("vec", np.float64), matrix("codes", np.uint8)
        self.start = np.flatnonzero(np.diff(self.list, prepend=-1))


def _matched(ix: Index, blocks: Blocks, q: _Block, m: _Block, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of q and rows of m whose cosine may be high enough; same: each pair of rows once."""
    square = lambda x: (x * x).sum(-1)
    # A member's coded place: codewords looked up in the tables, and the centroid. All asymmetric distances |query - place|
    # of the block are then one matrix product, which sums up what a table of products for each query and subspace would.
    place = ix.centroids[m.list]
    for k, ((a, b), book) in enumerate(zip(ix.cuts, ix.books)):
        place[:, a:b] += book[m.codes[:, k]]
    # |query - place| <= radius + what the codes miss, of unit vectors, as a bound of the product.
    least = ((1 + square(place) - (blocks.radius + m.missed) ** 2) / 2 - 1e-5).astype(np.float32)
    place = place.astype(np.float32)
    # Lists out of a query's reach are left out, where that spares whole lists.
    ends = [*m.start[1:].tolist(), len(m.list)]
    lists = m.list[m.start]
    c = ix.centroids[lists]
    near = np.sqrt(np.maximum(0, square(q.vec)[:, None] - 2 * q.vec @ c.T + square(c))) <= blocks.reach[lists] + blocks.radius
    some = np.flatnonzero(np.repeat(near.any(0), np.diff(ends, prepend=0)))
    ask = np.flatnonzero(near.any(1))
    place, least = place[some], least[some]
    vec = q.vec.astype(np.float32)
    for i in range(0, len(ask), 512):
        rows = ask[i : i + 512]
        a, b = np.nonzero(vec[rows] @ place.T >= least)
        a, b = rows[a], some[b]
        if same:
            keep = q.cls[a] < m.cls[b]
            a, b = a[keep], b[keep]
        yield a, b


def _linked(index, blocks, path: str, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = opened(path)
        for batch in batches:
            for one, two in zip(batch.a.tolist(), batch.b.tolist()):
                q = _Block(fs, f"{root}/block={one}")
                m = q if one == two else _Block(fs, f"{root}/block={two}")
                mine, other, edges = np.zeros(len(q.cls), np.int64), np.zeros(len(m.cls), np.int64), []
                for a, b in _matched(index.value, blocks.value, q, m, one == two):
                    cos = np.concatenate([np.einsum("ij,ij->i", q.vec[a[k : k + 50_000]], m.vec[b[k : k + 50_000]]) for k in range(0, len(a), 50_000)] or [np.zeros(0)])
                    a, b = a[cos >= threshold], b[cos >= threshold]
                    if len(a):
                        mine += np.bincount(a, m.weight[b], len(q.cls)).astype(np.int64)
                        other += np.bincount(b, q.weight[a], len(m.cls)).astype(np.int64)
                        edges.append(forest(q.cls[a], m.cls[b]))
                if not edges:
                    continue
                v, r = forest(*(np.concatenate([e[k] for e in edges]) for k in (0, 1)))
                counted = [pd.DataFrame({"cls": x.cls[n > 0], "links": n[n > 0], "root": None}) for x, n in ((q, mine), (m, other))]
                yield pd.concat([*counted, pd.DataFrame({"cls": v, "links": 0, "root": r})]).astype({"root": "Int64"})

    return run


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, sample: int = SAMPLE) -> DataFrame:
    """One row per row of df: vec_id, n_links, component_id, kept."""
    spark = session(df)
    df = columns(df, id_col, vec_col).toDF("vec_id", "vec_in")
    dims = df.agg(F.max(F.size("vec_in"))).first()[0] or 0
    # Rows know their class by a digest of 128 bits, so that vectors are no key of a join.
    plain = written(df.mapInArrow(_plain(max(1, dims)), "vec_id long, vec binary").withColumn("digest", F.md5("vec")), "pq-rows")
    classes = plain.where("vec IS NOT NULL").groupBy("digest").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"), F.first("vec").alias("vec"))
    each = written(classes.withColumn("cls", F.monotonically_increasing_id()), "pq-classes")
    count = each.count()
    if count:
        drawn = each.select("vec").orderBy(F.xxhash64("vec")).limit(sample).collect()
        index = spark.sparkContext.broadcast(Index(_unit([bytes(r.vec) for r in drawn]), count))
        rows = written(each.select("cls", "weight", "vec").mapInPandas(_assigned(index), "cls long, weight long, list int, reach double, vec binary, codes binary, missed double"), "pq-codes")
        lists = rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("reach")).orderBy("list").toPandas()  # at most SAMPLE / 4 rows
        own = Blocks(index.value, lists["list"].to_numpy(), lists["n"].to_numpy(), lists["reach"].to_numpy(), threshold)
        blocks = spark.sparkContext.broadcast(own)
        of = spark.createDataFrame(pd.DataFrame({"list": own.lists, "first": own.first[own.group], "parts": own.parts[own.group]}), "list int, first long, parts long")
        path = f"{shared_folder(spark)}/folioscan-pq-{uuid.uuid4().hex}"
        placed = rows.join(F.broadcast(of), "list").withColumn("block", F.col("first") + F.pmod(F.xxhash64("cls"), F.col("parts"))).drop("first", "parts", "reach")
        placed.repartition(partitions(spark), "block").write.partitionBy("block").parquet(path)
        filled = placed.select("block").distinct()  # hashes may leave one empty
        units = spark.range(len(own.parts)).repartition(partitions(spark)).mapInPandas(_units(index, blocks), "a long, b long")
        for side in ("a", "b"):
            units = units.join(filled.withColumnRenamed("block", side), side, "left_semi")
        units = written(units, "pq-units").repartition(partitions(spark) * 2, F.xxhash64("a", "b"))
        found = written(units.mapInPandas(_linked(index, blocks, path, threshold), "cls long, links long, root long"), "pq-links")
    else:
        found = spark.createDataFrame([], "cls long, links long, root long")
    linked = found.where("root IS NULL").groupBy("cls").agg(F.sum("links").alias("links"))
    comp = components(found.where("root IS NOT NULL").select(F.col("cls").alias("a"), F.col("root").alias("b")), "pq-edges").withColumnRenamed("v", "cls")
    least = comp.join(each.select("cls", "least"), "cls").groupBy("c").agg(F.min("least").alias("lowest"))
    result = each.select("cls", "digest", "weight", "least").join(linked, "cls", "left").join(comp.join(least, "c").select("cls", "lowest"), "cls", "left")
    result = result.select("digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("lowest", "least").alias("component_id"))
    alone = F.col("digest").isNull()
    out = plain.select("vec_id", "digest").join(result, "digest", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


ORACLE = """WITH RECURSIVE v AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0 THEN embedding::DOUBLE[] END AS e FROM embeddings),
u AS (SELECT uid, vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL),
p AS (SELECT a.uid AS a, b.uid AS b FROM u a, u b WHERE a.uid <> b.uid AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r AS (SELECT uid AS v, uid AS w FROM u UNION SELECT r.v, p.b FROM r JOIN p ON p.a = r.w),
c AS (SELECT r.v AS uid, min(u.vec_id) AS component_id FROM r JOIN u ON u.uid = r.w GROUP BY r.v),
l AS (SELECT a AS uid, count(*) AS n_links FROM p GROUP BY a)
SELECT v.vec_id, coalesce(l.n_links, 0) AS n_links, CASE WHEN v.e IS NULL THEN v.vec_id ELSE c.component_id END AS component_id, v.vec_id = CASE WHEN v.e IS NULL THEN v.vec_id ELSE c.component_id END AS kept
FROM v LEFT JOIN l USING (uid) LEFT JOIN c USING (uid)"""
