"""4. N-gram Jaccard join: the exact self-join of documents by the Jaccard similarity of their word shingles.

1 - Jaccard is a metric, and the join partitions that metric space. The first pivots are single shingles: a document's
nearest pivots are its own shingles, taken from the rarest, and by the prefix bound two documents within the radius share
one of the first n - ceil(t n) + 1. Documents that pivots link form regions; no link leaves a region. A region joins in
one task or, where it is large, is cut into Voronoi cells around documents drawn from it: each document has its home in
the cell of its nearest pivot and is copied into each other cell that the triangle inequality can't exclude
(d(y, p) <= d(y, nearest) + 2 r, and d(y, p) <= r + the cell's radius). Cells are cut again; where that no longer helps,
as in a dense group of copies, blocks of a cell are joined against each other. A document's links are counted in its home
cell alone, which holds all that it may link with, so nothing counts twice.

Before, documents with equal sets become one class with a weight, and classes of which too few shingles occur in any
other class (below t n) are left out: they can't link. Which shingles classes share is counted in shards of shingles;
those that many have would make a shard hot, so shingles that a sample proves to be shared are spread by class instead.
Nothing is capped, and the sample changes no result.

Shingles are 64-bit hashes, of which the join keeps 48 bits beside the shard: a chance of some 1e-9 for a pair that a
shingle is wrongly taken as shared.

Defined cases: null and empty texts and texts of white space have the empty set and link with nothing; repeated rows,
also of one doc_id, are documents of their own; component_id ignores null doc_ids; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm._common import columns, components, forest, frugal, mixed, partitions, session, spread, text_slices, united, word_spans, written

#: Shingles that a region may hold to be joined in one task (8 bytes each); documents that are joined as one matrix.
REGION_SHINGLES = 4_000_000
#: Shingles of a shard in which documents' shingles are matched; MB of texts that are dealt to the shards together.
SHARD, SLICES = 3_000_000, 8
LEAF = 768
SPARSE = 5
PIVOTS = 12
DEPTH = 6
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        for k, x in enumerate((_BASE, _INVERSE)):
            _pow[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 2_000_000), x, np.uint64)]))
    return _pow[0], _pow[1]


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, one text after the other, and where each text's start."""
    docs = len(at) - 1
    s, e, doc = word_spans(data, at)
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    power, inverse = _powers(len(data) + 1)
    upper = (data >= 65) & (data <= 90)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint8(1) + upper * np.uint8(32)).astype(np.uint64) * power[: len(data)], out=sums[1:])
    word = mixed((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    del sums, upper
    count = np.bincount(doc, minlength=docs)
    first = np.concatenate([[0], np.cumsum(count)])
    width_of = np.minimum(np.maximum(count, 1), width)
    size = np.where(count > 0, count - width_of + 1, 0)  # fewer words: the whole sequence as one
    begins = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(docs), size)
    at_word = np.arange(begins[-1]) - begins[owner] + first[owner]
    h = width_of[owner].astype(np.uint64)
    for k in range(width):
        has = width_of[owner] > k
        h = np.where(has, mixed(h * np.uint64(0xA0761D6478BD642F) + word[np.minimum(at_word + k, len(word) - 1)]), h)
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
        if b - a > 1:
            h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=docs))])


def _class_ids(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(at)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h ^ np.uint64(0x5851F42D4C957F2D)))])
    return n, mixed(sums[at[1:]] - sums[at[:-1]] + n.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)).view(np.int64)


def _classed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            uids = batch.column(2)
            for i, j, data, at in text_slices(batch.column(1), 1_000_000):
                n, c = _class_ids(*shingle_sets(data, at, width))
                yield pa.RecordBatch.from_arrays([ids[i:j].cast(pa.int64()), pa.array(n, pa.int64()), pa.array(c, mask=n == 0), uids[i:j]], ["doc_id", "n", "cls", "uid"])

    return run


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unsix(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _found_in(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _often(width: int):
    """Of a task's texts the shingles that several of its classes have, and how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, h, classes = np.zeros(0, np.int64), [], 0
        for batch in batches:
            for _, _, data, at in text_slices(batch.column(0), 1_000_000):
                x, at = shingle_sets(data, at, width)
                n, c = _class_ids(x, at)
                _, once = np.unique(c, return_index=True)
                new = np.zeros(len(c), bool)
                new[once] = True
                new &= (n > 0) & ~np.isin(c, seen)
                seen = np.concatenate([seen, c[new]])
                classes += int(new.sum())
                h.append(x[np.repeat(new, n)])
        if h:
            x, n = np.unique(np.concatenate(h), return_counts=True)
            use = n >= max(2, classes // 100)
            yield pa.RecordBatch.from_arrays([pa.array(x[use].view(np.int64)), pa.array(n[use], pa.int64())], ["h", "n"])

    return run


def hot_shingles(texts: DataFrame, width: int, count: int, sample: int = 4_000, most: int = 1 << 16) -> np.ndarray:
    """Shingles, sorted, that many classes have: those that two classes share for certain, by about `sample` of the texts (a
    column; count: of all). They only decide where a shingle is counted, so results are the same with any sample."""
    some = texts.where(F.rand(11) < sample / max(1, count))
    top = some.mapInArrow(frugal(_often(width)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(most).toArrow()
    return np.sort(top["h"].to_numpy().astype(np.int64).view(np.uint64))


def _dealt(width: int, shards: int, keys: np.ndarray, hot):
    """For about SLICES MB of texts and each shard, one row with its classes' shingles that belong there. A hot shingle, of
    which it's known that classes share it, isn't counted in a shard of its own but in one by the class."""

    def rows(h: np.ndarray, c: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        _, once = np.unique(c, return_index=True)
        keep = np.zeros(len(c), bool)
        keep[once] = True
        keep &= n > 0
        owner = np.repeat(np.arange(len(n)), n)
        use = keep[owner]
        h, owner = h[use], owner[use]
        often = _found_in(h, hot.value)
        shard = np.where(often, (mixed(c.view(np.uint64)) % np.uint64(shards))[owner], h % np.uint64(shards)).astype(np.int64) * 2 + often
        order = np.argsort(shard, kind="stable")
        h, owner, shard = h[order], owner[order], shard[order]
        ends = np.searchsorted(shard, np.arange(2 * shards + 1)).tolist()
        out: list[list] = [[] for _ in range(10)]
        for k in range(shards):
            a, b, e = ends[2 * k : 2 * k + 3]
            if a == e:
                continue
            row = [int(keys[k]), k]
            for i, j, packed in ((a, b, lambda x: _six(x // np.uint64(shards))), (b, e, lambda x: x.tobytes())):
                who, times = np.unique(owner[i:j], return_counts=True)
                row += [c[who].tobytes(), times.astype("<u4").tobytes(), n[who].astype("<u4").tobytes(), packed(h[i:j])]
            for column, v in zip(out, row):
                column.append(v)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if i < 2 else pa.binary()) for i, x in enumerate(out)], _DEALT_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for _, _, data, at in text_slices(batch.column(0), 1_000_000):
                h, at = shingle_sets(data, at, width)
                n, c = _class_ids(h, at)
                held.append((h, c, n))
                if len(held) >= SLICES or sum(len(x[0]) for x in held) > SLICES * 200_000:
                    yield rows(*map(np.concatenate, zip(*held)))
                    held = []
        if held:
            yield rows(*map(np.concatenate, zip(*held)))

    return run


_DEALT = "key int, shard int, ids binary, counts binary, sizes binary, hashes binary, hot_ids binary, hot_counts binary, hot_sizes binary, hot_hashes binary"
_DEALT_NAMES = [x.split()[0] for x in _DEALT.split(", ")]


def _gathered(ids, counts, sizes, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes, their sizes, shingles, and whose each is."""
    ids = np.frombuffer(b"".join(ids), np.int64)
    counts = np.frombuffer(b"".join(counts), "<u4").astype(np.int64)
    sizes = np.frombuffer(b"".join(sizes), "<u4").astype(np.int64)
    return ids, sizes, h, np.repeat(np.arange(len(ids)), counts)


def _once(ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which shingles to use, so that each class counts once."""
    keep = np.zeros(len(ids), bool)
    keep[np.unique(ids, return_index=True)[1]] = True
    return keep[owner]


def _shared(shards: int, keys: np.ndarray):
    """Of a shard's shingles, those that two classes have, dealt to buckets by class."""

    def dealt(ids, sizes, h, owner, df, shard, packed) -> list[tuple]:
        bucket = (mixed(ids.view(np.uint64)) % np.uint64(shards)).astype(np.int64)[owner]
        order = np.argsort(bucket, kind="stable")
        h, owner, df, bucket = h[order], owner[order], df[order], bucket[order]
        ends = np.searchsorted(bucket, np.arange(shards + 1))
        rows = []
        for k in np.unique(bucket).tolist():
            a, b = ends[k], ends[k + 1]
            who, times = np.unique(owner[a:b], return_counts=True)
            rows.append((int(keys[k]), shard, ids[who].tobytes(), times.astype("<u4").tobytes(), sizes[who].astype("<u4").tobytes(), packed(h[a:b]), df[a:b].tobytes()))
        return rows

    def run(x: pd.DataFrame) -> pd.DataFrame:
        ids, sizes, h, owner = _gathered(x.ids, x.counts, x.sizes, _unsix(b"".join(x.hashes)))
        use = _once(ids, owner)
        h, owner = h[use], owner[use]
        order = np.argsort(h, kind="stable")
        new = np.ones(len(h), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        group = np.cumsum(new) - 1
        df = np.empty(len(h), np.int64)
        df[order] = np.bincount(group)[group] if len(h) else 0
        use = df > 1
        rows = dealt(ids, sizes, h[use], owner[use], np.minimum(df[use], 254).astype(np.uint8), int(x.shard.iloc[0]), _six)
        ids, sizes, h, owner = _gathered(x.hot_ids, x.hot_counts, x.hot_sizes, np.frombuffer(b"".join(x.hot_hashes), np.uint64))
        use = _once(ids, owner)
        rows += dealt(ids, sizes, h[use], owner[use], np.full(int(use.sum()), 255, np.uint8), -1, lambda v: v.tobytes())
        return pd.DataFrame(rows, columns=["bucket", "shard", "ids", "counts", "sizes", "hashes", "df"])

    return run


def _whole(shard: int, packed: bytes, shards: int) -> np.ndarray:
    """A row's shingles, of 48 bits beside the shard."""
    n = np.uint64(shards)
    if shard >= 0:
        return _unsix(packed) * n + np.uint64(shard)
    h = np.frombuffer(packed, np.uint64)
    return (h // n & np.uint64((1 << 48) - 1)) * n + h % n


def _kept(shards: int, percent: int):
    """The classes with enough shared shingles, and these from the rarest."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([_whole(k, b, shards) for k, b in zip(x.shard.tolist(), x.hashes)])
        ids, sizes, h, owner = _gathered(x.ids, x.counts, x.sizes, h)
        df = np.frombuffer(b"".join(x.df), np.uint8)
        u, at = np.unique(ids, return_inverse=True)
        n = np.zeros(len(u), np.int64)
        n[at] = sizes
        who = at[owner]
        keep = np.bincount(who, minlength=len(u)) * 100 >= percent * n
        use = keep[who]
        h, who, df = h[use], who[use], df[use]
        order = np.lexsort((h, df, who))
        h, who = h[order], who[order]
        ends = np.searchsorted(who, np.arange(len(u) + 1))
        some = np.flatnonzero(keep)
        return pd.DataFrame({"cls": u[some], "n": n[some], "k": np.diff(ends)[some], "hashes": [h[ends[i] : ends[i + 1]].tobytes() for i in some.tolist()]})

    return run


def _prefixes(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for part in range(0, len(x), 500):
                y = x.iloc[part : part + 500]
                n, k = y.n.to_numpy(), y.k.to_numpy()
                length = (n + (-percent * n) // 100 + 1) - (n - k)  # n - ceil(t n) + 1, less those that no other class has
                got = [np.frombuffer(b, np.int64, m) for b, m in zip(y.hashes, length.tolist())]
                yield pd.DataFrame({"h": np.concatenate([np.zeros(0, np.int64), *got]), "cls": np.repeat(y.cls.to_numpy(), length)})

    return run


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    got = [x for x in batches if len(x)]
    if got:
        h, c = np.concatenate([x.h.to_numpy() for x in got]), np.concatenate([x.cls.to_numpy() for x in got])
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        root = c[np.flatnonzero(new)][np.cumsum(new) - 1]
        some = root != c
        if some.any():
            v, r = forest(c[some], root[some])
            yield pd.DataFrame({"a": v, "b": r})


# Within a region ---------------------------------------------------------------------------------------------------


def _overlaps(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Shingles that each of rows has in common with each of cols. Shingles that many documents have are columns of a
    matrix product; those of up to SPARSE documents are counted pair by pair."""
    some = np.unique(np.concatenate([rows, cols]))
    lengths = np.array([len(sets[i]) for i in some.tolist()])
    flat, who = np.concatenate([sets[i] for i in some.tolist()]), np.repeat(np.arange(len(some)), lengths)
    total, r, c = np.zeros((len(rows), len(cols)), np.float32), np.searchsorted(some, rows), np.searchsorted(some, cols)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    group = np.cumsum(new) - 1
    df = np.bincount(group) if len(flat) else np.zeros(0, int)
    many = df > SPARSE
    use = many[group]
    at, own = (np.cumsum(many) - 1)[group[use]], who[use]
    for low in range(0, int(many.sum()), 4096):
        a, b = np.searchsorted(at, (low, low + 4096))
        x = np.zeros((len(some), min(4096, int(many.sum()) - low)), np.float32)
        x[own[a:b], at[a:b] - low] = 1
        total += x[r] @ x[c].T
    row_at, col_at = np.full(len(some), -1), np.full(len(some), -1)
    row_at[r], col_at[c] = np.arange(len(rows)), np.arange(len(cols))
    few = ~use & (df[group] > 1)
    group, who = group[few], who[few]
    for k in range(1, SPARSE):
        same = group[k:] == group[:-k]
        x, y = who[:-k][same], who[k:][same]
        for p, q in ((x, y), (y, x)):
            ok = (row_at[p] >= 0) & (col_at[q] >= 0)
            np.add.at(total, (row_at[p[ok]], col_at[q[ok]]), 1)
    both = np.flatnonzero((row_at >= 0) & (col_at >= 0))
    total[row_at[both], col_at[both]] = lengths[both]
    return total


def _cells(sets, n, home, members, percent):
    """Voronoi cells of members: (members, which of them are at home there)."""
    pivots = members[np.linspace(0, len(members) - 1, PIVOTS).astype(int)]
    both = _overlaps(sets, members, pivots)
    far = 1 - both / (n[members][:, None] + n[pivots][None, :] - both)
    near = far.argmin(1)
    r = 1 - percent / 100
    slack = 1e-5
    for k in range(len(pivots)):
        own = near == k
        at_home = own & home
        if at_home.any():
            radius = far[at_home, k].max()
            take = own | ((far[:, k] <= far.min(1) + 2 * r + slack) & (far[:, k] <= radius + r + slack))
            yield members[take], at_home[take]


def joined(sets: list[np.ndarray], n: np.ndarray, weight: np.ndarray, home: np.ndarray, percent: int, depth: int = 0, members: np.ndarray | None = None, apart: bool = False) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Weight that each member at home links with, and edges that connect what is linked. apart: links between members at home don't count."""
    members = np.arange(len(sets)) if members is None else members
    links, edges = np.zeros(len(sets), np.int64), []
    if not apart and len(members) > LEAF and depth < DEPTH:
        cells = list(_cells(sets, n, home, members, percent))
        if sum(len(m) ** 2 for m, _ in cells) < 0.8 * len(members) ** 2:
            for m, h in cells:
                l, e = joined(sets, n, weight, h, percent, depth + 1, m)
                links += l
                edges += e
            return links, edges
    own = members[home]
    members = members[~home] if apart else members
    for i in range(0, len(own), LEAF):
        rows = own[i : i + LEAF]
        for j in range(0, len(members), LEAF):
            cols = members[j : j + LEAF]
            both = _overlaps(sets, rows, cols)
            linked = 100 * both >= percent * (n[rows][:, None] + n[cols][None, :] - both)
            linked &= (rows[:, None] != cols[None, :]) & (both > 0)
            links[rows] += linked @ weight[cols]
            a, b = np.nonzero(linked)
            if len(a):
                ids, at = np.unique(np.concatenate([rows[a], cols[b]]), return_inverse=True)
                edges.append((ids, ids[united(len(ids), at[: len(a)], at[len(a) :])]))
    return links, edges


def _region(percent: int):
    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("cls", ignore_index=True)
        cls = x.cls.to_numpy()
        sets = [np.frombuffer(b, np.int64) for b in x.hashes]
        home = x.home.to_numpy(bool)
        links, edges = joined(sets, x.n.to_numpy(), x.weight.to_numpy(), home, percent, apart=bool(x.i.iloc[0] != x.j.iloc[0]))
        a = np.concatenate([np.zeros(0, np.int64), *(p for p, _ in edges)])
        b = np.concatenate([np.zeros(0, np.int64), *(q for _, q in edges)])
        v, root = forest(a, b)
        return pd.concat([pd.DataFrame({"cls": cls[home], "links": links[home], "root": None}), pd.DataFrame({"cls": cls[v.astype(int)], "links": 0, "root": cls[root.astype(int)]})]).astype({"root": "Int64"})

    return run


def _nearest(percent: int):
    """A block of a large region and its pivots: the cells where each document of the block has to be."""

    def run(x: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(p):
            return pd.DataFrame({"region": [], "cls": [], "home": [], "cell": [], "d": [], "near": []})
        sets = [np.frombuffer(b, np.int64) for b in [*x.hashes, *p.hashes]]
        n = np.concatenate([x.n.to_numpy(), p.n.to_numpy()])
        rows, cols = np.arange(len(x)), len(x) + np.arange(len(p))
        both = _overlaps(sets, rows, cols)
        far = (1 - both / (n[rows][:, None] + n[cols][None, :] - both)).astype(float)
        near, least = far.argmin(1), far.min(1)
        r, k = 1 - percent / 100, len(p)
        out = pd.DataFrame({"region": np.repeat(x.region.to_numpy(), k), "cls": np.repeat(x.cls.to_numpy(), k), "home": np.repeat(x.home.to_numpy(bool), k), "cell": np.tile(p.cls.to_numpy(), len(x)), "d": far.ravel(), "near": (near[:, None] == np.arange(k)).ravel()})
        return out[out.near | (out.d <= np.repeat(least, k) + 2 * r + 1e-5)]

    return run


def _cut(regions: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Regions (region, cls, home), each cut into the Voronoi cells of some of its documents."""
    block = F.pmod(F.xxhash64("cls"), F.greatest(F.lit(1), F.ceil(F.col("total") / REGION_SHINGLES * 4)).cast("int"))
    drawn = [F.min(F.struct(F.xxhash64("cls", F.lit(k)), "cls"))["cls"] for k in range(PIVOTS)]
    total = regions.join(sets.select("cls", "k"), "cls").groupBy("region").agg(F.sum("k").alias("total"), F.array_distinct(F.array(*drawn)).alias("some"))
    rows = regions.join(total, "region").withColumn("block", block)
    pivots = total.select("region", "total", F.explode("some").alias("cls")).join(sets.select("cls", "n", "hashes"), "cls")
    pivots = pivots.withColumn("block", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("total") / REGION_SHINGLES * 4)).cast("int") - 1)))
    left = rows.join(sets.select("cls", "n", "hashes"), "cls").select("region", "block", "cls", "home", "n", "hashes").groupBy("region", "block")
    right = pivots.select(F.col("region").alias("p_region"), F.col("block").alias("p_block"), "cls", "n", "hashes").groupBy("p_region", "p_block")
    placed = written(left.cogroup(right).applyInPandas(_nearest(percent), "region long, cls long, home boolean, cell long, d double, near boolean"), "jaccard-cells")
    radius = placed.where("near AND home").groupBy("region", "cell").agg(F.max("d").alias("radius"))
    kept = placed.join(radius, ["region", "cell"]).where(F.col("near") | (F.col("d") <= F.col("radius") + (1 - percent / 100) + 1e-5))
    return written(kept.select(F.xxhash64("region", "cell").alias("region"), "cls", (F.col("home") & F.col("near")).alias("home")), "jaccard-regions")


def links(classes: DataFrame, sets: DataFrame, percent: int, region_shingles: int = REGION_SHINGLES) -> DataFrame:
    """(cls, links, root): weight linked with, where root is null; else an edge."""
    spark = sets.sparkSession
    prefix = sets.select("cls", "n", "k", "hashes").mapInPandas(frugal(_prefixes(percent)), "h long, cls long")
    stars = prefix.repartition(partitions(spark), "h").mapInPandas(frugal(_stars), "a long, b long")
    regions = written(components(stars, "jaccard-stars", reduced=True).select(F.col("c").alias("region"), F.col("v").alias("cls"), F.lit(True).alias("home")), "jaccard-regions")
    done, shrunk = [], None
    for depth in range(DEPTH):
        total = regions.join(sets.select("cls", "k"), "cls").groupBy("region").agg(F.sum("k").alias("total"))
        large = total.where(F.col("total") > region_shingles).select("region")
        count = total.where(F.col("total") > region_shingles).agg(F.sum("total")).first()[0] or 0
        if not count or (shrunk is not None and count > 0.8 * shrunk):
            break
        shrunk = count
        done.append(regions.join(large, "region", "left_anti"))
        regions = _cut(regions.join(large, "region", "left_semi"), sets, percent)
    for part in done:
        regions = regions.unionByName(part)
    # Regions that are still large are joined block against block: a document at home goes to each block of members.
    total = regions.join(sets.select("cls", "k"), "cls").groupBy("region").agg(F.sum("k").alias("total"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("total") * 2 / region_shingles)).cast("int")
    rows = regions.join(total.withColumn("blocks", F.when(F.col("total") <= region_shingles, 1).otherwise(blocks)).drop("total"), "region")
    rows = rows.withColumn("at", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    at_home = rows.where("home").withColumn("other", other).select("region", F.col("at").alias("i"), F.col("other").alias("j"), "cls", F.lit(True).alias("home"))
    member = rows.withColumn("other", other).select("region", F.col("other").alias("i"), F.col("at").alias("j"), "cls", F.lit(False).alias("home"))
    pairs = at_home.unionByName(member).groupBy("region", "i", "j", "cls").agg(F.max("home").alias("home"))  # one row of each document in a pair of blocks
    # In a pair of blocks (i, j), i <> j, rows of block i are at home and rows of block j are members.
    pairs = pairs.join(sets.select("cls", "n", "hashes"), "cls").join(classes.select("cls", "weight"), "cls")
    return pairs.groupBy("region", "i", "j").applyInPandas(frugal(_region(percent)), "cls long, links long, root long")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 70, region_shingles: int = REGION_SHINGLES) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, n_similar, component_id, uid (monotonically_increasing_id of docs), and
    first: whether this row is the one of its component with the least doc_id (null last; then the least uid)."""
    spark = session(docs)
    docs = columns(docs, id_col, text_col).toDF("doc_id", "text")
    each = written(docs.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(frugal(_classed(width)), "doc_id long, n long, cls long, uid long"), "jaccard-classes")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "uid")
    classes = written(each.where("cls IS NOT NULL").groupBy("cls").agg(F.count(F.lit(1)).alias("weight"), F.min(order).alias("least"), F.first("n").alias("n")).select("cls", "weight", F.col("least.doc_id").alias("least"), F.col("least.uid").alias("first"), "n"), "jaccard-weights")
    total = classes.agg(F.sum("n")).first()[0] or 0
    shards = int(min(32_000, max(partitions(spark), -(-total // SHARD))))
    keys = np.array(spread(shards, partitions(spark)))
    texts = docs.select("text").where("text IS NOT NULL")
    hot = spark.sparkContext.broadcast(hot_shingles(texts, width, each.count()))
    dealt = texts.mapInArrow(frugal(_dealt(width, shards, keys, hot)), _DEALT)
    shared = dealt.groupBy("key").applyInPandas(frugal(_shared(shards, keys)), "bucket int, shard int, ids binary, counts binary, sizes binary, hashes binary, df binary")
    sets = written(shared.groupBy("bucket").applyInPandas(frugal(_kept(shards, percent)), "cls long, n long, k long, hashes binary"), "jaccard-sets")
    found = written(links(classes, sets, percent, region_shingles), "jaccard-links")
    linked = found.where("root IS NULL").groupBy("cls").agg(F.sum("links").alias("links"))
    comp = components(found.where("root IS NOT NULL").select(F.col("cls").alias("a"), F.col("root").alias("b")), "jaccard-edges").withColumnRenamed("v", "cls")
    lowest = F.min(F.struct(F.col("least").isNull(), "least", "first")).alias("low")
    least = comp.join(classes.select("cls", "least", "first"), "cls").groupBy("c").agg(lowest)
    result = classes.select("cls", "weight", "least", "first").join(linked, "cls", "left").join(comp.join(least, "c").select("cls", "low"), "cls", "left")
    own = F.col("low").isNull()
    result = result.select("cls", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_similar"), F.when(own, F.col("least")).otherwise(F.col("low.least")).alias("component_id"), F.when(own, F.col("first")).otherwise(F.col("low.first")).alias("first"))
    out = each.join(result, "cls", "left")
    alone = F.col("cls").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).alias("n_similar"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "uid", (alone | (F.col("uid") == F.col("first"))).alias("first"))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 70, region_shingles: int = REGION_SHINGLES) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, n_similar, component_id. See the module's text for every case."""
    return grouped(docs, id_col, text_col, width, percent, region_shingles).drop("uid", "first")


ORACLE = """WITH RECURSIVE t AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT uid, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] END) AS s FROM t),
n AS (SELECT uid, doc_id, len(s) AS n FROM s),
x AS (SELECT uid, unnest(s) AS g FROM s),
b AS (SELECT a.uid AS a, b.uid AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.uid < b.uid GROUP BY 1, 2),
p AS (SELECT a, b FROM b JOIN n x ON x.uid = a JOIN n y ON y.uid = b WHERE 100 * k >= 70 * (x.n + y.n - k)),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT uid AS v, uid AS w FROM n UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.w),
c AS (SELECT r.v AS uid, min(n.doc_id) AS component_id FROM r JOIN n ON n.uid = r.w GROUP BY r.v),
l AS (SELECT a AS uid, count(*) AS n_similar FROM e GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, coalesce(l.n_similar, 0) AS n_similar, c.component_id FROM n JOIN c USING (uid) LEFT JOIN l USING (uid)"""
