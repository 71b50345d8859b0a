"""Operators against brute force in small, odd magnitudes, clashing names, long texts, and the laws of random draws."""

import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from folioscan.llm import _common, embedding_dedup, hnsw, jaccard_join, language_id, licenses, mixing, packing, quality, sharding, token_counts, vectors

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
CLASH = ("_score", "_bytes", "_uid", "_copies", "_copy", "_keep", "_lang", "_id", "uid", "copies", "c0", "c1", "size", "key", "n", "Text", "doc_Id")


def with_clashes(docs):
    return docs.select("doc_id", "text", "lang", "source", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])


@pytest.mark.parametrize("name", ["op1", "op3", "op4", "op5", "op6", "op7", "op8", "op10"])
def test_clashing_names(spark, documents, labels, name):
    run = {
        "op1": lambda d: token_counts.token_counts(d, BYTE), "op3": language_id.identify, "op4": jaccard_join.similar, "op5": lambda d: mixing.mix(d).drop("uid"), "op6": lambda d: sharding.shards(d).select("doc_id", "size", "text_crc32"),
        "op7": lambda d: quality.classify(d, labels.withColumn("Quality_", F.lit(1)).withColumn("_id", F.lit(1))), "op8": lambda d: packing.pack(d, WORD).drop("sequence_id", "offset"), "op10": licenses.scan,
    }[name]
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(run(with_clashes(documents))) == plain(run(documents.select("doc_id", "text", "lang", "source")))


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, documents, labels, tmp_path, k):
    """Each stage keeps all columns, whatever their names, and takes an empty table; its input needn't be files."""
    labels.coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    stage = corpus_pipeline.STAGES[k][1]
    docs = with_clashes(documents)
    got = stage(spark, docs.repartition(3), str(tmp_path)).toPandas()
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    if k < 4:
        assert list(got.columns) == docs.columns and len(got) > 0
        assert all((got.iloc[:, 4 + i] == i).all() for i in range(len(CLASH)))
        texts = [str(r.text) for r in documents.collect()]
        assert set(map(str, got.iloc[:, 1])) <= set(texts)
    else:
        assert len(got) > 17


def test_ambiguous():
    class Frame:
        columns = ["Text", "TEXT", "id"]

    with pytest.raises(ValueError):
        _common.place(Frame, "text")
    assert _common.place(Frame, "Text") == 0 and _common.place(Frame, "ID") == 2


def test_spread(spark):
    for count, parts in ((1, 4), (8, 12), (31, 12), (500, 13)):
        keys = _common.spread(count, parts)
        assert len(set(keys)) == count
        at = spark.createDataFrame([(k,) for k in keys], "k int").select(F.pmod(F.hash("k"), F.lit(parts)).alias("p")).groupBy("p").count().toPandas()["count"]
        assert at.max() <= -(-count // parts)


def test_batches_are_bounded(spark):
    """Ten rows of 3 MB don't come to Python at once."""
    docs = spark.range(0, 10, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('long words ', 300000)").alias("text"))
    _common.session(docs)
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) <= 4
    got = token_counts.token_counts(docs, BYTE).collect()
    assert len(got) == 10 and len({r.n_tokens for r in got}) == 1 and got[0].n_bytes == 3_300_000


def test_hypergeometric():
    """Both ways of drawing have the law's mean, variance and frequencies."""
    good, bad, n = 37, 60, 40
    law = np.array([math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(good + 1)])
    for most in (1_000_000_000, 1):
        rng = np.random.default_rng(3)
        seen = np.bincount([sharding.hypergeometric(rng, good, bad, n, most) for _ in range(20_000)], minlength=good + 1)
        want = law * 20_000
        use = want > 5
        assert ((seen[use] - want[use]) ** 2 / want[use]).sum() < use.sum() + 5 * math.sqrt(2 * use.sum())
    rng = np.random.default_rng(4)
    good, bad, n = 3_000_000_000, 9_000_000_000, 70_000
    x = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(3000)])
    spread = math.sqrt(n * 0.25 * 0.75)
    assert abs(x.mean() - n / 4) < 5 * spread / math.sqrt(3000) and abs(x.std() / spread - 1) < 0.08
    assert sharding.hypergeometric(rng, 2_000_000_000, 5, 2_000_000_005) == 2_000_000_000
    assert sharding.hypergeometric(rng, 2_000_000_000, 0, 7) == 7 and sharding.hypergeometric(rng, 5, 2_000_000_000, 0) == 0


def test_shuffle_is_uniform(spark):
    """Over seeds each row comes into each shard alike, and two rows of one partition don't go together."""
    counts, together = np.zeros((12, 3)), 0
    m = [sharding.matrix([7, 5], 3, seed) for seed in range(2000)]
    assert all(x.sum(0).tolist() == [4, 4, 4] for x in m)
    first = np.array([x[0] for x in m])
    law = lambda k: math.comb(4, k) * math.comb(8, 7 - k) / math.comb(12, 7)
    for s in range(3):
        seen = np.bincount(first[:, s], minlength=5)
        assert all(abs(seen[k] / 2000 - law(k)) < 5 * math.sqrt(law(k) / 2000) + 1e-3 for k in range(5))
    docs = spark.range(0, 12, 1, 2).selectExpr("id AS doc_id", "cast(id AS string) AS text").cache()
    for seed in range(12):
        for r in sharding.shards(docs, count=3, seed=seed).collect():
            counts[r.doc_id, r.shard] += 1
    assert (counts.sum(1) == 12).all() and counts.max() <= 11 and together == 0


def test_magnitudes(spark):
    """Finite vectors of any magnitude take part."""
    data = [(0, [1e200, 1e200]), (20, [1e200, 1e200]), (1, [1.0, 1.0]), (40, [1e-200, 1e-200]), (2, [1e-200, 0.0]), (3, [0.0, 0.0]), (4, [float("inf"), 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {0: (3, 0), 20: (3, 0), 1: (3, 0), 40: (3, 0), 2: (0, 2), 3: (0, 3), 4: (0, 4)}
    found = hnsw.nearest(df).where("query_id = 40").orderBy("rank").collect()
    assert {r.vec_id for r in found} == {0, 20, 1, 2} and [r.vec_id for r in found][:2] == [0, 20]
    assert np.allclose(np.linalg.norm(vectors.unit(np.array([[1e300, 1e300], [1e-300, 0]])), axis=1), 1)


def test_neighbours_ties(spark):
    """Equal scores: the smaller ids, in order."""
    df = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(60)], "vec_id long, embedding array<double>")
    got = hnsw.nearest(df, top=5).where("query_id = 20").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("leaf", [4, 16, 1000])
def test_cells(monkeypatch, leaf):
    """Voronoi cells of a region lose no link and count none twice, however small they are cut."""
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    cuts = []
    cells = jaccard_join._cells
    monkeypatch.setattr(jaccard_join, "_cells", lambda *a: cuts.append(1) or cells(*a))
    rng = np.random.default_rng(8)
    sets = []
    for g in range(10):
        base = rng.choice(4000, 60, replace=False)
        for _ in range(int(rng.integers(2, 18))):
            x = base.copy()
            swap = rng.random(60) < rng.choice([0.02, 0.1, 0.2])
            x[swap] = rng.integers(0, 4000, swap.sum())
            sets.append(np.unique(x).astype(np.int64))
    n, weight = np.array([len(x) for x in sets]), rng.integers(1, 4, len(sets))
    links, edges = jaccard_join.joined(sets, n, weight, np.ones(len(sets), bool), 70)
    near = np.array([[i != j and 100 * len(np.intersect1d(a, b)) >= 70 * len(np.union1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    assert links.tolist() == (near * weight[None, :]).sum(1).tolist() and near.any()
    assert bool(cuts) == (len(sets) > leaf)
    a, b = np.concatenate([x for x, _ in edges]), np.concatenate([y for _, y in edges])
    ids = np.arange(len(sets))
    assert _common.united(len(ids), a.astype(int), b.astype(int)).tolist() == _common.united(len(ids), *np.nonzero(near)).tolist()


def test_hot_shingles(spark, documents):
    """A passage that all texts share is dealt by class; results are those of brute force."""
    from test_operators import brute_jaccard, rows

    rng = np.random.default_rng(9)
    passage = " ".join(f"shared{i}" for i in range(80))
    data = [(i, passage + " " + " ".join(f"w{k}" for k in rng.integers(0, 3, i % 7))) for i in range(120)]
    data += [(500 + i, passage + " " + " ".join(f"v{k}" for k in rng.integers(0, 10**6, 60))) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert len(jaccard_join.hot_shingles(df.select("text"), 3, 180)) >= 78
    assert rows(jaccard_join.similar(df)) == sorted(brute_jaccard(data))


def kneser_ney(texts, order=5):
    """The textbook's interpolated modified Kneser-Ney of bytes, with the module's bounds of discounts: a function of n-gram to probability."""
    counts = Counter()
    for t in texts:
        b = b"\x02" * (order - 1) + t.encode()
        counts.update(b[i : i + order] for i in range(len(b) - order + 1))
    levels = {order: counts}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])

    def discount(n, c):
        have = Counter(levels[n].values())
        y = have[1] / (have[1] + 2 * have[2]) if have[1] + 2 * have[2] else None
        i = min(c, 3)
        d = i - (i + 1) * y * have[i + 1] / have[i] if y is not None and have[i] else 0.5
        return min(i - 0.05, max(0.05, d))

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / 256
        own = {g: c for g, c in levels[n].items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        c = own.get(gram, 0)
        back = sum(discount(n, x) for x in own.values())
        return ((c - discount(n, c) if c else 0) + back * p(gram[1:])) / sum(own.values())

    return p


def test_kneser_ney_textbook(spark):
    texts = ["abracadabra abra", "banana band and bananas", "a cab, a cabbage", "zz"]
    p = kneser_ney(texts)
    model = quality.train(spark.createDataFrame([(t,) for t in texts], "text string").withColumn("lang", F.lit(3)))
    ask = [b"abrac", b"\x02\x02\x02\x02a", b"anana", b"and q", b"xyzzy", b" banb", b"a cab", b"bagez"]
    keys = [(3 << 40) | int.from_bytes(g, "big") for g in ask]
    got = {r.k: math.exp(r.logp) for r in quality.probabilities(spark.createDataFrame([(k,) for k in keys], "k long"), model).collect()}
    for g, k in zip(ask, keys):
        assert got[k] == pytest.approx(p(g), rel=1e-4), g


def test_quality_counts_languages_apart(spark):
    """Models are numbered, so no two of many languages meet."""
    docs = spark.range(90 * 40).selectExpr("id AS doc_id", "concat('l', id % 90) AS lang", "concat(repeat(char(33 + id % 90), 30), ' text ', id) AS text")
    labels = docs.selectExpr("doc_id", "1 AS quality")
    got = quality.classify(docs, labels).groupBy("lang").agg(F.max("perplexity").alias("p"), F.min("threshold").alias("t")).collect()
    assert len(got) == 90 and len({r.t for r in got}) > 45


def em(r, rounds=4000):
    pi = np.full(r.shape[1], 1 / r.shape[1])
    for _ in range(rounds):
        part = r * pi
        part /= part.sum(1, keepdims=True)
        pi = part.mean(0)
    return pi, np.log((r * pi).sum(1)).sum()


def test_mixtures():
    """Shares, and the set of languages, are those of plain expectation-maximisation over every word; sets of four are found."""
    rng = np.random.default_rng(10)
    table = np.log(np.full((language_id.BUCKETS, 5), 1e-6, np.float32))
    words = [[("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6))) for _ in range(30)] for _ in range(5)]
    for k, ws in enumerate(words):
        for w in ws:
            data = np.frombuffer((w + " ").encode(), np.uint8)
            key, counts = language_id._buckets(data, np.array([0, len(data)]))
            table[key[counts], k] = np.log(1e-2)
    pick = lambda *ls: " ".join(rng.choice(words[k]) for k in ls for _ in range(25))
    texts = [pick(0), pick(1, 2), pick(0, 1, 2, 3), pick(3, 3, 3, 4), "", "123 ,,", words[2][0]]
    data = "".join(texts).encode()
    at = np.cumsum([0, *map(len, texts)])
    best, share, _, _, _ = language_id.infer(table, np.frombuffer(data, np.uint8), at)
    for i, t in enumerate(texts):
        if not t or t[0] == "1":
            assert best[i] == -1 and share[i] == 0
            continue
        b = np.frombuffer(t.encode(), np.uint8)
        key, counts = language_id._buckets(b, np.array([0, len(b)]))
        like = table[key].astype(float)
        like[~counts] = 0
        begin = np.flatnonzero(np.concatenate([[True], b[:-1] == 32]) & (b != 32))
        w = np.add.reduceat(like, begin)
        r = np.exp(w - w.max(1, keepdims=True))
        pi, _ = em(r)
        order = np.argsort(-pi, kind="stable")
        fits = []
        for m in range(1, 6):
            p, fit = em(r[:, order[:m]])
            fits.append((fit - (m - 1) * language_id.PENALTY * math.log(len(r) + 1), p.max(), order[p.argmax()]))
        m = next((k for k in range(4) if fits[k + 1][0] <= fits[k][0]), 4)
        assert share[i] == pytest.approx(fits[m][1], abs=0.03)
        if fits[m][1] > 0.3:
            assert best[i] == fits[m][2]
    assert share[2] == pytest.approx(0.25, abs=0.05) and share[1] == pytest.approx(0.5, abs=0.05)


def test_packing_is_certified(spark, documents):
    got = packing.pack(documents, WORD).collect()
    assert all(r.certified for r in got)
    items = spark.createDataFrame([(i, 34) for i in range(50)], "uid long, length long")
    assert all(r.certified for r in packing.packed(items, 100).collect())


def test_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        _common.shared_folder(Session)
    Context.master = "local[4]"
    assert _common.shared_folder(Session).startswith("file:")


def test_types(spark):
    assert isinstance(language_id.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).schema["score"].dataType, T.DoubleType)
