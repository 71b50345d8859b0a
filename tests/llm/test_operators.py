import re
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscan.llm import _common, embedding_dedup, hnsw, jaccard_join, language_id, licenses, mixing, packing, quality, sharding, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def brute_jaccard(docs, percent=70):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    near = [{j for j, b in enumerate(sets) if j != i and a and b and 100 * len(a & b) >= percent * len(a | b)} for i, a in enumerate(sets)]
    out = []
    for i, a in enumerate(sets):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [docs[j][0] for j in seen if docs[j][0] is not None]
        out.append((docs[i][0], len(a), len(near[i]), min(ids) if ids else None))
    return out


@pytest.mark.parametrize("region", [4_000_000, 300])
def test_jaccard(spark, documents, region, monkeypatch):
    monkeypatch.setattr(jaccard_join, "REGION_SHINGLES", region)
    rng = np.random.default_rng(1)
    texts = []
    for g in range(12):
        w = [f"w{k}" for k in rng.integers(0, 40, 50)]
        for _ in range(8):
            v = list(w)
            for at in rng.integers(0, 50, rng.integers(0, 8)):
                v[at] = f"n{rng.integers(0, 9)}"
            texts.append(" ".join(v))
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").union(more)
    data = [(r.doc_id, r.text) for r in docs.collect()]
    got = rows(jaccard_join.similar(docs, region_shingles=region))
    want = sorted(brute_jaccard(data), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
    assert got == want
    assert rows(jaccard_join.similar(documents)) == rows(jaccard_join.similar(documents.select("text", "doc_id")))
    assert jaccard_join.similar(documents.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))]
    df = spark.createDataFrame(e, "a long, b long")
    one, stars = rows(_common.components(df, "t")), rows(_common.components(df, "t", one_task=0))
    assert one == stars
    same = dict(one)
    assert all(same[a] == same[b] for a, b in e) and all(c <= v for v, c in one)


def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 24))
    x[300:330] = x[0] + rng.normal(size=(30, 24)) * 0.15
    x[400:420] = x[1]
    data = [(i, [float(v) for v in r], "l") for i, r in enumerate(x)]
    bad = [(900, None, "l"), (920, [], "l"), (940, [0.0] * 24, "l"), (960, [1.0, None] + [1.0] * 22, "l"), (980, [float("nan")] * 24, "l"), (1000, [float("inf")] * 24, "l"), (None, data[5][1], "l"), (7, data[7][1], "l")]
    return spark.createDataFrame(data + bad, "vec_id long, embedding array<double>, label string"), x


def test_embeddings(spark):
    df, x = vectors(spark)
    got = embedding_dedup.near_duplicates(df).collect()
    assert len(got) == 908
    v = np.concatenate([x, x[5:6], x[7:8]])
    ids = [*range(900), None, 7]
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    want = sorted((str(i), int(n)) for i, n in zip(ids, near.sum(1)))
    found = sorted((str(r.vec_id), r.n_links) for r in got if r.vec_id is None or r.vec_id < 900)
    assert sum(a == b for a, b in zip(found, want)) >= 0.97 * len(want)
    by = {r.vec_id: r for r in got}
    assert all(by[i].n_links == 0 and by[i].kept for i in (900, 920, 940, 960, 980, 1000))
    assert by[400].component_id == 1 and not by[400].kept and by[1].kept
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    assert embedding_dedup.near_duplicates(df.where("vec_id > 899")).count() == 6


def test_embeddings_large_group(spark):
    """A third of the rows are near copies of each other: every link is found, from both ends."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 64))
    x[2000:4000] = x[0] + rng.normal(size=(2000, 64)) * 0.29
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = (u @ u.T >= 0.9).sum(1) - 1
    assert want[2000:4000].mean() > 1000
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    assert [got[i] for i in range(6000)] == want.tolist()


def test_neighbours(spark):
    df, x = vectors(spark)
    got = hnsw.nearest(df).collect()
    v, ids = np.concatenate([x, x[5:6], x[7:8]]), [*range(900), None, 7]
    hit = total = 0
    for q in range(0, 900, 20):
        s = v @ x[q]
        s[q] = -np.inf
        best = set(np.argsort(-s, kind="stable")[:20].tolist())
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(a.score > b.score or (a.score == b.score and (b.vec_id is None or a.vec_id <= b.vec_id)) for a, b in zip(mine, mine[1:]))
        hit += len({ids[i] for i in best} & {r.vec_id for r in mine})
        total += 20
    assert hit >= 0.9 * total
    assert {r.query_id for r in got} == set(range(0, 900, 20))
    few = hnsw.nearest(df.where("vec_id < 5 AND vec_id <> 7")).collect()
    assert len(few) == 4 and hnsw.nearest(df.limit(0)).count() == 0


def test_tokens(spark, documents):
    t = Tokenizer.from_file(BYTE)
    data = documents.select("doc_id", "text").collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in data)
    got = token_counts.token_counts(documents, BYTE).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.token_counts(documents.limit(0), BYTE).count() == 0


def test_packing(spark, documents):
    t = Tokenizer.from_file(WORD)
    want = []
    for r in documents.select("doc_id", "text").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            want.append((str(r.doc_id), k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())))
    got = packing.pack(documents, WORD).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 4096
    assert packing.pack(documents.limit(0), WORD).count() == 0


def test_exchange(spark):
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 101, 3000)
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "uid long, length long")
    got = packing.packed(items, 100, partition=200).collect()
    assert len(got) == len({r.uid for r in got}) == 3000
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + int(lengths[r.uid])
    assert max(fill.values()) <= 100
    assert packing.least_bins(lengths, 100) <= len(fill) <= 1.03 * packing.least_bins(lengths, 100)
    assert packing.least_bins(np.array([60, 60, 60, 30]), 100) == 3 and packing.least_bins(np.array([], int), 100) == 0


def test_mixing(spark, documents):
    got = mixing.mix(documents).collect()
    assert len(got) == 17 and all(r.taken <= 2 * r.size for r in got)
    sizes, target = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        target[r.source] = r.target
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert all(target[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    assert rows(mixing.mix(documents).drop("uid")) == rows(mixing.mix(documents).drop("uid"))
    assert mixing.mix(documents.limit(0)).count() == 0
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.expr("repeat('a ', cast(1 + id % 50 as int))").alias("text"), F.expr("concat('s', id % 4)").alias("source"))
    by = mixing.mix(many).groupBy("source").agg(F.first("target"), F.sum("taken")).collect()
    assert all(abs(b - a) <= 100 for _, a, b in by)


def test_sharding(spark, documents):
    got = sharding.shards(documents).collect()
    want = sorted((len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in documents.select("text").collect())
    assert sorted((r.size, r.text_crc32) for r in got) == want
    big = sharding.shards(spark.range(1003).selectExpr("id AS doc_id", "cast(id AS string) AS text").repartition(5))
    by = {}
    for r in big.collect():
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(map(len, by.values())) == [125] * 5 + [126] * 3 and all(sorted(s) == list(range(len(s))) for s in by.values())
    m = sharding.matrix([100, 0, 7, 300], 8, 1)
    assert m.sum(1).tolist() == [100, 0, 7, 300] and m.sum(0).max() - m.sum(0).min() <= 1 and m.min() >= 0
    assert sharding.shards(documents.limit(0)).count() == 0


def test_language(spark, documents):
    got = language_id.identify(documents).collect()
    assert len(got) == 17
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[4] == by[5] == by[6] == by[10] == "und" and {by[1], by[15]} <= {"en", "de"}  # learned here; 15 itself is held out
    assert language_id.identify(documents.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify(documents.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = language_id.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert r > 0.97


def test_language_trains_on_all(spark):
    """Every row that isn't held out counts, however many a language has."""
    docs = spark.range(12_000).selectExpr("id AS doc_id", "'abc xyz' AS text", "if(id < 40, 'de', 'en') AS lang")
    langs, table = language_id.learn(docs).value
    n = {lang: 7 * sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in ids) for lang, ids in (("de", range(40)), ("en", range(40, 12_000)))}
    assert langs == ["de", "en"]
    for k, lang in enumerate(langs):  # of an unseen bucket the probability is 0.05 of all counts and as much for each bucket
        assert 0.05 / np.exp(table[:, k].min().astype(float)) == pytest.approx(n[lang] + 0.05 * language_id.BUCKETS, rel=1e-4)


def test_quality(spark, documents, labels):
    got = quality.classify(documents, labels).collect()
    assert len(got) == 17 and not any(r.keep for r in got if r.doc_id in (4, 5))
    assert quality.classify(documents.limit(0), labels).count() == 0
    assert quality.classify(documents, labels.limit(0)).count() == 17


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    r = quality.classify(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int"))).collect()
    share = dict(map(tuple, r))
    assert share[1] > 0.97 and share[0] < 0.4


def test_quality_pooled(spark):
    """Rows of no language, of one without trusted text and of one with a single trusted text are judged by the pool."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang"), spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    good = [r.text for r in docs.join(labels.where("quality = 1"), "doc_id").where("lang = 'en' AND length(text) BETWEEN 300 AND 3000").orderBy("doc_id").limit(12).collect()]
    junk = "|#| 7 ## @@ 9;; Q{}~ %% 3 ^^ " * 40
    new = [(-1, junk, None), (-2, junk, "xx"), (-3, junk, "yy"), (-4, good[0], "yy")] + [(-10 - k, t, lang) for k, t in enumerate(good) for lang in (None,)]
    got = {r.doc_id: r for r in quality.classify(docs.unionByName(spark.createDataFrame(new, docs.schema)), labels.union(spark.createDataFrame([(-4, 1)], labels.schema))).collect()}
    assert not any(got[i].keep for i in (-1, -2, -3)) and got[-4].keep
    assert all(got[i].threshold is not None for i in (-1, -2, -3)) and sum(got[-10 - k].keep for k in range(12)) >= 11


def test_quality_trains_on_all(spark):
    """Of many trusted texts each half trains, or sets the threshold, whatever their number: the words of half of them are known."""
    rng = np.random.default_rng(8)
    n = 30_000
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzäöüßéèàçñøåœ"))
    words = ["".join(w) for w in letters[rng.integers(0, len(letters), (n, 8))]]
    times = rng.integers(1, 6, n)
    new = [(i, " ".join([w] * int(k)), "en") for i, (w, k) in enumerate(zip(words, times))] + [(n + i, w, "en") for i, w in enumerate(words)]
    docs = spark.createDataFrame(new, "doc_id long, text string, lang string")
    got = quality.classify(docs, docs.where(F.col("doc_id") < n).selectExpr("doc_id", "1 AS quality")).where(F.col("doc_id") >= n)
    p = np.array([r.perplexity for r in got.select("perplexity").collect()])
    assert abs((p < 13).mean() - 0.5) < 0.03, np.quantile(p, [0.1, 0.3, 0.4, 0.45, 0.48, 0.5, 0.52, 0.55, 0.6, 0.9])


def test_kneser_ney(spark):
    """Probabilities of all bytes after a context add up to one."""
    texts = spark.createDataFrame([("abracadabra abra",), ("banana band",)], "text string").withColumn("lang", F.lit(3))
    model = quality.train(texts)
    for context in (b"abra", b"\x02\x02\x02\x02", b"zzzz", b"anan"):
        head = (3 << 40) | int.from_bytes(context, "big") << 8
        p = quality.probabilities(spark.createDataFrame([(head | b,) for b in range(256)], "k long"), model)
        assert abs(p.agg(F.sum(F.exp("logp"))).first()[0] - 1) < 1e-4


def test_licenses(spark, documents):
    got = {r.doc_id: r for r in licenses.scan(documents).collect()}
    assert got[14].licenses == got[14].whole_license == "MIT" and got[14].n_license_lines == 1
    assert got[4].licenses is None and got[4].n_units == 0 and got[1].licenses is None
    assert licenses.scan(documents).count() == 17 and licenses.scan(documents.limit(0)).count() == 0
    whole = spark.createDataFrame([(1, "MIT LICENCE\n\nCopyright 1999, x\n" + licenses._MIT.lower())], "doc_id long, text string")
    assert licenses.scan(whole).first().whole_license == "MIT"


def test_licenses_notices(spark):
    """Only notices go: known texts are found however they are wrapped, and body lines count."""
    own = {"MIT": licenses._MIT, "ISC": licenses._ISC, "Apache-2.0": licenses._APACHE}
    notices = ("", "Copyright (c) 2020-2024 Jane Roe\n", "// © 2019 Roe Ltd.\n\n", "(C) 2001 x\n", " * Copyright The Roe Authors\n", "Portions Copyright 1999 by me\n")
    texts = []
    for name, text in own.items():
        for width in (30, 37, 45, 60, 66, 72, 78, 80, 100, 100_000):
            body = "\n".join(textwrap.fill(x, width, break_long_words=False, break_on_hyphens=False) for x in text.split("\n"))
            texts += [(name, n + body) for n in notices]
        texts += [(name, " ".join(text.split())), (name, "Copyright (c) 2020 Jane Roe. All rights reserved. " + " ".join(text.split()))]
    first = licenses._MIT.split("\n")[0]
    texts += [("MIT", "MIT License Copyright (c) 2020 Jane Roe " + " ".join(licenses._MIT.split())), (None, first), (None, first + "\nThe copyright of all else is sold."), (None, "Copyright (c) 2020 Jane Roe")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert [(i, got[i].whole_license) for i in got if got[i].whole_license != texts[i][0]] == []
    assert got[len(texts) - 2].n_units == 2 and got[len(texts) - 1].n_units == 0


def test_language_stage(spark):
    """Texts evenly mixed of languages and texts of none of them go; others stay."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by = {lang: " ".join(r.text for r in docs.where((F.col("lang") == lang) & (F.length("text") > 300)).limit(6).collect()).split() for lang in ("en", "de", "fr", "es")}
    mixed = lambda *ls: " ".join(" ".join(by[lang][k : k + 1]) for k in range(120) for lang in ls)
    rng = np.random.default_rng(6)
    foreign = " ".join("".join(rng.choice(list("qxzwkjyvh"), 7)) for _ in range(200))
    new = [(-1, mixed("en", "de", "fr")), (-2, mixed("en", "de", "fr", "es")), (-3, foreign), (-4, "это " * 3 + "совсем другой язык текста " * 20), (-5, mixed("en"))]
    more = spark.createDataFrame(new, "doc_id long, text string").select("doc_id", "text", *[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields[2:]])
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs.unionByName(more), "").select("doc_id").collect()}
    assert {i for i in kept if i < 0} == {-5}
    assert len(kept) > 0.97 * docs.where(r"text rlike '\\p{L}'").select("doc_id").distinct().count()


def test_pipeline(spark, documents, labels, tmp_path):
    import corpus_pipeline

    documents.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    labels.coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        if k < 4:
            assert docs.columns == before.columns
        if k == 2:
            once = jaccard_join.similar(before).select("component_id").distinct().count()
            assert docs.count() == once
    assert docs.count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
