"""3. Language ID by multilingual mixture inference.

The languages' models are distributions of byte 4-grams of lower-cased letters, hashed to 2^16 buckets (so of fixed size
a language), counted from all rows of each language that aren't held out. A text is a mixture: each word comes from one language, and expectation-maximisation estimates the shares
from the words' n-gram likelihoods, until they stand still. Sets of 1, 2, ... languages, by share, are fitted anew each, as
long as the penalised likelihood rises, up to all of them, and that set is selected; the prediction is the largest share in it, the score that share. tag() also gives
what shares can't tell, as they are relative: the mean log likelihood a byte (_fit) of _letters bytes, to be held against
limits() of texts that didn't train, and the prediction's share in the mixture of all languages (_share).

Defined cases: null text, or one without a letter, is `und` with score 0; a table without usable labels predicts `und`
for all; ties go to the first language by code point; repeated rows give repeated rows; rows with a null id never train
and aren't held out; an empty table gives an empty result; further columns, of any name, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.llm._common import columns, frugal, session, text_slices, written

BUCKETS, PENALTY = 1 << 16, 4.0
#: EM ends when no share moves by more than STILL.
STILL, ROUNDS = 2e-3, 200
#: For limits(): bytes of median text added to each, texts that a limit needs, quartile distances and nats below the median.
SHRINK, FEWEST, QUARTILES, NATS = 100, 20, 8, 0.5
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _buckets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the n-gram that ends at each byte, and which bytes count: letters, and the first byte after a word."""
    b = _FOLD[data]
    key = b.astype(np.uint32)
    starts = at[:-1]
    for k in range(1, 4):
        before = np.empty(len(b), np.uint32)
        before[:k], before[k:] = 32, b[:-k] if k < len(b) else b[:0]
        for j in range(k):
            s = starts + j
            before[s[s < len(b)]] = 32
        key |= before << np.uint32(8 * k)
    counts = b != 32
    counts[1:] |= counts[:-1] & (b[1:] == 32)
    return ((key * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64), counts


def _lowered(texts: pa.Array) -> pa.Array:
    return pa.array([t.lower() if t is not None else "" for t in texts.to_pylist()], pa.large_string())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).dictionary_encode()
        names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        for i, j, data, at in text_slices(_lowered(batch.column(0))):
            key, counts = _buckets(data, at)
            of = np.repeat(code[i:j], np.diff(at))[counts]
            order = np.argsort(of, kind="stable")
            key, (own, begin) = key[counts][order], np.unique(of[order], return_index=True)
            for c, part in zip(own.tolist(), np.split(key, begin[1:])):
                n = np.bincount(part, minlength=BUCKETS)
                got[names[c]] = got[names[c]] + n if names[c] in got else n
    for lang, n in got.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], ["lang", "bucket", "n"])


def train(texts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities by bucket and language, of texts (text, lang)."""
    rows = texts.mapInArrow(frugal(_counted), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = rows.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts")).orderBy("lang").toArrow()  # at most BUCKETS entries a language
    langs = found["lang"].to_pylist()
    table = np.zeros((BUCKETS, len(langs)), np.float32)
    for k, counts in enumerate(found["counts"]):
        n = np.full(BUCKETS, 0.05)
        n[counts.values.field("bucket").to_numpy()] += counts.values.field("n").to_numpy()
        table[:, k] = np.log(n / n.sum())
    return langs, table


def _sub(r: np.ndarray, n: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their texts, these texts' first words and numbers of words, of some (boolean) of the texts."""
    m = n[some]
    return r[np.repeat(some, n)], np.repeat(np.arange(len(m)), m), np.cumsum(m) - m, m


def _shares(r: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares by EM and the log likelihood of each text, of its likelihoods of words. A text is done when no share moves by
    more than STILL; each step raises its likelihood, so it ends, and ROUNDS is a guard alone."""
    texts, langs = len(n), r.shape[1]
    pi = np.full((texts, langs), 1 / langs, np.float32)
    doc, begin = np.repeat(np.arange(texts), n), np.cumsum(n) - n
    if langs > 1:
        at, (own, who, first, m), now = np.arange(texts), (r, doc, begin, n), pi.copy()
        for k in range(ROUNDS):
            part = own * now[who]
            part /= part.sum(1, keepdims=True)
            new = np.add.reduceat(part, first) / m[:, None]
            moved = np.abs(new - now).max(1) > STILL
            now = new
            if not moved.any():
                break
            if k % 3 == 2 and moved.mean() < 0.8:  # texts that are done go
                pi[at] = now
                at = at[moved]
                own, who, first, m = _sub(own, m, moved)
                now = now[moved]
        pi[at] = now
    return pi, np.add.reduceat(np.log((r * pi[doc]).sum(1)).astype(np.float64), begin)


def infer(table: np.ndarray, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Language (-1: none), score, log likelihood, counted bytes and share among all languages of each text; of these lower-cased bytes."""
    docs, langs = len(at) - 1, table.shape[1]
    best, share, total, size_of, of_all = np.full(docs, -1), np.zeros(docs), np.zeros(docs), np.zeros(docs, np.int64), np.zeros(docs)
    key, counts = _buckets(data, at)
    letter = _FOLD[data] != 32
    first = letter.copy()
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first[1:] &= ~letter[:-1] | edge[1:-1]
    word = np.flatnonzero(first)
    if not len(word) or not langs:
        return best, share, total, size_of, of_all
    like = table[key]
    like[~counts] = 0
    w = np.add.reduceat(like, word)
    del like
    doc_at = np.searchsorted(at, word, "right") - 1
    some, begin, n = np.unique(doc_at, return_index=True, return_counts=True)
    doc = np.repeat(np.arange(len(some)), n)
    top = w.max(1, keepdims=True)
    r = np.exp(np.maximum(w - top, -60))
    pi, _ = _shares(r, n)
    order = np.argsort(-pi, 1, kind="stable")
    r = np.take_along_axis(r, order[doc], 1)
    value = np.full(len(some), -np.inf)
    pick, size, raw = np.zeros(len(some), int), np.zeros(len(some)), np.zeros(len(some))
    rising, own, m = np.arange(len(some)), r, n
    for k in range(1, langs + 1):
        p, plain = _shares(np.ascontiguousarray(own[:, :k]), m)
        fit = plain - (k - 1) * PENALTY * np.log(m + 1)
        better = fit > value[rising]
        at, p = rising[better], p[better]
        raw[at], value[at] = plain[better], fit[better]
        first = p.argmax(1)
        pick[at], size[at] = order[at, first], p.max(1)
        if not better.any():
            break
        own, _, _, m = _sub(own, m, better)
        rising = at
    best[some], share[some] = pick, size
    total[some] = raw + np.add.reduceat(top[:, 0].astype(np.float64), begin)
    size_of[some] = np.add.reduceat(np.add.reduceat(counts.astype(np.int64), word), begin)
    of_all[some] = pi[np.arange(len(some)), pick]
    return best, np.minimum(share, 1), total, size_of, np.minimum(of_all, 1)


def _tagged(model, out: list[str], text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = model.value
        names = np.array([*langs, "und"], object)
        for batch in batches:
            raw = batch.column(text_at)
            best, share = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            total, size, of_all = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for i, j, data, at in text_slices(_lowered(raw), max(200_000, 4_000_000 // max(4, len(langs)))):
                best[i:j], share[i:j], total[i:j], size[i:j], of_all[i:j] = infer(table, data, at)
            for i in np.flatnonzero(best >= 0).tolist():  # bytes from 128 on may be no letters
                if not _LETTER.search(raw[i].as_py()):
                    best[i], share[i] = -1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), pa.array(share), pa.array(total / np.maximum(size, 1)), pa.array(size), pa.array(of_all)], out)

    return run


def _remainder(id_col: str):
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Broadcast:
    """The languages' models, broadcast (of fixed size a language), from all rows that aren't held out."""
    spark = session(docs)
    known = docs.where((_remainder(id_col) != 1) & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    return spark.sparkContext.broadcast(train(known))


def tag(docs: DataFrame, model: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with _held_out, _lang_pred, _score, _fit, _letters, _share, names that docs must not have (see masked()); a narrow
    pass over docs."""
    session(docs)
    schema = T.StructType([*docs.schema.fields, T.StructField("_lang_pred", T.StringType()), T.StructField("_score", T.DoubleType()), T.StructField("_fit", T.DoubleType()), T.StructField("_letters", T.LongType()), T.StructField("_share", T.DoubleType())])
    out = docs.mapInArrow(frugal(_tagged(model, [f.name for f in schema.fields], docs.columns.index(text_col))), schema)
    return out.withColumn("_held_out", F.coalesce(_remainder(id_col) == 1, F.lit(False)))


def limits(docs: DataFrame, model: Broadcast, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """_lang_pred, _median, _limit: the least _fit, drawn towards the median, that a text of the language has, by all
    held-out texts of docs labelled and predicted as it; with fewer than FEWEST by those of all languages, and none if
    these are too few as well. A row for each language of the model."""
    spark = docs.sparkSession
    held_out = docs.where((_remainder(id_col) == 1) & F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    own = tag(held_out, model, "id", "text").where((F.col("_letters") > 0) & (F.col("lang") == F.col("_lang_pred"))).select("_lang_pred", "_fit", "_letters")
    own = written(own, "lang-fits")
    median = own.groupBy("_lang_pred").agg(F.percentile_approx("_fit", 0.5, 10_000).alias("_median"), F.count(F.lit(1)).alias("_n"))
    drawn = own.join(F.broadcast(median), "_lang_pred").withColumn("_gap", F.col("_letters") * (F.col("_median") - F.col("_fit")) / (F.col("_letters") + SHRINK))
    far = lambda x: F.greatest(F.lit(NATS), QUARTILES * F.percentile_approx(x, 0.75, 10_000))
    each = {r._lang_pred: r for r in drawn.groupBy("_lang_pred").agg(F.first("_median").alias("m"), F.first("_n").alias("n"), far("_gap").alias("far")).collect()}  # a row per language
    pool = drawn.agg(F.percentile_approx("_fit", 0.5, 10_000).alias("m"), F.count(F.lit(1)).alias("n"), far("_gap").alias("far")).first()
    out = []
    for lang in model.value[0]:
        r = each[lang] if lang in each and each[lang].n >= FEWEST else pool if pool.n >= FEWEST else None
        out.append((lang, r.m if r else None, r.m - r.far if r else None))
    return spark.createDataFrame(out, "_lang_pred string, _median double, _limit double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    docs = columns(docs, "doc_id", "text", "lang")
    rows = tag(docs, learn(docs))
    return rows.select("doc_id", F.col("_held_out").alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))
