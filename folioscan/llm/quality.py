"""7. Quality classifier: the perplexity of each text under an interpolated modified Kneser-Ney model of trusted text.

The model is one of bytes, of order 5 and per language (the column lang), as words of open vocabularies leave a word
model with unseen ones only. Every trusted text has one of two uses, by a hash of its id: training counts the 5-grams of
one half, the scores of the other half, held out, set the thresholds. Neither is sampled or bounded. Texts without a
language, and of those with fewer than 2 * FEWEST trusted texts, go by a model pooled over all languages (the sum of
their counts) and the threshold of all held-out texts under it; where there are no such texts, it isn't needed. Lower orders are
continuation counts; discounts come from the counts of counts. All of that are sharded tables by n-gram. Which rows are
trusted is joined by id alone and written under the key of their input split, where the passes over texts look it up.

Scoring joins counts where they are: each input split lists the distinct 5-grams that its texts hold (far fewer than its
bytes), the distinct ones of the corpus are joined order by order with the sharded counts, and each split's
probabilities are written to the shared folder under the split's key. A second pass over the same splits reads its own
table and adds up each document. So neither texts nor n-grams of single documents are ever shuffled, and nothing that
grows is broadcast. An n-gram that is missing in the table is an error, never skipped.

A document's score is its mean negative log probability a byte, drawn towards the language's median as if SHRINK bytes
of median text were added, for in a short text it says little. The threshold of a language lies as far above the
QUANTILE of its trusted held-out scores as that lies above their median, since text must not be dropped for being
in the last hundredth.

Defined cases: null and empty texts have no n-gram and score null; they are rejected. Where even the
pool has fewer than FEWEST / 2 held-out texts, texts with a letter are kept. Repeated rows are rows of their own; a score that equals the
threshold is kept; an empty table gives an empty result; further columns, of any name, are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.llm._common import columns, frugal, opened, partitions, session, shared_folder, text_slices, written

ORDER, SHRINK, QUANTILE = 5, 100, 0.99
#: Trusted texts to train on, and as many to hold out, that a language's own model needs; the number of the pooled one.
FEWEST, POOL = 20, (1 << 15) - 1  # models are numbered below 2^15; so many languages with trusted texts are never reached
_LANG = 8 * ORDER
_LOW = lambda n: (1 << (8 * n)) - 1


def _grams(data: np.ndarray, at: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each byte, below the language's 16 bits; before a text stand bytes 2."""
    key = np.repeat(lang.astype(np.int64) << _LANG, np.diff(at))
    key |= data
    starts = at[:-1]
    for k in range(1, ORDER):
        before = np.empty(len(data), np.int64)
        before[:k], before[k:] = 2, data[:-k] if k < len(data) else data[:0]
        for j in range(k):
            s = starts + j
            before[s[s < len(data)]] = 2  # may touch the next text, which sets it again
        key |= before << (8 * k)
    return key


class Slots:
    """A hash table of int64 keys in numpy: one slot per key; those that find theirs taken are kept sorted aside."""

    def __init__(self, bits: int = 21):
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.float32)
        self.aside, self.aside_values = np.zeros(0, np.int64), np.zeros(0, np.float32)

    def slot(self, k: np.ndarray) -> np.ndarray:
        return ((k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def add(self, k: np.ndarray, v: np.ndarray | None = None) -> None:
        """Distinct keys that aren't there."""
        v = np.zeros(len(k), np.float32) if v is None else v
        s = self.slot(k)
        _, first = np.unique(s, return_index=True)
        first = first[self.keys[s[first]] == -1]
        self.keys[s[first]], self.values[s[first]] = k[first], v[first]
        rest = np.ones(len(k), bool)
        rest[first] = False
        a, b = np.concatenate([self.aside, k[rest]]), np.concatenate([self.aside_values, v[rest]])
        order = np.argsort(a)
        self.aside, self.aside_values = a[order], b[order]

    def missing(self, k: np.ndarray) -> np.ndarray:
        k = np.unique(k[self.keys[self.slot(k)] != k])
        if len(self.aside) and len(k):
            at = np.minimum(np.searchsorted(self.aside, k), len(self.aside) - 1)
            k = k[self.aside[at] != k]
        return k

    def get(self, k: np.ndarray) -> np.ndarray:
        s = self.slot(k)
        out = self.values[s]
        miss = np.flatnonzero(self.keys[s] != k)
        if len(miss):
            if not len(self.aside):
                raise LookupError("an n-gram is missing in its split's table")
            at = np.minimum(np.searchsorted(self.aside, k[miss]), len(self.aside) - 1)
            if (self.aside[at] != k[miss]).any():
                raise LookupError("an n-gram is missing in its split's table")
            out[miss] = self.aside_values[at]
        return out

    def all(self) -> np.ndarray:
        return np.concatenate([self.keys[self.keys != -1], self.aside])


def _trusted(path: str, train: bool):
    """A function that keeps of a batch (with _block and _id) the rows that train, or those held out, by the splits' lists."""
    fs, root = opened(path)
    held: tuple[int | None, pa.Array | None] = (None, None)

    def kept(batch: pa.RecordBatch) -> pa.RecordBatch:
        nonlocal held
        block, ids = batch.column("_block").to_numpy(zero_copy_only=False), batch.column("_id")
        own = np.zeros(batch.num_rows, bool)
        for b in np.unique(block).tolist():
            if held[0] != b:
                t = pq.read_table(f"{root}/block={b}", filesystem=fs, columns=["_id", "train"], partitioning=None)
                held = (b, t["_id"].filter(pc.equal(t["train"], train)).drop_null().cast(ids.type).combine_chunks())
            own |= (block == b) & pc.is_in(ids, value_set=held[1]).to_numpy(zero_copy_only=False)
        return batch.filter(pa.array(own))

    return kept


def _only(path: str, train: bool, run):
    """run over the rows that train, or over those held out."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(map(_trusted(path, train), batches))

    return over


def _with_pool(path: str, run):
    """run over all rows (text, _lang, ...), and over those held out as rows of the pool as well."""

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_out = _trusted(path, False)
        for batch in batches:
            yield batch
            own = held_out(batch)
            yield own.set_column(1, own.schema.field(1), pa.array(np.full(own.num_rows, POOL), own.schema.field(1).type))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(twice(batches))

    return over


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang = batch.column(1).to_numpy(zero_copy_only=False)
        for i, j, data, at in text_slices(batch.column(0), 4_000_000):
            k, n = np.unique(_grams(data, at, lang[i:j]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n, pa.int64())], ["k", "c"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables: dict[int, Slots] = {}
    for batch in batches:
        block, lang = batch.column(2).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for i, j, data, at in text_slices(batch.column(0), 1_000_000):
            for b in np.unique(block[i:j]).tolist():  # nearly always one
                own = block[i:j] == b
                g = _grams(data, at, lang[i:j])
                if not own.all():
                    g = g[np.repeat(own, np.diff(at))]
                table = tables.setdefault(b, Slots())
                table.add(table.missing(g))
    for b, table in tables.items():
        k = np.sort(table.all())
        for i in range(0, len(k), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k[i : i + 100_000]), b)), pa.array(k[i : i + 100_000])], ["block", "k"])


def _low(col: str, n: int):
    """The last n bytes of an n-gram, with its language."""
    return F.col(col).bitwiseAND(F.lit(~_LOW(ORDER) | _LOW(n)))


def _context(col: str, n: int):
    """The n - 1 bytes before the last of an n-gram of order n, with its language."""
    return F.col(col).bitwiseAND(F.lit(~_LOW(ORDER))).bitwiseOR(F.shiftright(F.col(col).bitwiseAND(F.lit(_LOW(n))), 8))


def _discounts(t: DataFrame) -> DataFrame:
    """Per language three discounts, of counts 1, 2 and more."""
    n = t.groupBy(F.shiftright("k", _LANG).alias("lang")).agg(*[F.sum((F.col("c") == i).cast("long")).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    d = lambda i: F.least(F.lit(float(i)) - 0.05, F.greatest(F.lit(0.05), F.coalesce(i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(0.5))))
    return n.select("lang", d(1).alias("d1"), d(2).alias("d2"), d(3).alias("d3"))


def counted(texts: DataFrame, run=_counted) -> DataFrame:
    """Of texts (text, lang int, ...) the n-grams of the full order: k, c."""
    return written(texts.mapInArrow(frugal(run), "k long, c long").groupBy("k").agg(F.sum("c").alias("c")), "kn-counts")


def train(texts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """The model of texts (text, lang int), see fitted()."""
    return fitted(counted(texts))


def fitted(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Of written counts (k, c): for each order 1 to ORDER the n-grams (k, less: count less its discount) and their
    contexts (h, total, back: the discounts' sum)."""
    out, t = [], counts
    for n in range(ORDER, 0, -1):
        if n < ORDER:
            t = written(t.groupBy(_low("k", n).alias("k")).agg(F.count(F.lit(1)).alias("c")), "kn-order")
        d = F.broadcast(written(_discounts(t), "kn-discounts"))  # a row per language, whose numbers have 16 bits
        cut = t.withColumn("lang", F.shiftright("k", _LANG)).join(d, "lang")
        cut = cut.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        context = cut.groupBy(_context("k", n).alias("h")).agg(F.sum("c").alias("total"), F.sum("d").alias("back"))
        out.append((cut.select("k", (F.col("c") - F.col("d")).alias("less")), context))
    return out[::-1]


def probabilities(grams: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """k, logp of distinct n-grams (k) of the full order."""
    asked = [grams]
    for n in range(ORDER - 1, 0, -1):
        asked.append(asked[-1].select(_low("k", n).alias("k")).distinct())
    below = None
    for n, (own, (seen, contexts)) in enumerate(zip(asked[::-1], model), 1):
        row = own.withColumn("h", _context("k", n)).join(seen, "k", "left").join(contexts, "h", "left")
        if below is None:
            row = row.withColumn("p0", F.lit(1 / 256))
        else:
            row = row.withColumn("s", _low("k", n - 1)).join(below, "s")
        p = F.when(F.col("total").isNull(), F.col("p0")).otherwise((F.coalesce("less", F.lit(0.0)) + F.col("back") * F.col("p0")) / F.col("total"))
        row = row.select("k", p.alias("p"))
        below = row.select(F.col("k").alias("s"), F.col("p").alias("p0"))
    return row.select("k", F.log("p").cast("float").alias("logp"))


def _scored(path: str, out: list[str], text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(path)
        held: tuple[int | None, Slots | None] = (None, None)
        for batch in batches:
            block, lang = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            size, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for i, j, data, at in text_slices(batch.column(text_at), 1_000_000):
                size[i:j] = np.diff(at)
                for b in np.unique(block[i:j]).tolist():
                    own = (block[i:j] == b) & (size[i:j] > 0)
                    if not own.any():
                        continue
                    if held[0] != b:
                        t = pq.read_table(f"{root}/block={b}", filesystem=fs, columns=["k", "logp"], partitioning=None)
                        table = Slots()
                        table.add(t["k"].to_numpy(), t["logp"].to_numpy())
                        held = (b, table)
                    g = _grams(data, at, lang[i:j])
                    begin = at[:-1]
                    if not own.all():
                        g = g[np.repeat(own, np.diff(at))]
                        begin = np.cumsum(size[i:j][own]) - size[i:j][own]
                    total[np.flatnonzero(own) + i] = np.add.reduceat(held[1].get(g).astype(np.float64), begin)
            mean = pa.array(-total / np.maximum(size, 1), mask=size == 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(2, batch.num_columns)), pa.array(size), mean], [*out, "_bytes", "_mean"])

    return run


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with _bytes, _mean (negative log probability a byte), _score, _threshold and _keep, names that docs must not have
    (see masked()), nor _id, _l, _block, _lang, _median; a narrow pass over docs."""
    spark = session(docs)
    if docs.select(F.input_file_name().alias("f")).where("f = ''").limit(1).count():
        docs = written(docs, "quality-docs")  # not read from files: a copy has splits to go by
    split = F.xxhash64(F.input_file_name(), F.input_file_block_start())
    lang, id_ = F.col(f"`{lang_col}`").cast("string"), F.col(f"`{id_col}`")
    ids = columns(labels, "doc_id", "quality").where(F.col("quality") == 1).select(F.col("doc_id").alias("_id")).dropna().distinct()
    # Of each trusted row its split, language and use; neither ids nor rows are ever in one task.
    known = docs.where(F.octet_length(F.col(f"`{text_col}`")) > 0).select(split.alias("block"), id_.alias("_id"), lang.alias("_l")).join(ids, "_id")
    known = written(known.withColumn("train", F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(1 << 30)) < 1 << 29), "trusted")
    lists = f"{shared_folder(spark)}/folioscan-trusted-lists-{uuid.uuid4().hex}"
    # A split without trusted rows has a list all the same, so one that is missing is an error.
    each = known.select("block", "_id", "train").unionByName(docs.select(split.alias("block")).distinct(), allowMissingColumns=True)
    each.repartition(partitions(spark), "block").write.partitionBy("block").parquet(lists)
    counts = {r._l: r.n for r in known.groupBy("_id").agg(F.min("_l").alias("_l")).groupBy("_l").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    rich = sorted(x for x, n in counts.items() if x is not None and n >= 2 * FEWEST)
    code = F.coalesce(F.create_map(*[F.lit(y) for k, x in enumerate(rich) for y in (x, k)])[lang], F.lit(POOL)) if rich else F.lit(POOL)
    own = docs.select(split.alias("_block"), code.alias("_lang"), *[F.col(f"`{c}`") for c in docs.columns])
    pooled = own.where(F.col("_lang") == POOL).limit(1).count() > 0
    part = own.select(F.col(f"`{text_col}`"), "_lang", "_block", id_.alias("_id"))
    grams = counted(part, _only(lists, True, _counted))
    if pooled:
        of_all = grams.groupBy(F.col("k").bitwiseAND(F.lit(_LOW(ORDER))).bitwiseOR(F.lit(POOL << _LANG)).alias("k")).agg(F.sum("c").alias("c"))
        grams = written(grams.where(F.shiftright("k", _LANG) != POOL).unionByName(of_all), "kn-counts")
    model = fitted(grams)
    # Held-out texts ask under the pool's model as well.
    asked = written(part.mapInArrow(frugal(_with_pool(lists, _asked) if pooled else _asked), "block long, k long"), "kn-asked")
    known_grams = probabilities(asked.select("k").distinct(), model)
    path = f"{shared_folder(spark)}/folioscan-kn-{uuid.uuid4().hex}"
    asked.join(known_grams, "k").repartition(partitions(spark), "block").write.partitionBy("block").parquet(path)

    def scored(rows: DataFrame, over=lambda run: run) -> DataFrame:
        kept = [f for f in rows.schema.fields if f.name not in ("_block", "_lang")]
        schema = T.StructType([*kept, T.StructField("_bytes", T.LongType()), T.StructField("_mean", T.DoubleType())])
        text_at = 2 + [f.name for f in kept].index(text_col)
        return rows.mapInArrow(frugal(over(_scored(path, [f.name for f in kept], text_at))), schema)

    def held(rows: DataFrame) -> DataFrame:
        rows = rows.select("_block", "_lang", F.col(f"`{text_col}`"), "_id", F.col("_lang").alias("_l"))
        return scored(rows, lambda run: _only(lists, False, run)).where("_bytes > 0").select("_l", "_bytes", "_mean")

    held_out = held(part.where(F.col("_lang") != POOL))
    held_out = written(held_out.unionByName(held(part.withColumn("_lang", F.lit(POOL)))) if pooled else held_out, "trusted-scores")
    median = held_out.groupBy("_l").agg(F.percentile_approx("_mean", 0.5, 10_000).alias("_median"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= FEWEST // 2).drop("_n")
    drawn_in = (F.col("_bytes") * F.col("_mean") + SHRINK * F.col("_median")) / (F.col("_bytes") + SHRINK)
    limits = held_out.join(median, "_l").groupBy("_l").agg(F.first("_median").alias("_median"), F.percentile_approx(drawn_in, QUANTILE, 10_000).alias("_q"))
    limits = written(limits.select("_l", "_median", (2 * F.col("_q") - F.col("_median")).alias("_threshold")), "quality-limits")
    out = scored(own.withColumn("_l2", F.col("_lang"))).join(F.broadcast(limits), F.col("_l2") == F.col("_l"), "left").drop("_l2")  # a row per model
    letter = F.col(f"`{text_col}`").rlike(r"\p{L}")
    keep = F.coalesce((F.col("_bytes") > 0) & F.when(F.col("_threshold").isNull(), letter).otherwise(F.col("_score") <= F.col("_threshold")), F.lit(False))
    return out.withColumn("_score", F.coalesce(drawn_in, F.col("_mean"))).withColumn("_keep", keep).drop("_l", "_median")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity (a byte), score, threshold, keep."""
    rows = score(columns(docs, "doc_id", "text", "lang"), labels)
    return rows.select("doc_id", "lang", F.col("_bytes").alias("n_bytes"), F.exp("_mean").alias("perplexity"), F.col("_score").alias("score"), F.col("_threshold").alias("threshold"), F.col("_keep").alias("keep"))
