"""The corpus pipeline: five operators in a row over documents. Each stage reads what its predecessor kept, from Parquet."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import jaccard_join, language_id, mixing, packing, quality
from folioscan.llm._common import filed, masked, written

#: A text goes as mixed if no language has this share of it; above a half, as two may share it evenly.
LEAST_SHARE = 0.6
#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def _own(docs: DataFrame, plain: DataFrame, rows: DataFrame) -> DataFrame:
    """The columns of docs (in plain as c0, c1, ..., see masked()) of rows."""
    return rows.select(*plain.columns).toDF(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go: null and empty texts, and those of which the model finds the
    perplexity too high. Null ids and languages are judged like others; an empty table stays empty. Here and in
    the other stages columns may have any names, repeated rows are judged one by one, and ties keep all."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    plain, (id_, text, lang) = masked(docs, "doc_id", "text", "lang")
    return _own(docs, plain, quality.score(plain, labels, id_, text, lang).where("_keep"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (also null and empty texts), of which no language has LEAST_SHARE, or that fit their
    language far worse than held-out texts of it, go. An empty table stays empty; without labels all go, as all are `und`."""
    plain, (id_, text, lang) = masked(docs, "doc_id", "text", "lang")
    model = language_id.learn(plain, id_, text, lang)
    limits = F.broadcast(language_id.limits(plain, model, id_, text, lang))  # a row per language
    fit = (F.col("_letters") * F.col("_fit") + language_id.SHRINK * F.col("_median")) / (F.col("_letters") + language_id.SHRINK)
    rows = language_id.tag(plain, model, id_, text).join(limits, "_lang_pred")
    return _own(docs, plain, rows.where((F.least("_score", "_share") >= LEAST_SHARE) & F.coalesce(fit >= F.col("_limit"), F.lit(True))))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays (null last; of repeated rows one). Texts
    that are null or without words are nobody's duplicates and stay. An empty table stays empty."""
    plain, (id_, text) = masked(docs, "doc_id", "text")
    plain = filed(plain)
    rest = jaccard_join.grouped(plain, id_, text).where("NOT first").select("uid")
    return _own(docs, plain, plain.withColumn("uid", F.monotonically_increasing_id()).join(rest, "uid", "left_anti"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; texts without words any number of times. An empty table stays empty."""
    plain, (id_, text, source) = masked(docs, "doc_id", "text", "source")
    plain = filed(plain)
    return mixing.emitted(plain, mixing.mix(plain, id_, text, source)).toDF(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their sequences; a null or empty text is one piece, its end id. An empty table gives none."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
