"""1. Token counts: a map-side lookup in two tiers, with no shuffle of pre-tokens.

The first tier is a table of at most TABLE frequent pre-tokens and their numbers of tokens, broadcast (a few MB by its
bound). It comes from a bounded sample of the texts (about SAMPLE rows, by hash) and only sets the speed: what it lacks,
the tokenizer encodes, in batches, into the worker's own cache, and the counts are the tokenizer's with any table.

Defined cases: null is an empty text, with 0 tokens and 0 bytes; repeated rows give repeated rows; null ids stay; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm._common import KEPT, columns, session
from folioscan.llm.pretokens import BYTE_PATTERN, Pretokens, by_size, encoded

SAMPLE, TABLE = 2_000, 1 << 16


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got: Counter = Counter()
    for b in batches:
        for t in b.column(0).to_pylist():
            got.update(BYTE_PATTERN.findall(t))
    top = got.most_common(TABLE)
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["part", "n"])


def frequent(texts: DataFrame, path: str, sample: int = SAMPLE, table: int = TABLE) -> dict[str, int]:
    """Tokens of the most frequent pre-tokens of about sample of the texts (one column, no nulls)."""
    share = sample / max(1, texts.count())
    some = texts.where(F.rand(7) < share)  # by place, not by text, of which one may fill half of the table
    top = some.mapInArrow(_frequent, "part string, n long").groupBy("part").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "part").limit(table).collect()
    parts = [r.part for r in top]
    return dict(zip(parts, map(len, encoded(path, parts))))


def _counted(path: str, table, limit: int):
    key = uuid.uuid4().hex  # of this call; the workers keep its cache

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in KEPT:
            KEPT.clear()
            KEPT[key] = Pretokens(path, BYTE_PATTERN, False, len, table.value)
        worker = KEPT[key]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n: list[int] = []
            for i, j in by_size(texts):
                n += map(sum, worker.batch(texts[i:j]))
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n])], ["id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, sample: int = SAMPLE) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (more than limit) of every text, by the tokenizer in the file at path."""
    session(docs)
    rows = columns(docs, id_col, text_col)
    table = rows.sparkSession.sparkContext.broadcast(frequent(rows.select(text_col).dropna(), path, sample))
    kind = rows.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(_counted(path, table, limit), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
