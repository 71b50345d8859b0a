"""8. Best-fit packing of documents into sequences, with certified partitions.

Documents become ids with an end id; only longer ones are cut into pieces of the capacity. Pieces are dealt to
partitions by hash (at most PARTITION of them each in expectation, whatever their source), each packed by best-fit
decreasing. Dual-feasible functions bound the bins that a partition needs from below; if best fit meets the bound, the
partition is certified as packed best. The others keep what is exactly full, exchange all else (the pieces of up to FAN
partitions come together, dealt anew if they are too many for one) and run again, until each is certified or a round no
longer lowers their bins; `certified` says of each sequence which it was. Of bins that fit equally, and of pieces of one
length, the first by number is taken.

Defined cases: null is an empty text: the end id alone; repeated rows are documents of their own; null ids stay; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm._common import KEPT, columns, frugal, partitions, session, spread, written
from folioscan.llm.pretokens import WORD_PATTERN, Pretokens, by_size, encoded, tokenizer

PARTITION, FAN = 400_000, 8


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _joined(path: str):
    """Ids of many words, as bytes: the words are encoded as texts of 400, and cut after each id that ends a word."""
    vocab = tokenizer(path).get_vocab()
    ends = np.zeros(max(vocab.values()) + 1, bool)
    for token, k in vocab.items():
        ends[k] = token.endswith("</w>")

    def many(words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        runs = [words[i : i + 400] for i in range(0, len(words), 400)]
        for run, ids in zip(runs, encoded(path, [" ".join(r) for r in runs])):
            a = np.array(ids, "<u4")
            cuts = (np.flatnonzero(ends[a]) * 4 + 4).tolist()
            if len(cuts) != len(run):  # no file of this kind of tokenizer gives that
                out += map(_bytes, encoded(path, run))
                continue
            all_ids = a.tobytes()
            out += [all_ids[i:j] for i, j in zip([0, *cuts], cuts)]
        return out

    return many


def _pieces(path: str, end: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ("packing", path)
        if key not in KEPT:
            KEPT.clear()
            KEPT[key] = Pretokens(path, WORD_PATTERN, True, _bytes, many=_joined(path))
        worker, last, width = KEPT[key], _bytes([end]), 4 * capacity
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, j in by_size(texts):
                for k, parts in enumerate(worker.batch(texts[i:j]), i):
                    all_ids = b"".join(parts) + last
                    for p in range(0, len(all_ids), width):
                        cut = all_ids[p : p + width]
                        row.append(k)
                        piece.append(p // width)
                        start.append(p // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        if with_ids:
                            ids.append(cut)
            out = [batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def pieces(docs: DataFrame, path: str, id_col: str, text_col: str, end: int, capacity: int, with_ids: bool = False) -> DataFrame:
    session(docs)
    rows = columns(docs, id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_pieces(path, end, capacity, with_ids), f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A number of bins that any packing needs, by dual-feasible functions."""
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=capacity + 1)
    total = np.arange(capacity + 1) * n
    upto_n, upto = np.cumsum(n), np.cumsum(total)
    best = -(-int(total.sum()) // capacity)
    # Threshold functions: above capacity - a a piece counts as a bin, below a as nothing.
    a, half = np.arange(0, capacity // 2 + 1), capacity // 2
    large = upto_n[capacity] - upto_n[capacity - a]
    middle = upto_n[capacity - a] - upto_n[half]
    spare = middle * capacity - (upto[capacity - a] - upto[half])
    small = upto[half] - np.where(a > 0, upto[np.maximum(a - 1, 0)], 0)
    best = max(best, int((large + middle + np.maximum(0, -((spare - small) // capacity))).max()))
    # Rounding functions: x goes to floor((k + 1) x) / k unless (k + 1) x is whole.
    x = np.arange(capacity + 1)
    for k in range(1, 33):
        whole = (k + 1) * x % capacity == 0
        scaled = np.where(whole, k * x, (k + 1) * x // capacity * capacity)  # in units of 1 / (k capacity)
        best = max(best, -(-int((scaled * n).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place in it of each piece, and what each bin holds; longest first, each to the fullest bin that takes it."""
    order = np.argsort(-lengths, kind="stable")
    bins, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, filled = 0, []
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(filled)
            filled.append(0)
        bins[i], place[i] = b, filled[b]
        filled[b] += size
        room -= size
        if room:
            if not rooms[room]:
                mask |= 1 << room
            rooms[room].append(b)
    return bins, place, np.array(filled, np.int64)


def _packed(capacity: int):
    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
        lengths = x.length.to_numpy(np.int64)
        bins, place, filled = best_fit(lengths, capacity)
        certified = len(filled) == least_bins(lengths, capacity)
        return pd.DataFrame({"uid": x.uid, "length": lengths, "part": x.part, "bin": bins, "offset": place, "closed": certified | (filled[bins] == capacity), "certified": certified})

    return run


def packed(items: DataFrame, capacity: int, partition: int = PARTITION) -> DataFrame:
    """uid, sequence_id, offset, certified of items (uid long, length long, at most capacity). Partitions whose gap isn't
    closed exchange and run again, as long as that lowers the number of their bins."""
    spark = session(items)
    full = items.where(F.col("length") == capacity).select("uid", F.lit(-1).alias("round"), F.lit(0).alias("part"), F.col("uid").alias("bin"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    rest = items.where(F.col("length") < capacity).select("uid", "length")
    done, r, kept, open_bins = [full], 0, None, None
    row = lambda df, r, ok: df.select("uid", F.lit(r).alias("round"), "part", "bin", "offset", ok.alias("certified"))
    while count := rest.count():
        parts = max(1, -(-count // partition))
        # The first deal, and each exchange: pieces of FAN partitions come together.
        part = F.pmod(F.xxhash64("uid", F.lit(r)), F.lit(parts)) if r == 0 else F.pmod(F.xxhash64(F.floor(F.col("part") / FAN), F.pmod(F.xxhash64("uid", F.lit(r)), F.lit(-(-parts // max(1, before // FAN))))), F.lit(max(1, parts)))
        # A part's key is such that no two of them meet in one task while another has none.
        of = spark.createDataFrame(list(enumerate(spread(parts, partitions(spark)))), "part int, key int")
        dealt = rest.withColumn("part", part.cast("int")).join(F.broadcast(of), "part")  # a row for each `partition` pieces
        result = written(dealt.groupBy("key").applyInPandas(frugal(_packed(capacity)), "uid long, length long, part int, bin long, offset long, closed boolean, certified boolean"), "packed")
        each = result.groupBy("part").agg(F.max("bin").alias("m"), F.bool_and("certified").alias("ok"))
        bins, left = each.agg(F.coalesce(F.sum(F.col("m") + 1), F.lit(0)), F.count_if(~F.col("ok"))).first()
        if open_bins is not None and bins >= open_bins:  # the exchange gained nothing
            done.append(row(kept, r - 1, F.lit(False)))
            break
        if left <= 1:
            done.append(row(result, r, F.col("certified")))
            break
        done.append(row(result.where("closed"), r, F.lit(True)))
        kept = result.where("NOT closed")
        open_bins = kept.select("part", "bin").distinct().count()
        rest, before, r = kept.select("uid", "length", "part"), parts, r + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("uid", F.when(F.col("round") < 0, F.col("bin") * 2).otherwise(((F.col("bin") * 16_777_216 + F.col("part")) * 64 + F.col("round")) * 2 + 1).alias("sequence_id"), "offset", "certified")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = 1, capacity: int = 4096, with_ids: bool = False, partition: int = PARTITION) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset, certified of each piece; with_ids: also its ids, little-endian."""
    cut = written(pieces(docs, path, id_col, text_col, end, capacity, with_ids).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    placed = packed(cut.select("uid", "length"), capacity, partition)
    return cut.join(placed, "uid").drop("uid").withColumnRenamed("id", id_col)
