"""Boxes and sizes; what a detector needs besides its model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions.isbn import _c
from folioscan.options import Options


def letterbox(width: Column | str, height: Column | str, options: Options = Options()) -> Column:
    """struct(scale, pad_x, pad_y) of an image put into the middle of the canvas."""
    w, h = _c(width), _c(height)
    scale = F.least(options.canvas[0] / w, options.canvas[1] / h)
    pad = lambda side, full: F.floor((full - F.bround(side * scale)) / 2).cast("int")
    return F.struct(scale.alias("scale"), pad(w, options.canvas[0]).alias("pad_x"), pad(h, options.canvas[1]).alias("pad_y"))


def unboxed(box: Column, width: Column, height: Column, frame: Column, options: Options = Options()) -> Column:
    """struct(left, top, right, bottom) on the image, padded and clipped; null if nothing is left."""

    def edge(v: str, pad: str, full: Column, sign: int) -> Column:
        x = (box[v] - frame[pad]) / frame["scale"] + sign * options.padding
        return F.greatest(F.lit(0), F.least(full.cast("int"), (F.floor(x) if sign < 0 else F.ceil(x)).cast("int")))

    out = F.struct(edge("x1", "pad_x", width, -1).alias("left"), edge("y1", "pad_y", height, -1).alias("top"), edge("x2", "pad_x", width, 1).alias("right"), edge("y2", "pad_y", height, 1).alias("bottom"))
    return F.when((out["right"] > out["left"]) & (out["bottom"] > out["top"]), out)


def zoom(width: Column | str, height: Column | str) -> Column:
    """The factor for a page: 2, unless its short side then leaves 600 to 2000."""
    short = F.least(_c(width), _c(height))
    return F.greatest(600 / short, F.least(2000 / short, F.lit(2.0)))


def raster(width: Column | str, height: Column | str, least_short: int | None = None, most_long: int | None = None) -> Column:
    """struct(width, height) of a picture enlarged to a least short side, then reduced to a most long one; in proportion."""
    w, h = _c(width), _c(height)
    short, long = F.least(w, h), F.greatest(w, h)
    scale = F.lit(1.0)
    if least_short is not None:
        scale = F.greatest(scale, least_short / short)
    if most_long is not None:
        scale = F.when(long > most_long, F.least(scale, most_long / long)).otherwise(scale)
    side = lambda x: F.when(scale == 1, x).otherwise(F.greatest(F.lit(1), F.bround(x * scale))).cast("int")
    return F.struct(side(w).alias("width"), side(h).alias("height"))


def pdg_header(content: Column | str) -> Column:
    """struct(width, height, type); null for short data, unusable types and sizes that the length can't hold."""
    x = _c(content)
    byte = lambda i: F.conv(F.hex(F.substring(x, i + 1, 1)), 16, 10).cast("int")
    a, b, kind, n = byte(16) + 256 * byte(17), byte(18) + 256 * byte(19), byte(15), F.octet_length(x)
    make = lambda w, h: F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"), kind.alias("type"))
    fits = a.cast("long") * b * 3 <= n.cast("long") * 60
    return F.when(n >= 140, F.when(kind.isin(0xFF, 0x10), None).when(kind.isin(0xAA, 0xAC), make(F.lit(1120), F.lit(1568))).when(kind == 0xAB, make(b, a)).when(fits, make(a, b)))


def picture_type(content: Column | str) -> Column:
    head = F.hex(F.substring(_c(content), 1, 8))
    return F.when(head.startswith("FFD8FF"), "jpeg").when(head == "89504E470D0A1A0A", "png").otherwise("pdg")


_CORNERS = ("x1", "y1", "x2", "y2")


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The shared part of the joint area; a and b: x1, y1, x2, y2 as rows."""
    w = np.minimum(a[2], b[2]) - np.maximum(a[0], b[0])
    h = np.minimum(a[3], b[3]) - np.maximum(a[1], b[1])
    both, area = np.maximum(w, 0) * np.maximum(h, 0), lambda v: (v[2] - v[0]) * (v[3] - v[1])
    return both / np.maximum(area(a) + area(b) - both, 1e-9)


def _greedy(box: np.ndarray, group: np.ndarray, most: float) -> np.ndarray:
    """Indices of the boxes that stay; sorted by group, best first within. A step takes the first of all groups at once."""
    left, kept = np.arange(len(group)), []
    while len(left):
        g = group[left]
        first = np.r_[True, g[1:] != g[:-1]]
        head = left[first]
        kept.append(head)
        best, left = np.repeat(head, np.diff(np.r_[np.flatnonzero(first), len(g)]))[~first], left[~first]
        left = left[_overlap(box[:, best], box[:, left]) <= most]
    return np.sort(np.concatenate(kept)) if kept else left


def suppress(boxes: DataFrame, options: Options = Options()) -> DataFrame:
    """boxes (image, class_id, x1, y1, x2, y2, score): greedy per image and class, by score. Groups come sorted, many in a
    batch, and one may go on over any number of batches: of those before, its kept boxes alone are held."""
    names = boxes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # what is kept of the last group so far
        for b in batches:
            box = np.stack([b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in _CORNERS])
            new = b.column("_first").to_numpy(zero_copy_only=False)
            group, alive = np.cumsum(new), np.ones(len(new), bool)
            goes_on = np.flatnonzero(group == 0)
            for old in held if len(goes_on) else ():
                for one in old.T:
                    goes_on = goes_on[_overlap(one[:, None], box[:, goes_on]) <= options.overlap]
            alive[group == 0] = False
            alive[goes_on] = True
            rows = np.flatnonzero(alive)
            kept = rows[_greedy(box[:, rows], group[rows], options.overlap)]
            if len(group):
                last = box[:, kept[group[kept] == group[-1]]]
                held = [last] if group[-1] else [*held, last]
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(kept)) for c in names], names=names)

    w = Window.partitionBy("image", "class_id").orderBy(F.desc("score"), *map(F.asc_nulls_last, _CORNERS))
    some = boxes.where(F.col("score") >= options.confidence).withColumn("_first", F.row_number().over(w) == 1)
    return some.mapInArrow(run, boxes.schema)
