"""What a detector finds on images, once its boxes are a table: numbers of boxes, of images, and of the sources that text
gave nothing for. Pixels are a provider's work; it gets images (source, item, content) and returns BOXES."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import cip, isbn
from folioscan.functions.isbn import _c
from folioscan.operators import pages
from folioscan.options import Options

#: class_id: 0 a number alone, 1 a cataloguing page, 2 a barcode. box: the detector's order, best first.
BOXES = "source string, item string, box int, class_id int, score double, barcode string, lines array<string>"
#: Errors after which images are no use.
FINAL = ("encrypted", "too_few_members", "corrupt", "unsupported_suffix")


def box_number(class_id: Column | str, barcode: Column | str, lines: Column | str, options: Options = Options()) -> Column:
    """The sound number of a box: a barcode's own, or of its lines; a cataloguing page's field; else lines from the keyword on."""
    bar, a = isbn.cleaned(barcode), _c(lines)
    plain = isbn.extract_lines(a, options.china_only)
    alone = isbn.extract_lines(isbn.from_keyword(a), options.china_only)
    # What lines give is sound already; to ask again would copy these long expressions into the check.
    return F.when(_c(class_id) == 2, F.when(isbn.sound(bar), bar).otherwise(plain)).when(_c(class_id) == 1, cip.book_number(a)).otherwise(alone)


def detected(boxes: DataFrame, options: Options = Options()) -> DataFrame:
    """boxes: a row per (source, item): isbn of the first box with a sound one, box and score of it, else of the last box."""
    made = isbn.once(boxes.select("source", "item", "box", "score", "class_id", "barcode", "lines"), "isbn", box_number("class_id", "barcode", "lines", options)).select("source", "item", "box", "score", "isbn")
    found = F.struct("isbn", "box", "score")
    g = made.groupBy("source", "item").agg(F.min_by(found, F.when(F.col("isbn").isNotNull(), F.col("box"))).alias("hit"), F.max_by(found, "box").alias("last"))
    return g.select("source", "item", F.coalesce("hit", "last").alias("f")).select("source", "item", "f.isbn", "f.box", "f.score")


def archive_images(members: DataFrame, options: Options = Options()) -> DataFrame:
    """source, item, at, page, method: an archive's pictures by full name: legal pages, then covers, then the first of the others."""
    base = F.lower(F.regexp_extract("name", "([^/]*)$", 1))
    kind = F.when(base.startswith("leg"), 0).when(base.startswith("cov"), 1).otherwise(2)
    some = members.where(F.lower("name").endswith(".pdg")).withColumn("kind", kind)
    return pages.placed(some, "archive", ["kind", "name"], "kind", {2: options.pdg_fallback}).select(
        F.col("archive").alias("source"), F.col("name").alias("item"), "at", F.when(F.col("kind") < 2, -10).otherwise(F.col("nth")).cast("int").alias("page"), F.when(F.col("kind") == 0, "leg001").when(F.col("kind") == 1, "cov").otherwise("pdg").alias("method")
    )


def epub_images(members: DataFrame, most: int = 10) -> DataFrame:
    """source, item, at, page, method: an e-book's pictures of covers, then of legal pages."""
    some = members.where(F.lower("name").rlike(r"\.(png|jpg|jpeg|webp|bmp)$"))
    none = F.lit(None).cast("int")
    return pages.images_first(some, ("cov", "leg"), most).select(F.col("archive").alias("source"), F.col("name").alias("item"), "at", none.alias("page"), F.lit("onnx").alias("method"))


def completed(rows: DataFrame, images: DataFrame, found: DataFrame, options: Options = Options()) -> DataFrame:
    """rows (public rows) of one kind; those without a number take that of the first image, by at, whose boxes have one;
    else the page and method of the image with the best score. images: source, item, at, page, method; found: detected()."""
    found = images.join(found, ["source", "item"])
    own = F.struct("isbn", "page", "method")
    g = found.groupBy("source").agg(F.min_by(own, F.when(F.col("isbn").isNotNull(), F.col("at"))).alias("hit"), F.max_by(own, F.when(F.col("score") > 0, F.struct("score", -F.col("at")))).alias("best"))
    open_ = ~F.col("success") & ~F.coalesce(F.col("error").isin(*FINAL), F.lit(False))
    hit, best = F.col("hit").isNotNull(), F.col("best").isNotNull()
    new = rows.join(g, "source", "left").withColumn("_o", F.coalesce(open_, F.lit(False)))
    pick = lambda k: F.when(F.col("_o") & hit, F.col(f"hit.{k}")).when(F.col("_o") & best, F.col(f"best.{k}")).otherwise(F.col(k))
    error = F.when(F.col("_o") & hit, None).when(F.col("_o") & best, "not_recognised").otherwise(F.col("error"))
    out = new.select("success", F.when(F.col("_o") & hit, F.col("hit.isbn")).otherwise(F.col("isbn")).alias("isbn"), "ssid", "source", "source_type", pick("method").alias("method"), pick("page").alias("page"), "elapsed", error.alias("error"))
    return out.withColumn("success", isbn.valid_for("isbn", "ssid", options.strict)).select(*rows.columns)
