"""Pages of a book: which to look at, in which order, and what the sampled ones say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions.isbn import _c
from folioscan.options import Options


def _run(a: Column, b: Column) -> Column:
    """a to b; nothing if b is before a."""
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))


def candidate_pages(count: Column | str, options: Options = Options()) -> Column:
    n = _c(count).cast("int")
    one = F.lit(1)
    front = _run(F.greatest(one, F.lit(options.front[0])), F.least(n, F.lit(options.front[1])))
    back = _run(F.greatest(one, n - options.back[0] + 1), F.greatest(one, n - options.back[1] + 1))
    return F.array_distinct(F.concat(front, back))


def sampled_pages(count: Column | str) -> Column:
    """At most 5 pages (from 0), evenly from the second to the last; the first alone if there is no other."""
    n = _c(count).cast("int")
    k = F.least(F.lit(5), n - 1)
    step = lambda i: (F.lit(1) + F.floor(i * (n - 2) / F.greatest(F.lit(1), k - 1))).cast("int")
    return F.when(n > 1, F.array_distinct(F.transform(F.sequence(F.lit(0), k - 1), step))).otherwise(F.array(F.lit(0)))


def bookmarks(toc: DataFrame) -> DataFrame:
    """toc (source, title, page): the pages of copyright and back covers, once each, in their order."""
    priority = F.when(F.col("title").contains("版权"), 0).when(F.col("title").contains("封底"), 1)
    some = toc.withColumn("priority", priority).where(F.col("priority").isNotNull() & (F.col("page") >= 1))
    some = some.groupBy("source", "page").agg(F.min("priority").alias("priority"))
    return some.withColumn("ordinal", F.row_number().over(Window.partitionBy("source").orderBy("priority", "page")))


def ordered(candidates: DataFrame, marks: DataFrame) -> DataFrame:
    """candidates (source, page, ordinal), bookmarked pages before them, each page once."""
    both = marks.select("source", "page", F.lit(0).alias("kind"), "ordinal").unionByName(candidates.select("source", "page", F.lit(1).alias("kind"), "ordinal"))
    first = both.groupBy("source", "page").agg(F.min(F.struct("kind", "ordinal")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("at.kind", "at.ordinal", "page"))
    return first.select("source", "page", (F.col("at.kind") == 0).alias("bookmarked"), rank.alias("ordinal"))


def pdf_type(pages: DataFrame) -> DataFrame:
    """pages (source, has_text): text_based from half of the pages on, mixed from one on, else scanned."""
    share = F.avg(F.col("has_text").cast("double"))
    return pages.groupBy("source").agg(F.when(share >= 0.5, "text_based").when(share > 0, "mixed").otherwise("scanned").alias("pdf_type"))


def first_success(stages: DataFrame, by: str = "source") -> DataFrame:
    """stages (by, ordinal, isbn, ...): the first row with a number; no row for sources without."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy("ordinal"))
    return stages.where("isbn IS NOT NULL").withColumn("_r", rank).where("_r = 1").drop("_r")


def best_failure(stages: DataFrame) -> DataFrame:
    """stages (source, ordinal, isbn, score): of each source without a number the best-scored page, the first of equals."""
    w = Window.partitionBy("source")
    lost = stages.withColumn("_ok", F.max(F.col("isbn").isNotNull()).over(w)).where("NOT _ok")
    return lost.withColumn("_r", F.row_number().over(w.orderBy(F.desc_nulls_last("score"), "ordinal"))).where("_r = 1").drop("_r", "_ok", "isbn")


def member_order(members: DataFrame, options: Options = Options()) -> DataFrame:
    """members (archive, ordinal, name) of an e-book: markup, front matter first, at most the options' number of them."""
    keys = ("copyright", "copyr", "titlepage", "title", "front", "colophon", "imprint", "verso", "rights", "legal", "cip", "info")
    low = F.lower("name")
    front = low.rlike(r"(" + "|".join(keys) + r")[^/]*$")
    rank = F.row_number().over(Window.partitionBy("archive").orderBy(F.desc(front), "ordinal"))
    return members.where(low.rlike(r"\.(opf|xhtml|html|htm|xml)$")).withColumn("at", rank).where(F.col("at") <= options.text_members)


def images_first(members: DataFrame, leaders: tuple[str, ...], most: int | None = None) -> DataFrame:
    """Images whose names begin with one of leaders, in that order: archives look at legal pages before covers, e-books after."""
    base = F.lower(F.regexp_extract("name", "([^/]*)$", 1))
    lead = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(leaders))):
        lead = F.when(base.startswith(p), i).otherwise(lead)
    out = members.withColumn("lead", lead).where("lead IS NOT NULL")
    out = out.withColumn("at", F.row_number().over(Window.partitionBy("archive").orderBy("lead", "ordinal")))
    return out.where(F.col("at") <= most) if most else out


def placed(rows: DataFrame, by: str, order: list[str], kind: str, most: dict[int, int]) -> DataFrame:
    """rows with at (place in order within by) and nth (place within by and kind), without those of a kind beyond its most."""
    w = Window.partitionBy(by)
    out = rows.withColumn("nth", F.row_number().over(Window.partitionBy(by, kind).orderBy(*order)))
    keep = F.lit(True)
    for k, n in most.items():
        keep &= (F.col(kind) != k) | (F.col("nth") <= n)
    return out.where(keep).withColumn("at", F.row_number().over(w.orderBy(*order)))


def archive_gate(members: DataFrame, options: Options = Options()) -> DataFrame:
    """archive, pdgs, encrypted, verdict: what to do with an archive, from its list of members alone."""
    g = members.groupBy("archive").agg(F.count_if(F.lower("name").endswith(".pdg")).alias("pdgs"), F.coalesce(F.max("encrypted"), F.lit(False)).alias("encrypted"))
    return g.withColumn("verdict", F.when(F.col("encrypted"), "encrypted").when(F.col("pdgs") < options.pdg_least, "too_few_members").otherwise("open"))
