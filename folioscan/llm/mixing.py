"""5. Mixing sources to target weights by systematic sampling.

Each source has a target number of words; the expected copies of a document are target / size of its source. Within a
source the documents are put in order of size, their expected copies summed up, a random offset of the source added,
and a document is emitted once for each whole number that its interval crosses. In order of size the words taken stay
within about the largest document of the target. The prefix sums are a distributed rank (no source is ever in one task)
times the copies; offsets are multiples of 2^-20 by the hash of the source and the seed, so reruns agree.

Targets: sources by code point, null last, weigh as the list of weights, repeating, and share factor times all words; a
target stops at most times its source's words, and the excess is shared by weight among the others until none is above.

Defined cases: null and empty texts have size 0 and are taken any number of times, 0 words each; a source without words
has target 0; repeated rows are documents of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.llm._common import columns, masked, ranked, session, written

WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...], factor: float, most: int) -> DataFrame:
    """source, source_size, n, target, source_at of sizes (source, source_size, n): a row per source."""
    # In order of cap per weight the capped sources come first; for k of them the level of the rest is plain.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("source_at", F.row_number().over(order) - 1)
    weighed = weighed.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_at") % len(weights) + 1).cast("int")).cast("long"))
    by_cap = Window.orderBy(F.col("source_size") / F.col("w"), "source_at")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.lit(factor) * F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    leveled = weighed.withColumn("level", level)
    # The level at which the first source that isn't capped stands; a source with cap below its level is capped.
    capped = F.col("w") * F.col("level") >= most * F.col("source_size")
    final = F.min(F.when(~capped, F.struct(F.col("source_size") / F.col("w"), "source_at", "level"))).over(every)["level"]
    return leveled.withColumn("final", final).select("source", "source_at", "source_size", "n", F.when(capped, (most * F.col("source_size")).cast("double")).otherwise(F.col("w") * F.col("final")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), factor: float = 1.5, most: int = 2, seed: int = 1) -> DataFrame:
    """uid (monotonically_increasing_id of docs), doc_id, source, size, source_size, target, copies, taken: a row per row of docs, those with 0 copies too."""
    session(docs)
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    rows = columns(docs, id_col, text_col, source_col).toDF("doc_id", "text", "source")
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "source", size.alias("size"))
    spot = written(rows, "mix-sizes")  # ranges are drawn from a sample, for which each text would else be counted once more
    spot = spot.withColumn("group", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")))
    placed = ranked(spot, "group", ["size", "doc_id", "uid"], "mix")
    # Sources are few beside documents; their weights need their order over all of them.
    sizes = placed.groupBy("group").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    wanted = targets(sizes.drop("group"), weights, factor, most).withColumn("group", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")))
    offset = (F.conv(F.substring(F.md5(F.concat("group", F.lit(f"/{seed}"))), 1, 5), 16, 10).cast("long") + 0.5) / (1 << 20)
    wanted = wanted.withColumn("each", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("offset", offset)
    out = placed.join(wanted.drop("source", "n"), "group")
    copies = (F.floor(F.col("offset") + (F.col("rank") + 1) * F.col("each")) - F.floor(F.col("offset") + F.col("rank") * F.col("each"))).alias("copies")
    return out.select("uid", "doc_id", "source", "size", "source_size", "target", copies).withColumn("taken", F.col("copies") * F.col("size"))


def emitted(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of docs, each as often as mix(docs) takes it; docs as from filed(), so that a second scan numbers them alike."""
    times = mixed.where("copies > 0").select("uid", "copies")
    plain = masked(docs)[0]
    rows = plain.withColumn("uid", F.monotonically_increasing_id()).join(times, "uid")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*plain.columns).toDF(*docs.columns)


ORACLE = """WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - 2 * coalesce(sum(source_size) OVER o, 0)::DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::DOUBLE AS level FROM w WINDOW o AS (ORDER BY source_size / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, source_size / w) FILTER (WHERE w * level < 2 * source_size) AS level FROM l),
t AS (SELECT l.source, l.source_size, CASE WHEN l.w * l.level >= 2 * l.source_size THEN (2 * l.source_size)::DOUBLE ELSE l.w * f.level END AS target,
(('0x' || substr(md5(CASE WHEN l.source IS NULL THEN 'n' ELSE 's' || l.source END || '/1'), 1, 5))::BIGINT + 0.5::DOUBLE) / 1048576 AS off FROM l, f),
r AS (SELECT d.*, t.source_size, t.target, t.off, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS each, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS k FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(off + (k + 1) * each) - floor(off + k * each)) * size)::BIGINT AS taken, source FROM r"""
