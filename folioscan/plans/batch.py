"""Batches: what becomes of each file, and the summary."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions import isbn, meta, naming
from folioscan.options import BATCH, Options


def with_named(files: DataFrame, options: Options = Options()) -> DataFrame:
    """files (path), with the ids of their stems (named), parsed once."""
    parsed = isbn.once(files, "_n", meta.stem_ids(meta.stem("path")))
    valid = isbn.once(parsed, "_n", meta.ids_if_valid(F.col("_n"), options.strict))
    named = F.struct(F.col("_n.isbn").alias("isbn"), isbn.isbn13("_n.isbn").alias("isbn13"), F.col("_n.ssid").alias("ssid"))
    return isbn.once(valid, "named", named).drop("_n")


def skipped(options: Options = Options()) -> Column:
    """The outcome of files that the stem settles; null for the others."""
    number = F.col("named.isbn13").isNotNull() & F.lit(options.skip_isbn)
    ssid = F.col("named.ssid").isNotNull() & F.lit(options.skip_ssid)
    return F.when(number, "skip_isbn").when(ssid, "skip_ssid")


def outcome(found: Column, named: Column, error: Column) -> Column:
    return F.when(error.isNotNull(), "error").when(found["isbn13"].isNotNull(), "extract_isbn").when(found["ssid"].isNotNull() & named["ssid"].isNull(), "extract_ssid").when(named["ssid"].isNotNull(), "fallback_ssid").otherwise("failed")


def routed(results: DataFrame, options: Options = Options(), root: str = "") -> DataFrame:
    """results (path, named, found, error): with outcome, folder and name. A plan; sinks apply it."""
    out = results.withColumn("outcome", F.coalesce(skipped(options), outcome(F.col("found"), F.col("named"), F.col("error"))))
    lost = F.col("outcome").isin("failed", "error")
    name = F.when(lost, naming.failed("path", options.lower_suffix)).otherwise(naming.destination("path", F.col("found"), F.col("named"), options))
    if options.keep_tree:
        name = naming.in_tree("path", root, name)
    return out.withColumn("folder", F.when(lost, "failed").otherwise("success")).withColumn("name", name)


def unclashed(plan: DataFrame) -> DataFrame:
    """The plan, where files that would meet get _001, _002, ... by path; from the 100th on 8 characters of a digest."""
    at = F.row_number().over(Window.partitionBy("folder", "name").orderBy("path")) - 1
    end = F.regexp_extract("name", r".(\.[^.]*)$", 1)
    mark = F.when(F.col("_at") < 100, F.format_string("_%03d", "_at")).otherwise(F.concat(F.lit("_"), F.substring(F.md5(F.col("path").cast("string")), 1, 8)))
    base = F.substr("name", F.lit(1), F.length("name") - F.length(end))
    return plan.withColumn("_at", at).withColumn("name", F.when(F.col("_at") == 0, F.col("name")).otherwise(F.concat(base, mark, end))).drop("_at")


def summary(results: DataFrame) -> DataFrame:
    o = F.col("outcome")
    skip, good = o.startswith("skip_"), o.isin("extract_isbn", "extract_ssid", "fallback_ssid")
    lost = o.isin("failed", "error")
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if(skip).alias("skipped"), F.count_if(good).alias("success"), F.count_if(lost).alias("failed"), F.count_if(good | lost).alias("processed"))


def callback_tag(o: Column) -> Column:
    return F.when(o == "extract_isbn", "isbn_ok").when(o == "extract_ssid", "ssid_ok").when(o == "error", None).otherwise(o)


def run(files: DataFrame, extract, options: Options = Options(), root: str = "") -> DataFrame:
    """files (path, ...): the stem settles some; extract (DataFrame -> path, isbn, ssid, error) sees the others alone."""
    named = with_named(files, options)
    settled = skipped(options)
    none = F.struct(F.lit(None).cast("string").alias("isbn"), F.lit(None).cast("string").alias("isbn13"), F.lit(None).cast("string").alias("ssid"))
    hit = named.where(settled.isNotNull()).select("path", "named", none.alias("found"), F.lit(None).cast("string").alias("error"))
    rest = named.where(settled.isNull())
    got = extract(rest.drop("named")).select("path", F.struct("isbn", isbn.isbn13("isbn").alias("isbn13"), "ssid").alias("found"), "error")
    miss = rest.select("path", "named").join(got, "path", "left").select("path", "named", "found", F.when(F.col("found").isNull() & F.col("error").isNull(), "extract_exception").otherwise(F.col("error")).alias("error"))
    return unclashed(routed(hit.unionByName(miss), options, root))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with index (from 1) by order, and total. Never in one task: ranges are sorted apart, and the counts of those before
    added. rows are computed once: kept before the ranges are drawn, which would else compute them all for a sample."""
    rows = rows.persist()
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).persist()
    part = F.shiftright("_at", 33)
    runs = placed.groupBy(part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    runs = runs.withColumn("_before", before).withColumn("total", F.sum("_n").over(Window.partitionBy())).drop("_n")
    return placed.withColumn("_part", part).join(F.broadcast(runs), "_part").withColumn("index", F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_part", "_at", "_first", "_before")


def entries(routed_: DataFrame) -> DataFrame:
    """What a listener of a batch gets: old, new, elapsed, tag, index, total, error; by path."""
    elapsed = F.col("elapsed") if "elapsed" in routed_.columns else F.lit(None).cast("double")
    new = F.concat_ws("/", "folder", "name")
    return numbered(routed_.select(F.col("path").alias("old"), new.alias("new"), elapsed.alias("elapsed"), callback_tag(F.col("outcome")).alias("tag"), "error"), "old")


def staged(rows: DataFrame) -> DataFrame:
    """rows, written to the folder of spark.checkpoint.dir, which executors share, and read back. Only local mode may do without it."""
    spark = rows.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folioscan-")
    path = f"{base.rstrip('/')}/folioscan-batch-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def run_folder(spark: SparkSession, folder: str, success: str, failed: str, options: Options = Options(), recursive: bool = True, dry_run: bool = False, **providers) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A folder's files from listing to destinations: (entries, summary, moves), of rows that are extracted once and staged.
    Files settled by their names aren't opened.
    Moves are made when moves is run; dry_run: it is the plan alone. providers: see extract.everything()."""
    from folioscan.plans import extract
    from folioscan.sources import files, sinks

    found = files.scan(spark, files.root(folder), recursive, include=BATCH)
    get = lambda rest: staged(extract.everything(rest, options, **providers)).select(F.col("source").alias("path"), "isbn", "ssid", F.when(~F.col("error").isin("not_found", "no_region", "not_recognised"), F.col("error")).alias("error"))
    plan = staged(run(found.select("path", "content"), get, options, files.root(folder)))
    moves = plan.select("path", "folder", "name")
    return entries(plan), summary(plan), moves if dry_run else sinks.move(moves, success, failed)
