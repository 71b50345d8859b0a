"""Exact duplicates by stages: size, then a prefix, then the digest of the whole; only what a stage can't tell apart goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folioscan.options import SORTS

PREFIX = 256


def candidates(files: DataFrame, least: int = 1, most: int | None = None, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), exclude_dirs: tuple[str, ...] = ()) -> DataFrame:
    """Of files (path, size, ...) those in the bounds; suffixes and folder names by lower case."""
    from folioscan.functions.meta import suffix

    keep = F.col("size") >= least
    if most is not None:
        keep &= F.col("size") <= most
    if include:
        keep &= suffix("path").isin(*[e.lower().lstrip(".") for e in include])
    if exclude:
        keep &= ~suffix("path").isin(*[e.lower().lstrip(".") for e in exclude])
    for d in exclude_dirs:
        keep &= ~F.lower("path").contains(f"/{d.lower()}/")
    return files.where(keep)


def physical(files: DataFrame) -> DataFrame:
    """One path for each file of a device; inode 0 says nothing."""
    known = files.where(F.col("ino") != 0).groupBy("dev", "ino").agg(F.min("path").alias("path"))
    return files.join(known.select("path"), "path", "left_semi").unionByName(files.where(F.coalesce(F.col("ino") == 0, F.lit(True))))


def digests(files: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """files (path, size, times, and content or nothing) that may have a duplicate, with md5: two sizes, then prefixes, have
    to meet. No content is ever shuffled. A column of content is digested where it is read; without it, prefixes are
    read from the files whose size isn't alone, and whole files only where prefixes meet as well and the cache
    (size, mtime_ns, path, md5_hex) doesn't know the digest."""
    rest = [c for c in files.columns if c != "content"]
    if "content" in files.columns:
        content = F.col("content").cast("binary")
        marked = files.select(*rest, F.xxhash64(F.substring(content, 1, PREFIX)).alias("ph"), F.md5(content).alias("md5"))
        some = marked.join(marked.groupBy("size").count().where("count > 1").select("size"), "size", "left_semi")
    else:
        some = files.join(files.groupBy("size").count().where("count > 1").select("size"), "size", "left_semi")
        some = _read(some, rest, "ph long", lambda f: _prefix(f))
    some = some.join(some.groupBy("size", "ph").count().where("count > 1").select("size", "ph"), ["size", "ph"], "left_semi").drop("ph")
    known = None
    if cache is not None:
        known = some.join(cache.select("size", F.col("mtime_ns").alias("modified"), "path", F.col("md5_hex").alias("known")), ["size", "modified", "path"], "left")
    if "content" in files.columns:
        return some if known is None else known.withColumn("md5", F.coalesce("known", "md5")).select(*rest, "md5")
    if known is None:
        return _read(some, rest, "md5 string", _whole)
    hit = known.where("known IS NOT NULL").select(*rest, F.col("known").alias("md5"))
    return hit.unionByName(_read(known.where("known IS NULL").select(*rest), rest, "md5 string", _whole))


def _prefix(file) -> int:
    import zlib

    head = file.read(PREFIX)
    return zlib.crc32(head) << 32 | zlib.adler32(head) if len(head) else 0


def _whole(file) -> str:
    import hashlib

    return hashlib.file_digest(file, "md5").hexdigest()


def _read(files: DataFrame, names: list[str], made: str, of) -> DataFrame:
    """files with a column made of each file by of(open file); files that can't be read go, as they do when listed."""
    schema = T.StructType([files.schema[c] for c in names]).add(*made.split())

    def run(batches):
        for b in batches:
            values, keep = [], []
            for path in b["path"]:
                try:
                    with open(path, "rb") as f:
                        values.append(of(f))
                    keep.append(True)
                except OSError:
                    keep.append(False)
            out = b.loc[keep, names].copy()
            out[made.split()[0]] = values
            yield out

    return files.select(*names).mapInPandas(run, schema)


def marked(members: DataFrame, strategy: str = "oldest_changed") -> DataFrame:
    """members (size, md5, path, times) of groups of two or more, with n, keep and rank (by path)."""
    by, oldest = SORTS[strategy]
    group = ["size", "md5"]
    w = Window.partitionBy(*group)
    best = w.orderBy(F.col(by).asc() if oldest else F.col(by).desc(), "path")
    out = members.withColumn("n", F.count(F.lit(1)).over(w)).where("n > 1")
    return out.withColumn("keep", F.row_number().over(best) == 1).withColumn("member", F.row_number().over(w.orderBy("path")))


def groups(members: DataFrame) -> DataFrame:
    """A row per group: size, md5, n, dup_count, saved_bytes."""
    g = members.groupBy("size", "md5").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return g.withColumn("dup_count", F.col("n") - 1).withColumn("saved_bytes", F.col("size") * (F.col("n") - 1))


def limited(groups_: DataFrame, most: int) -> DataFrame:
    """Groups by size, largest first, with taken duplicates: all until the limit, then the rest of it; has_more. most <= 0: all."""
    if most <= 0:
        return groups_.withColumn("taken", F.col("dup_count")).withColumn("has_more", F.lit(False))
    # Each group has a duplicate, so only the first `most` groups can be taken: a top-k, and a window over its rows alone.
    order = Window.orderBy(F.desc("size"), "md5").rowsBetween(Window.unboundedPreceding, -1)
    top = groups_.orderBy(F.desc("size"), "md5").limit(most).withColumn("before", F.coalesce(F.sum("dup_count").over(order), F.lit(0)))
    total = groups_.agg(F.sum("dup_count").alias("total"))  # one row
    out = top.where(F.col("before") < most).withColumn("taken", F.least("dup_count", F.lit(most) - F.col("before"))).drop("before")
    return out.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > most).drop("total")


def totals(groups_: DataFrame, scanned: DataFrame) -> DataFrame:
    g = groups_.agg(F.count(F.lit(1)).alias("dup_groups"), F.coalesce(F.sum("dup_count"), F.lit(0)).alias("dups"), F.coalesce(F.sum("saved_bytes"), F.lit(0)).alias("saved"))
    return g.crossJoin(scanned.agg(F.count(F.lit(1)).alias("total")))  # one row with one row


def find_duplicates(files: DataFrame, strategy: str = "oldest_changed", most: int = 1000, cache: DataFrame | None = None, **bounds) -> DataFrame:
    """The members of the duplicate groups of files, as far as the limit goes, with keep."""
    members = marked(digests(candidates(files, **bounds), cache), strategy)
    g = limited(groups(members), most).select("size", "md5", "taken", "has_more")
    cut = members.drop("keep").join(g, ["size", "md5"]).where(F.col("member") <= F.col("taken") + 1)
    return marked(cut.drop("n", "member"), strategy)


def removals(found: DataFrame) -> DataFrame:
    """The plan of a clean-up: what would go, and the bytes; nothing is removed here (see sinks.remove)."""
    return found.where("NOT keep").select("path", "size")


def auto_clean(files: DataFrame, strategy: str = "oldest_changed", most: int = 0, cache: DataFrame | None = None, dry_run: bool = False, trash: str | None = None, **bounds) -> DataFrame:
    """find_duplicates(), and the removal of all that isn't kept: path, reclaimed, error. dry_run: what would go, untouched."""
    from folioscan.sources import sinks

    plan = removals(find_duplicates(files, strategy, most, cache, **bounds))
    return plan.select("path", F.col("size").alias("reclaimed"), F.lit(None).cast("string").alias("error")) if dry_run else sinks.remove(plan, trash)


def reclaimed(removed: DataFrame) -> DataFrame:
    """removed (path, reclaimed, error): removed, errors, reclaimed_bytes; one row."""
    ok = F.col("error").isNull()
    return removed.agg(F.count_if(ok).alias("removed"), F.count_if(~ok).alias("errors"), F.coalesce(F.sum(F.when(ok, F.col("reclaimed"))), F.lit(0)).alias("reclaimed_bytes"))


def updated_cache(cache: DataFrame, fresh: DataFrame, most: int) -> DataFrame:
    """Both, the latest entry of each key; beyond most entries the longest unused go until 95 % of it are left."""
    key = Window.partitionBy("size", "mtime_ns", "path").orderBy(F.desc("last_used"))
    both = cache.unionByName(fresh).withColumn("_r", F.row_number().over(key)).where("_r = 1").drop("_r")
    return evicted(both, most)


def evicted(cache: DataFrame, most: int) -> DataFrame:
    """The cache, if it has most entries or fewer; else the latest 95 % of most: a top-k, and a window over its rows alone."""
    top = cache.orderBy(F.desc("last_used"), "path").limit(most + 1)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc("last_used"), "path"))
    return top.withColumn("_n", n).withColumn("_k", rank).where((F.col("_n") <= most) | (F.col("_k") <= int(0.95 * most))).drop("_n", "_k")


def cache_stats(files: DataFrame, cache: DataFrame) -> DataFrame:
    known = cache.select("size", F.col("mtime_ns").alias("modified"), "path", F.lit(True).alias("hit"))
    hit = F.coalesce("hit", F.lit(False))
    return files.join(known, ["size", "modified", "path"], "left").agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"))
