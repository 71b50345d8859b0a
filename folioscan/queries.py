"""Queries over the driver's tables, each with the DuckDB SQL that gives the same rows. The tables hold no book numbers,
so these are made from keys, by the same arithmetic on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions import cip, isbn, meta, naming
from folioscan.operators import dedup, geometry, pages
from folioscan.options import Options
from folioscan.plans import batch, detect, extract
from folioscan.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows of a small file, over all cores: a row group is read by one task, which would else do all that follows."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism, key)


# The made numbers ---------------------------------------------------------------------------------------------------


def made(key: Column) -> Column:
    """A number of 13 digits for keys divisible by 3, one with a wrong check digit for remainder 1, else null."""
    body = F.concat(F.lit("9787"), F.lpad(key.cast("string"), 8, "0"))
    wrong = ((isbn.check13(body).cast("int") + 1) % 10).cast("string")
    return F.when(key % 3 == 0, F.concat(body, isbn.check13(body))).when(key % 3 == 1, F.concat(body, wrong))


def _s13(x: str) -> str:
    return " + ".join(f"{1 + 2 * (i % 2)} * try_cast(substr({x}, {i + 1}, 1) AS INT)" for i in range(12))


def _s10(x: str) -> str:
    return " + ".join(f"{10 - i} * try_cast(substr({x}, {i + 1}, 1) AS INT)" for i in range(9))


def _made(key: str) -> str:
    body = f"('9787' || lpad(({key})::VARCHAR, 8, '0'))"
    check = f"((10 - ({_s13(body)}) % 10) % 10)"
    return f"CASE ({key}) % 3 WHEN 0 THEN {body} || {check} WHEN 1 THEN {body} || (({check} + 1) % 10) END"


def _sound(x: str) -> str:
    last = f"CASE WHEN substr({x}, 10, 1) = 'X' THEN 10 ELSE try_cast(substr({x}, 10, 1) AS INT) END"
    return f"coalesce(CASE length({x}) WHEN 13 THEN regexp_full_match({x}, '[0-9]{{13}}') AND ({_s13(x)} + try_cast(substr({x}, 13, 1) AS INT)) % 10 = 0 WHEN 10 THEN regexp_full_match({x}, '[0-9]{{9}}[0-9X]') AND ({_s10(x)} + {last}) % 11 = 0 END, false)"


def _acceptable(x: str) -> str:
    return f"({_sound(x)} AND CASE length({x}) WHEN 13 THEN substr({x}, 1, 3) IN ('978', '979') ELSE substr({x}, 1, 1) = '7' END)"


def _c10(x: str) -> str:
    rest = f"((11 - ({_s10(x)}) % 11) % 11)"
    return f"CASE {rest} WHEN 10 THEN 'X' ELSE {rest}::VARCHAR END"


def _extract(t: str) -> str:
    """First acceptable number of a text without CJK or full-width characters."""
    fixed = f"regexp_replace({t}, '(^|[^0-9])1787([0-9])', '\\19787\\2', 'g')"
    runs = ((r"[0-9 \-–—]{6,}[0-9Xx]", 0), (r"(?:^|[^0-9])(97[89][0-9 \-–—]{4,}[0-9])", 1), (r"[0-9Xx\s\-–—]{8,}", 0))
    made_ = [f"[c for c in [upper(regexp_replace(m, '[^0-9Xx]', '', 'g')) for m in regexp_extract_all({fixed}, '{p}', {g})] if {_acceptable('c')}][1]" for p, g in runs]
    return f"coalesce({', '.join(made_)})"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files."""
    d = _t(spark, sf_dir, "documents")
    ts = F.pmod(F.coalesce("doc_id", F.lit(0)) * 7919, F.lit(1009))
    path = F.concat(F.lit("/in/"), F.coalesce(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.md5("text"), F.lit("none")), F.lit(".txt"))
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return d.select(path.alias("path"), F.octet_length(content).cast("long").alias("size"), content.alias("content"), ts.alias("changed"), (ts * 3 % 997).alias("modified"), (ts * 7 % 991).alias("accessed"))


_FILES = "f AS (SELECT '/in/' || coalesce(lpad(doc_id::VARCHAR, 12, '0'), md5(text), 'none') || '.txt' AS path, strlen(coalesce(text, ''))::BIGINT AS size, coalesce(text, '') AS text, (coalesce(doc_id, 0) * 7919) % 1009 AS changed, ((coalesce(doc_id, 0) * 7919) % 1009) * 3 % 997 AS modified, ((coalesce(doc_id, 0) * 7919) % 1009) * 7 % 991 AS accessed FROM documents), m AS (SELECT *, md5(text) AS h FROM f WHERE size >= 1), g AS (SELECT size, h AS md5, count(*) AS n, count(*) - 1 AS dup_count, size * (count(*) - 1) AS saved_bytes FROM m GROUP BY size, h HAVING count(*) > 1)"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.digests(dedup.candidates(_files(spark, sf_dir)))


# Duplicates -----------------------------------------------------------------------------------------------------------


@_query(f"WITH {_FILES} SELECT size, md5, n, dup_count, saved_bytes FROM g")
def dedup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.groups(_members(spark, sf_dir))


def _keep_sql(by: str, way: str) -> str:
    return f"WITH {_FILES} SELECT path, m.size, h AS md5, n, row_number() OVER (PARTITION BY m.size, h ORDER BY {by} {way}, path) = 1 AS keep, (row_number() OVER (PARTITION BY m.size, h ORDER BY path))::INT AS member FROM m JOIN g ON m.size = g.size AND h = g.md5"


for _by in ("changed", "modified", "accessed"):
    for _age, _way in (("oldest", "ASC"), ("newest", "DESC")):

        def _keep(spark: SparkSession, sf_dir: str, s: str = f"{_age}_{_by}") -> DataFrame:
            return dedup.marked(_members(spark, sf_dir), s).select("path", "size", "md5", "n", "keep", "member")

        _keep.__name__ = f"dedup_keep_{_age}_{_by}"
        _query(_keep_sql(_by, _way))(_keep)

_LIMITED = lambda most: "l AS (SELECT *, coalesce(sum(dup_count) OVER (ORDER BY size DESC, md5 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(dup_count) OVER () > 20 AS has_more FROM g), k AS (SELECT size, md5, least(dup_count, 20 - before)::BIGINT AS taken, has_more FROM l WHERE before < 20)".replace("20", str(most))


@_query(f"WITH {_FILES}, {_LIMITED(20)} SELECT * FROM k")
def dedup_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.limited(dedup.groups(_members(spark, sf_dir)), 20).select("size", "md5", "taken", "has_more")


@_query(f"WITH {_FILES}, {_LIMITED(1000)}, r AS (SELECT m.*, k.has_more, row_number() OVER (PARTITION BY m.size, h ORDER BY path) AS i, taken FROM m JOIN k ON m.size = k.size AND h = k.md5) SELECT path, size, h AS md5, count(*) OVER (PARTITION BY size, h) AS n, row_number() OVER (PARTITION BY size, h ORDER BY changed, path) = 1 AS keep FROM r WHERE i <= taken + 1")
def dedup_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.find_duplicates(_files(spark, sf_dir)).select("path", "size", "md5", "n", "keep")


@_query(f"WITH {_FILES} SELECT count(*) AS dup_groups, sum(dup_count)::BIGINT AS dups, sum(saved_bytes)::BIGINT AS saved, (SELECT count(*) FROM f WHERE size >= 1) AS total FROM g")
def dedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = dedup.candidates(_files(spark, sf_dir))
    return dedup.totals(dedup.groups(dedup.digests(files)), files.select("path"))


@_query(f"WITH {_FILES}, c AS (SELECT size, modified, path FROM f WHERE changed % 2 = 0) SELECT count(c.path) AS hits, count(*) - count(c.path) AS misses FROM f LEFT JOIN c USING (size, modified, path)")
def dedup_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).drop("content")
    return dedup.cache_stats(files, files.where("changed % 2 = 0").select("size", F.col("modified").alias("mtime_ns"), "path"))


@_query("WITH k AS (SELECT user_id, max(ts) AS last_used FROM events GROUP BY user_id), r AS (SELECT *, row_number() OVER (ORDER BY last_used DESC, user_id::VARCHAR) AS i FROM k) SELECT user_id FROM r WHERE (SELECT count(*) FROM k) <= 40 OR i <= 38")
def lru_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_used")).withColumn("path", F.col("user_id").cast("string"))
    return dedup.evicted(k, 40).select("user_id")


@_query("SELECT min(o_orderkey) AS path_key FROM orders WHERE o_custkey % 10 <> 0 GROUP BY o_custkey % 3, o_custkey UNION ALL SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0")
def physical_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("path"), (F.col("o_custkey") % 3).alias("dev"), F.when(F.col("o_custkey") % 10 == 0, 0).otherwise(F.col("o_custkey")).alias("ino"))
    return dedup.physical(rows).select(F.col("path").alias("path_key"))


# Numbers --------------------------------------------------------------------------------------------------------------

_N = f"n AS (SELECT p_partkey AS k, {_made('p_partkey')} AS x FROM part)"


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isbn.once(_spread(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), "k"), "x", made(F.col("k")))


@_query(f"WITH {_N} SELECT k, x, {_sound('x')} AS sound, {_acceptable('x')} AS acceptable, {_sound('substr(x, 4, 10)')} AS tail_sound FROM n")
def isbn_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(spark, sf_dir).select("k", "x", isbn.sound("x").alias("sound"), isbn.acceptable("x").alias("acceptable"), isbn.sound(F.substring("x", 4, 10)).alias("tail_sound"))


@_query(f"WITH {_N}, t AS (SELECT k, x, CASE WHEN {_sound('x')} THEN substr(x, 4, 9) || {_c10('substr(x, 4, 9)')} END AS ten FROM n) SELECT k, ten, CASE WHEN ten IS NOT NULL THEN x END AS back FROM t")
def isbn10_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isbn.once(_numbers(spark, sf_dir), "ten", isbn.isbn10("x")).select("k", "ten", isbn.isbn13("ten").alias("back"))


@_query(f"WITH {_N} SELECT k, CASE WHEN {_sound('x')} THEN x END AS formatted FROM n")
def isbn_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("no. "), F.substring("x", 1, 3), F.lit("-"), F.substring("x", 4, 1), F.lit(" "), F.substring("x", 5, 9))
    return _numbers(spark, sf_dir).select("k", isbn.formatted(raw).alias("formatted"))


@_query(f"WITH {_N}, s AS (SELECT *, CASE WHEN k % 2 = 0 THEN lpad(k::VARCHAR, 8, '1') END AS ssid, {_sound('x')} AS ok FROM n) SELECT k, ok AND ssid IS NOT NULL AS level1, ok AS level2, ok OR ssid IS NOT NULL AS level3 FROM s")
def strict_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _numbers(spark, sf_dir).withColumn("ssid", F.when(F.col("k") % 2 == 0, F.lpad(F.col("k").cast("string"), 8, "1")))
    return n.select("k", *[isbn.valid_for("x", "ssid", i).alias(f"level{i}") for i in (1, 2, 3)])


# Text -----------------------------------------------------------------------------------------------------------------

_KEY = "(conv_id * 31 + turn)"


def _dashed(x: str) -> str:
    return f"(substr({x}, 1, 3) || '-' || substr({x}, 4, 1) || '-' || substr({x}, 5))"


_LINES = f"c AS (SELECT conv_id, turn, text, {_KEY} AS k, {_made(_KEY)} AS x FROM conversations), l AS (SELECT conv_id, turn, CASE k % 5 WHEN 0 THEN coalesce(text, '') || ' ISBN ' || coalesce({_dashed('x')}, '') WHEN 1 THEN coalesce(x, '') || ' ' || coalesce(text, '') WHEN 2 THEN coalesce(text, '') || coalesce(x, '') ELSE coalesce(text, '') END AS line FROM c)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("conv_id") * 31 + F.col("turn")
    t, x = F.coalesce("text", F.lit("")), F.coalesce("x", F.lit(""))
    dashed = F.coalesce(F.concat(F.substring("x", 1, 3), F.lit("-"), F.substring("x", 4, 1), F.lit("-"), F.substring("x", 5, 9)), F.lit(""))
    c = isbn.once(_t(spark, sf_dir, "conversations").withColumn("k", k), "x", made(F.col("k")))
    line = F.when(F.col("k") % 5 == 0, F.concat(t, F.lit(" ISBN "), dashed)).when(F.col("k") % 5 == 1, F.concat(x, F.lit(" "), t)).when(F.col("k") % 5 == 2, F.concat(t, x)).otherwise(t)
    return c.select("conv_id", "turn", line.alias("line"))


@_query(f"WITH {_LINES} SELECT conv_id, turn, {_extract('line')} AS isbn FROM l")
def extract_first_isbn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("conv_id", "turn", isbn.extract_gated("line").alias("isbn"))


@_query(f"WITH {_LINES}, a AS (SELECT *, lead(line) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM l), e AS (SELECT conv_id, turn * 2 AS o, 1 AS p, {_extract('line')} AS isbn FROM a UNION ALL SELECT conv_id, turn * 2, 2, {_extract('(line || nxt)')} FROM a UNION ALL SELECT conv_id, turn * 2 + 1, 2, {_extract('(line || chr(32) || nxt)')} FROM a UNION ALL SELECT conv_id, 0, 3, {_extract('j')} FROM (SELECT conv_id, string_agg(line, ' ' ORDER BY turn) AS j FROM l GROUP BY 1)) SELECT conv_id, arg_min(isbn, p * 1000000 + o) FILTER (WHERE isbn IS NOT NULL) AS isbn FROM e GROUP BY conv_id")
def extract_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda s: s["line"]).alias("lines"))
    return rows.select("conv_id", isbn.extract_lines("lines").alias("isbn"))


@_query(f"WITH {_LINES}, f AS (SELECT conv_id, min(turn) AS at FROM l WHERE regexp_matches(line, '(?i)[1Il]\\s*[S5]\\s*[8B]\\s*N') GROUP BY 1) SELECT l.conv_id, turn, CASE WHEN turn = f.at THEN regexp_extract(line, '(?is)[1Il]\\s*[S5]\\s*[8B]\\s*N.*') ELSE line END AS line FROM l LEFT JOIN f USING (conv_id)")
def keyword_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "line"))).alias("a"))
    cut = rows.select("conv_id", F.explode(F.arrays_zip(F.transform("a", lambda s: s["turn"]).alias("turn"), isbn.from_keyword(F.transform("a", lambda s: s["line"])).alias("line"))).alias("z"))
    return cut.select("conv_id", "z.turn", "z.line")


@_query(f"WITH {_LINES}, e AS (SELECT conv_id, turn, line, {_extract('line')} AS isbn FROM l) SELECT conv_id, turn, isbn, coalesce(regexp_matches(line, '(?i)[1Il]\\s*[S5]\\s*[8B]\\s*N') OR NOT regexp_matches(line, '[A-Za-z]') OR strpos(replace(replace(line, '-', ''), ' ', ''), isbn) <= 3, false) AS trusted FROM e WHERE isbn IS NOT NULL")
def line_context_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = isbn.once(_lines(spark, sf_dir), "isbn", isbn.extract_gated("line")).where("isbn IS NOT NULL")
    return e.select("conv_id", "turn", "isbn", F.coalesce(isbn.trusted_line("line", "isbn"), F.lit(False)).alias("trusted"))


@_query("SELECT doc_id, regexp_matches(text, '(?i)isbn|97[89][0-9 Xx-]{10,}') AS gate, regexp_matches(text, '(?i)[1Il]\\s*[S5]\\s*[8B]\\s*N') AS keyword FROM documents")
def byte_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", isbn.gate("text").alias("gate"), isbn.has_keyword("text").alias("keyword"))


@_query(f"SELECT doc_id, {_extract('text')} AS isbn FROM documents")
def true_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digit runs of whole documents that are no book numbers, and those that happen to be."""
    return _t(spark, sf_dir, "documents").select("doc_id", isbn.extract_gated("text").alias("isbn"))


@_query("WITH p AS (SELECT doc_id, [trim(x) for x in string_split(text, chr(10)) if trim(x) <> ''] AS a FROM documents) SELECT doc_id, len(a)::INT AS n_lines, array_to_string(a, '|') AS joined FROM p")
def page_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "documents").select("doc_id", isbn.text_lines("text").alias("a"))
    return p.select("doc_id", F.when(F.col("a").isNotNull(), F.size("a")).alias("n_lines"), F.array_join("a", "|").alias("joined"))


_CIP = "c AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN '## CIP数据核字（2021）第' || p_partkey || '号' WHEN 1 THEN 'CTP 数据核字 (2019) ' || p_partkey || '号' WHEN 2 THEN 'CIP数据核字第 A' || p_partkey || ' 号' ELSE p_name END AS t FROM part), z AS (SELECT k, trim(regexp_replace(translate(regexp_replace(trim(t), '^#+\\s*', ''), '／（）．—－–', '/().---'), '\\s+', ' ', 'g')) AS line FROM c)"


def _cips(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    t = F.when(k % 4 == 0, F.concat(F.lit("## CIP数据核字（2021）第"), k, F.lit("号"))).when(k % 4 == 1, F.concat(F.lit("CTP 数据核字 (2019) "), k, F.lit("号"))).when(k % 4 == 2, F.concat(F.lit("CIP数据核字第 A"), k, F.lit(" 号"))).otherwise(F.col("p_name"))
    return _t(spark, sf_dir, "part").select(k.alias("k"), t.alias("t"))


@_query(f"WITH {_CIP} SELECT k, line FROM z")
def cip_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cips(spark, sf_dir).select("k", cip.line("t").alias("line"))


@_query(f"WITH {_CIP} SELECT k, CASE k % 4 WHEN 0 THEN 'CIP数据核字(2021)第' || regexp_extract(line, '([0-9]+)号', 1) || '号' WHEN 1 THEN 'CIP数据核字(2019)第' || regexp_extract(line, '([0-9]+)号', 1) || '号' WHEN 2 THEN 'CIP数据核字第' || regexp_extract(line, '(A[0-9]+)', 1) || '号' END AS number FROM z")
def cip_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cips(spark, sf_dir).select("k", cip.number(F.array("t")).alias("number"))


# Metadata and names ---------------------------------------------------------------------------------------------------


@_query(f"WITH {_N} SELECT k, CASE WHEN k % 7 = 0 THEN NULL ELSE x END AS isbn, CASE WHEN k % 7 = 0 THEN NULL ELSE k::VARCHAR END AS ssid FROM n")
def bookinfo_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("k") % 7 == 0, "no section\n").otherwise("\n[General]\n")
    text = F.concat(head, F.lit("title=a=b\nISBN号= "), F.coalesce("x", F.lit("")), F.lit("\nisbn10=123\nSS号="), F.col("k"), F.lit("\nssid=other"))
    return _numbers(spark, sf_dir).select("k", meta.bookinfo(text).alias("b")).select("k", "b.isbn", "b.ssid")


@_query(f"WITH {_N} SELECT k, CASE WHEN k % 5 <> 0 THEN x END AS isbn, CASE WHEN k % 5 <> 0 THEN k::VARCHAR END AS ssid FROM n")
def metaxml_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("<meta><ssid>"), F.col("k"), F.lit("</ssid><isbn>"), F.coalesce(F.regexp_replace("x", "^(...)", "$1-"), F.lit("")), F.lit("</isbn><title>t</title>"))
    text = F.when(F.col("k") % 5 == 0, F.lit("<meta><ssid>")).otherwise(F.concat(body, F.lit("</meta>")))
    return _numbers(spark, sf_dir).select("k", meta.meta_xml(text).alias("b")).select("k", "b.isbn", "b.ssid")


@_query(f"WITH {_N} SELECT k, coalesce(CASE WHEN k % 2 = 0 THEN x END, nullif(CASE WHEN k % 4 = 1 THEN 'B' || k ELSE '' END, '')) AS isbn, coalesce(CASE WHEN k % 6 = 0 THEN 'a' || k END, 'b' || k) AS ssid FROM n")
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    a = F.struct(F.when(k % 2 == 0, F.col("x")).alias("isbn"), F.when(k % 6 == 0, F.concat(F.lit("a"), k)).otherwise("").alias("ssid"))
    b = F.struct(F.when(k % 4 == 1, F.concat(F.lit("B"), k)).otherwise("").alias("isbn"), F.concat(F.lit("b"), k).alias("ssid"))
    return _numbers(spark, sf_dir).select("k", meta.merged(a, b).alias("m")).select("k", "m.isbn", "m.ssid")


_EXT = ("pdf", "EPUB", "mobi", "zip", "rar", "7z", "jpg", "txt", "UVZ", "pdg")
_PATHS = f"p AS (SELECT k, x, '/in/d' || k % 3 || '/The  Book_' || k || CASE k % 4 WHEN 0 THEN '_' || coalesce({_dashed('x')}, 'none') WHEN 1 THEN '_' || lpad(k::VARCHAR, 8, '5') WHEN 2 THEN '' ELSE '_' || coalesce(x, 'y') || '_' END AS base, list_extract(['{chr(39) + ', ' + chr(39)}'], 1) AS e0, ({str(list(_EXT)).replace('[', 'list_value(').replace(']', ')')})[(k % 10 + 1)::INT] AS ext FROM n), q AS (SELECT *, base || '.' || ext AS path, substr(base, strpos(base, 'The')) AS stem FROM p), s AS (SELECT *, {_extract('stem')} AS nisbn, nullif(regexp_extract(stem, '(?:^|[^0-9])([0-9]{{8}})(?:[^0-9]|$)', 1), '') AS nssid FROM q)".replace("list_extract(['', ''], 1) AS e0, ", "")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, x = F.col("k"), F.col("x")
    dashed = F.concat(F.substring("x", 1, 3), F.lit("-"), F.substring("x", 4, 1), F.lit("-"), F.substring("x", 5, 9))
    tail = F.when(k % 4 == 0, F.concat(F.lit("_"), F.coalesce(dashed, F.lit("none")))).when(k % 4 == 1, F.concat(F.lit("_"), F.lpad(k.cast("string"), 8, "5"))).when(k % 4 == 2, "").otherwise(F.concat(F.lit("_"), F.coalesce(x, F.lit("y")), F.lit("_")))
    ext = F.element_at(F.array(*map(F.lit, _EXT)), (k % 10 + 1).cast("int"))
    return _numbers(spark, sf_dir).withColumn("path", F.concat(F.lit("/in/d"), k % 3, F.lit("/The  Book_"), k, tail, F.lit("."), ext))


@_query(f"WITH {_N}, {_PATHS} SELECT path, CASE lower(ext) WHEN 'txt' THEN NULL WHEN 'jpg' THEN 'image' WHEN 'pdg' THEN 'image' WHEN 'zip' THEN 'archive' WHEN 'rar' THEN 'archive' WHEN '7z' THEN 'archive' WHEN 'uvz' THEN 'archive' ELSE lower(ext) END AS kind FROM q")
def kind_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("path", naming.kind("path").alias("kind"))


@_query(f"WITH {_N}, {_PATHS} SELECT path, nisbn AS isbn, nssid AS ssid FROM s")
def stem_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("path", meta.stem_ids(meta.stem("path")).alias("i")).select("path", "i.isbn", "i.ssid")


def _found() -> Column:
    k = F.col("k")
    number = F.when(k % 9 == 0, made(k * 3))
    return F.struct(number.alias("isbn"), isbn.isbn13(number).alias("isbn13"), F.when(k % 5 == 0, F.lpad(k.cast("string"), 8, "6")).alias("ssid"))


_FOUND = f"r AS (SELECT *, CASE WHEN k % 9 = 0 THEN {_made('k * 3')} END AS fisbn, CASE WHEN k % 5 = 0 THEN lpad(k::VARCHAR, 8, '6') END AS fssid, CASE WHEN {_sound('nisbn')} THEN nisbn END AS n13 FROM s), t AS (SELECT *, coalesce(fisbn, fssid, n13, nssid) AS tag, CASE WHEN fisbn IS NOT NULL THEN true WHEN fssid IS NOT NULL THEN false ELSE n13 IS NOT NULL END AS num, lower(ext) AS e FROM r), u AS (SELECT *, CASE WHEN num THEN nisbn ELSE nssid END AS old FROM t)"
_CLEAN = "trim(regexp_replace(CASE WHEN old IS NULL THEN stem ELSE regexp_replace(stem, array_to_string(string_split(old, ''), '-?'), '_') END, '_+', '_', 'g'), '_')"
_NEW = {
    1: "trim(CASE WHEN old IS NOT NULL AND contains(replace(replace(stem, '-', ''), ' ', ''), tag) THEN stem ELSE stem || '_' || tag END, '_ ')",
    2: "trim(CASE WHEN old IS NOT NULL AND contains(replace(replace(stem, '-', ''), ' ', ''), tag) THEN stem ELSE tag || '_' || stem END, '_ ')",
    3: f"{_CLEAN} || '_' || tag",
    4: f"tag || '_' || {_CLEAN}",
}


def _renamed_sql(new: str, longest: int) -> str:
    return f"WITH {_N}, {_PATHS}, {_FOUND} SELECT path, CASE WHEN tag IS NULL THEN stem || '.' || e ELSE substr({new}, 1, {longest} - length(e) - 1) || '.' || e END AS name FROM u"


def _renamed(spark: SparkSession, sf_dir: str, options: Options) -> DataFrame:
    rows = batch.with_named(_paths(spark, sf_dir), options)
    rows = isbn.once(rows, "found", _found())
    return rows.select("path", naming.destination("path", F.col("found"), F.col("named"), options).alias("name"))


for _mode, _sql in _NEW.items():

    def _rename(spark: SparkSession, sf_dir: str, m: int = _mode) -> DataFrame:
        return _renamed(spark, sf_dir, Options(rename_mode=m))

    _rename.__name__ = f"rename_mode{_mode}"
    _query(_renamed_sql(_sql, 180))(_rename)


@_query(_renamed_sql(_NEW[3], 24))
def rename_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed(spark, sf_dir, Options(longest_name=24))


@_query(_renamed_sql("concat_ws('_', tag, CASE WHEN num THEN nullif(coalesce(fssid, nssid), tag) ELSE nullif(coalesce(fisbn, n13), tag) END)", 180))
def keep_name_false(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed(spark, sf_dir, Options(keep_name=False))


@_query(f"WITH {_N}, {_PATHS} SELECT path, regexp_replace(path, '^/in/', '') AS name FROM q")
def keep_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("path", naming.in_tree("path", "/in", meta.name("path")).alias("name"))


@_query("SELECT p_partkey AS path, CASE i WHEN 0 THEN b || '.pdf' ELSE b || CASE WHEN i < 100 THEN '_' || lpad(i::VARCHAR, 3, '0') ELSE '_' || substr(md5(p_partkey::VARCHAR), 1, 8) END || '.pdf' END AS name FROM (SELECT p_partkey, 'f' || p_partkey % 7 AS b, row_number() OVER (PARTITION BY p_partkey % 7 ORDER BY lpad(p_partkey::VARCHAR, 12, '0')) - 1 AS i FROM part)")
def name_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    plan = _t(spark, sf_dir, "part").select(F.lpad(k.cast("string"), 12, "0").alias("order"), k.alias("path"), F.lit("success").alias("folder"), F.concat(F.lit("f"), k % 7, F.lit(".pdf")).alias("name"))
    return batch.unclashed(plan).select("path", "name")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.when(F.col("k") % 11 == 0, "corrupt")
    return batch.routed(isbn.once(batch.with_named(_paths(spark, sf_dir)), "found", _found()).withColumn("error", error))


_OUTCOME = "o AS (SELECT *, CASE WHEN n13 IS NOT NULL THEN 'skip_isbn' WHEN k % 11 = 0 THEN 'error' WHEN fisbn IS NOT NULL THEN 'extract_isbn' WHEN fssid IS NOT NULL AND nssid IS NULL THEN 'extract_ssid' WHEN nssid IS NOT NULL THEN 'fallback_ssid' ELSE 'failed' END AS outcome FROM t)"


@_query(f"WITH {_N}, {_PATHS}, {_FOUND}, {_OUTCOME} SELECT path, outcome, CASE WHEN outcome IN ('failed', 'error') THEN 'failed' ELSE 'success' END AS folder FROM o")
def outcome_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("path", "outcome", "folder")


@_query(f"WITH {_N}, {_PATHS}, {_FOUND}, {_OUTCOME} SELECT count(*) AS total, count(*) FILTER (WHERE outcome LIKE 'skip%') AS skipped, count(*) FILTER (WHERE outcome IN ('extract_isbn', 'extract_ssid', 'fallback_ssid')) AS success, count(*) FILTER (WHERE outcome IN ('failed', 'error')) AS failed, count(*) FILTER (WHERE outcome NOT LIKE 'skip%') AS processed FROM o")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.summary(_results(spark, sf_dir))


# Pages and members ----------------------------------------------------------------------------------------------------

_COUNT = "(o_orderkey % 12 + 1)"


@_query(f"WITH c AS (SELECT o_orderkey, {_COUNT}::INT AS n FROM orders) SELECT o_orderkey, array_to_string(list_concat(range(2, least(n, 5) + 1), [p for p in range(greatest(1, n - 2), greatest(1, n) + 1) if NOT (p >= 2 AND p <= least(n, 5))]), ',') AS pages FROM c")
def candidate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.array_join(pages.candidate_pages(F.col("o_orderkey") % 12 + 1).cast("array<string>"), ",").alias("pages"))


@_query(f"WITH c AS (SELECT o_orderkey, {_COUNT}::INT AS n FROM orders) SELECT o_orderkey, CASE WHEN n > 1 THEN array_to_string(list_sort(list_distinct([1 + (k * (n - 2)) // greatest(1, least(5, n - 1) - 1) for k in range(0, least(5, n - 1))])), ',') ELSE '0' END AS pages FROM c")
def page_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.sort_array(pages.sampled_pages(F.col("o_orderkey") % 12 + 1)).cast("array<string>"), ",").alias("pages"))


_TOC = "m AS (SELECT l_orderkey AS source, l_linenumber % 3 + 1 AS page, min(CASE l_partkey % 4 WHEN 0 THEN 0 ELSE 1 END) AS priority FROM lineitem WHERE l_partkey % 4 IN (0, 1) GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY priority, page) AS ordinal FROM m)"


def _toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_partkey") % 4
    title = F.when(p == 0, "版权页").when(p == 1, "封底").otherwise("Chapter")
    return _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), title.alias("title"), (F.col("l_linenumber") % 3 + 1).alias("page"))


@_query(f"WITH {_TOC} SELECT source, page, priority, ordinal FROM b")
def bookmark_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.bookmarks(_toc(spark, sf_dir))


@_query(f"WITH {_TOC}, c AS (SELECT DISTINCT l_orderkey AS source, l_linenumber AS page FROM lineitem), a AS (SELECT coalesce(b.source, c.source) AS source, coalesce(b.page, c.page) AS page, b.page IS NOT NULL AS bookmarked, b.ordinal AS o FROM c FULL JOIN b ON c.source = b.source AND c.page = b.page) SELECT source, page, bookmarked, row_number() OVER (PARTITION BY source ORDER BY NOT bookmarked, o, page) AS ordinal FROM a")
def bookmarked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("page"), F.col("l_linenumber").alias("ordinal")).distinct()
    return pages.ordered(c, pages.bookmarks(_toc(spark, sf_dir)))


@_query("SELECT l_orderkey AS source, CASE WHEN avg((l_quantity < 20)::INT) >= 0.5 THEN 'text_based' WHEN avg((l_quantity < 20)::INT) > 0 THEN 'mixed' ELSE 'scanned' END AS pdf_type FROM lineitem GROUP BY 1")
def pdf_type_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.pdf_type(_t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), (F.col("l_quantity") < 20).alias("has_text")))


_STAGES = f"s AS (SELECT l_orderkey AS source, l_linenumber AS ordinal, l_quantity AS score, CASE WHEN l_partkey % 4 = 0 THEN {_made('l_partkey * 3')} END AS isbn FROM lineitem), d AS (SELECT source, ordinal, max(score) AS score, min(isbn) AS isbn FROM s GROUP BY 1, 2)"


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_partkey")
    s = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("ordinal"), F.col("l_quantity").alias("score"), F.when(p % 4 == 0, made(p * 3)).alias("isbn"))
    return s.groupBy("source", "ordinal").agg(F.max("score").alias("score"), F.min("isbn").alias("isbn"))


@_query(f"WITH {_STAGES} SELECT source, min(ordinal) AS ordinal, arg_min(isbn, ordinal) AS isbn FROM d WHERE isbn IS NOT NULL GROUP BY source")
def first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.first_success(_stages(spark, sf_dir)).select("source", "ordinal", "isbn")


@_query(f"WITH {_STAGES}, w AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, ordinal) AS i FROM d WHERE source NOT IN (SELECT source FROM d WHERE isbn IS NOT NULL)) SELECT source, ordinal, score FROM w WHERE i = 1")
def best_failed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.best_failure(_stages(spark, sf_dir)).select("source", "ordinal", "score")


_MEMBER = "n AS (SELECT l_orderkey AS archive, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ordinal, CASE l_partkey % 6 WHEN 0 THEN 'OEBPS/Copyright.xhtml' WHEN 1 THEN 'a/ch' || l_partkey || '.html' WHEN 2 THEN l_partkey || '.PDG' WHEN 3 THEN 'leg001.pdg' WHEN 4 THEN 'cov001.pdg' ELSE 'img/title.png' END AS name FROM lineitem)"


def _archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_partkey")
    name = F.when(p % 6 == 0, "OEBPS/Copyright.xhtml").when(p % 6 == 1, F.concat(F.lit("a/ch"), p, F.lit(".html"))).when(p % 6 == 2, F.concat(p, F.lit(".PDG"))).when(p % 6 == 3, "leg001.pdg").when(p % 6 == 4, "cov001.pdg").otherwise("img/title.png")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("archive"), F.row_number().over(w).alias("ordinal"), name.alias("name"), (F.col("l_suppkey") % 37 == 0).alias("encrypted"))


@_query(f"WITH {_MEMBER}, r AS (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY name NOT LIKE '%Copyright%', ordinal) AS at_ FROM n WHERE regexp_matches(lower(name), '\\.(opf|xhtml|html|htm|xml)$')) SELECT archive, name, at_ AS place FROM r WHERE at_ <= 200")
def epub_member_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.member_order(_archive_members(spark, sf_dir)).select("archive", "name", F.col("at").alias("place"))


@_query(f"WITH {_MEMBER} SELECT archive, name, row_number() OVER (PARTITION BY archive ORDER BY CASE WHEN name LIKE 'leg%' THEN 0 ELSE 1 END, ordinal) AS place FROM n WHERE name LIKE 'leg%' OR name LIKE 'cov%'")
def archive_image_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.images_first(_archive_members(spark, sf_dir), ("leg", "cov")).select("archive", "name", F.col("at").alias("place"))


@_query("SELECT l_orderkey AS archive, count(*) FILTER (WHERE l_partkey % 6 IN (2, 3, 4)) AS pdgs, bool_or(l_suppkey % 37 = 0) AS encrypted, CASE WHEN bool_or(l_suppkey % 37 = 0) THEN 'encrypted' WHEN count(*) FILTER (WHERE l_partkey % 6 IN (2, 3, 4)) < 2 THEN 'too_few_members' ELSE 'open' END AS verdict FROM lineitem GROUP BY 1")
def archive_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.archive_gate(_archive_members(spark, sf_dir), Options(pdg_least=2))


# Geometry -------------------------------------------------------------------------------------------------------------

_WH = "(200 + p_partkey % 3000)::DOUBLE AS w, (300 + (p_partkey * 7) % 2500)::DOUBLE AS h"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return _t(spark, sf_dir, "part").select(k.alias("k"), (200 + k % 3000).cast("double").alias("w"), (300 + k * 7 % 2500).cast("double").alias("h"))


@_query(f"WITH s AS (SELECT p_partkey AS k, {_WH} FROM part), z AS (SELECT *, least(1280 / w, 1280 / h) AS scale FROM s), f AS (SELECT *, floor((1280 - round_even(w * scale, 0)) / 2) AS px, floor((1280 - round_even(h * scale, 0)) / 2) AS py FROM z), b AS (SELECT *, floor((100 - px) / scale - 20) AS l, floor((200 - py) / scale - 20) AS t, ceil((500 - px) / scale + 20) AS r, ceil((400 + k % 700 - py) / scale + 20) AS m FROM f), c AS (SELECT k, greatest(0, least(w, l))::INT AS l, greatest(0, least(h, t))::INT AS t, greatest(0, least(w, r))::INT AS r, greatest(0, least(h, m))::INT AS m FROM b) SELECT k, l AS left_, t AS top_, r AS right_, m AS bottom_ FROM c WHERE r > l AND m > t")
def box_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sizes(spark, sf_dir).withColumn("frame", geometry.letterbox("w", "h"))
    box = F.struct(F.lit(100.0).alias("x1"), F.lit(200.0).alias("y1"), F.lit(500.0).alias("x2"), (400.0 + F.col("k") % 700).alias("y2"))
    out = s.withColumn("b", geometry.unboxed(box, F.col("w"), F.col("h"), F.col("frame"))).where("b IS NOT NULL")
    return out.select("k", F.col("b.left").alias("left_"), F.col("b.top").alias("top_"), F.col("b.right").alias("right_"), F.col("b.bottom").alias("bottom_"))


@_query(f"WITH s AS (SELECT p_partkey AS k, {_WH} FROM part) SELECT k, round(greatest(600 / least(w, h), least(2000 / least(w, h), 2.0::DOUBLE)), 6) AS zoom FROM s")
def render_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark, sf_dir).select("k", F.round(geometry.zoom("w", "h"), 6).alias("zoom"))


_TYPES = ("AA", "AC", "AB", "FF", "10", "02")


@_query("SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 1120 WHEN 1 THEN 1120 WHEN 2 THEN 3 WHEN 5 THEN CASE WHEN (p_partkey % 200) * 3 * 3 <= 150 * 60 THEN p_partkey % 200 END END::INT AS width, CASE p_partkey % 6 WHEN 0 THEN 1568 WHEN 1 THEN 1568 WHEN 2 THEN p_partkey % 200 WHEN 5 THEN CASE WHEN (p_partkey % 200) * 3 * 3 <= 150 * 60 THEN 3 END END::INT AS height FROM part")
def pdg_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (k % 6 + 1).cast("int"))
    content = F.unhex(F.concat(F.repeat(F.lit("00"), F.lit(15)), kind, F.lpad(F.hex(k % 200), 2, "0"), F.lit("000300"), F.repeat(F.lit("00"), F.lit(130))))
    return _t(spark, sf_dir, "part").select(k.alias("k"), geometry.pdg_header(content).alias("p")).select("k", "p.width", "p.height")


_IOU = "greatest(least(p.x2, x.x2) - greatest(p.x1, x.x1), 0) * greatest(least(p.y2, x.y2) - greatest(p.y1, x.y1), 0)"


@_query(f"WITH RECURSIVE b AS (SELECT l_orderkey AS image, l_linenumber % 3 AS class_id, l_quantity * 4 AS x1, (l_partkey % 100)::DOUBLE AS y1, l_quantity * 4 + 60 AS x2, (l_partkey % 100)::DOUBLE + 60 AS y2, 1.0::DOUBLE - l_discount * 9 AS score FROM lineitem), g AS (SELECT image, class_id, list(b ORDER BY score DESC, x1, y1) AS alive FROM b WHERE score >= 0.3 GROUP BY 1, 2), r AS (SELECT image, class_id, alive[1] AS p, alive[2:] AS rest FROM g UNION ALL SELECT image, class_id, rest[1], rest[2:] FROM (SELECT image, class_id, [x for x in rest if {_IOU} / greatest((p.x2 - p.x1) * (p.y2 - p.y1) + (x.x2 - x.x1) * (x.y2 - x.y1) - {_IOU}, 1e-9) <= 0.45] AS rest FROM r) WHERE len(rest) > 0) SELECT image, class_id, p.x1 AS x1, p.y1 AS y1, p.x2 AS x2, p.y2 AS y2, p.score AS score FROM r")
def box_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy per image and class."""
    x = F.col("l_quantity") * 4
    y = F.pmod("l_partkey", F.lit(100)).cast("double")
    b = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), (F.col("l_linenumber") % 3).alias("class_id"), x.alias("x1"), y.alias("y1"), (x + 60).alias("x2"), (y + 60).alias("y2"), (F.lit(1.0) - F.col("l_discount") * 9).alias("score"))
    return geometry.suppress(b)


@_query("SELECT p_partkey AS k, CASE WHEN s = 1 THEN w::INT ELSE greatest(1, round_even(w * s, 0))::INT END AS width, CASE WHEN s = 1 THEN h::INT ELSE greatest(1, round_even(h * s, 0))::INT END AS height FROM (SELECT *, CASE WHEN greatest(w, h) > 2000 THEN least(a, 2000 / greatest(w, h)) ELSE a END AS s FROM (SELECT *, greatest(1.0::DOUBLE, 600 / least(w, h)) AS a FROM (SELECT p_partkey, (200 + p_partkey % 3000)::DOUBLE AS w, (300 + (p_partkey * 7) % 2500)::DOUBLE AS h FROM part)))")
def raster_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark, sf_dir).select("k", geometry.raster("w", "h", 600, 2000).alias("r")).select("k", "r.width", "r.height")


# Images, members and whole files --------------------------------------------------------------------------------------

_BOX = f"b AS (SELECT l_orderkey AS source, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS box, l_partkey % 3 AS class_id, l_quantity AS score, {_made('l_partkey + l_suppkey')} AS barcode, {_made('l_suppkey * 2 + 1')} AS x FROM lineitem), n AS (SELECT *, CASE WHEN class_id = 2 AND {_sound('barcode')} THEN barcode WHEN {_acceptable('x')} THEN x END AS isbn FROM b)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("source"), at.alias("box"), (F.col("l_partkey") % 3).cast("int").alias("class_id"), F.col("l_quantity").alias("score"), (F.col("l_partkey") + F.col("l_suppkey")).alias("k"), (F.col("l_suppkey") * 2 + 1).alias("j"))
    both = isbn.once(isbn.once(rows, "barcode", made(F.col("k"))), "x", made(F.col("j")))
    lines = F.filter(F.array(F.lit("图书在版编目"), F.concat(F.lit("书号 ISBN "), F.substring("x", 1, 3), F.lit("-"), F.substring("x", 4, 10))), lambda v: v.isNotNull())
    return both.select("source", F.lit("page001").alias("item"), "box", "class_id", "score", "barcode", lines.alias("lines"))


@_query(f"WITH {_BOX} SELECT source::VARCHAR AS source, coalesce(arg_min(box, box) FILTER (WHERE isbn IS NOT NULL), max(box)) AS box, arg_min(isbn, box) FILTER (WHERE isbn IS NOT NULL) AS isbn, coalesce(arg_min(score, box) FILTER (WHERE isbn IS NOT NULL), arg_max(score, box)) AS score FROM n GROUP BY source")
def detected_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detected(_boxes(spark, sf_dir)).select("source", "box", "isbn", "score")


@_query(f"WITH {_BOX} SELECT source::VARCHAR AS source, min(isbn) IS NOT NULL AS success, arg_min(isbn, box) FILTER (WHERE isbn IS NOT NULL) AS isbn, 'onnx' AS method, 1 AS page, CASE WHEN min(isbn) IS NULL THEN 'not_recognised' END AS error FROM n GROUP BY source")
def extract_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    files = _t(spark, sf_dir, "lineitem").select("l_orderkey").distinct().select(F.col("l_orderkey").cast("string").alias("path"))
    shots = files.select(F.col("path").alias("source"), F.lit("page001").alias("item"), F.lit(1).alias("at"), F.lit(1).alias("page"), F.lit("onnx").alias("method"))
    return detect.completed(extract.image_rows(files), shots, detect.detected(boxes)).select("source", "success", "isbn", "method", "page", "error")


_PICTURES = f"WITH {_MEMBER}, s AS (SELECT *, CASE WHEN name LIKE 'leg%' THEN 0 WHEN name LIKE 'cov%' THEN 1 ELSE 2 END AS kind FROM n WHERE lower(name) LIKE '%.pdg'), t AS (SELECT *, row_number() OVER (PARTITION BY archive, kind ORDER BY kind, name, ordinal) AS nth FROM s)"


@_query(_PICTURES + " SELECT archive, name, row_number() OVER (PARTITION BY archive ORDER BY kind, name, ordinal) AS place, CASE WHEN kind < 2 THEN -10 ELSE nth END::INT AS page, CASE kind WHEN 0 THEN 'leg001' WHEN 1 THEN 'cov' ELSE 'pdg' END AS method FROM t WHERE kind < 2 OR nth <= 1")
def archive_picture_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal pages, covers, then the first of the rest."""
    out = detect.archive_images(_archive_members(spark, sf_dir), Options(pdg_fallback=1))
    return out.select(F.col("source").alias("archive"), F.col("item").alias("name"), F.col("at").alias("place"), "page", "method")


_PIC = "CASE l_partkey % 4 WHEN 0 THEN 'img/cover.JPG' WHEN 1 THEN 'img/leg1.png' WHEN 2 THEN 'img/p.png' ELSE 'cov.xhtml' END"


@_query(f"WITH n AS (SELECT l_orderkey AS archive, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ordinal, {_PIC} AS name FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY name NOT LIKE '%cover%', ordinal) AS place FROM n WHERE name LIKE '%cover%' OR name LIKE '%leg1%') SELECT archive, name, place FROM r WHERE place <= 3")
def epub_picture_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_partkey") % 4
    name = F.when(p == 0, "img/cover.JPG").when(p == 1, "img/leg1.png").when(p == 2, "img/p.png").otherwise("cov.xhtml")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    members = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("archive"), F.row_number().over(w).alias("ordinal"), name.alias("name"))
    return detect.epub_images(members, 3).select(F.col("source").alias("archive"), F.col("item").alias("name"), F.col("at").alias("place"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey with two made numbers."""
    k = F.col("p_partkey")
    return isbn.once(isbn.once(_t(spark, sf_dir, "part").select(k.alias("k")), "x", made(F.col("k"))), "y", made(F.col("k") + 1))


def _member_rows(parts: DataFrame, *members: tuple) -> DataFrame:
    """members: (name, content as string, condition)."""
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("name"), F.when(c, F.encode(F.coalesce(t, F.lit("")), "UTF-8")).alias("content")) for i, (n, t, c) in enumerate(members)])
    m = parts.select(F.col("k").cast("string").alias("archive"), (F.col("k") % 11 == 0).alias("encrypted"), F.explode(rows).alias("m")).where("m.content IS NOT NULL")
    return m.select("archive", "m.ordinal", "m.name", F.octet_length("m.content").cast("long").alias("size"), "encrypted", "m.content")


@_query(f"WITH p AS (SELECT p_partkey AS k, {_made('p_partkey')} AS x, {_made('p_partkey + 1')} AS y FROM part), r AS (SELECT k, CASE WHEN k % 2 = 0 AND {_acceptable('x')} THEN x WHEN {_acceptable('y')} THEN y END AS isbn FROM p) SELECT k::VARCHAR AS source, isbn, isbn IS NOT NULL AS success, 'epub' AS source_type, CASE WHEN isbn IS NULL THEN 'not_found' END AS error FROM r")
def extract_epub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package file first, then markup."""
    yes, p = F.lit(True), _parts(spark, sf_dir)
    dashed = lambda c: F.concat(F.substring(c, 1, 3), F.lit("-"), F.substring(c, 4, 1), F.lit("-"), F.substring(c, 5, 9))
    members = _member_rows(p, ("text/a.xhtml", F.concat(F.lit("<p>ISBN "), F.coalesce(F.col("y"), F.lit("")), F.lit("</p>")), yes), ("META-INF/container.xml", F.lit('<r full-path="c/book.opf"/>'), yes), ("c/book.opf", F.concat(F.lit("<id>isbn "), F.coalesce(dashed("x"), F.lit("")), F.lit("</id>")), F.col("k") % 2 == 0))
    return extract.from_epub(members).select("source", "isbn", "success", "source_type", "error")


_ARCHIVE = f"p AS (SELECT p_partkey AS k, {_made('p_partkey')} AS x, {_made('p_partkey + 1')} AS y, p_partkey % 11 = 0 AS locked, p_partkey % 5 = 0 AS few FROM part), f AS (SELECT *, CASE WHEN k % 4 IN (0, 1) THEN x END AS ix, CASE WHEN k % 4 IN (0, 1) AND k % 8 <> 1 THEN lpad(k::VARCHAR, 8, '1') END AS is_, CASE WHEN k % 4 IN (1, 2) THEN y END AS mx, CASE WHEN k % 4 = 2 THEN lpad(k::VARCHAR, 8, '2') END AS ms FROM p), r AS (SELECT *, CASE WHEN NOT (locked OR few) THEN coalesce(mx, ix) END AS isbn, CASE WHEN NOT (locked OR few) THEN coalesce(ms, is_) END AS ssid, NOT (locked OR few) AND coalesce(ix, is_) IS NOT NULL AS had FROM f)"


@_query(f"WITH {_ARCHIVE} SELECT k::VARCHAR AS source, isbn, ssid, {_sound('isbn')} OR ssid IS NOT NULL AS success, CASE WHEN had THEN 'bookinfo' WHEN coalesce(isbn, ssid) IS NOT NULL THEN 'meta' END AS method, CASE WHEN had THEN -20 WHEN coalesce(isbn, ssid) IS NOT NULL THEN -21 END AS page, CASE WHEN locked THEN 'encrypted' WHEN few THEN 'too_few_members' WHEN coalesce(isbn, ssid) IS NULL THEN 'not_found' END AS error FROM r")
def extract_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("k"), _parts(spark, sf_dir)
    ssid = lambda digit, when: F.when(when, F.lpad(k.cast("string"), 8, digit))
    info = F.concat(F.lit("[General]\nISBN号="), F.coalesce("x", F.lit("")), F.lit("\nSS号="), F.coalesce(ssid("1", k % 8 != 1), F.lit("")))
    xml = F.concat(F.lit("<meta><isbn>"), F.coalesce("y", F.lit("")), F.lit("</isbn><ssid>"), F.coalesce(ssid("2", k % 4 == 2), F.lit("")), F.lit("</ssid></meta>"))
    members = _member_rows(p, ("b/BookInfo.dat", info, k % 4 < 2), ("meta.xml", xml, (k % 4).isin(1, 2)), ("000001.pdg", F.lit("x"), k % 5 != 0), ("readme.txt", F.lit("x"), F.lit(True)))
    return extract.from_archive(members, Options(pdg_least=1)).select("source", "isbn", "ssid", "success", "method", "page", "error")


_PDF = f"l AS (SELECT l_orderkey AS source, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS page, count(*) OVER (PARTITION BY l_orderkey) AS n, CASE WHEN l_partkey % 4 = 0 THEN {_made('l_partkey')} END AS x FROM lineitem), c AS (SELECT *, CASE WHEN page >= 2 AND page <= least(n, 5) THEN page WHEN page >= n - 2 THEN 100 + page END AS spot FROM l), h AS (SELECT source, arg_min(page, spot) AS page, arg_min(x, spot) AS isbn FROM c WHERE spot IS NOT NULL AND source % 3 <> 0 AND {_acceptable('x')} GROUP BY source)"


@_query(f"WITH {_PDF} SELECT s.source::VARCHAR AS source, h.isbn, h.page::INT AS page, h.isbn IS NOT NULL AS success, CASE WHEN h.isbn IS NOT NULL THEN 'text' END AS method, CASE WHEN h.isbn IS NULL THEN 'no_region' END AS error FROM (SELECT DISTINCT source FROM l) s LEFT JOIN h USING (source)")
def extract_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of text-based sources alone; scanned ones are left for a detector."""
    w = Window.partitionBy("l_orderkey")
    at = F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", at.alias("page"), F.count(F.lit(1)).over(w).cast("int").alias("pages"), F.col("l_partkey").alias("k"))
    rows = isbn.once(rows, "x", F.when(F.col("k") % 4 == 0, made(F.col("k"))))
    text = F.when(F.col("l_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("书名\n  ISBN "), F.coalesce("x", F.lit("none"))))
    got = extract.from_pdf_pages(rows.select(F.col("l_orderkey").cast("string").alias("source"), "page", text.alias("text"), "pages"))
    return got.select("source", "isbn", "page", "success", "method", "error")


@_query(f"WITH {_N} SELECT k, {_acceptable('x')} AS has_number, CASE WHEN {_acceptable('x')} THEN x END AS isbn, k % 2 = 0 AS is_page FROM n")
def cip_book_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cataloguing page's number, split over two lines for some."""
    head = F.when(F.col("k") % 2 == 0, "图书在版编目（CIP）数据").otherwise("目录")
    a = F.when(F.col("k") % 4 < 2, F.array(head, F.concat(F.lit("ISBN　"), F.coalesce("x", F.lit(""))))).otherwise(F.array(head, F.concat(F.lit("ISBN "), F.coalesce(F.substring("x", 1, 7), F.lit(""))), F.coalesce(F.substring("x", 8, 6), F.lit("")), F.lit("定价")))
    n = isbn.once(_numbers(spark, sf_dir), "n", cip.book_number(a))
    return n.select("k", F.col("n").isNotNull().alias("has_number"), F.col("n").alias("isbn"), cip.is_page(a).alias("is_page"))


@_query("SELECT '{\"k\":' || n_nationkey || ',\"name\":\"' || n_name || '\",\"none\":null}' AS value FROM nation")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.as_json(_t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("none")))


@_query("SELECT count(*) FILTER (WHERE o_orderkey % 7 <> 0) AS removed, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS errors, sum(CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END)::BIGINT AS reclaimed_bytes FROM orders")
def removal_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 7 == 0
    return dedup.reclaimed(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.when(k, 0).otherwise(F.col("o_custkey")).alias("reclaimed"), F.when(k, "busy").alias("error")))


@_query(f"WITH {_N}, {_PATHS}, {_FOUND}, {_OUTCOME} SELECT path AS old, row_number() OVER (ORDER BY path) AS index, count(*) OVER () AS total, CASE outcome WHEN 'extract_isbn' THEN 'isbn_ok' WHEN 'extract_ssid' THEN 'ssid_ok' WHEN 'error' THEN NULL ELSE outcome END AS tag FROM o")
def batch_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listener gets of each file, with the running index."""
    return batch.entries(_results(spark, sf_dir)).select("old", "index", "total", "tag")
