"""Extraction cascades over tables of members and pages: cheap and built-in first, one branch per source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions import isbn, meta
from folioscan.operators import pages
from folioscan.options import Options

ROW = ("success", "isbn", "ssid", "source", "source_type", "method", "page", "elapsed", "error")


def flat(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """The public row; rows have isbn, ssid, source, source_type, method, page, error."""
    ok = isbn.valid_for("isbn", "ssid", options.strict)
    return rows.withColumn("success", ok).withColumn("elapsed", F.lit(None).cast("double")).select(*ROW)


def from_epub(members: DataFrame, options: Options = Options()) -> DataFrame:
    """members (archive, ordinal, name, size, content): the package file first, then markup by member_order."""
    text = F.decode(F.col("content"), "ISO-8859-1")
    container = members.where(F.lower("name") == "meta-inf/container.xml")
    opf = container.select("archive", F.regexp_extract(text, 'full-path="([^"]+)"', 1).alias("opf"))
    marked = members.join(opf, "archive", "left").withColumn("is_opf", F.coalesce(F.col("name") == F.col("opf"), F.lit(False)))
    rest = pages.member_order(marked.where("NOT is_opf"), options).withColumn("ordinal", F.col("at")).drop("at")
    both = marked.where("is_opf").withColumn("ordinal", F.lit(0)).unionByName(rest)
    some = both.where((F.col("size") <= options.member_bytes) & isbn.gate(text))
    found = some.select(F.col("archive").alias("source"), "ordinal", isbn.extract(meta.decode_any("content"), options.china_only).alias("isbn"))
    hit = pages.first_success(found)
    out = members.select(F.col("archive").alias("source")).distinct().join(hit, "source", "left")
    none = F.lit(None).cast("string")
    return flat(out.select("isbn", none.alias("ssid"), "source", F.lit("epub").alias("source_type"), none.alias("method"), F.lit(None).cast("int").alias("page"), F.when(F.col("isbn").isNull(), "not_found").alias("error")), options)


def from_archive(members: DataFrame, options: Options = Options()) -> DataFrame:
    """members as above, encrypted too: the gate, then meta.xml and bookinfo.dat field by field."""
    gate = pages.archive_gate(members, options)
    base = F.lower(F.regexp_extract("name", "([^/]*)$", 1))
    inner = members.join(gate.where("verdict = 'open'").select("archive"), "archive", "left_semi")
    one = lambda n, most: inner.where((base == n) & (F.col("size") <= most)).groupBy("archive").agg(F.min_by("content", "name").alias("content"))
    info = one("bookinfo.dat", 1 << 20).withColumn("d", meta.decode_bookinfo("content")).select("archive", meta.bookinfo("d.text").alias("info"), F.col("d.encoding").alias("encoding"))
    xml = one("meta.xml", 1 << 18).select("archive", meta.meta_xml(meta.decode_any("content")).alias("xml"))
    both = gate.join(info, "archive", "left").join(xml, "archive", "left").withColumn("m", meta.merged(F.col("xml"), F.col("info")))
    had = F.coalesce(F.col("info.isbn"), F.col("info.ssid")).isNotNull()
    got = F.coalesce(F.col("m.isbn"), F.col("m.ssid")).isNotNull()
    method = F.when(had, "bookinfo").when(got, "meta")
    page = F.when(had, -20).when(got, -21)
    error = F.when(F.col("verdict") != "open", F.col("verdict")).when(~got, "not_found")
    return flat(both.select(F.col("m.isbn").alias("isbn"), F.col("m.ssid").alias("ssid"), F.col("archive").alias("source"), F.lit("archive").alias("source_type"), method.alias("method"), page.alias("page"), error.alias("error")), options)


def from_pdf_pages(page_text: DataFrame, toc: DataFrame | None = None, options: Options = Options()) -> DataFrame:
    """page_text (source, page, text, pages): candidate pages, bookmarked first; lines that can be trusted. Only the text of
    text-based sources is read, by their sampled pages; scanned and mixed ones are for detect.completed()."""
    sampled = F.array_contains(pages.sampled_pages("pages"), F.col("page") - 1)
    kinds = pages.pdf_type(page_text.where(sampled).select("source", (F.length(F.btrim("text")) > 0).alias("has_text")))
    want = page_text.select("source", "pages").distinct().select("source", F.posexplode(pages.candidate_pages("pages", options)).alias("ordinal", "page"))
    marks = pages.bookmarks(toc) if toc is not None else want.where("false").select("source", "page", "ordinal")
    order = pages.ordered(want, marks)
    readable = page_text.join(kinds.where("pdf_type = 'text_based'"), "source", "left_semi")
    found = order.join(readable.select("source", "page", "text"), ["source", "page"]).select("source", "page", "ordinal", "bookmarked", isbn.search_lines(isbn.text_lines("text"), options.china_only).alias("isbn"))
    hit = pages.first_success(found)
    out = page_text.select("source").distinct().join(hit, "source", "left")
    method = F.when(F.col("bookmarked"), "bookmark").when(F.col("isbn").isNotNull(), "text")
    return flat(out.select("isbn", F.lit(None).cast("string").alias("ssid"), "source", F.lit("pdf").alias("source_type"), method.alias("method"), "page", F.when(F.col("isbn").isNull(), "no_region").alias("error")), options)


def from_mobi(files: DataFrame, options: Options = Options()) -> DataFrame:
    """files (path, content): one pass over each file, whose texts and error come in one group; the first number wins."""
    from folioscan.sources.mobi import first_texts

    none = F.lit(None).cast("string")
    rows = files.select("path", "content").mapInPandas(first_texts, "source string, ordinal int, text string, error string")
    found = isbn.once(rows, "isbn", isbn.extract("text", options.china_only))
    out = found.groupBy("source").agg(F.min_by("isbn", F.when(F.col("isbn").isNotNull(), F.col("ordinal"))).alias("isbn"), F.max("error").alias("error"))
    return flat(out.select("isbn", none.alias("ssid"), "source", F.lit("mobi").alias("source_type"), none.alias("method"), F.lit(None).cast("int").alias("page"), F.when(F.col("isbn").isNull(), F.coalesce("error", F.lit("not_found"))).alias("error")), options)


def image_rows(files: DataFrame) -> DataFrame:
    """Public rows of images, which have no text of their own."""
    return files.select(F.lit(False).alias("success"), *[F.lit(None).cast("string").alias(c) for c in ("isbn", "ssid")], F.col("path").alias("source"), F.lit("image").alias("source_type"), F.lit(None).cast("string").alias("method"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("double").alias("elapsed"), F.lit("no_region").alias("error"))


def everything(files: DataFrame, options: Options = Options(), page_text: DataFrame | None = None, toc: DataFrame | None = None, boxes: DataFrame | None = None, by_name: bool = False) -> DataFrame:
    """files (path, content) of any kind: a public row for each, by the branch of its suffix; one plan, nothing collected.
    page_text and toc of PDF files, and boxes (see detect) of images, come from providers; without them these are rows
    with an error. by_name: a sound number in a file's name settles it."""
    from folioscan.functions import naming
    from folioscan.plans import detect
    from folioscan.sources.files import zip_members

    kinds = files.withColumn("kind", naming.kind("path"))
    of = lambda k: kinds.where(F.col("kind") == k).drop("kind")
    found = None if boxes is None else detect.detected(boxes, options)
    fill = lambda rows, images: rows if found is None else detect.completed(rows, images, found, options)
    epub, archive = zip_members(of("epub")), zip_members(of("archive"))
    broken = lambda m, kind: _failed(m.where("error = 'corrupt'").select(F.col("archive").alias("path")), kind, "corrupt")
    image = of("image")
    parts = [
        fill(from_epub(epub.where("error IS NULL"), options), detect.epub_images(epub)), broken(epub, "epub"),
        fill(from_archive(archive.where("error IS NULL"), options), detect.archive_images(archive, options)), broken(archive, "archive"),
        from_mobi(of("mobi"), options),
        fill(image_rows(image), image.select(F.col("path").alias("source"), F.col("path").alias("item"), F.lit(1).alias("at"), F.lit(1).alias("page"), F.lit("onnx").alias("method"))),
        _failed(kinds.where("kind IS NULL"), None, "unsupported_suffix"),
    ]
    pdf = of("pdf").select("path")
    if page_text is None:
        parts.append(_failed(pdf, "pdf", "no_provider"))
    else:
        text = from_pdf_pages(page_text, toc, options)
        shots = page_text.select("source", "pages").distinct().select("source", F.posexplode(pages.candidate_pages("pages", options)).alias("at", "page"))
        text = fill(text, shots.select("source", F.format_string("page%03d", "page").alias("item"), "at", "page", F.lit("onnx").alias("method")))
        parts += [text, _failed(pdf.join(page_text.select(F.col("source").alias("path")).distinct(), "path", "left_anti"), "pdf", "corrupt")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if not by_name:
        return out
    named = isbn.once(out, "_n", meta.stem_ids(meta.stem("source")))
    use = isbn.valid_for("_n.isbn", "_n.ssid", options.strict)
    made = {"success": F.lit(True), "isbn": F.col("_n.isbn"), "ssid": F.col("_n.ssid"), "method": F.lit("filename"), "page": F.lit(None).cast("int"), "error": F.lit(None).cast("string")}
    return named.select(*[F.when(use, made[c]).otherwise(F.col(c)).alias(c) if c in made else F.col(c) for c in ROW])


def _failed(files: DataFrame, kind: str | None, error: str) -> DataFrame:
    return image_rows(files).withColumn("source_type", F.lit(kind).cast("string")).withColumn("error", F.lit(error))
