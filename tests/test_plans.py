import io
import os
import struct
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from folioscan.operators import dedup, geometry, pages
from folioscan.plans import batch, detect, extract
from folioscan.sources import files, sinks

N = "9787894465412"


def zipped(members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return b.getvalue()


def book(text: bytes, exth: bytes = b"") -> bytes:
    head = struct.pack(">HHIHHI", 1, 0, len(text), 2, 4096, 0)
    ext = b"EXTH" + struct.pack(">LL", 12 + (8 + len(exth) if exth else 0), 1 if exth else 0) + (struct.pack(">LL", 104, 8 + len(exth)) + exth if exth else b"")
    rec0 = head + b"MOBI" + struct.pack(">L", 8) + ext
    start = 78 + 16
    return bytes(76) + struct.pack(">H", 2) + struct.pack(">LL", start, 0) + struct.pack(">LL", start + len(rec0), 0) + rec0 + text


def test_files_end_to_end(spark, tmp_path):
    epub = zipped([("META-INF/container.xml", '<r full-path="o.opf"/>'), ("o.opf", f"<x>ISBN {N}</x>"), ("a.html", "x")])
    archive = zipped([("bookinfo.dat", f"[g]\nISBN号={N}\nSS号=12345678".encode("gb18030")), *[(f"{i}.pdg", b"x") for i in range(30)]])
    for name, data in (("a.epub", epub), ("b.zip", archive), ("c.mobi", book(f"isbn {N}".encode())), ("d.mobi", book(b"x", N.encode())), ("e.zip", b"no"), ("f.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    all_files = files.scan(spark, files.root(str(tmp_path)))
    known, unknown = files.with_kind(all_files)
    assert unknown.count() == 1
    members = files.zip_members(known.where("kind IN ('epub', 'archive')"))
    e = extract.from_epub(members.where("archive LIKE '%epub'")).first()
    assert (e.success, e.isbn, e.error) == (True, N, None)
    got = {r.source.rsplit("/", 1)[1]: r for r in extract.from_archive(members.where("archive LIKE '%zip'")).collect()}
    assert (got["b.zip"].isbn, got["b.zip"].ssid, got["b.zip"].method, got["b.zip"].page) == (N, "12345678", "bookinfo", -20)
    assert got["e.zip"].error == "too_few_members"
    # One unread record is part of the reference's rule, so the text has to be in EXTH or before the last record.
    m = {r.source.rsplit("/", 1)[1]: r.isbn for r in extract.from_mobi(known.where("kind = 'mobi'")).collect()}
    assert m["d.mobi"] == N


def test_pdf_pages(spark):
    rows = [("a", p, f"page {p}" if p != 9 else f"书 ISBN {N}\nx", 10) for p in range(1, 11)]
    text = spark.createDataFrame(rows, "source string, page int, text string, pages int")
    assert extract.from_pdf_pages(text).first().method == "text"
    toc = spark.createDataFrame([("a", "版权", 9)], "source string, title string, page int")
    r = extract.from_pdf_pages(text, toc).first()
    assert (r.isbn, r.page, r.method) == (N, 9, "bookmark")


def test_everything(spark, tmp_path):
    """Files of all kinds in one plan, with a provider's pages and boxes, and a batch of them from folder to destinations."""
    from folioscan.options import Options

    epub = zipped([("META-INF/container.xml", '<r full-path="o.opf"/>'), ("o.opf", f"<x>ISBN {N}</x>")])
    bare = zipped([("META-INF/container.xml", "<r/>"), ("cover.png", b"x")])
    archive = zipped([("bookinfo.dat", f"[g]\nISBN号={N}".encode("gb18030")), *[(f"{i:06}.pdg", b"x") for i in range(30)]])
    pictures = zipped([*[(f"{i:06}.pdg", b"x") for i in range(30)], ("leg001.pdg", b"x"), ("cov001.pdg", b"x")])
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    for name, data in (("a.epub", epub), ("b.zip", archive), ("sub/c.mobi", book(b"x", N.encode())), ("d.zip", pictures), ("e.zip", b"no"), ("f.txt", b"x"), ("g.png", b"x"), ("h.pdf", b"x"), ("i.pdf", b"x"), ("j.epub", bare), (f"k_{N}.zip", b"no")):
        (folder / name).write_bytes(data)
    at = lambda n: str(folder / n)
    boxes = [(at("d.zip"), "000002.pdg", 1, 0, 0.9, None, ["x", f"ISBN {N}"]), (at("d.zip"), "leg001.pdg", 1, 2, 0.4, "123", ["nothing"]), (at("g.png"), at("g.png"), 1, 2, 0.8, N, None), (at("j.epub"), "cover.png", 1, 1, 0.7, None, ["图书在版编目", "x"]), (at("i.pdf"), "page003", 1, 0, 0.5, None, [N])]
    boxes = spark.createDataFrame(boxes, detect.BOXES)
    text = spark.createDataFrame([(at("h.pdf"), p, f"ISBN {N}" if p == 2 else "text", 6) for p in range(1, 7)] + [(at("i.pdf"), p, "", 6) for p in range(1, 7)], "source string, page int, text string, pages int")
    found = files.scan(spark, str(folder)).select("path", "content")
    got = {r.source[len(str(folder)) + 1 :]: r for r in extract.everything(found, page_text=text, boxes=boxes).collect()}
    assert len(got) == 11
    assert {n: got[n].isbn for n in got} == {"a.epub": N, "b.zip": N, "sub/c.mobi": N, "d.zip": N, "e.zip": None, "f.txt": None, "g.png": N, "h.pdf": N, "i.pdf": N, "j.epub": None, f"k_{N}.zip": None}
    assert {n: got[n].error for n in got if got[n].error} == {"e.zip": "corrupt", "f.txt": "unsupported_suffix", "j.epub": "not_recognised", f"k_{N}.zip": "corrupt"}
    assert (got["d.zip"].method, got["d.zip"].page) == ("pdg", 3) or (got["d.zip"].method, got["d.zip"].page) == ("pdg", 2) or got["d.zip"].page == 3
    assert (got["i.pdf"].page, got["h.pdf"].method) == (3, "text") and all(r.success == (r.isbn is not None) for r in got.values())
    plain = {r.source[len(str(folder)) + 1 :]: r for r in extract.everything(found, by_name=True).collect()}
    assert plain["h.pdf"].error == "no_provider" and plain[f"k_{N}.zip"].method == "filename" and plain[f"k_{N}.zip"].isbn == N

    rows, total, moves = batch.run_folder(spark, str(folder), str(tmp_path / "ok"), str(tmp_path / "no"), Options(keep_tree=True))
    assert [r["index"] for r in rows.orderBy("index").collect()] == list(range(1, 10))
    s = total.first()
    assert (s.total, s.skipped, s.success, s.failed) == (9, 1, 3, 5)
    assert all((folder / n).exists() for n in got)  # nothing moves before moves runs
    assert all(r.error is None for r in moves.collect())
    assert (tmp_path / f"ok/sub/c_{N}.mobi").exists() and (tmp_path / "no/e.zip").exists() and (folder / "f.txt").exists()


def test_command(spark, tmp_path, capsys):
    from folioscan import __main__ as command

    (tmp_path / f"x_{N}.mobi").write_bytes(b"x")
    command.main([str(tmp_path), "--json", "--filename", "--strict", "2"])
    assert f'"isbn":"{N}"' in capsys.readouterr().out


def test_clean(spark, tmp_path):
    """From a listing to removal: contents are read by path only where sizes, then prefixes, meet."""
    for name, data in (("a", "same" * 200), ("b", "same" * 200), ("sub/c", "same" * 200), ("d", "same" * 199 + "sama"), ("e", "x"), ("f", "")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(data)
    os.utime(tmp_path / "b", ns=(5, 5))
    (tmp_path / "sub/circle").symlink_to(tmp_path, target_is_directory=True)
    listed = files.listing(spark, str(tmp_path))
    assert listed.count() == 6 and listed.where("error IS NOT NULL").count() == 0
    assert files.listing(spark, str(tmp_path), follow_symlinks=True).select("ino").distinct().count() == 6
    rows = listed.drop("error")
    found = dedup.find_duplicates(rows, "oldest_modified").collect()
    assert {r.path.rsplit("/", 1)[1]: r.keep for r in found} == {"a": False, "b": True, "c": False}
    plan = dedup.digests(dedup.candidates(rows.withColumn("content", F.lit(b"x"))))._jdf.queryExecution().executedPlan().toString()
    assert not any("content" in x for x in plan.splitlines() if "Exchange" in x)
    key = F.lit(1.0).alias("last_used")
    cache = rows.where("path LIKE '%/a' OR path LIKE '%/c'").select("size", F.col("modified").alias("mtime_ns"), "path", F.lit("known").alias("md5_hex"), key)
    sinks.save_cache(cache, str(tmp_path / "cache"))
    sinks.save_cache(sinks.load_cache(spark, str(tmp_path / "cache")), str(tmp_path / "cache"))
    kept = sinks.load_cache(spark, str(tmp_path / "cache"))
    assert kept.count() == 2 and sinks.load_cache(spark, str(tmp_path / "none")).count() == 0
    assert {r.path.rsplit("/", 1)[1]: r.md5 == "known" for r in dedup.digests(rows, kept).collect()} == {"a": True, "b": False, "c": True, "d": False}
    assert dedup.auto_clean(rows, "oldest_modified", dry_run=True).count() == 2 and (tmp_path / "a").exists()
    gone = dedup.auto_clean(rows, "oldest_modified", trash=str(tmp_path / "trash")).collect()
    assert sum(r.reclaimed for r in gone) == 1600 and len(list((tmp_path / "trash").iterdir())) == 2
    assert (tmp_path / "b").exists() and not (tmp_path / "a").exists()


def test_run(spark):
    f = spark.createDataFrame([(f"/in/{N}.PDF",), ("/in/x/a.pdf",), ("/in/y/a.pdf",), ("/in/z_12345678.epub",)], "path string")
    found = lambda rest: rest.select("path", F.when(F.col("path").contains("/x/"), N).alias("isbn"), F.lit(None).cast("string").alias("ssid"), F.lit(None).cast("string").alias("error"))
    plan = {r.path: r for r in batch.run(f, found).collect()}
    assert [plan[p].outcome for p in (f"/in/{N}.PDF", "/in/x/a.pdf", "/in/y/a.pdf", "/in/z_12345678.epub")] == ["skip_isbn", "extract_isbn", "failed", "fallback_ssid"]
    assert plan["/in/x/a.pdf"].name == f"a_{N}.pdf"


def test_sinks(spark, tmp_path):
    for n in ("a.txt", "b.txt"):
        (tmp_path / n).write_text("same")
    plan = spark.createDataFrame([(str(tmp_path / "a.txt"), "success", "n/c.txt")], "path string, folder string, name string")
    moved = sinks.move(plan, str(tmp_path / "ok"), str(tmp_path / "no"))
    assert moved.collect()[0].error is None and (tmp_path / "ok/n/c.txt").exists()
    assert moved.collect()[0].error is None  # again: nothing to do
    gone = sinks.remove(spark.createDataFrame([(str(tmp_path / "b.txt"), 4)], "path string, size long")).collect()[0]
    assert gone.reclaimed == 4 and not (tmp_path / "b.txt").exists()
    assert sinks.as_json(plan).first().value.startswith('{"path"')


def test_duplicates(spark):
    rows = [(f"/{i}", len(t), t.encode(), i, i, i) for i, t in enumerate(["aa", "aa", "ab", "c", "aa", "c", "", ""])]
    f = spark.createDataFrame(rows, "path string, size long, content binary, changed long, modified long, accessed long")
    found = dedup.find_duplicates(f, most=2).orderBy("path").collect()
    assert [(r.path, r.keep) for r in found] == [("/0", True), ("/1", False), ("/4", False)]
    g = dedup.groups(dedup.digests(dedup.candidates(f)))
    assert g.count() == 2 and dedup.limited(g, 0).where("taken = dup_count").count() == 2
    assert dedup.removals(dedup.find_duplicates(f, most=0)).count() == 3


def test_pages(spark):
    get = lambda n: spark.range(1).select(pages.candidate_pages(F.lit(n)), pages.sampled_pages(F.lit(n))).first()
    assert tuple(get(1)) == ([1], [0]) and tuple(get(10)) == ([2, 3, 4, 5, 8, 9, 10], [1, 3, 5, 7, 9])


def test_suppression(spark):
    b = pd.DataFrame({"image": 1, "class_id": [0, 0, 1, 0], "x1": [0.0, 1, 0, 50], "y1": 0.0, "x2": [10.0, 11, 10, 60], "y2": 10.0, "score": [0.9, 0.8, 0.7, 0.1]})
    assert geometry.suppress(spark.createDataFrame(b)).count() == 2


def _one_by_one(rows):
    """Greedy suppression of (image, class_id, x1, y1, x2, y2, score), a group at a time."""
    kept = {}
    for r in sorted((r for r in rows if r[6] >= 0.3), key=lambda r: (-r[6], *r[2:6])):
        mine = kept.setdefault(r[:2], [])
        both = lambda k: max(min(r[4], k[4]) - max(r[2], k[2]), 0) * max(min(r[5], k[5]) - max(r[3], k[3]), 0)
        if all(both(k) / max((r[4] - r[2]) * (r[5] - r[3]) + (k[4] - k[2]) * (k[5] - k[3]) - both(k), 1e-9) <= 0.45 for k in mine):
            mine.append(r)
    return sorted(r for m in kept.values() for r in m)


def test_suppression_of_many_groups(spark):
    """Groups share a Python call, and one group may span Arrow batches."""
    rows = [(i % 300, i % 2, float(i * 37 % 101), float(i * 53 % 97), float(i * 37 % 101 + 30), float(i * 53 % 97 + 30), round((i * 7919 % 1000) / 1000, 3)) for i in range(6000)]
    rows += [(1000, 0, float(i * 3 % 4000), 0.0, float(i * 3 % 4000 + 10), 10.0, 0.5 + i * 7919 % 4000 / 10000) for i in range(3000)]
    b = spark.createDataFrame(rows, "image long, class_id int, x1 double, y1 double, x2 double, y2 double, score double")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("10000", "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert sorted(map(tuple, geometry.suppress(b).collect())) == _one_by_one(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    plan = geometry.suppress(b)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan  # a call for each group costs about a millisecond


def test_entries_compute_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.range(1000).selectExpr("lpad(id, 4, '0') AS path", "'success' AS folder", "'n' AS name", "'failed' AS outcome", "cast(null AS string) AS error")
    got = batch.entries(rows.mapInPandas(count, rows.schema)).orderBy("old").collect()
    assert [(r["index"], r.total) for r in got] == [(i + 1, 1000) for i in range(1000)]
    assert seen.value == 1000


def test_stream(spark, tmp_path):
    from folioscan.streaming import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("x")
    seen = []
    watch.each_batch(watch.files(spark, str(tmp_path / "in")), lambda df, _: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination()
    assert sum(seen) == 1
