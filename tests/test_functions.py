import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscan.functions import cip, isbn, meta, naming
from folioscan.options import Options, extensions
from folioscan.sources import mobi

N = "9787894465412"


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("x", "ok", "sound", "other"),
    [("9787894465412", True, True, "7894465410"), ("9787115428028", True, True, "7115428026"), ("9787556412693", True, True, "7556412695"), ("9787123456789", False, False, None), ("712345678X", False, False, None), ("0306406152", False, True, "9780306406157"), ("2015101632", False, True, "9782015101637"), ("9137011219", False, True, "9789137011219"), ("7003780356", True, True, "9787003780351"), ("", False, False, None), ("12X4567890123", False, False, None), (None, False, False, None)],
)
def test_numbers(spark, x, ok, sound, other):
    r = spark.createDataFrame([(x,)], "x string").select(isbn.acceptable("x"), isbn.sound("x"), isbn.isbn10("x"), isbn.isbn13("x")).first()
    assert (r[0], r[1]) == (ok, sound)
    if other:
        assert other in (r[2], r[3])


def test_no_short_form_for_979(spark):
    body = "979123456789"
    x = body + str(-sum((1 + 2 * (i % 2)) * int(c) for i, c in enumerate(body)) % 10)
    assert one(spark, x, isbn.sound) and one(spark, x, isbn.isbn10) is None


@pytest.mark.parametrize(
    ("text", "want"),
    [("ISBN 978-7-89446-541-2", "9787894465412"), ("2024年出版 978-7-89446-541-2", "9787894465412"), ("ISBN 978唱7唱03唱027084唱9", "9787030270849"), ("1787894465412", "9787894465412"), ("ＩＳＢＮ　９７８７８９４４６５４１２", "9787894465412"), ("9787123456789 then 9787894465412", "9787894465412"), ("no number", None), ("", None), (None, None), ("2015101632", None)],
)
def test_extract(spark, text, want):
    r = spark.createDataFrame([(text,)], "x string").select(isbn.extract("x").alias("a"), isbn.extract_gated("x").alias("b")).first()
    assert r.a == r.b == want


def test_random_numbers(spark):
    rng, rows = random.Random(3), []
    for _ in range(300):
        body = "9787" + "".join(rng.choice("0123456789") for _ in range(8))
        good = body + str(-sum((1 + 2 * (i % 2)) * int(c) for i, c in enumerate(body)) % 10)
        at = rng.randrange(4, 13)
        rows.append((good, good[:at] + str((int(good[at]) + rng.randrange(1, 10)) % 10) + good[at + 1 :]))
    df = spark.createDataFrame(rows, "good string, bad string")
    back = isbn.isbn13(isbn.isbn10("good")) == F.col("good")
    assert df.where(isbn.acceptable("good") & back & ~isbn.sound("bad")).count() == 300


def test_lines(spark):
    search = lambda a: one(spark, a, isbn.search_lines, "array<string>")
    assert one(spark, ["x", "ISBN 978-7-894", "46-541-2"], isbn.extract_lines, "array<string>") == "9787894465412"
    assert one(spark, [], isbn.extract_lines, "array<string>") is None
    assert search(["abcdef9787894465412"]) is None
    assert search(["abc 9137011219 def", "isbn abc 9787894465412"]) == "9787894465412"
    assert one(spark, ["x", "a 1SBN 5", "ISBN"], isbn.from_keyword, "array<string>") == ["x", "1SBN 5", "ISBN"]


def test_cip(spark):
    assert one(spark, ["# CIP数据核字（2021）第188747号"], cip.number, "array<string>") == "CIP数据核字(2021)第188747号"
    assert one(spark, ["CTP 数据核字 (2019) 12号"], cip.number, "array<string>") == "CIP数据核字(2019)第12号"
    assert one(spark, ["CIP 核字第A7号"], cip.number, "array<string>") == "CIP数据核字第A7号"
    assert one(spark, ["none"], cip.number, "array<string>") is None
    assert one(spark, ["## ISBN 978－7－89446－541－2"], cip.book_number, "array<string>") == "9787894465412"
    assert one(spark, ["图书在版编目"], cip.is_page, "array<string>")


@pytest.mark.parametrize(
    ("text", "want"),
    [("isbn=9787894465412", (None, None)), ("[a]\nISBN号=978-7-89446-541-2\nss号=12\nssid=13", ("9787894465412", "12")), ("[a]\nisbn=\nisbn10=7894465410", ("7894465410", None)), ("[a]\nisbn=123\nisbn13=9787894465413", ("9787894465413", None)), ("[a]\r\nother=1", (None, None)), (None, (None, None)), ("[a]\nisbn=9787894465413\nSS号=5", ("9787894465413", "5"))],
)
def test_bookinfo(spark, text, want):
    b = one(spark, text, meta.bookinfo)
    assert (b.isbn, b.ssid) == want


@pytest.mark.parametrize(("text", "want"), [("<m><ssid>1</ssid><isbn>978-7-89446-541-2</isbn></m>", ("9787894465412", "1")), ("<m><ssid>", (None, None)), ("", (None, None)), (None, (None, None))])
def test_meta_xml(spark, text, want):
    b = one(spark, text, meta.meta_xml)
    assert (b.isbn, b.ssid) == want


def test_decoding(spark):
    f = lambda b: one(spark, b, meta.decode_any, "binary")
    assert f("书".encode()) == "书" and f("书号x".encode("gb18030")) == "书号x" and f(None) is None
    assert one(spark, "书".encode("gb18030"), meta.decode_bookinfo, "binary").encoding == "gb18030"
    assert one(spark, "ＡＢ", meta.nfkc) == "AB"


def test_names(spark):
    assert one(spark, "/a/b.c/d.E.PDF", meta.suffix) == "pdf" and one(spark, "/a/b.c/d", meta.suffix) == "" and one(spark, "/a/.x", meta.suffix) == ""
    assert one(spark, "/a/d.E.PDF", meta.stem) == "d.E"
    assert one(spark, "t 978-7-5676-7312-0 978", lambda x: naming.without_tag(x, F.lit("9787567673120"))) == "t _ 978"
    assert one(spark, "__a__b_", naming.clean_stem) == "a_b"
    i = one(spark, "b_96395223_x", meta.stem_ids)
    assert (i.isbn, i.ssid) == (None, "96395223")


def test_long_expressions_stand_once(spark):
    """What is named several times inside of a higher-order function is bound: it would else run as often, or for each element."""
    tree = lambda column: spark.range(1).select(F.lit("x").alias("x")).select(column.alias("y"))._jdf.queryExecution().analyzed().toString()
    assert tree(meta.bookinfo("x")).count("split(x") == 1
    assert tree(isbn.extract(F.reverse("x"))).count("reverse(x") == 1
    assert tree(isbn.extract_lines(F.split("x", "a"))).count("split(x") == 1
    assert tree(isbn.from_keyword(F.split("x", "a"))).count("split(x") == 1
    assert tree(cip.book_number(F.split("x", "a"))).count("split(x") == 1
    assert tree(naming.without_tag(F.reverse("x"), F.col("x"))).count("reverse(x") == 1


@pytest.mark.parametrize(
    ("lines", "want"),
    [(["图书", f"{N[:7]}", N[7:], "定价"], N), (["图书", "。", ""], None), (["ISBN 978-7-89446", "－541-2"], N), ([N[:9], "图书", N[9:]], N), (["　", N], N), (["9787894465", None, "412"], N), ([], None), (None, None)],
)
def test_lines_that_join(spark, lines, want):
    """Neighbours of which one can't take part aren't joined; all lines are, from three on."""
    assert one(spark, lines, isbn.extract_lines, "array<string>") == want


def test_options():
    assert extensions((".PDF", "epub")) == ("pdf", "epub")
    for bad in ({"rename_mode": 5}, {"longest_name": 3}, {"strict": True}):
        with pytest.raises(ValueError):
            Options(**bad)
    with pytest.raises(ValueError):
        extensions(("png",))


def packed(data: bytes) -> bytes:
    out = bytearray()
    for i in range(0, len(data), 8):
        part = data[i : i + 8]
        out += bytes((len(part),)) + part
    return bytes(out)


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=200))
def test_palmdoc(data):
    assert mobi.unpacked(packed(data)) == data


def test_palmdoc_copies():
    assert mobi.unpacked(b"abc" + bytes((0x80, 0x18 | 3))) == b"abc" + b"abcabc" and mobi.unpacked(b"\xe1") == b" a" and mobi.unpacked(b"a\x80") == b"a"
