"""Metadata of archives and file names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.functions import isbn
from folioscan.functions.isbn import _c

#: Names under which the two ids stand.
NUMBER_KEYS, SSID_KEYS = ("isbn号", "isbn13", "isbn10", "isbn"), ("ss号", "ssid号", "ssid", "ss")
TRIED = ("utf-8", "utf-16-le", "gb18030", "big5")


def plausible(value: Column) -> Column:
    """A value without dashes and spaces, if it has 10 characters, or 13 with a book prefix. No check digit is asked."""
    return isbn.let(F.upper(F.translate(value, "- ", "")), lambda x: F.when((F.length(x) == 10) | ((F.length(x) == 13) & x.rlike("^97[89]")), x))


def bookinfo(text: Column | str) -> Column:
    """struct(isbn, ssid) of an INI text: nothing counts before a section; the first usable value wins."""
    head = lambda x: x.startswith("[") & x.rlike(r"^\[.*\]$")
    return isbn.let(F.transform(F.split(_c(text), r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda rows: isbn.let(F.coalesce(F.array_position(F.transform(rows, head), True), F.lit(0)), lambda begin: isbn.let(_pairs(F.filter(rows, lambda x, i: (begin > 0) & (i + 1 > begin) & x.contains("=") & ~head(x))), _ids)))


def _pairs(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, "=", 1))).alias("k"), F.trim(F.regexp_replace(x, "^[^=]*=", "")).alias("v")))


def _ids(pairs: Column) -> Column:
    number = F.transform(F.filter(pairs, lambda p: p["k"].isin(*NUMBER_KEYS)), lambda p: plausible(p["v"]))
    ssid = F.transform(F.filter(pairs, lambda p: p["k"].isin(*SSID_KEYS)), lambda p: F.nullif(p["v"], F.lit("")))
    first = lambda a: F.get(F.filter(a, lambda x: x.isNotNull()), F.lit(0))
    return F.struct(first(number).alias("isbn"), first(ssid).alias("ssid"))


def meta_xml(text: Column | str) -> Column:
    """struct(isbn, ssid) of the root's children; nulls for malformed text."""
    x = F.from_xml(_c(text), "isbn string, ssid string", {"mode": "PERMISSIVE"})
    return F.struct(plausible(F.trim(x["isbn"])).alias("isbn"), F.nullif(F.trim(x["ssid"]), F.lit("")).alias("ssid"))


def merged(*infos: Column) -> Column:
    """Field by field the first that isn't empty."""
    return F.struct(*[F.coalesce(*[F.nullif(i[k], F.lit("")) for i in infos]).alias(k) for k in ("isbn", "ssid")])


def suffix(path: Column | str) -> Column:
    """Lower-cased, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(_c(path), r"[^/.][^/]*\.([^./]*)$", 1))


def name(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def stem(path: Column | str) -> Column:
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]*$", "")


def stem_ids(text: Column | str) -> Column:
    """struct(isbn, ssid): an acceptable number, and a run of just 8 digits that isn't in it."""
    ssid = lambda x: F.nullif(F.regexp_extract(x, "(?<![0-9])([0-9]{8})(?![0-9])", 1), F.lit(""))
    return isbn.let(text, lambda x: F.struct(isbn.extract_gated(x).alias("isbn"), ssid(x).alias("ssid")))


def ids_if_valid(ids: Column, strict: int) -> Column:
    return F.when(isbn.valid_for(ids["isbn"], ids["ssid"], strict), ids)


@F.pandas_udf(T.StringType())
def decode_any(data: pd.Series) -> pd.Series:
    """The first of TRIED that decodes; else UTF-8 without what is malformed."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        for codec in TRIED:
            try:
                return b.decode(codec)
            except UnicodeError:
                continue
        return b.decode("utf-8", "ignore")

    return data.map(one)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())]))
def decode_bookinfo(data: pd.Series) -> pd.DataFrame:
    """GB18030, unless that fails or leaves replacement characters; then UTF-8."""

    def one(b: bytes | None) -> tuple[str | None, str | None]:
        if b is None:
            return None, None
        try:
            if "�" not in (t := b.decode("gb18030")):
                return t, "gb18030"
        except UnicodeError:
            pass
        return b.decode("utf-8", "replace"), "utf-8"

    return pd.DataFrame([one(b) for b in data], columns=["text", "encoding"])


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """The exact compatibility form, which has no built-in expression."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))
