"""Cataloguing-in-publication pages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan.functions import isbn
from folioscan.functions.isbn import _c

_HEAD = r"(?i)C[IT]P\s*"
_YEAR = r"\s*\(\s*([0-9]{4})\s*\)\s*"


def line(text: Column | str) -> Column:
    t = F.regexp_replace(F.trim(_c(text)), r"^#+\s*", "")
    return F.trim(F.regexp_replace(F.translate(t, "／（）．—－–", "/().---"), r"\s+", " "))


def lines(raw: Column | str) -> Column:
    """Normalised, without empty ones."""
    return F.filter(F.transform(_c(raw), line), lambda x: x != "")


def number(raw: Column | str) -> Column:
    """The registration number, with its year if there is one."""
    a = _c(raw)
    text = F.array_join(F.transform(a, line), " ")
    dated = _HEAD + "数据核字" + _YEAR + r"(?:第\s*)?([A-Z0-9]+)\s*号"
    plain = _HEAD + r"数据核字第\s*([A-Z0-9]+)\s*号"
    get = lambda t, p, g: F.nullif(F.regexp_extract(t, p, g), F.lit(""))
    close = F.get(F.filter(F.transform(a, lambda x: F.when(x.rlike("(?i)C[IT]P"), get(x, r"(?i)核字第?\s*([A-Z0-9]+)\s*号", 1))), lambda x: x.isNotNull()), F.lit(0))
    with_year = F.concat(F.lit("CIP数据核字("), get(text, dated, 1), F.lit(")第"), get(text, dated, 2), F.lit("号"))
    return F.coalesce(with_year, F.concat(F.lit("CIP数据核字第"), F.coalesce(get(text, plain, 1), close), F.lit("号")))


def is_page(raw: Column | str) -> Column:
    return F.exists(_c(raw), lambda x: x.contains("图书在版编目") | x.contains("CIPPage"))


def book_number(raw: Column | str) -> Column:
    """The number of a page: by lines, then by any run with a prefix in the whole."""
    whole = lambda a: F.regexp_replace(F.array_join(a, " "), r"\s+", " ")
    runs = lambda a: F.transform(F.regexp_extract_all(whole(a), F.lit(rf"97[89][0-9\s{isbn.DASHES}]{{4,}}[0-9]"), F.lit(0)), isbn.cleaned)
    return isbn.let(lines(raw), lambda a: F.coalesce(isbn.extract_lines(a), F.get(F.filter(runs(a), lambda x: isbn.acceptable(x)), F.lit(0))))
