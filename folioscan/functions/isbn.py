"""Book numbers in text, as built-in column expressions (no Python worker)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WS = r"\s*"
KEYWORD = "(?i)" + _WS.join(("[1Il]", "[S5]", "[8B]", "N"))
GATE = "(?i)isbn|97[89][0-9 Xx-]{10,}"
DASHES = r"\-–—"
#: Runs that may be a number: with or without the keyword; by prefix; anything like one.
RUNS = (
    (f"(?:{KEYWORD}{_WS}[:：]?{_WS})?([0-9 {DASHES}]{{6,}}[0-9Xx])", 1),
    (f"(?<![0-9])(97[89][0-9 {DASHES}]{{4,}}[0-9])(?![0-9])", 1),
    (rf"[0-9Xx\s{DASHES}]{{8,}}", 0),
)
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "
#: A line without any of these takes no part in a number or keyword, so it gives a neighbour nothing.
_JOINS = rf"[0-9A-Za-z\s{DASHES}！-～　]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with value as a column that later expressions read; Catalyst would else copy a long expression into each of them."""
    return df.withColumn(name, F.explode(F.array(value)))


def let(value: Column | str, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it. Higher-order functions are interpreted, so a long
    expression that is named twice inside of one runs twice, and once for each element if a lambda names it."""
    return F.get(F.transform(F.array(_c(value)), body), F.lit(0))


def has_keyword(text: Column | str) -> Column:
    return _c(text).rlike(KEYWORD)


def gate(text: Column | str) -> Column:
    """Whether a text may hold a number at all; cheap, to be asked first. Binary is read byte by byte."""
    return _c(text).rlike(GATE)


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _narrow(text: Column | str) -> Column:
    return let(_c(text).cast("string"), lambda x: F.when(_ascii(x) | ~x.rlike("[！-～　]"), x).otherwise(F.translate(x, _WIDE, _NARROW)))


def _joined(narrow: Column) -> Column:
    dashed = let(narrow, lambda x: F.when(_ascii(x), x).otherwise(F.regexp_replace(x, r"(?<=[0-9])\s*[一-鿿]{1,3}\s*(?=[0-9])", "-")))
    return let(dashed, lambda x: F.when(x.contains("1787"), F.regexp_replace(x, "(?<![0-9])1787([0-9])", "9787$1")).otherwise(x))


def normalized(text: Column | str) -> Column:
    """Full-width forms made narrow; up to three CJK characters between digits are a dash; a leading bar read as 1 goes."""
    return _joined(_narrow(text))


def cleaned(text: Column | str) -> Column:
    return F.upper(F.regexp_replace(_c(text), "[^0-9Xx]", ""))


def _sum(x: Column, weights: list[int]) -> Column:
    """Weighted digits of a string that begins with as many; null for another."""
    n = len(weights)
    value = F.substring(x, 1, n).try_cast("bigint")
    # Bound by a lambda, so that the cast is done once and not for each digit.
    digits = lambda v: reduce(add, [w * (F.floor(v / 10 ** (n - i)) % 10 if n - i else v % 10) for i, w in enumerate(weights, 1)])
    return F.get(F.transform(F.array(value), digits), F.lit(0)).cast("int")


_W13 = [1, 3] * 6
_W10 = list(range(10, 1, -1))


def sound(number: Column | str) -> Column:
    """Whether the check digit of a cleaned number holds; false for null."""
    return let(number, _sound)


def _sound(x: Column) -> Column:
    long = x.rlike("^[0-9]{13}$") & (_sum(x, [*_W13, 1]) % 10 == 0)
    last = F.when(x.endswith("X"), 10).otherwise(F.substring(x, 10, 1).try_cast("int"))
    short = x.rlike("^[0-9]{9}[0-9X]$") & ((_sum(x, _W10) + last) % 11 == 0)
    return F.coalesce(F.when(F.length(x) == 13, long).when(F.length(x) == 10, short), F.lit(False))


def acceptable(number: Column | str, china_only: bool = True) -> Column:
    """sound(), and 13 digits begin with 978 or 979, 10 with the group 7 (china_only)."""
    return let(number, lambda x: _acceptable(x, china_only))


def _acceptable(x: Column, china_only: bool) -> Column:
    first = F.when(F.length(x) == 13, x.rlike("^97[89]"))
    return F.coalesce(first.otherwise(x.startswith("7") if china_only else F.lit(True)), F.lit(False)) & _sound(x)


def check13(twelve: Column | str) -> Column:
    return ((10 - _sum(_c(twelve), _W13) % 10) % 10).cast("string")


def check10(nine: Column | str) -> Column:
    rest = (11 - _sum(_c(nine), _W10) % 11) % 11
    return F.when(rest == 10, "X").otherwise(rest.cast("string"))


def isbn13(number: Column | str) -> Column:
    """The form of 13 digits of a sound number; else null."""
    body = lambda x: F.concat(F.lit("978"), F.substring(x, 1, 9))
    return let(number, lambda x: F.when(_sound(x), F.when(F.length(x) == 13, x).otherwise(F.concat(body(x), check13(body(x))))))


def isbn10(number: Column | str) -> Column:
    """The form of 10 digits; null for 979, which has none."""
    x = _c(number)
    body = F.substring(x, 4, 9)
    return F.when(sound(x), F.when(F.length(x) == 10, x).when(x.startswith("978"), F.concat(body, check10(body))))


def formatted(raw: Column | str) -> Column:
    """Any raw string to 13 digits, if it is sound; no rule of prefix or group."""
    return isbn13(cleaned(raw))


def valid_for(number: Column | str, ssid: Column | str, strict: Column | int) -> Column:
    """Level 1: both ids; 2: a sound number; 3: either."""
    ok, other = sound(number), F.coalesce(_c(ssid) != "", F.lit(False))
    level = F.lit(strict) if isinstance(strict, int) else strict
    return F.when(level <= 1, ok & other).when(level == 2, ok).otherwise(ok | other)


def extract(text: Column | str, china_only: bool = True) -> Column:
    """The first acceptable number: by each kind of run in turn, in the text's order. A binary or null text gives null."""
    return let(normalized(text), lambda t: _first_number(t, china_only))


def _first_number(t: Column, china_only: bool) -> Column:
    found = []
    for pattern, group in RUNS:
        runs = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(group)), cleaned)
        found.append(F.get(F.filter(runs, lambda x: _acceptable(x, china_only)), F.lit(0)))
    return F.coalesce(*found)


def extract_gated(text: Column | str, china_only: bool = True) -> Column:
    """extract(), behind a test that nearly all texts without a number fail. Equal in result."""
    found = lambda x: let(_joined(x), lambda t: _first_number(t, china_only))
    return let(_narrow(text), lambda x: F.when(x.rlike(rf"[0-9](?:[0-9Xx\s{DASHES}一-鿿]){{6,}}"), found(x)))


def extract_lines(lines: Column | str, china_only: bool = True) -> Column:
    """Each line; then each two neighbours joined, without and with a space; then all joined, which is new for three or more."""
    return let(lines, lambda a: _extract_lines(a, china_only))


def _extract_lines(a: Column, china_only: bool) -> Column:
    first = lambda x: F.get(F.filter(F.transform(x, lambda t: extract_gated(t, china_only)), lambda t: t.isNotNull()), F.lit(0))
    pairs = F.zip_with(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, F.lit(2), F.greatest(F.size(a), F.lit(0))), lambda x, y: F.when(x.rlike(_JOINS) & y.rlike(_JOINS), F.array(F.concat(x, y), F.concat(x, F.lit(" "), y))).otherwise(F.array().cast("array<string>")))
    return F.coalesce(first(a), first(F.flatten(pairs)), F.when(F.size(a) > 2, extract_gated(F.array_join(a, " "), china_only)))


def from_keyword(lines: Column | str) -> Column:
    """Lines, of which the first with the keyword begins at it."""
    at = lambda a: F.coalesce(F.array_position(F.transform(a, has_keyword), True), F.lit(0))
    cut = lambda a, n: F.transform(a, lambda x, i: F.when(i + 1 == n, F.regexp_substr(x, F.lit("(?s)" + KEYWORD + ".*"))).otherwise(x))
    return let(lines, lambda a: let(at(a), lambda n: cut(a, n)))


def trusted_line(line: Column | str, number: Column | str) -> Column:
    """Whether a number found in a line is no part of noise: a keyword or CJK characters vouch for it; in a line with
    letters it has to stand at the beginning."""
    x, n = _c(line), _c(number)
    at = F.instr(F.translate(x, "- ", ""), F.ltrim(n, F.lit("0")))
    return has_keyword(x) | x.rlike(r"[一-鿿]") | ~x.rlike("[A-Za-z]") | (at <= 3)


def search_lines(lines: Column | str, china_only: bool = True) -> Column:
    """The first number in a line that can be trusted with it."""
    found = F.transform(_c(lines), lambda x: F.struct(x.alias("line"), extract_gated(x, china_only).alias("isbn")))
    return F.get(F.filter(found, lambda s: s["isbn"].isNotNull() & trusted_line(s["line"], s["isbn"])), F.lit(0))["isbn"]


def text_lines(text: Column | str) -> Column:
    """A page's lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(_c(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
