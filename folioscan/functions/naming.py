"""Names of destinations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan.functions.isbn import _c, let
from folioscan.functions.meta import name, stem, suffix
from folioscan.options import Options


def clean_stem(text: Column | str) -> Column:
    return F.btrim(F.regexp_replace(_c(text), "_+", "_"), F.lit("_"))


def without_tag(text: Column | str, tag: Column | str) -> Column:
    """text, where the first place with the tag's characters, dashes between them allowed, is one underscore."""
    t = _c(tag)
    pattern = F.array_join(F.split(t, ""), "-?")
    cut = lambda x, hit, at: F.concat(F.substr(x, F.lit(1), at - 1), F.lit("_"), F.substr(x, at + F.length(hit)))
    return let(text, lambda x: let(F.regexp_substr(x, pattern), lambda hit: F.when(hit.isNull() | (t == ""), x).otherwise(let(F.instr(x, hit), lambda at: cut(x, hit, at)))))


def fitted(text: Column, ending: Column, longest: int) -> Column:
    """The tail goes, of the stem alone."""
    return F.concat(F.substr(text, F.lit(1), F.lit(longest) - F.length(ending)), ending)


def ending(path: Column | str, lower: bool) -> Column:
    raw = F.regexp_extract(name(path), r".(\.[^.]*)$", 1)
    return F.lower(raw) if lower else raw


def destination(path: Column | str, found: Column, named: Column, options: Options) -> Column:
    """The new name of a file, from the ids found in it and those in its name (structs isbn, isbn13, ssid).

    Order: number found, ssid found, number named, ssid named; without any the stem stays."""
    base, end = stem(path), ending(path, options.lower_suffix)
    tag = F.coalesce(found["isbn13"], found["ssid"], named["isbn13"], named["ssid"])
    is_number = F.when(found["isbn13"].isNotNull(), True).when(found["ssid"].isNotNull(), False).otherwise(named["isbn13"].isNotNull())
    if not options.keep_name:
        other = F.when(is_number, F.coalesce(found["ssid"], named["ssid"])).otherwise(F.coalesce(found["isbn13"], named["isbn13"]))
        new = F.concat_ws("_", tag, F.when(other != tag, other))
    else:
        old = F.when(is_number, named["isbn"]).otherwise(named["ssid"])
        if options.rename_mode in (1, 2):
            there = old.isNotNull() & F.translate(base, "- ", "").contains(tag)
            new = F.when(there, base).otherwise(F.concat_ws("_", *((base, tag) if options.rename_mode == 1 else (tag, base))))
            new = F.btrim(new, F.lit("_ "))
        else:
            rest = clean_stem(F.when(old.isNull(), base).otherwise(without_tag(base, old)))
            parts = (F.nullif(rest, F.lit("")), tag)
            new = F.concat_ws("_", *(parts if options.rename_mode == 3 else parts[::-1]))
    return F.when(tag.isNull(), F.concat(base, end)).otherwise(fitted(new, end, options.longest_name))


def in_tree(path: Column | str, root: str, new: Column) -> Column:
    """new below the folders that path has below root."""
    inner = F.regexp_extract(F.replace(_c(path), F.lit(root.rstrip("/") + "/"), F.lit("")), r"^(.*/)?[^/]*$", 1)
    return F.concat(inner, new)


def failed(path: Column | str, lower: bool) -> Column:
    """The name in the folder of failures."""
    return F.concat(stem(path), ending(path, lower))


def kind(path: Column | str) -> Column:
    """By suffix alone; null for what no reader takes."""
    from folioscan.options import KINDS

    table = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return table[suffix(path)]
