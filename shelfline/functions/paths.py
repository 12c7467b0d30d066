"""Paths: order, segments, cleaning, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(path: Column) -> Column:
    """Sorts a directory right before its contents and both before siblings such as ``dir-x``: a slash counts as the lowest character."""
    return F.replace(path, F.lit("/"), F.lit("\0"))


def trim_space(text: Column) -> Column:
    """Without white space at either end, beyond ASCII too."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def segments(path: Column) -> Column:
    """The non-empty segments, each trimmed."""
    return F.filter(F.transform(F.split(path, "/"), trim_space), lambda s: s != "")


def clean(path: Column) -> Column:
    """The shortest equal path: no empty or ``.`` segments, ``..`` resolved, nothing above the root of an absolute path; an empty one is ``.``."""
    absolute = path.startswith("/")
    up = F.lit("..")

    def step(acc: Column, s: Column) -> Column:
        drop = (F.size(acc) > 0) & (F.element_at(acc, F.greatest(F.size(acc), F.lit(1))) != up)
        parent = F.when(drop, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(absolute, acc).otherwise(F.concat(acc, F.array(s)))
        return F.when((s == "") | (s == "."), acc).when(s == "..", parent).otherwise(F.concat(acc, F.array(s)))

    # a leading empty string keeps element_at valid on an empty list
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda acc, s: F.when(F.size(acc) == 0, F.when((s == "") | (s == "."), acc).when((s == "..") & absolute, acc).otherwise(F.array(s))).otherwise(step(acc, s)))
    joined = F.array_join(parts, "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def join(*parts: Column) -> Column:
    """Joined by slashes, then cleaned; empty parts don't count."""
    return clean(F.array_join(F.filter(F.array(*parts), lambda s: s != ""), "/"))


def next_segment(path: Column, prefix: str) -> Column:
    """What follows the prefix up to the next slash, with that slash where there is one."""
    rest = F.substring(path, len(prefix) + 1, 2147483647)
    return F.when(F.instr(rest, "/") > 0, F.concat(F.substring_index(rest, "/", 1), F.lit("/"))).otherwise(rest)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """From the last dot of the name on, else empty."""
    return F.regexp_extract(name, r"(\.[^.]*)$", 1)


def hidden(name: Column) -> Column:
    return name.startswith(".")


def prefixes(path: Column) -> Column:
    """``a``, ``a/b``, ``a/b/c`` of ``a/b/c``."""
    parts = segments(path)
    return F.transform(parts, lambda s, i: F.array_join(F.slice(parts, 1, i + 1), "/"))
