"""Helpers on strings, lists and paths: columns for data, plain functions for the few paths that a program is given."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F


def take(text: Column, n: int) -> Column:
    """The first ``n`` characters, none if ``n`` isn't positive."""
    return F.left(text, F.lit(max(n, 0)))


def drop(text: Column, n: int) -> Column:
    """All but the first ``n`` characters."""
    return F.substring(text, F.lit(max(n, 0) + 1), F.length(text))


def last(text: Column) -> Column:
    """The last character; an empty text has none (null)."""
    return F.when(F.length(text) > 0, F.right(text, F.lit(1)))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common beginning."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    at = F.array_position(same, False).cast("int")
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).when(at == 0, F.length(a)).otherwise(at - 1)


def list_take(xs: Column, n: int) -> Column:
    return F.slice(xs, F.lit(1), F.lit(max(n, 0)))


def list_drop(xs: Column, n: int) -> Column:
    return F.slice(xs, F.lit(max(n, 0) + 1), F.size(xs))


def list_take_right(xs: Column, n: int) -> Column:
    """The last ``n`` elements, all if there are fewer."""
    return F.slice(xs, F.greatest(F.size(xs) - max(n, 0) + 1, F.lit(1)), F.lit(max(n, 0)))


def list_last(xs: Column) -> Column:
    return F.get(xs, F.size(xs) - 1)


def joined_lines(lines: Column) -> Column:
    """Lines, stripped, as one text: a space before each, but a line that ends in a hyphen loses it and runs on."""
    return F.replace(F.replace(F.concat(F.lit(" "), F.array_join(F.transform(lines, lambda x: F.trim(x)), "\n")), F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))


def extension(path: Column) -> Column:
    """What stands behind the last dot, null if there is none."""
    return F.when(path.contains("."), F.regexp_extract(path, r"(?s)\.([^.]*)$", 1))


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"(?s)\.[^.]*$", "")


def _names(path: str) -> list[str]:
    return os.path.abspath(path).split(os.sep)


def _common(lists: list[list[str]]) -> int:
    n = 0
    while all(len(x) > n for x in lists) and len({x[n] for x in lists}) == 1:
        n += 1
    return n


def lowest_common_path(paths: list[str]) -> str:
    """The deepest folder (or the path itself) that all paths share."""
    lists = [_names(p) for p in paths]
    return os.sep.join(lists[0][: _common(lists)])


def remove_common_prefix(a: str, b: str) -> tuple[str, str]:
    """What is left of two paths without the folders that both begin with."""
    x, y = _names(a), _names(b)
    n = _common([x, y])
    return os.sep.join(x[n:]), os.sep.join(y[n:])


def path_relative_to(path: str, folder: str) -> str:
    """The path as seen from a folder."""
    x, y = _names(path), _names(folder)
    n = _common([x, y])
    return os.sep.join([".."] * (len(y) - n) + x[n:])
