"""String helpers: literal (never regular-expression) search, negative slicing, padding that never truncates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s ﻿  　]+"


def length(x: Column) -> Column:
    return F.char_length(x)


def lower(x: Column) -> Column:
    return F.lower(x)


def upper(x: Column) -> Column:
    return F.upper(x)


def trim(x: Column) -> Column:
    """All white space, tabs, line breaks and no-break spaces included."""
    return F.regexp_replace(F.regexp_replace(x, "^" + _SPACE, ""), _SPACE + "$", "")


def contains(x: Column, part) -> Column:
    return x.contains(part)


def starts_with(x: Column, part) -> Column:
    return x.startswith(part)


def ends_with(x: Column, part) -> Column:
    return x.endswith(part)


def replace(x: Column, part: str, by: str) -> Column:
    """The first occurrence."""
    at = F.locate(part, x)
    tail = F.substr(x, at + len(part))
    return F.when(x.isNull(), None).when(at > 0, F.concat(F.substr(x, F.lit(1), at - 1), F.lit(by), tail)).otherwise(x)


def replace_all(x: Column, part: str, by: str) -> Column:
    if part == "":  # between characters
        return F.array_join(F.filter(F.split(x, ""), lambda c: c != ""), by)
    return F.replace(x, F.lit(part), F.lit(by))


def slice_(x: Column, start: int, end: int | None = None) -> Column:
    """Negative positions count from the end; ``end`` is exclusive."""
    n = F.char_length(x)
    a = F.greatest(n + start, F.lit(0)) if start < 0 else F.least(F.lit(start), n)
    b = n if end is None else F.greatest(n + end, F.lit(0)) if end < 0 else F.least(F.lit(end), n)
    return F.when(x.isNull(), None).otherwise(F.substr(x, a + 1, F.greatest(b - a, F.lit(0))))


def _quote(part: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()<>*+-=!?^$|" else c for c in part)


def split_array(x: Column, part: str = ",") -> Column:
    return F.split(x, _quote(part), -1) if part else F.filter(F.split(x, ""), lambda c: c != "")


def split(x: Column, part: str = ",") -> Column:
    """The parts as a JSON array in text."""
    return F.to_json(split_array(x, part))


def concat(x: Column, other, sep: str = "") -> Column:
    """Null if either side is."""
    other = other if isinstance(other, Column) else F.lit(other)
    return F.concat(x.cast("string"), F.lit(sep), other.cast("string"))


def pad_start(x: Column, n: int, fill: str = " ") -> Column:
    return F.when(F.char_length(x) >= n, x).otherwise(F.lpad(x, n, fill)) if fill else x


def pad_end(x: Column, n: int, fill: str = " ") -> Column:
    return F.when(F.char_length(x) >= n, x).otherwise(F.rpad(x, n, fill)) if fill else x
