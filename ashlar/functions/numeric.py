"""Scalar helpers whose semantics differ from Spark's ANSI defaults: IEEE division, unguarded logarithms, clipping."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def num(x) -> Column:
    return _c(x).cast("double")


def div(a, b) -> Column:
    """IEEE division: x/0 is +-Infinity, 0/0 NaN, null with null."""
    a, b = num(a), num(b)
    zero = F.when(a.isNull(), None).when((a == 0) | F.isnan(a), NAN).when(a > 0, INF).otherwise(-INF)
    return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b))


def mod(a, b) -> Column:
    """Remainder with the dividend's sign; by zero NaN."""
    a, b = num(a), num(b)
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, NAN).otherwise(a % F.when(b != 0, b))


def log(x, base: float | None = None) -> Column:
    """Logarithm: of 0 -Infinity, of negatives NaN."""
    x = num(x)
    plain = F.log(x) if base is None else F.log2(x) if base == 2 else F.log10(x) if base == 10 else F.log(x) / F.log(F.lit(float(base)))
    return F.when(x == 0, -INF).when(x < 0, NAN).otherwise(plain)


def log10(x) -> Column:
    return log(x, 10)


def log2(x) -> Column:
    return log(x, 2)


def floor(x) -> Column:
    return F.floor(num(x)).cast("double")


def ceil(x) -> Column:
    return F.ceil(num(x)).cast("double")


def sign(x) -> Column:
    return F.signum(num(x))


def sqrt(x) -> Column:
    return F.sqrt(num(x))


def pow(x, y) -> Column:  # noqa: A001
    return F.pow(num(x), num(y))


def round(x, decimals: int = 0) -> Column:  # noqa: A001
    """Half away from zero; NaN and infinities pass through."""
    x = num(x)
    return F.when(F.isnan(x) | x.isin(INF, -INF), x).otherwise(F.round(x, decimals))


def clip(x, low=None, high=None) -> Column:
    """min(max(x, low), high); null if any is null."""
    x = num(x)
    if low is not None:
        low = num(low)
        x = F.when(x.isNull() | low.isNull(), None).otherwise(F.greatest(x, low))
    if high is not None:
        high = num(high)
        x = F.when(x.isNull() | high.isNull(), None).otherwise(F.least(x, high))
    return x


def is_in(x, values: Iterable) -> Column:
    """Never null; None in the list matches null."""
    values = list(values)
    some = [v for v in values if v is not None]
    out = F.coalesce(_c(x).isin(some), F.lit(False)) if some else F.lit(False)
    return out | _c(x).isNull() if None in values else out


def is_between(x, low, high, closed: str = "both") -> Column:
    x, low, high = _c(x), _c(low), _c(high)
    left = x >= low if closed in ("both", "left") else x > low
    right = x <= high if closed in ("both", "right") else x < high
    if closed not in ("both", "left", "right", "neither"):
        raise ValueError(f"closed: {closed}")
    return F.when(x.isNull() | low.isNull() | high.isNull(), None).otherwise(left & right)


def and_(*conds: Column) -> Column:
    """Two-valued: null counts as false."""
    out = F.lit(True)
    for c in conds:
        out = out & F.coalesce(c, F.lit(False))
    return out


def or_(*conds: Column) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | F.coalesce(c, F.lit(False))
    return out


def not_(x: Column) -> Column:
    return ~x


def compare(a, op: str, b) -> Column:
    """eq, neq, gt, gte, lt, lte with NaN unequal to everything; null operands give null."""
    a, b = _c(a), _c(b)
    plain = {"eq": a == b, "neq": a != b, "gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]
    nan = F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
    return F.when(a.isNull() | b.isNull(), None).when(nan, F.lit(op == "neq")).otherwise(plain)


def cast(x, dtype: str) -> Column:
    """f64 f32 i32 u32 bool utf8 category datetime; integers reject fractions and overflow, text that is no number is NaN."""
    x = _c(x)
    if dtype in ("i32", "u32"):
        low, high = (-(2**31), 2**31 - 1) if dtype == "i32" else (0, 2**32 - 1)
        v = x.cast("double")
        bad = (v != F.floor(v)) | (v < low) | (v > high) | F.isnan(v)
        return F.when(bad, F.raise_error(F.lit(f"value does not fit {dtype}"))).otherwise(v.cast("long")).cast("int" if dtype == "i32" else "long")
    if dtype in ("f64", "f32"):
        text = F.trim(x.cast("string"))
        kind = "double" if dtype == "f64" else "float"
        got = F.when(text == "", 0.0).when(F.lower(text).isin("true", "false"), (F.lower(text) == "true").cast("double")).otherwise(text.try_cast("double"))
        return F.when(x.isNull(), None).otherwise(F.coalesce(got, F.lit(NAN))).cast(kind)
    if dtype == "bool":
        text = x.cast("string")
        return F.when(x.isNull(), None).otherwise(~text.isin("", "0", "0.0", "-0.0", "NaN") & ~((text == "false") & (F.typeof(x) == "boolean")))
    if dtype in ("utf8", "category"):
        return x.cast("string")
    if dtype == "datetime":
        return x.cast("timestamp")
    raise ValueError(f"dtype: {dtype}")


def fill_null(x, value) -> Column:
    return F.coalesce(_c(x), _c(value))


def days_between(a, b) -> Column:
    """(a - b) in days, with fractions."""
    ms = lambda c: F.unix_millis(_c(c).cast("timestamp")).cast("double")
    return (ms(a) - ms(b)) / 86_400_000
