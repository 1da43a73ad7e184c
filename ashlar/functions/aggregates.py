"""The twelve aggregates, with their null and single-value rules, for groups and for windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("sum", "mean", "min", "max", "count", "nunique", "first", "last", "std", "var", "median", "quantile")


def std(x: Column) -> Column:
    """Sample standard deviation; 0 for one value, null for none."""
    x = x.cast("double")
    return F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.stddev_samp(x))


def var(x: Column) -> Column:
    x = x.cast("double")
    return F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.var_samp(x))


def quantile(x: Column, q: float, method: str = "linear") -> Column:
    """``linear``: position q(n-1); ``minitab``: position q(n+1)-1, held within the data. Exact."""
    x = x.cast("double")
    if method == "linear":
        return F.percentile(x, F.lit(float(q)))
    if method != "minitab":
        raise ValueError(f"method: {method}")
    s = F.sort_array(F.collect_list(x))
    n = F.count(x)
    pos = F.least(F.greatest((n + 1) * F.lit(float(q)) - 1, F.lit(0.0)), (n - 1).cast("double"))
    low = F.floor(pos).cast("int")
    a, b = F.get(s, low), F.get(s, F.least(low + 1, (n - 1).cast("int")))
    return F.when(n > 0, a + (b - a) * (pos - low))


def median(x: Column) -> Column:
    return quantile(x, 0.5)


def first(x: Column, order: Column) -> Column:
    """First non-null by ``order``."""
    return F.min_by(x, F.when(x.isNotNull(), order))


def last(x: Column, order: Column) -> Column:
    return F.max_by(x, F.when(x.isNotNull(), order))


def aggregate(kind: str, x: Column, order: Column | None = None, q: float = 0.5, method: str = "linear") -> Column:
    if kind in ("first", "last") and order is None:
        raise ValueError(f"{kind} needs an order: frames have none of their own")
    make = {
        "sum": lambda: F.sum(x.cast("double")), "mean": lambda: F.avg(x.cast("double")), "min": lambda: F.min(x), "max": lambda: F.max(x),
        "count": lambda: F.count(x), "nunique": lambda: F.count_distinct(x), "first": lambda: first(x, order), "last": lambda: last(x, order),
        "std": lambda: std(x), "var": lambda: var(x), "median": lambda: quantile(x, 0.5, method), "quantile": lambda: quantile(x, q, method),
    }
    if kind not in make:
        raise ValueError(f"unknown aggregate {kind}; known: {', '.join(KINDS)}")
    return make[kind]()


def windowed(kind: str, x: Column, w, q: float = 0.5) -> Column:
    """The aggregate over a window; distinct counts go through a set, which windows allow."""
    if kind == "nunique":
        return F.size(F.collect_set(x).over(w)).cast("long")
    if kind in ("std", "var"):
        d = x.cast("double")
        f = F.stddev_samp if kind == "std" else F.var_samp
        return F.when(F.count(d).over(w) == 1, F.lit(0.0)).otherwise(f(d).over(w))
    if kind in ("first", "last"):
        return getattr(F, kind)(x, ignorenulls=True).over(w)
    if kind in ("median", "quantile"):
        s = F.sort_array(F.collect_list(x.cast("double")).over(w))  # works for every frame, percentile doesn't
        n = F.size(s)
        pos = (n - 1) * F.lit(0.5 if kind == "median" else float(q))
        low = F.floor(pos).cast("int")
        a, b = F.get(s, low), F.get(s, F.least(low + 1, n - 1))
        return F.when(n > 0, a + (b - a) * (pos - low))
    return aggregate(kind, x).over(w)
