"""``Frame``: the fluent table interface, a thin layer over a Spark DataFrame.

Plans stay lazy and Catalyst's; the class adds exact semantics where Spark's differ (null ordering, suffixes, aggregates
of one value) and an explicit row order: operators that depend on row position use the columns named by ``order`` (or
given per call) and, with ``by``, work within groups, which keeps them distributed.
"""

from __future__ import annotations

import difflib
import json
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructType, TimestampNTZType, TimestampType

from ashlar.functions import aggregates as A
from ashlar.functions import numeric as N
from ashlar.operators import positions


def _names(x: str | Sequence[str] | None) -> list[str]:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


class Frame:
    def __init__(self, df: DataFrame, order: str | Sequence[str] | None = None):
        self.df, self.order = df, _names(order)
        self._cuts: dict[str, list] = {}  # boundaries of order keys, passed on by operators that leave rows and keys as they are
        self._link: tuple | None = None  # of a chain that one pass makes: kind, order, the frame before it, its columns
        self._numbered: tuple | None = None  # order and rows with their positions

    # -- schema -------------------------------------------------------------------------------------------------
    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def dtypes(self) -> dict[str, str]:
        return dict(self.df.dtypes)

    @property
    def shape(self) -> tuple[int, int]:
        return self.df.count(), len(self.columns)

    def _new(self, df: DataFrame, order=None) -> Frame:
        order = self.order if order is None else order
        return Frame(df, [c for c in order if c in df.columns])

    def _slices(self, keys: list[str]) -> list:
        """Boundaries of the first key, found once for a chain of operators."""
        if keys[0] not in self._cuts:
            self._cuts[keys[0]] = positions.boundaries(self.df, keys[0])
        return self._cuts[keys[0]]

    def _ordered(self, df: DataFrame, *changed: str) -> Frame:
        """``df``, which has the rows of this frame; ``changed`` columns have new values."""
        out = self._new(df)
        out._cuts = {k: v for k, v in self._cuts.items() if k in df.columns and k not in changed}
        return out

    def _check(self, *names: str) -> None:
        for n in names:
            if n not in self.columns:
                near = difflib.get_close_matches(n, self.columns, 3)
                raise KeyError(f"unknown column {n!r}" + (f"; did you mean {', '.join(near)}?" if near else f"; columns: {', '.join(self.columns)}"))

    def with_order(self, *keys: str) -> Frame:
        """Name the columns that define the row order."""
        self._check(*keys)
        return Frame(self.df, keys)

    def _by(self, order=None) -> list[Column]:
        keys = _names(order) or self.order
        if not keys:
            raise ValueError("this operator depends on row order: name it with with_order(...) or order=")
        self._check(*keys)
        return [F.col(k).asc_nulls_last() for k in keys]

    # -- projection and filters ---------------------------------------------------------------------------------
    def select(self, *items: str | Column) -> Frame:
        self._check(*[i for i in items if isinstance(i, str)])
        return self._new(self.df.select(*items))

    def drop(self, *cols: str) -> Frame:
        return self._new(self.df.drop(*cols))

    exclude = drop

    def rename(self, names: dict[str, str] | Callable[[str], str]) -> Frame:
        if callable(names):
            names = {c: names(c) for c in self.columns}
        self._check(*names)
        to = [names.get(c, c) for c in self.columns]
        if len(set(to)) < len(to):
            raise ValueError("rename makes duplicate columns")
        return Frame(self.df.toDF(*to), [names.get(c, c) for c in self.order])

    def with_column(self, name: str, expr: Column) -> Frame:
        """Add or replace; a replaced column moves to the end."""
        return self.with_columns(**{name: expr})

    def with_columns(self, **exprs: Column) -> Frame:
        """All expressions see the columns as they were before."""
        keep = [F.col(f"`{c}`") for c in self.columns if c not in exprs]
        return self._new(self.df.select(*keep, *[(e if isinstance(e, Column) else F.lit(e)).alias(n) for n, e in exprs.items()]))

    assign = with_columns

    def filter(self, cond: Column) -> Frame:
        return self._new(self.df.filter(cond))

    where = filter

    def is_null(self, col: str) -> Frame:
        return self.filter(F.col(col).isNull())

    def not_null(self, col: str) -> Frame:
        return self.filter(F.col(col).isNotNull())

    def between(self, col: str, low, high, closed: str = "both") -> Frame:
        return self.filter(N.is_between(F.col(col), low, high, closed))

    def select_dtypes(self, *kinds: str) -> Frame:
        return self.select(*[c for c, t in self.df.dtypes if t in kinds or ("numeric" in kinds and c in self.numeric())])

    def numeric(self) -> list[str]:
        return [f.name for f in self.df.schema if isinstance(f.dataType, (NumericType, TimestampType, TimestampNTZType))]

    def select_numeric(self) -> Frame:
        return self.select(*self.numeric())

    def pipe(self, f: Callable, *args, **kw):
        return f(self, *args, **kw)

    # -- joins --------------------------------------------------------------------------------------------------
    def join(self, other: Frame | DataFrame, on=None, how: str = "inner", left_on=None, right_on=None, suffix: str = "_right", l_suffix: str = "", r_suffix: str | None = None, validate: str | None = None, nulls_equal: bool = False) -> Frame:
        from ashlar.operators.joins import join

        out = join(self.df, other.df if isinstance(other, Frame) else other, on, how, left_on, right_on, l_suffix, suffix if r_suffix is None else r_suffix, validate, nulls_equal)
        return self._new(out)

    def inner_join(self, other, on=None, **k) -> Frame:
        return self.join(other, on, "inner", **k)

    def left_join(self, other, on=None, **k) -> Frame:
        return self.join(other, on, "left", **k)

    def right_join(self, other, on=None, **k) -> Frame:
        return self.join(other, on, "right", **k)

    def outer_join(self, other, on=None, **k) -> Frame:
        return self.join(other, on, "outer", **k)

    def semi_join(self, other, on=None, **k) -> Frame:
        return self.join(other, on, "semi", **k)

    def anti_join(self, other, on=None, **k) -> Frame:
        return self.join(other, on, "anti", **k)

    def cross_join(self, other, **k) -> Frame:
        return self.join(other, None, "cross", **k)

    def join_asof(self, other, left_on: str, right_on: str, strategy: str = "backward", by=None, suffix: str = "_right") -> Frame:
        from ashlar.operators.joins import join_asof

        return self._new(join_asof(self.df, other.df if isinstance(other, Frame) else other, left_on, right_on, strategy, _names(by), self.order, suffix))

    # -- aggregation --------------------------------------------------------------------------------------------
    def group_by(self, *keys: str) -> Groups:
        self._check(*keys)
        if not keys:
            raise ValueError("group_by needs a key; agg() aggregates the whole frame")
        return Groups(self, list(keys))

    def agg(self, **spec) -> Frame:
        return Groups(self, []).agg(**spec)

    def cube(self, *keys: str, **spec) -> Frame:
        return Frame(self.df.cube(*keys).agg(*Groups(self, [])._exprs(spec)))

    def rollup(self, *keys: str, **spec) -> Frame:
        return Frame(self.df.rollup(*keys).agg(*Groups(self, [])._exprs(spec)))

    def broadcast_agg(self, **aggs: Column) -> Frame:
        """Whole-frame aggregates as columns of every row: a one-row frame, joined by broadcast."""
        return self._new(self.df.crossJoin(F.broadcast(self.df.agg(*[a.alias(n) for n, a in aggs.items()]))))

    # -- statistics of the core ---------------------------------------------------------------------------------
    def describe(self, *cols: str, method: str = "linear") -> Frame:
        """count, mean, std, min, 25%, 50%, 75%, max as rows (``stat``); one pass over the data, quartiles of long columns by slices."""
        cols = cols or [c for c in self.numeric()]
        d = lambda c: F.col(c).cast("double") if not isinstance(self.df.schema[c].dataType, (TimestampType, TimestampNTZType)) else F.unix_millis(F.col(c).cast("timestamp")).cast("double")
        stats = {
            "count": lambda x: F.count(x).cast("double"), "mean": F.avg, "std": F.stddev_samp, "min": F.min,
            "25%": lambda x: A.quantile(x, 0.25, method), "50%": lambda x: A.quantile(x, 0.5, method), "75%": lambda x: A.quantile(x, 0.75, method), "max": F.max,
        }
        cut = {"25%": 0.25, "50%": 0.5, "75%": 0.75} if Groups(self, []).largest() > Groups.most else {}
        one = self.df.agg(*[F.struct(*[f(d(c)).alias(c) for c in cols]).alias(s) for s, f in stats.items() if s not in cut])
        if cut:
            for i, c in enumerate(cols):
                one = one.crossJoin(positions.quantiles(self.df.select(d(c).alias("_x")), "_x", list(cut.values()), [], [f"{i}_{s}" for s in cut], method))
            one = one.select("*", *[F.struct(*[F.col(f"{i}_{s}").alias(c) for i, c in enumerate(cols)]).alias(s) for s in cut])
        return Frame(one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), *[F.col(f"`{s}`")[c].alias(c) for c in cols]) for s in stats])).alias("r")).select("r.*"))

    def quantiles(self, col: str, qs: Sequence[float], by=None, method: str = "linear") -> Frame:
        """Exact quantiles as columns q<percent>, per group with ``by``, for groups too large for one task."""
        names = [f"q{100 * q:g}".replace(".", "_") for q in qs]
        return Frame(positions.quantiles(self.df, col, list(qs), _names(by), names, method))

    def map_batches(self, f: Callable, schema: str | StructType) -> Frame:
        """A table function: ``f`` turns every Arrow record batch into one or more of the given schema."""

        def run(batches):
            for batch in batches:
                out = f(batch)
                yield from [out] if not isinstance(out, (list, tuple)) else out

        return Frame(self.df.mapInArrow(run, schema))

    def corr(self, *cols: str, method: str = "pearson") -> Frame:
        cols = list(cols) or self.numeric()
        return Frame(_pairs(self.df, cols, method == "spearman", True))

    def cov(self, *cols: str) -> Frame:
        return Frame(_pairs(self.df, list(cols) or self.numeric(), False, False))

    def value_counts(self, col: str, normalize: bool = False) -> Frame:
        self._check(col)
        out = self.df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias(col)).agg(F.count(F.lit(1)).cast("double").alias("count"))
        if normalize:
            out = out.crossJoin(F.broadcast(out.agg(F.sum("count").alias("_t")))).select(col, (F.col("count") / F.col("_t")).alias("proportion"))
        return Frame(out)

    def profile(self) -> Frame:
        kinds = {"null_count": lambda c: F.count_if(c.isNull()).cast("string"), "approx_unique": lambda c: F.approx_count_distinct(c).cast("string"), "min": lambda c: F.min(c).cast("string"), "max": lambda c: F.max(c).cast("string")}
        one = self.df.agg(*[F.struct(F.lit(c).alias("column"), *[f(F.col(f"`{c}`")).alias(k) for k, f in kinds.items()]).alias(f"_{i}") for i, c in enumerate(self.columns)])
        return Frame(one.select(F.explode(F.array(*[F.col(f"_{i}") for i in range(len(self.columns))])).alias("r")).select("r.*"))

    def nunique(self) -> Frame:
        """Distinct values per column, null counting as one."""
        return Frame(self.df.agg(*[(F.count_distinct(F.col(c)) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in self.columns]))

    # -- windows ------------------------------------------------------------------------------------------------
    def with_window(self, name: str, func: str, col: str | Column | None = None, partition_by=(), order_by=None, descending: bool = False, method: str = "average", offset: int = 1) -> Frame:
        from ashlar.operators.windows import window_column

        return self.with_columns(**{name: window_column(func, col, _names(partition_by), _names(order_by) or self.order, descending, method, offset)})

    def over(self, name: str, kind: str, col: str, partition_by=(), order_by=None, descending: bool = False, q: float = 0.5) -> Frame:
        """An aggregate per partition on every row; with ``order_by`` it runs from the first row to this one."""
        w = Window.partitionBy(*_names(partition_by))
        if order_by:
            if kind in ("median", "quantile", "nunique"):
                raise ValueError(f"{kind} has no running form")
            w = w.orderBy(*[F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in _names(order_by)]).rowsBetween(Window.unboundedPreceding, 0)
        return self.with_columns(**{name: A.windowed(kind, F.col(col), w, q)})

    def rolling(self, name: str, col: str, window: int, agg: str = "mean", by=None, order=None, q: float = 0.5) -> Frame:
        """Over the last ``window`` rows; without ``by`` in blocks of rows, so that no task orders everything."""
        if not _names(by):
            return self._beside(order, window - 1, 0, name, col, lambda w: A.windowed(agg, F.col(col), w.rowsBetween(-(window - 1), 0), q))
        w = Window.partitionBy(*_names(by)).orderBy(*self._by(order)).rowsBetween(-(window - 1), 0)
        return self.with_columns(**{name: A.windowed(agg, F.col(col), w, q)})

    def expanding(self, name: str, col: str, agg: str = "sum", by=None, order=None, q: float = 0.5) -> Frame:
        """From the first row on. Without ``by``: sum, mean, count, min and max by slices; the others are one ordered sequence."""
        if not _names(by) and agg in ("sum", "mean", "count", "min", "max"):
            self._by(order)
            keys = _names(order) or self.order
            base, made = self._chain("running", keys, name, col)
            made[name] = (col, agg)
            return self._linked("running", keys, base, made, positions.running(base.df, keys, made, base._slices(keys)))
        w = Window.partitionBy(*_names(by)).orderBy(*self._by(order)).rowsBetween(Window.unboundedPreceding, 0)
        return self.with_columns(**{name: A.windowed(agg, F.col(col), w, q)})

    def _beside(self, order, back: int, ahead: int, name: str, col: str, make) -> Frame:
        self._by(order)
        keys = _names(order) or self.order
        base, made = self._chain("beside", keys, name, col)
        made[name] = (back, ahead, make)
        if base._numbered is None or base._numbered[0] != keys:
            base._numbered = keys, positions.number(base.df, keys, "_row", cuts=base._slices(keys))
        back, ahead = (max(m[i] for m in made.values()) for i in (0, 1))
        return self._linked("beside", keys, base, made, positions.beside(base.df, keys, back, ahead, lambda w: {k: m[2](w) for k, m in made.items()}, base._numbered[1]))

    def _chain(self, kind: str, keys: list[str], name: str, col: str) -> tuple[Frame, dict]:
        """The frame before a chain of such operators and their columns, if ``col`` can join them in one pass; else this frame."""
        if self._link is not None:
            was, at, base, made = self._link
            if was == kind and at == keys and col not in made and not set(made) & set(keys) and (name in made or name not in self.columns):
                return base, dict(made)
        return self, {}

    def _linked(self, kind: str, keys: list[str], base: Frame, made: dict, df: DataFrame) -> Frame:
        out = base._ordered(df, *made)
        out._link = kind, keys, base, made
        return out

    def _moved(self, name: str, col: str, periods: int, by, order, make) -> Frame:
        """``make(value some rows before)`` as a column."""
        if not _names(by):
            return self._beside(order, max(periods, 0), max(-periods, 0), name, col, lambda w: make(F.lag(col, periods).over(w)))
        return self.with_columns(**{name: make(F.lag(col, periods).over(self._at(by, order)))})

    def _at(self, by, order) -> Window:
        return Window.partitionBy(*_names(by)).orderBy(*self._by(order))

    def shift(self, name: str, col: str, periods: int = 1, by=None, order=None) -> Frame:
        return self._moved(name, col, periods, by, order, lambda before: before)

    def diff(self, name: str, col: str, periods: int = 1, by=None, order=None) -> Frame:
        return self._moved(name, col, periods, by, order, lambda before: F.col(col).cast("double") - before.cast("double"))

    def pct_change(self, name: str, col: str, periods: int = 1, by=None, order=None) -> Frame:
        def change(before: Column) -> Column:
            before = before.cast("double")
            return (F.col(col).cast("double") - before) / F.when(before != 0, before)

        return self._moved(name, col, periods, by, order, change)

    def cumsum(self, name: str, col: str, by=None, order=None) -> Frame:
        """Running sum, null adding nothing; without ``by`` in two phases, so that no task sorts everything."""
        if _names(by):
            w = self._at(by, order).rowsBetween(Window.unboundedPreceding, 0)
            return self.with_columns(**{name: F.sum(F.coalesce(F.col(col).cast("double"), F.lit(0.0))).over(w)})
        self._by(order)
        keys = _names(order) or self.order
        return self._ordered(positions.running_sum(self.df, keys, F.coalesce(F.col(col).cast("double"), F.lit(0.0)), name, self._slices(keys)), name)

    # -- order, limits, samples ---------------------------------------------------------------------------------
    def sort(self, *keys: str | Column, descending: bool | Sequence[bool] = False, nulls_last: bool = True) -> Frame:
        desc = [descending] * len(keys) if isinstance(descending, bool) else list(descending)
        cols = []
        for k, d in zip(keys, desc, strict=True):
            c = F.col(k) if isinstance(k, str) else k
            cols.append((c.desc_nulls_last() if nulls_last else c.desc_nulls_first()) if d else (c.asc_nulls_last() if nulls_last else c.asc_nulls_first()))
        return self._new(self.df.orderBy(*cols))

    def top_k(self, k: int, *keys: str, descending: bool = True) -> Frame:
        return self.sort(*keys, descending=descending).limit(k)

    def limit(self, n: int, offset: int = 0) -> Frame:
        df = self.df.orderBy(*self._by()) if self.order else self.df
        return self._new((df.offset(max(0, offset)) if offset > 0 else df).limit(max(0, n)))

    def head(self, n: int = 5) -> Frame:
        return self.limit(n)

    def tail(self, n: int = 5) -> Frame:
        last = self.df.orderBy(*[F.col(k).desc_nulls_first() for k in _names(self.order) or self._by()]).limit(max(0, n))
        return self._new(last.orderBy(*self._by()))

    def with_row_number(self, name: str = "row", order=None) -> Frame:
        """0-based dense position, numbered in two phases."""
        self._by(order)
        keys = _names(order) or self.order
        out = self._ordered(positions.number(self.df, keys, name, cuts=self._slices(keys)), name)
        if name not in keys:
            out._numbered = keys, out.df.withColumn("_row", F.col(name))
        return out

    def slice(self, start: int, end: int | None = None) -> Frame:
        d = positions.number(self.df, [k for k in self.order] or self._by(), "_row")
        if start < 0 or (end is not None and end < 0):
            n = self.df.count()
            start = max(0, n + start) if start < 0 else start
            end = max(0, n + end) if end is not None and end < 0 else end
        cond = F.col("_row") >= start
        return self._new(d.filter(cond if end is None else cond & (F.col("_row") < end)).drop("_row"))

    def take(self, indices: Sequence[int]) -> Frame:
        n = self.df.count()
        if any(i < 0 or i >= n for i in indices):
            raise IndexError("take: index out of range")
        d = positions.number(self.df, [k for k in self.order] or self._by(), "_row")
        at = self.df.sparkSession.createDataFrame([(p, int(i)) for p, i in enumerate(indices)], "_at long, _row long")
        return Frame(d.join(at, "_row").orderBy("_at").drop("_row", "_at"))

    def sample(self, n: int | None = None, fraction: float | None = None, seed: int = 1) -> Frame:
        """Without replacement, of exact size."""
        if n is None:
            n = round(self.df.count() * fraction) if fraction is not None else 10
        d = self.df.withColumn("_r", F.rand(seed))
        if n <= 100_000:  # the smallest n keys, found per partition first
            return self._new(d.orderBy("_r").limit(n).drop("_r"))
        # a large sample stays where it is: keys below the n-th, whose exact place is settled among the few near it
        total = self.df.count()
        if n >= total:
            return self._new(self.df)
        spread = 6 * (n**0.5 + 1) / total
        low, high = n / total - spread, n / total + spread
        sure = d.filter(F.col("_r") < low).count()
        edge = d.filter((F.col("_r") >= low) & (F.col("_r") < high)).groupBy(F.floor((F.col("_r") - low) / (high - low) * 4096).alias("c")).count().orderBy("c").collect()
        cut, at = sure, low
        for r in edge:
            if cut + r["count"] > n:
                break
            cut, at = cut + r["count"], low + (r["c"] + 1) * (high - low) / 4096
        rest = d.filter(F.col("_r") >= at).orderBy("_r").limit(n - cut)
        return self._new(d.filter(F.col("_r") < at).unionByName(rest).drop("_r"))

    # -- sets ---------------------------------------------------------------------------------------------------
    @staticmethod
    def concat(frames: Sequence[Frame], how: str = "vertical") -> Frame:
        if how == "vertical":
            for f in frames[1:]:
                if f.columns != frames[0].columns:
                    raise ValueError("vertical concat needs the same columns in the same order")
            return frames[0]._new(reduce(lambda a, b: a.unionByName(b), [f.df for f in frames]))
        if how != "horizontal":
            raise ValueError(f"how: {how}")
        seen: set[str] = set()
        for f in frames:
            if seen & set(f.columns):
                raise ValueError("horizontal concat makes duplicate columns")
            seen |= set(f.columns)
        parts = [positions.number(f.df, f.order or f._by(), "_row") for f in frames]
        return frames[0]._new(reduce(lambda a, b: a.join(b, "_row", "full"), parts).drop("_row"))

    def unique(self, *cols: str, keep: str = "first") -> Frame:
        keys = list(cols) or self.columns
        self._check(*keys)
        if keep == "none":
            w = Window.partitionBy(*keys)
            return self._new(self.df.withColumn("_n", F.count(F.lit(1)).over(w)).filter("_n = 1").drop("_n"))
        if keep not in ("first", "last"):
            raise ValueError(f"keep: {keep}")
        if set(keys) == set(self.columns):
            return self._new(self.df.dropDuplicates())
        best = F.min_by if keep == "first" else F.max_by
        order = F.struct(*[F.struct(F.col(k).isNull(), F.col(k)) for k in self.order]) if self.order else self._by()
        # an aggregate, not a window: duplicates are folded before the shuffle
        one = self.df.groupBy(*keys).agg(best(F.struct(*[F.col(c) for c in self.columns]), order).alias("_r"))
        return self._new(one.select("_r.*"))

    def intersect(self, other: Frame, all: bool = False) -> Frame:  # noqa: A002
        return self._new(self.df.intersectAll(other.df) if all else self.df.intersect(other.df))

    def subtract(self, other: Frame, all: bool = False) -> Frame:  # noqa: A002
        return self._new(self.df.exceptAll(other.df) if all else self.df.subtract(other.df))

    # -- missing data -------------------------------------------------------------------------------------------
    def fill_null(self, value=None, cols=None, **by_col) -> Frame:
        fills = by_col or {c: value for c in (_names(cols) or self.columns)}
        self._check(*fills)
        kinds = {f.name: f.dataType for f in self.df.schema}
        fits = lambda c, v: isinstance(v, str) == isinstance(kinds[c], StringType)
        return self._new(self.df.select(*[F.coalesce(F.col(c), F.lit(fills[c]).cast(kinds[c])).alias(c) if c in fills and fits(c, fills[c]) else F.col(c) for c in self.columns]))

    def ffill(self, *cols: str, by=None, order=None) -> Frame:
        return self._filled(True, cols, by, order)

    def bfill(self, *cols: str, by=None, order=None) -> Frame:
        return self._filled(False, cols, by, order)

    def _filled(self, forward: bool, cols, by, order) -> Frame:
        keys, by = _names(order) or self.order, _names(by)
        cols = cols or [c for c in self.columns if c not in keys + by]
        if not by:
            self._by(order)
            values = {c: F.col(c) for c in cols}
            return self._ordered(positions.carried(self.df, keys, values if forward else {}, {} if forward else values, self._slices(keys)), *cols)
        w, d = self._at(by, order), self.df
        if not forward:  # the last of the reversed rows: a frame to the end is read again for every row
            d, w = d.withColumn("_i", F.row_number().over(w)), Window.partitionBy(*by).orderBy(F.col("_i").desc())
        w = w.rowsBetween(Window.unboundedPreceding, 0)
        return self._new(d.select(*[F.last(c, ignorenulls=True).over(w).alias(c) if c in cols else F.col(c) for c in self.columns]))

    def drop_null(self, *cols: str) -> Frame:
        """Rows without null in the columns; NaN is a value."""
        self._check(*cols)
        return self.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols or self.columns]))

    def interpolate(self, *cols: str, by=None, order=None) -> Frame:
        """Linear by row position; edges take the nearest value, a column without any is NaN."""
        by = _names(by)
        out, points = {}, {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(c).cast("double").alias("x"))) for c in cols}
        if by:
            w = self._at(by, order)
            d = self.df.withColumn("_i", F.row_number().over(w))
        else:
            self._by(order)
            keys = _names(order) or self.order
            cuts = self._slices(keys)
            d = positions.number(self.df, keys, "_i", cuts=cuts, keep=True)
            d = positions.carried(d, ["_i"], {f"_back{i}": points[c] for i, c in enumerate(cols)}, {f"_ahead{i}": points[c] for i, c in enumerate(cols)}, cuts)
        for i, c in enumerate(cols):
            x = F.col(c).cast("double")
            if by:
                back = F.last(points[c], ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
                ahead = F.last(points[c], ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.col("_i").desc()).rowsBetween(Window.unboundedPreceding, 0))
            else:
                back, ahead = F.col(f"_back{i}"), F.col(f"_ahead{i}")
            line = back["x"] + (ahead["x"] - back["x"]) * (F.col("_i") - back["i"]) / F.when(ahead["i"] != back["i"], ahead["i"] - back["i"])
            out[c] = F.coalesce(x, line, back["x"], ahead["x"], F.lit(float("nan")))
        return self._new(d.select(*[out[c].alias(c) if c in out else F.col(c) for c in self.columns]))

    # -- shape --------------------------------------------------------------------------------------------------
    def melt(self, id_vars, value_vars=None, var_name: str = "variable", value_name: str = "value") -> Frame:
        ids = _names(id_vars)
        vals = _names(value_vars) or [c for c in self.columns if c not in ids]
        kind = "string" if isinstance(self.df.schema[vals[0]].dataType, StringType) else "double"
        d = self.df.select(*ids, *[F.col(c).cast(kind).alias(c) for c in vals])
        return Frame(d.unpivot(ids, vals, var_name, value_name))

    def pivot(self, index: str, columns: str, values: str, agg: str = "sum", labels: Sequence | None = None) -> Frame:
        """One column per label; without ``labels`` a first pass finds them (at most spark.sql.pivotMaxValues)."""
        d = self.df.groupBy(*_names(index)).pivot(columns, list(labels)) if labels is not None else self.df.filter(F.col(columns).isNotNull()).groupBy(*_names(index)).pivot(columns)
        order = F.struct(*self.order) if self.order else None
        return Frame(d.agg(A.aggregate(agg, F.col(values), order)))

    def explode(self, col: str) -> Frame:
        """A row per element of a JSON array or comma-separated list; null and empty give one null row."""
        x = F.col(col)
        if not isinstance(self.df.schema[col].dataType, StringType):
            parts = x
        else:
            t = F.trim(x)
            parts = F.when(t.startswith("["), F.from_json(t, "array<string>")).when(t == "", None).otherwise(F.transform(F.split(x, ","), lambda v: F.trim(v)))
        return self._new(self.df.select(*[F.explode_outer(parts).alias(c) if c == col else F.col(c) for c in self.columns]))

    def unnest(self, col: str, sep: str = ".", schema: str | StructType | None = None) -> Frame:
        """JSON objects as dotted columns in place of ``col``; the fields are found in a first pass if not given."""
        if schema is None:
            spark = self.df.sparkSession
            texts = self.df.filter(F.col(col).isNotNull()).select(F.col(col).cast("string"))._jdf
            found = spark._jsparkSession.read().json(getattr(texts, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())).schema()
            schema = StructType.fromJson(json.loads(found.json()))
        if isinstance(schema, str):
            schema = StructType.fromDDL(schema)
        out: list[Column] = []

        def walk(kind: StructType, at: Column, name: str) -> None:
            for f in kind:
                here, n = at[f.name], f"{name}{sep}{f.name}"
                if isinstance(f.dataType, StructType):
                    walk(f.dataType, here, n)
                elif isinstance(f.dataType, (NumericType,)):
                    out.append(here.cast("double").alias(n))
                elif isinstance(f.dataType, StringType):
                    out.append(here.alias(n))
                else:
                    out.append(F.to_json(here).alias(n) if f.dataType.typeName() == "array" else here.cast("string").alias(n))

        d = self.df.withColumn("_j", F.from_json(col, schema))
        walk(schema, F.col("_j"), col)
        return self._new(d.select(*[F.col(f"`{c}`") for c in self.columns if c != col], *out))

    def transpose(self, header: str | None = None) -> Frame:
        """For small frames: rows become columns, as text."""
        rows = self.df.orderBy(*self._by()) if self.order else self.df
        data = rows.limit(10_001).collect()
        if len(data) > 10_000:
            raise ValueError("transpose is for at most 10 000 rows")
        names = [str(r[header]) if header else f"row_{i}" for i, r in enumerate(data)]
        text = lambda v: "" if v is None else str(v)
        out = [(c, *[text(r[c]) for r in data]) for c in self.columns if c != header]
        return Frame(self.df.sparkSession.createDataFrame(out, StructType.fromDDL(", ".join(f"`{n}` string" for n in ["column", *names]))))

    # -- user functions, execution ------------------------------------------------------------------------------
    def map_elements(self, name: str, col: str, f: Callable, dtype: str) -> Frame:
        """A scalar function, once per row, nulls included; Arrow-batched."""
        u = F.udf(f, dtype, useArrow=True).asNondeterministic()
        return self.with_columns(**{name: u(F.col(col))})

    def persist(self) -> Frame:
        self.df.persist()
        return self

    def unpersist(self) -> Frame:
        self.df.unpersist()
        return self

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)

    def collect(self, timeout: float | None = None) -> list[dict]:
        """Rows as dicts; after ``timeout`` seconds the jobs are cancelled and TimeoutError is raised."""
        from ashlar.operators.execution import collect

        return collect(self.df.orderBy(*self._by()) if self.order else self.df, timeout)

    def collect_with_report(self):
        from ashlar.operators.execution import collect_with_report

        return collect_with_report(self.df)

    def to_list(self) -> list[dict]:
        return self.collect()

    def show(self, n: int = 20) -> None:
        self.df.show(n, truncate=False)

    def column(self, name: str) -> Series:
        self._check(name)
        return Series(self, name)

    __getitem__ = column


def _pairs(df: DataFrame, cols: list[str], ranks: bool, scaled: bool) -> DataFrame:
    """Correlation or covariance matrix, over pairwise complete rows, in one aggregate (Spearman: ranks per pair)."""
    aggs = []
    if ranks:
        out = None
        for i, a in enumerate(cols):
            for b in cols[i:]:
                d = df.select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).dropna()
                d = positions.average_rank(positions.average_rank(d, "x", "rx"), "y", "ry")
                one = d.agg(_corr(F.col("rx"), F.col("ry")).alias(f"{i}_{cols.index(b)}"))
                out = one if out is None else out.crossJoin(one)
        one = out
    else:
        for i, a in enumerate(cols):
            for j in range(i, len(cols)):
                ok = F.col(a).isNotNull() & F.col(cols[j]).isNotNull()
                x, y = F.when(ok, F.col(a).cast("double")), F.when(ok, F.col(cols[j]).cast("double"))
                aggs.append((_corr(x, y) if scaled else F.covar_samp(x, y)).alias(f"{i}_{j}"))
        one = df.agg(*aggs)
    at = lambda i, j: F.col(f"{min(i, j)}_{max(i, j)}")
    rows = [F.struct(F.lit(c).alias("column"), *[at(i, j).alias(d) for j, d in enumerate(cols)]) for i, c in enumerate(cols)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _corr(x: Column, y: Column) -> Column:
    """Pearson from co-moments; NaN for fewer than two pairs or a constant."""
    sx, sy = F.stddev_samp(x), F.stddev_samp(y)
    return F.when((F.count(x) < 2) | (sx == 0) | (sy == 0), F.lit(float("nan"))).otherwise(F.covar_samp(x, y) / F.when(sx * sy != 0, sx * sy))


class Groups:
    def __init__(self, frame: Frame, keys: list[str]):
        self.frame, self.keys = frame, keys

    def _exprs(self, spec: dict) -> list[Column]:
        """name=kind (aggregates the column of that name), name=[kinds] (``name_kind``), name=(col, kind[, q]) or name=Column."""
        order = F.struct(*self.frame.order) if self.frame.order else None
        out = []
        for name, s in spec.items():
            if isinstance(s, Column):
                out.append(s.alias(name))
            elif isinstance(s, str):
                out.append(A.aggregate(s, F.col(name), order).alias(name))
            elif isinstance(s, list):
                out += [A.aggregate(k, F.col(name), order).alias(f"{name}_{k}") for k in s]
            else:
                col, kind, *rest = s
                out.append(A.aggregate(kind, F.col(col), order, *rest).alias(name))
        if not out:
            raise ValueError("agg needs an aggregate")
        return out

    #: rows of the largest group whose quantiles are found in one task; beyond it groups are cut into slices
    most = 1 << 20

    def largest(self) -> int:
        return self.frame.df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0

    def agg(self, **spec) -> Frame:
        cut: dict[tuple[str, str], dict[str, float]] = {}  # column and method -> name and share
        names, rest = [], {}
        for name, s in spec.items():
            items = [(name, name, s)] if isinstance(s, str) else [(f"{name}_{k}", name, k) for k in s] if isinstance(s, list) else [(name, *s)] if isinstance(s, tuple) else [(name, None, None)]
            names += [i[0] for i in items]
            for as_, col, kind, *more in items:
                if kind in ("median", "quantile"):
                    q, method = (*more, *(0.5, "linear")[len(more) :])
                    cut.setdefault((col, method), {})[as_] = 0.5 if kind == "median" else float(q)
                else:
                    rest[as_] = s if col is None else (col, kind, *more)
        if not cut or self.largest() <= self.most:
            return Frame(self.frame.df.groupBy(*self.keys).agg(*self._exprs(spec)))
        out = self.frame.df.groupBy(*self.keys).agg(*(self._exprs(rest) if rest else [F.count(F.lit(1)).alias("_n")]))
        for j, ((col, method), qs) in enumerate(cut.items()):
            q = positions.quantiles(self.frame.df, col, list(qs.values()), self.keys, list(qs), method)
            q = q.toDF(*[f"_k{j}_{i}" for i in range(len(self.keys))], *qs)
            same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{j}_{i}")) for i, k in enumerate(self.keys)]
            out = out.join(q, reduce(lambda a, b: a & b, same), "left") if same else out.crossJoin(q)
        return Frame(out.select(*[F.col(f"`{c}`") for c in [*self.keys, *names]]))

    def apply(self, f: Callable, schema: str | StructType) -> Frame:
        """``f`` turns each group's pandas frame into rows; a group must fit a task."""
        return Frame(self.frame.df.groupBy(*self.keys).applyInPandas(f, schema))

    def agg_with(self, name: str, col: str, f: Callable, dtype: str = "double") -> Frame:
        """An aggregate of one's own: ``f`` of a pandas series per group, Arrow-batched."""
        @F.pandas_udf(dtype)
        def own(x: pd.Series) -> float:
            return f(x)

        return Frame(self.frame.df.groupBy(*self.keys).agg(own(F.col(col)).alias(name)))

    def _all(self, kind: str) -> Frame:
        cols = [c for c in self.frame.numeric() if c not in self.keys]
        return self.agg(**{c: kind for c in cols})

    def count(self) -> Frame:
        return self.agg(count=F.count(F.lit(1)))

    def sum(self) -> Frame:
        return self._all("sum")

    def mean(self) -> Frame:
        return self._all("mean")

    def min(self) -> Frame:
        return self._all("min")

    def max(self) -> Frame:
        return self._all("max")

    def std(self) -> Frame:
        return self._all("std")

    def var(self) -> Frame:
        return self._all("var")

    def nunique(self) -> Frame:
        return self._all("nunique")

    def median(self) -> Frame:
        return self._all("median")


class Series:
    """One column with driver-side summaries; numeric ones use finite values only."""

    def __init__(self, frame: Frame, name: str):
        self.frame, self.name = frame, name

    def _one(self, expr: Column):
        return self.frame.df.agg(expr).first()[0]

    def _finite(self) -> Column:
        x = F.col(self.name).cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)

    def to_list(self) -> list:
        return [r[self.name] for r in self.frame.collect()]

    def null_count(self) -> int:
        return self._one(F.count_if(F.col(self.name).isNull()))

    def sum(self):
        return self._one(F.sum(self._finite()))

    def mean(self):
        return self._one(F.avg(self._finite()))

    def min(self):
        return self._one(F.min(self._finite()))

    def max(self):
        return self._one(F.max(self._finite()))

    def unique(self) -> Frame:
        return Frame(self.frame.df.select(self.name).distinct())

    def nunique(self) -> int:
        return self.unique().df.count()

    def value_counts(self, normalize: bool = False) -> Frame:
        return self.frame.value_counts(self.name, normalize)

    def fill_null(self, value) -> Frame:
        return self.frame.fill_null(value, self.name).select(self.name)

    def ffill(self) -> Frame:
        return self.frame.ffill(self.name).select(self.name)

    def bfill(self) -> Frame:
        return self.frame.bfill(self.name).select(self.name)

    def head(self, n: int = 5) -> list:
        return [r[self.name] for r in self.frame.head(n).df.collect()]

    def tail(self, n: int = 5) -> list:
        return [r[self.name] for r in self.frame.tail(n).df.collect()]
