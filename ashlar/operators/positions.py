"""Global positions and running sums without a single-partition window.

The first order key is cut into slices by boundaries taken from its quantiles (as many as there are shuffle partitions);
rows are ordered within slices, and the slices' totals, a handful of numbers, are added as literals.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, IntegerType, LongType, NumericType, StructField, StructType, TimestampNTZType, TimestampType


def boundaries(df: DataFrame, key: str, n: int | None = None) -> list:
    """Rising, distinct values that cut ``key`` into about ``n`` equal slices."""
    spark = df.sparkSession
    n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if n <= 1:
        return []
    kind = df.schema[key].dataType
    if isinstance(kind, (NumericType, DateType, TimestampType, TimestampNTZType)):
        at = [i / n for i in range(1, n)]
        found = df.agg(F.percentile_approx(key, at, 1000)).first()[0] or []
    else:
        rows = df.filter(F.col(key).isNotNull()).select(key)
        total = rows.count()
        some = sorted(r[0] for r in rows.sample(min(1.0, 50 * n / max(total, 1)), seed=1).collect())
        found = [some[len(some) * i // n] for i in range(1, n)] if some else []
    return sorted(set(found))


def bucket(df: DataFrame, key: str, cuts: list) -> Column:
    """Index of the slice of ``key``; null comes last."""
    kind = df.schema[key].dataType
    if not cuts:
        return F.lit(0)
    table = F.array(*[F.lit(c).cast(kind) for c in cuts])
    inside = F.size(F.filter(table, lambda c: c < F.col(key))) if len(cuts) <= 16 else _search(F.col(key), cuts, kind)
    return F.when(F.col(key).isNull(), len(cuts)).otherwise(inside)


def _search(key: Column, cuts: list, kind) -> Column:
    """Number of cuts below ``key``, by a binary tree of conditions."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key > F.lit(cuts[mid]).cast(kind), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(cuts))


def _ordered(keys: list[str], reverse: bool = False) -> list[Column]:
    return [F.col(k).desc_nulls_first() if reverse else F.col(k).asc_nulls_last() for k in keys]


def _prefixed(df: DataFrame, keys: list[str], total: Column, running, name: str, zero, cuts: list | None = None, keep: bool = False) -> DataFrame:
    cuts = boundaries(df, keys[0]) if cuts is None else cuts
    d = df.withColumn("_b", bucket(df, keys[0], cuts))
    sums = {r[0]: r[1] for r in d.groupBy("_b").agg(total).collect()}  # one row per slice
    at, offsets = zero, []
    for b in range(len(cuts) + 1):
        offsets.append(at)
        at = at + (sums.get(b) or zero)
    w = Window.partitionBy("_b").orderBy(*_ordered(keys))
    return d.withColumn(name, running(w) + F.element_at(F.array(*[F.lit(o) for o in offsets]), F.col("_b") + 1)).drop(*([] if keep else ["_b"]))


def number(df: DataFrame, keys: list[str], name: str, by: list[str] | None = None, cuts: list | None = None, keep: bool = False) -> DataFrame:
    """``df`` with the 0-based position of each row in the order of ``keys`` (null last), within groups with ``by``.

    ``cuts`` are known boundaries of the first key; any are right. ``keep`` leaves the slices in ``_b``. Groups are cut into the same slices, so few groups of many rows are no few tasks; counts per group and slice are joined.
    """
    if by:
        d = df.withColumn("_b", bucket(df, keys[0], boundaries(df, keys[0])))
        at = d.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
        before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
        at = at.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_b").alias("_c"), F.coalesce(before, F.lit(0)).alias("_before"))
        cond = F.col("_b") == F.col("_c")
        for i, c in enumerate(by):
            cond = cond & F.col(c).eqNullSafe(F.col(f"_k{i}"))
        d = d.join(at, cond)
        place = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*_ordered(keys))) - 1 + F.col("_before")
        return d.select(*[c for c in df.columns if c != name], place.alias(name))
    return _prefixed(df, keys, F.count(F.lit(1)), lambda w: (F.row_number().over(w) - 1).cast("long"), name, 0, cuts, keep)


def running_sum(df: DataFrame, keys: list[str], x: Column, name: str, cuts: list | None = None) -> DataFrame:
    return _prefixed(df, keys, F.sum(x), lambda w: F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0)), name, 0.0, cuts)


def beside(df: DataFrame, keys: list[str], back: int, ahead: int, make, numbered: DataFrame | None = None) -> DataFrame:
    """``df`` with the columns that ``make(window)`` gives over up to ``back`` rows before and ``ahead`` rows after each row.

    Rows are numbered (``numbered``: already, in ``_row``), and blocks of positions get copies of the rows next to them, so no task
    orders more than a block.
    """
    width = max(1 << 16, back, ahead)
    d = number(df, keys, "_row") if numbered is None else numbered
    b, i = F.floor(F.col("_row") / width), F.col("_row") % width
    at = [F.struct(b.alias("b"), F.lit(True).alias("own"))]
    if back:
        at.append(F.when(i >= width - back, F.struct((b + 1).alias("b"), F.lit(False).alias("own"))))
    if ahead:
        at.append(F.when(i < ahead, F.struct((b - 1).alias("b"), F.lit(False).alias("own"))))
    d = d.withColumn("_at", F.explode(F.filter(F.array(*at), lambda c: c.isNotNull())))
    d = d.withColumn("_b", F.col("_at.b")).withColumn("_own", F.col("_at.own"))
    made = make(Window.partitionBy("_b").orderBy("_row"))
    keep = [c for c in df.columns if c not in made]
    out = d.select(*keep, "_own", *[v.alias(k) for k, v in made.items()]).filter("_own")
    return out.select(*[c for c in df.columns], *[k for k in made if k not in df.columns])


def carried(df: DataFrame, keys: list[str], back: dict[str, Column], ahead: dict[str, Column] | None = None, cuts: list | None = None) -> DataFrame:
    """``df`` with columns of the last (``back``) or next (``ahead``) value that is not null, this row's included, in the order of ``keys``.

    Slices of the order are filled by themselves; what each passes on, one value a column, is joined. Next values are last values of the
    reversed order: a window that reaches to the end is read again for every row. ``df`` may have its slices in ``_b`` already.
    """
    cuts = boundaries(df, keys[0]) if cuts is None else cuts
    names = {(k, way): f"_v{len(back) * way + i}" for way, values in enumerate((back, ahead or {})) for i, k in enumerate(values)}
    columns = [c for c in df.columns if c != "_b"]
    d = df if "_b" in df.columns else df.withColumn("_b", bucket(df, keys[0], cuts))
    d = d.select("*", *[(ahead if way else back)[k].alias(m) for (k, way), m in names.items()])
    order = F.struct(*[F.struct(F.col(k).isNull().alias("n"), F.col(k).alias("k")) for k in keys])
    some = [(F.min_by if way else F.max_by)(F.col(m), F.when(F.col(m).isNotNull(), order)).alias(m) for (_, way), m in names.items()]
    got = {r["_b"]: r for r in d.groupBy("_b").agg(*some).collect()}  # a row a slice
    n = len(cuts) + 1
    pass_on: dict[str, list] = {m: [None] * n for m in names.values()}
    for (_, way), m in names.items():
        now = None
        for b in range(n - 1, -1, -1) if way else range(n):
            pass_on[m][b] = now
            if b in got and got[b][m] is not None:
                now = got[b][m]
    kinds = StructType([StructField("_c", IntegerType()), *[StructField("_p" + m, d.schema[m].dataType) for m in pass_on]])
    table = df.sparkSession.createDataFrame([(b, *[v[b] for v in pass_on.values()]) for b in range(n)], kinds)
    w = [Window.partitionBy("_b").orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in (_ordered(keys), _ordered(keys, True))]
    d = d.select("*", *[F.last(m, ignorenulls=True).over(w[way]).alias("_w" + m) for (_, way), m in names.items()])
    d = d.join(F.broadcast(table), F.col("_b") == F.col("_c"), "left")  # a row a slice
    made = {k: F.coalesce(F.col("_w" + m), F.col("_p" + m)) for (k, _), m in names.items()}
    return d.select(*[made[c].alias(c) if c in made else F.col(c) for c in columns], *[v.alias(k) for k, v in made.items() if k not in columns])


def running(df: DataFrame, keys: list[str], made: dict[str, tuple[str, str]], cuts: list | None = None) -> DataFrame:
    """Running sums, means, counts, minima or maxima (name -> column and kind) from slices: each starts from the totals of those before it."""
    cuts = boundaries(df, keys[0]) if cuts is None else cuts
    d = df.withColumn("_b", bucket(df, keys[0], cuts))
    cols = list(dict.fromkeys(c for c, _ in made.values()))
    at = {c: i for i, c in enumerate(cols)}
    summed = {c for c, kind in made.values() if kind in ("sum", "mean")}
    whole = {"s": lambda c: F.sum(F.col(c).cast("double")) if c in summed else F.lit(0.0), "n": F.count, "lo": F.min, "hi": F.max}
    sums = {r["_b"]: r for r in d.groupBy("_b").agg(*[f(c).alias(f"{k}{at[c]}") for c in cols for k, f in whole.items()]).collect()}  # a row a slice
    now: dict = {f"{k}{i}": v for i in range(len(cols)) for k, v in (("s", 0.0), ("n", 0), ("lo", None), ("hi", None))}
    rows = []
    for b in range(len(cuts) + 1):
        rows.append((b, *now.values()))
        if b in sums:
            for k, v in now.items():
                x = sums[b][k]
                now[k] = v if x is None else x if v is None else v + x if k[0] in "sn" else (min if k[0] == "l" else max)(v, x, key=lambda y: (y != y, y))  # NaN is the largest
    kinds = [StructField("_c", IntegerType())]
    for c in cols:
        kinds += [StructField(f"_{k}{at[c]}", {"s": DoubleType(), "n": LongType()}.get(k, df.schema[c].dataType)) for k in whole]
    w = Window.partitionBy("_b").orderBy(*_ordered(keys)).rowsBetween(Window.unboundedPreceding, 0)
    use = {"count": "n", "sum": "ns", "mean": "ns", "min": "l", "max": "h"}
    need = dict.fromkeys((k, c) for c, kind in made.values() for k in use[kind])
    over = {"s": lambda c: F.sum(F.col(c).cast("double")), "n": F.count, "l": F.min, "h": F.max}
    d = d.select("*", *[over[k](c).over(w).alias(f"_w{k}{at[c]}") for k, c in need])
    d = d.join(F.broadcast(df.sparkSession.createDataFrame(rows, StructType(kinds))), F.col("_b") == F.col("_c"), "left")  # a row a slice

    def out(c: str, kind: str) -> Column:
        i = at[c]
        if kind == "min":
            return F.least(f"_wl{i}", f"_lo{i}")
        if kind == "max":
            return F.greatest(f"_wh{i}", f"_hi{i}")
        count = F.col(f"_wn{i}") + F.col(f"_n{i}")
        if kind == "count":
            return count
        total = F.coalesce(F.col(f"_ws{i}"), F.lit(0.0)) + F.col(f"_s{i}")
        return F.when(count > 0, total if kind == "sum" else total / count)

    new = {name: out(*s) for name, s in made.items()}
    return d.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns], *[v.alias(k) for k, v in new.items() if k not in df.columns])


def quantiles(df: DataFrame, col: str, qs: list[float], by: list[str], names: list[str], method: str = "linear") -> DataFrame:
    """Exact quantiles of ``col`` per group as columns ``names``; no task holds a group, only a slice of its distinct values.

    Counts per group and slice tell which slices hold the order statistics; only those are looked into. Null is no value.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    d = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(col).cast("double").alias("_x")).filter("_x is not null")
    d = d.withColumn("_b", bucket(d, "_x", boundaries(d, "_x"))).groupBy(*keys, "_b", "_x").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    per = d.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"))
    per = per.withColumn("_to", F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(w))
    want = []
    for i, q in enumerate(qs):
        pos = F.lit(float(q)) * (F.col("_all") - 1) if method == "linear" else F.least(F.greatest(F.lit(float(q)) * (F.col("_all") + 1) - 1, F.lit(0.0)), (F.col("_all") - 1).cast("double"))
        low = F.floor(pos)
        want += [F.struct(F.lit(2 * i).alias("w"), low.alias("r"), (pos - low).alias("f")), F.struct(F.lit(2 * i + 1).alias("w"), F.least(low + 1, F.col("_all") - 1).alias("r"), (pos - low).alias("f"))]
    at = per.select(*keys, "_b", (F.col("_to") - F.col("_n")).alias("_before"), "_to", F.explode(F.array(*want)).alias("_t"))
    at = at.filter((F.col("_t.r") >= F.col("_before")) & (F.col("_t.r") < F.col("_to")))
    at = at.groupBy(*[F.col(k).alias("r" + k) for k in keys], F.col("_b").alias("r_b")).agg(F.collect_list(F.struct("_t.w", (F.col("_t.r") - F.col("_before")).alias("o"), "_t.f")).alias("_want"))
    cond = F.col("_b") == F.col("r_b")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col("r" + k))
    inside = d.join(at, cond)
    inside = inside.withColumn("_to", F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)))
    hit = inside.select(*keys, "_x", "_n", "_to", F.explode("_want").alias("_t")).filter((F.col("_t.o") < F.col("_to")) & (F.col("_t.o") >= F.col("_to") - F.col("_n")))
    value = lambda j: F.max(F.when(F.col("_t.w") == j, F.col("_x")))
    part = lambda j: F.max(F.when(F.col("_t.w") == j, F.col("_t.f")))
    line = lambda a, b, f: F.when((f == 0) | (a == b), a).otherwise(a + (b - a) * f)
    out = hit.groupBy(*keys).agg(*[line(value(2 * i), value(2 * i + 1), part(2 * i)).alias(n) for i, n in enumerate(names)])
    return out.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], *names)


def average_rank(df: DataFrame, col: str, out: str) -> DataFrame:
    """``df`` with the average rank of ``col`` over the whole frame; ties and hot values are folded before ranking."""
    n = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    r = running_sum(n, [col], F.col("_n"), "_to").select(F.col(col).alias("_v"), (F.col("_to") - (F.col("_n") - 1) / 2).alias(out))
    return df.join(r, F.col(col) == F.col("_v"), "left").drop("_v")


def slice_of(cuts: list, value) -> int:
    """The slice of a plain value."""
    return bisect_left(cuts, value)
