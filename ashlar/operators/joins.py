"""Equi-joins with suffix rules, and as-of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ashlar.operators import positions

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "semi": "left_semi", "anti": "left_anti", "cross": "cross"}


def _list(x) -> list[str]:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


def _unique_keys(df: DataFrame, keys: list[str], side: str) -> None:
    ok = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    if df.filter(ok).groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError(f"join keys are not unique on the {side}")


def join(left: DataFrame, right: DataFrame, on=None, how: str = "inner", left_on=None, right_on=None, l_suffix: str = "", r_suffix: str = "_right", validate: str | None = None, nulls_equal: bool = False) -> DataFrame:
    """Keys of one name are merged (taken from whichever side has the row); other shared names get suffixes."""
    if how not in HOW:
        raise ValueError(f"how: {how}; known: {', '.join(HOW)}")
    lk, rk = _list(on or left_on), _list(on or right_on)
    if how != "cross" and (not lk or len(lk) != len(rk)):
        raise ValueError("a join needs as many keys on either side, and at least one")
    for keys, df, side in ((lk, left, "left"), (rk, right, "right")):
        for k in keys:
            if k not in df.columns:
                raise KeyError(f"unknown key {k!r} on the {side}")
    if validate in ("1:1", "1:m"):
        _unique_keys(left, lk, "left")
    if validate in ("1:1", "m:1"):
        _unique_keys(right, rk, "right")
    r = right.toDF(*[f"_r_{c}" for c in right.columns])
    same = lambda a, b: F.col(f"`{a}`").eqNullSafe(F.col(f"`_r_{b}`")) if nulls_equal else F.col(f"`{a}`") == F.col(f"`_r_{b}`")
    if how == "cross":
        joined = left.crossJoin(r)
    else:
        joined = left.join(r, reduce(lambda a, b: a & b, [same(a, b) for a, b in zip(lk, rk, strict=True)]), HOW[how])
    if how in ("semi", "anti"):
        return joined
    merged = [a for a, b in zip(lk, rk, strict=True) if a == b] if how != "cross" else []
    clash = (set(left.columns) & set(right.columns)) - set(merged)
    out: list[Column] = []
    for c in left.columns:
        if c in merged:
            out.append((F.coalesce(F.col(f"`{c}`"), F.col(f"`_r_{c}`")) if how in ("right", "outer") else F.col(f"`{c}`")).alias(c))
        else:
            out.append(F.col(f"`{c}`").alias(c + l_suffix if c in clash else c))
    out += [F.col(f"`_r_{c}`").alias(c + r_suffix if c in clash else c) for c in right.columns if c not in merged]
    return joined.select(*out)


def join_asof(left: DataFrame, right: DataFrame, left_on: str, right_on: str, strategy: str = "backward", by: list[str] | None = None, order: list[str] | None = None, suffix: str = "_right") -> DataFrame:
    """Each left row with the nearest right row at or before it (backward), at or after it (forward), or either (nearest).

    Backward takes the last of equal right rows, forward the first, in the order of the right row's columns; nearest
    prefers forward at equal distance. Null keys match nothing. With ``by`` the groups are the unit of work; without,
    the key is cut into slices, and each slice gets the one right row of its neighbours that it may need.
    """
    if strategy not in ("backward", "forward", "nearest"):
        raise ValueError(f"strategy: {strategy}")
    by = by or []
    cols = [c for c in right.columns if c not in by]
    rest = F.struct(*[F.col(f"`{c}`") for c in cols])
    l = left.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col(left_on).alias("_k"), F.lit(1).alias("_side"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_l"))
    r = right.filter(F.col(right_on).isNotNull()).select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col(right_on).cast(left.schema[left_on].dataType).alias("_k"), rest.alias("_r"))
    groups = [f"_by{i}" for i in range(len(by))]
    if not by:
        cuts = positions.boundaries(left, left_on)
        l, r = l.withColumn("_b", positions.bucket(l, "_k", cuts)), r.withColumn("_b", positions.bucket(r, "_k", cuts))
        groups = ["_b"]
        every = left.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("_b"))
        ends = r.groupBy("_b").agg(F.max(F.struct("_k", "_r")).alias("hi"), F.min(F.struct("_k", "_r")).alias("lo"))
        ends = every.join(ends, "_b", "left")  # a row per slice
        w = Window.orderBy("_b")
        before = F.last("hi", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        after = F.last("lo", ignorenulls=True).over(Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1))
        near = ends.select("_b", before.alias("p"), after.alias("n")).select("_b", F.explode(F.array("p", "n")).alias("g")).filter("g is not null").select("g._k", "g._r", "_b")
        r = r.select("_k", "_r", "_b").unionByName(near)
    none_l, none_r = F.lit(None).cast(l.schema["_l"].dataType), F.lit(None).cast(r.schema["_r"].dataType)
    both = l.withColumn("_r", none_r).unionByName(r.withColumn("_side", F.lit(0)).withColumn("_l", none_l))
    pair = F.when(F.col("_side") == 0, F.struct("_k", "_r"))
    back = F.last(pair, ignorenulls=True).over(Window.partitionBy(*groups).orderBy("_k", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0))
    # the last of the reversed order: a frame that reaches to the end is read again for every row
    ahead = F.last(pair, ignorenulls=True).over(Window.partitionBy(*groups).orderBy(F.col("_k").desc(), F.col("_side"), F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0))
    if strategy == "backward":
        found = both.withColumn("_m", back)
    elif strategy == "forward":
        found = both.withColumn("_m", ahead)
    else:
        d = lambda c: F.abs(_number(c, left.schema[left_on].dataType) - _number(F.col("_k"), left.schema[left_on].dataType))
        found = both.withColumn("_p", back).withColumn("_n", ahead)
        pick = F.when(F.col("_p").isNull(), F.col("_n")).when(F.col("_n").isNull(), F.col("_p")).when(d(F.col("_n._k")) <= d(F.col("_p._k")), F.col("_n")).otherwise(F.col("_p"))
        found = found.withColumn("_m", pick)
    found = found.filter("_side = 1").withColumn("_m", F.when(F.col("_k").isNotNull(), F.col("_m._r")))
    merged = [right_on] if left_on == right_on else []
    return found.select(*[F.col(f"_l.`{c}`").alias(c) for c in left.columns], *[F.col(f"_m.`{c}`").alias(c + suffix if c in left.columns else c) for c in cols if c not in merged])


def _number(c: Column, kind) -> Column:
    return F.unix_micros(c.cast("timestamp")).cast("double") if kind.typeName() in ("timestamp", "timestamp_ntz", "date") else c.cast("double")
