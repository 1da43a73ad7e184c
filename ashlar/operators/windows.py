"""rank (five methods), row_number, lag, lead and cumsum as window columns."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

METHODS = ("average", "min", "max", "dense", "ordinal")


def window_column(func: str, col: str | Column | None, partition_by: list[str], order_by: list[str], descending: bool, method: str, offset: int) -> Column:
    x = F.col(col) if isinstance(col, str) else col
    keys = [F.col(k) for k in order_by] or ([x] if x is not None else [])
    if not keys:
        raise ValueError(f"{func} needs an order")
    order = [k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys]
    w = Window.partitionBy(*partition_by).orderBy(*order)
    if func == "rank":
        if method not in METHODS:
            raise ValueError(f"method: {method}; known: {', '.join(METHODS)}")
        ties = F.count(F.lit(1)).over(Window.partitionBy(*partition_by, *keys))
        low = F.rank().over(w)
        out = {"average": lambda: low + (ties - 1) / 2, "min": lambda: low, "max": lambda: low + ties - 1, "dense": lambda: F.dense_rank().over(w), "ordinal": lambda: F.row_number().over(w)}[method]()
        some = keys[0].isNotNull()
        for k in keys[1:]:
            some = some & k.isNotNull()
        return F.when(some, out.cast("double"))
    if func == "row_number":
        return F.row_number().over(w)
    if func == "lag":
        return F.lag(x, offset).over(w)
    if func == "lead":
        return F.lead(x, offset).over(w)
    if func == "cumsum":
        return F.sum(F.coalesce(x.cast("double"), F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    raise ValueError(f"unknown window function {func}")
