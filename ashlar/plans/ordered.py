"""Registered queries: operators over the whole order of a frame, remaining column functions, and round trips of the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ashlar.functions import numeric as N
from ashlar.operators.frame import Frame
from ashlar.plans.catalog import _H, _holes, frame, query, table
from ashlar.sources import readers, writers

_c = F.col
_BY = "ORDER BY ts, event_id"


def _events(spark, d):
    return frame(spark, d, "events", "ts", "event_id").select("event_id", "ts", "value")


# -- whole order --------------------------------------------------------------------------------------------------
@query("rolling_whole", f"SELECT event_id, round(avg(value) OVER w, 8) AS m, max(value) OVER w AS top, round(stddev_samp(value) OVER w, 6) AS sd FROM events WINDOW w AS ({_BY} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) QUALIFY row_number() OVER ({_BY}) > 1")
def rolling_whole(spark, d):
    f = _events(spark, d).with_row_number("n").rolling("m", "value", 7).rolling("top", "value", 7, "max").rolling("sd", "value", 7, "std")
    return f.filter(_c("n") > 0).select("event_id", F.round("m", 8).alias("m"), "top", F.round("sd", 6).alias("sd")).df


@query("expanding_whole", f"SELECT event_id, round(sum(value) OVER w + 1e-7, 4) AS total, round(avg(value) OVER w + 1e-9, 6) AS mean, count(value) OVER w AS n, min(value) OVER w AS low, max(value) OVER w AS high FROM events WINDOW w AS ({_BY} ROWS UNBOUNDED PRECEDING)")
def expanding_whole(spark, d):
    f = _events(spark, d)
    for name, kind in (("total", "sum"), ("mean", "mean"), ("n", "count"), ("low", "min"), ("high", "max")):
        f = f.expanding(name, "value", kind)
    return f.select("event_id", F.round(_c("total") + 1e-7, 4).alias("total"), F.round(_c("mean") + 1e-9, 6).alias("mean"), "n", "low", "high").df


@query("shift_whole", f"SELECT event_id, lag(value) OVER w AS s, lead(value, 2) OVER w AS ahead, round(value - lag(value, 3) OVER w, 8) AS d, round((value - lag(value) OVER w) / nullif(lag(value) OVER w, 0), 8) AS p FROM events WINDOW w AS ({_BY})")
def shift_whole(spark, d):
    f = _events(spark, d).shift("s", "value").shift("ahead", "value", -2).diff("d", "value", 3).pct_change("p", "value")
    return f.select("event_id", "s", "ahead", F.round("d", 8).alias("d"), F.round("p", 8).alias("p")).df


@query("ffill_whole", f"SELECT event_id, last_value(v IGNORE NULLS) OVER ({_BY} ROWS UNBOUNDED PRECEDING) AS f, first_value(v IGNORE NULLS) OVER ({_BY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM {_H}")
def ffill_whole(spark, d):
    h = _holes(spark, d).with_order("ts", "event_id").with_columns(f=_c("v"), b=_c("v"))
    return h.ffill("f").bfill("b").select("event_id", "f", "b").df


@query("interpolate_whole", f"""WITH n AS (SELECT *, row_number() OVER ({_BY}) AS i FROM {_H}),
 p AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS pi, last_value(v IGNORE NULLS) OVER a AS pv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER z AS ni, first_value(v IGNORE NULLS) OVER z AS nv FROM n
 WINDOW a AS (ORDER BY i ROWS UNBOUNDED PRECEDING), z AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT event_id, round(coalesce(v, pv + (nv - pv) * (i - pi) / nullif(ni - pi, 0), pv, nv), 8) AS v FROM p""")
def interpolate_whole(spark, d):
    return _holes(spark, d).with_order("ts", "event_id").interpolate("v").select("event_id", F.round("v", 8).alias("v")).df


@query("take_rows", f"SELECT event_id FROM (SELECT event_id, row_number() OVER ({_BY}) - 1 AS i FROM events) WHERE i IN (3, 17, 41, 0)")
def take_rows(spark, d):
    return _events(spark, d).take([17, 3, 41, 0]).select("event_id").df


@query("sample_size", "SELECT round(count(*) * 0.25)::BIGINT AS n, 0::BIGINT AS foreign_rows, round(count(*) * 0.25)::BIGINT AS distinct_rows FROM events")
def sample_size(spark, d):
    e = frame(spark, d, "events").select("event_id")
    s = e.sample(fraction=0.25, seed=3).df
    return s.join(e.df.withColumn("_in", F.lit(1)), "event_id", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(_c("_in").isNull()).alias("foreign_rows"), F.count_distinct("event_id").alias("distinct_rows"))


@query("head_rows", f"SELECT event_id FROM events {_BY} LIMIT 7")
def head_rows(spark, d):
    return _events(spark, d).head(7).select("event_id").df


# -- functions ----------------------------------------------------------------------------------------------------
@query("mod_pow_cast", "SELECT p_partkey, (p_partkey % 7)::DOUBLE AS m, round(power(p_size, 0.5), 8) AS p, p_size::VARCHAR AS s, round(ln(p_retailprice) / ln(2), 8) AS l2, round(ln(p_retailprice) / ln(7), 8) AS l7 FROM part")
def mod_pow_cast(spark, d):
    x = _c("p_retailprice")
    return frame(spark, d, "part").select("p_partkey", N.mod(_c("p_partkey"), F.lit(7)).alias("m"), F.round(N.pow(_c("p_size"), F.lit(0.5)), 8).alias("p"), N.cast(_c("p_size"), "utf8").alias("s"), F.round(N.log2(x), 8).alias("l2"), F.round(N.log(x, 7), 8).alias("l7")).df


@query("null_tests", f"SELECT event_id, v IS NULL AS missing, v IS NOT NULL AS present, coalesce(v, 0) AS filled FROM {_H}")
def null_tests(spark, d):
    return _holes(spark, d).select("event_id", _c("v").isNull().alias("missing"), _c("v").isNotNull().alias("present"), N.fill_null(_c("v"), 0).alias("filled")).df


@query("map_elements", "SELECT p_partkey, (p_size * p_size + 1)::DOUBLE AS y FROM part")
def map_elements(spark, d):
    return frame(spark, d, "part").select("p_partkey", "p_size").map_elements("y", "p_size", lambda v: float(v * v + 1), "double").select("p_partkey", "y").df


@query("is_null_rows", f"SELECT count(*) FILTER (v IS NULL) AS missing, count(*) FILTER (v IS NOT NULL) AS present, count(*) FILTER (v BETWEEN 5 AND 20) AS middle FROM {_H}")
def is_null_rows(spark, d):
    h = _holes(spark, d)
    n = [x.df.count() for x in (h.is_null("v"), h.not_null("v"), h.between("v", 5, 20))]
    return spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in zip(("missing", "present", "middle"), n, strict=True)])


@query("select_numeric", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def select_numeric(spark, d):
    return frame(spark, d, "supplier").select_numeric().df


@query("nunique_columns", "SELECT count(DISTINCT c_mktsegment) AS c_mktsegment, count(DISTINCT c_nationkey) AS c_nationkey FROM customer")
def nunique_columns(spark, d):
    return frame(spark, d, "customer").select("c_mktsegment", "c_nationkey").nunique().df


@query("group_shortcuts", "SELECT c_mktsegment, round(sum(c_acctbal), 2) AS c_acctbal, 'sum' AS kind FROM customer GROUP BY 1 UNION ALL SELECT c_mktsegment, round(avg(c_acctbal), 2), 'mean' FROM customer GROUP BY 1 UNION ALL SELECT c_mktsegment, max(c_acctbal), 'max' FROM customer GROUP BY 1 UNION ALL SELECT c_mktsegment, round(median(c_acctbal), 2), 'median' FROM customer GROUP BY 1 UNION ALL SELECT c_mktsegment, round(stddev_samp(c_acctbal), 2), 'std' FROM customer GROUP BY 1")
def group_shortcuts(spark, d):
    c = frame(spark, d, "customer").select("c_mktsegment", "c_acctbal")
    parts = []
    for kind in ("sum", "mean", "max", "median", "std"):
        got = getattr(c.group_by("c_mktsegment"), kind)().df
        value = next(x for x in got.columns if x != "c_mktsegment")
        parts.append(Frame(got.select("c_mktsegment", F.round(_c(value), 2).alias("c_acctbal"), F.lit(kind).alias("kind"))))
    return Frame.concat(parts).df


@query("intersect_all", "SELECT o_custkey % 50 AS k FROM orders INTERSECT ALL SELECT c_custkey % 50 FROM customer")
def intersect_all(spark, d):
    a, b = frame(spark, d, "orders").select((_c("o_custkey") % 50).alias("k")), frame(spark, d, "customer").select((_c("c_custkey") % 50).alias("k"))
    return a.intersect(b, all=True).df


@query("except_all", "SELECT o_custkey % 50 AS k FROM orders EXCEPT ALL SELECT c_custkey % 50 FROM customer")
def except_all(spark, d):
    a, b = frame(spark, d, "orders").select((_c("o_custkey") % 50).alias("k")), frame(spark, d, "customer").select((_c("c_custkey") % 50).alias("k"))
    return a.subtract(b, all=True).df


@query("join_validated", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_validated(spark, d):
    n = frame(spark, d, "nation").select("n_nationkey", "n_name")
    return frame(spark, d, "supplier").join(n, left_on="s_nationkey", right_on="n_nationkey", validate="m:1").select("s_suppkey", "n_name").df


@query("transposed", "SELECT 'r_regionkey' AS \"column\", (SELECT r_regionkey::VARCHAR FROM region WHERE r_name = 'ASIA') AS \"ASIA\", (SELECT r_regionkey::VARCHAR FROM region WHERE r_name = 'EUROPE') AS \"EUROPE\"")
def transposed(spark, d):
    r = frame(spark, d, "region", "r_regionkey").select("r_name", "r_regionkey").transpose("r_name").df
    return r.filter(_c(r.columns[0]) == "r_regionkey").select(_c(r.columns[0]).alias("column"), _c("ASIA").cast("string").alias("ASIA"), _c("EUROPE").cast("string").alias("EUROPE"))


# -- sources --------------------------------------------------------------------------------------------------------
_PART = "SELECT p_partkey, p_name, p_size, p_retailprice FROM part"


def _folder(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/ashlar-trip-{uuid.uuid4().hex}"


def _parts(spark, d) -> Frame:
    return frame(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")



def _source(spark, d):
    """The types that the table itself has."""
    kinds = dict(table(spark, d, "part").dtypes)
    return lambda f: f.df.select(*[_c(c).cast(kinds[c]).alias(c) for c in ("p_partkey", "p_name", "p_size", "p_retailprice")])


@query("csv_round_trip", _PART)
def csv_round_trip(spark, d):
    path = _folder(spark)
    writers.write_csv(_parts(spark, d), path)
    return _source(spark, d)(readers.read_csv(spark, path))


@query("json_round_trip", _PART)
def json_round_trip(spark, d):
    path = _folder(spark)
    writers.write_json(_parts(spark, d), path)
    return _source(spark, d)(readers.read_json(spark, path, orient="lines"))


@query("parquet_round_trip", _PART)
def parquet_round_trip(spark, d):
    path = _folder(spark)
    writers.write_parquet(_parts(spark, d), path)
    return _source(spark, d)(readers.read_parquet(spark, path))


@query("arrow_round_trip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def arrow_round_trip(spark, d):
    s = frame(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    back = readers.from_arrow_ipc(spark, writers.to_arrow_ipc(s))
    kinds = dict(s.df.dtypes)
    return back.df.select(*[_c(c).cast(kinds[c]).alias(c) for c in kinds])


@query("csv_text", "SELECT n_nationkey::DOUBLE AS n_nationkey, n_name FROM nation")
def csv_text(spark, d):
    n = frame(spark, d, "nation").select("n_nationkey", "n_name")
    return readers.from_csv(spark, writers.to_csv(n)).df.select(_c("n_nationkey").cast("double").alias("n_nationkey"), "n_name")


@query("rows_in_memory", "SELECT r_regionkey::DOUBLE AS r_regionkey, r_name FROM region")
def rows_in_memory(spark, d):
    r = frame(spark, d, "region").select(_c("r_regionkey").cast("double").alias("r_regionkey"), "r_name")
    return readers.from_rows(spark, r.to_list()).df.select(_c("r_regionkey").cast("double").alias("r_regionkey"), "r_name")


@query("columns_in_memory", "SELECT r_regionkey::DOUBLE AS r_regionkey, r_name FROM region")
def columns_in_memory(spark, d):
    rows = frame(spark, d, "region").select("r_regionkey", "r_name").to_list()
    return readers.from_columns(spark, {k: [r[k] for r in rows] for k in ("r_regionkey", "r_name")}).df.select(_c("r_regionkey").cast("double").alias("r_regionkey"), "r_name")


# -- quantiles by slices, functions of one's own --------------------------------------------------------------------
@query("quantiles_sliced", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.975), 6) AS q97_5 FROM lineitem GROUP BY 1")
def quantiles_sliced(spark, d):
    f = frame(spark, d, "lineitem").quantiles("l_extendedprice", [0.25, 0.5, 0.975], by="l_returnflag")
    return f.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q97_5")]).df


@query("quantiles_whole", "SELECT round(quantile_cont(l_quantity, 0.1), 6) AS q10, round(quantile_cont(l_quantity, 0.9), 6) AS q90 FROM lineitem")
def quantiles_whole(spark, d):
    return frame(spark, d, "lineitem").quantiles("l_quantity", [0.1, 0.9]).df


@query("own_aggregate", "SELECT c_mktsegment, round(exp(avg(ln(c_custkey + 1))), 6) AS geometric FROM customer GROUP BY 1")
def own_aggregate(spark, d):
    import numpy as np

    c = frame(spark, d, "customer").select("c_mktsegment", "c_custkey")
    return c.group_by("c_mktsegment").agg_with("geometric", "c_custkey", lambda x: float(np.exp(np.log(x + 1).mean()))).select("c_mktsegment", F.round("geometric", 6).alias("geometric")).df


@query("group_apply", "SELECT c_mktsegment, max(c_acctbal) - min(c_acctbal) AS span FROM customer GROUP BY 1")
def group_apply(spark, d):
    c = frame(spark, d, "customer").select("c_mktsegment", "c_acctbal")
    return c.group_by("c_mktsegment").apply(lambda p: p.groupby("c_mktsegment", as_index=False).agg(span=("c_acctbal", lambda x: x.max() - x.min())), "c_mktsegment string, span double").df


@query("map_batches", "SELECT n_name, length(n_name) AS n FROM nation")
def map_batches(spark, d):
    import pyarrow as pa
    import pyarrow.compute as pc

    n = frame(spark, d, "nation").select("n_name")
    return n.map_batches(lambda b: pa.RecordBatch.from_arrays([b.column(0), pc.utf8_length(b.column(0)).cast(pa.int64())], ["n_name", "n"]), "n_name string, n long").df
