"""Registered queries: name -> (callable, DuckDB SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ashlar.functions import dates as D
from ashlar.functions import numeric as N
from ashlar.functions import strings as S
from ashlar.operators.frame import Frame

_Q: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query function under ``name`` with its oracle."""

    def put(f):
        _Q[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return put


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark, d, name: str, *order: str) -> Frame:
    return Frame(table(spark, d, name), order)


def _c(x):
    return F.col(x)


# -- projection, filters, expressions ---------------------------------------------------------------------------
@query("scan_project", "SELECT l_orderkey, l_partkey, l_quantity * 2 AS double_qty FROM lineitem")
def scan_project(spark, d):
    return frame(spark, d, "lineitem").select("l_orderkey", "l_partkey", (_c("l_quantity") * 2).alias("double_qty")).df


@query("filter_and", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def filter_and(spark, d):
    return frame(spark, d, "orders").filter(N.and_(_c("o_orderstatus") == "F", _c("o_totalprice") > 100000)).select("o_orderkey", "o_totalprice").df


@query("filter_or_not", "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT (c_acctbal > 0) OR c_mktsegment = 'MACHINERY'")
def filter_or_not(spark, d):
    return frame(spark, d, "customer").filter(N.or_(N.not_(_c("c_acctbal") > 0), _c("c_mktsegment") == "MACHINERY")).select("c_custkey", "c_mktsegment").df


@query("is_in_between", "SELECT p_partkey, p_size BETWEEN 10 AND 20 AS mid, (p_size >= 10 AND p_size < 20) AS left_closed, p_type IN ('ECONOMY', 'STANDARD') AS kind FROM part")
def is_in_between(spark, d):
    return frame(spark, d, "part").select("p_partkey", N.is_between(_c("p_size"), 10, 20).alias("mid"), N.is_between(_c("p_size"), 10, 20, "left").alias("left_closed"), N.is_in(_c("p_type"), ["ECONOMY", "STANDARD"]).alias("kind")).df


@query("when_case", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 40 THEN 'large' WHEN l_quantity > 20 THEN 'middle' ELSE 'small' END AS size_class FROM lineitem")
def when_case(spark, d):
    return frame(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(_c("l_quantity") > 40, "large").when(_c("l_quantity") > 20, "middle").otherwise("small").alias("size_class")).df


@query("rename_drop", "SELECT s_suppkey AS id, s_name AS name, s_acctbal FROM supplier")
def rename_drop(spark, d):
    return frame(spark, d, "supplier").drop("s_nationkey", "absent").rename({"s_suppkey": "id", "s_name": "name"}).df


@query("with_columns", "SELECT o_orderkey, o_totalprice * 2 AS o_totalprice, o_totalprice + 1 AS plus FROM orders")
def with_columns(spark, d):
    return frame(spark, d, "orders").select("o_orderkey", "o_totalprice").with_columns(o_totalprice=_c("o_totalprice") * 2, plus=_c("o_totalprice") + 1).df


@query("math_exprs", "SELECT p_partkey, round(sqrt(p_retailprice), 8) AS s, round(ln(p_retailprice), 8) AS l, round(log10(p_retailprice), 8) AS l10, round(exp(p_size / 50.0), 8) AS e, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, abs(p_size - 25) AS a, round(pow(p_size, 1.5), 6) AS p, sign(p_size - 25)::DOUBLE AS g FROM part")
def math_exprs(spark, d):
    x, z = _c("p_retailprice"), _c("p_size")
    return frame(spark, d, "part").select("p_partkey", F.round(N.sqrt(x), 8).alias("s"), F.round(N.log(x), 8).alias("l"), F.round(N.log10(x), 8).alias("l10"), F.round(F.exp(z / 50.0), 8).alias("e"), N.floor(x).alias("f"), N.ceil(x).alias("c"), F.abs(z - 25).alias("a"), F.round(N.pow(z, 1.5), 6).alias("p"), N.sign(z - 25).alias("g")).df


@query("round_half_away", "SELECT p_partkey, round(p_retailprice, 1) AS r1, round(p_retailprice) AS r0 FROM part")
def round_half_away(spark, d):
    return frame(spark, d, "part").select("p_partkey", N.round(_c("p_retailprice"), 1).alias("r1"), N.round(_c("p_retailprice")).alias("r0")).df


@query("ieee_div", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount = 0 THEN (CASE WHEN l_tax = 0 THEN 'nan' ELSE 'inf' END) ELSE 'finite' END AS kind, CASE WHEN l_discount <> 0 THEN round(l_tax / l_discount, 6) END AS q FROM lineitem")
def ieee_div(spark, d):
    q = N.div(_c("l_tax"), _c("l_discount"))
    return frame(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.isnan(q), "nan").when(q == N.INF, "inf").otherwise("finite").alias("kind"), F.when(~F.isnan(q) & (q != N.INF), F.round(q, 6)).alias("q")).df


@query("clip", "SELECT c_custkey, least(greatest(c_acctbal, 0), 5000) AS clipped FROM customer")
def clip(spark, d):
    return frame(spark, d, "customer").select("c_custkey", N.clip(_c("c_acctbal"), 0, 5000).alias("clipped")).df


@query("str_case_trim", "SELECT p_partkey, upper(p_name) AS u, length(p_name) AS n, trim('  ' || p_name || ' ') AS t, contains(p_name, 'blue') AS has, starts_with(p_name, 'small') AS st, ends_with(p_name, 'anvil') AS en FROM part")
def str_case_trim(spark, d):
    x = _c("p_name")
    return frame(spark, d, "part").select("p_partkey", S.upper(x).alias("u"), S.length(x).alias("n"), S.trim(F.concat(F.lit("  "), x, F.lit(" \t"))).alias("t"), S.contains(x, "blue").alias("has"), S.starts_with(x, "small").alias("st"), S.ends_with(x, "anvil").alias("en")).df


@query("str_replace_slice", "SELECT p_partkey, CASE WHEN position('l' IN p_name) > 0 THEN substr(p_name, 1, position('l' IN p_name) - 1) || 'L' || substr(p_name, position('l' IN p_name) + 1) ELSE p_name END AS one, replace(p_name, 'l', 'L') AS every, substr(p_name, 2, 3) AS mid, right(p_name, 3) AS last3 FROM part")
def str_replace_slice(spark, d):
    x = _c("p_name")
    return frame(spark, d, "part").select("p_partkey", S.replace(x, "l", "L").alias("one"), S.replace_all(x, "l", "L").alias("every"), S.slice_(x, 1, 4).alias("mid"), S.slice_(x, -3).alias("last3")).df


@query("str_pad_concat", "SELECT p_partkey, CASE WHEN length(p_brand) >= 10 THEN p_brand ELSE lpad(p_brand, 10, '*') END AS l, CASE WHEN length(p_brand) >= 8 THEN p_brand ELSE rpad(p_brand, 8, '-') END AS r, p_brand || '/' || p_type AS c FROM part")
def str_pad_concat(spark, d):
    x = _c("p_brand")
    return frame(spark, d, "part").select("p_partkey", S.pad_start(x, 10, "*").alias("l"), S.pad_end(x, 8, "-").alias("r"), S.concat(x, _c("p_type"), "/").alias("c")).df


@query("str_split_json", "SELECT p_partkey, to_json(string_split(p_name, ' '))::VARCHAR AS parts FROM part")
def str_split_json(spark, d):
    return frame(spark, d, "part").select("p_partkey", S.split(_c("p_name"), " ").alias("parts")).df


@query("dt_parts", "SELECT event_id, year(ts)::DOUBLE AS y, month(ts)::DOUBLE AS m, day(ts)::DOUBLE AS d, hour(ts)::DOUBLE AS h, minute(ts)::DOUBLE AS mi, second(ts)::DOUBLE AS s, dayofweek(ts)::DOUBLE AS wd, (epoch_us(ts) // 1000)::DOUBLE AS ms FROM events")
def dt_parts(spark, d):
    t = _c("ts")
    return frame(spark, d, "events").select("event_id", D.year(t).alias("y"), D.month(t).alias("m"), D.day(t).alias("d"), D.hour(t).alias("h"), D.minute(t).alias("mi"), D.second(t).alias("s"), D.weekday(t).alias("wd"), D.epoch_millis(t).alias("ms")).df


@query("days_between", "SELECT o_orderkey, round((epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1995-01-01')) / 86400000.0, 6) AS days FROM orders")
def days_between(spark, d):
    return frame(spark, d, "orders").select("o_orderkey", F.round(N.days_between(_c("o_orderdate"), F.lit("1995-01-01").cast("timestamp")), 6).alias("days")).df


# -- aggregates -------------------------------------------------------------------------------------------------
@query("agg_basic", "SELECT l_returnflag, sum(l_quantity) AS s, round(avg(l_discount), 10) AS m, min(l_shipdate) AS lo, max(l_shipdate) AS hi, count(*) AS n FROM lineitem GROUP BY 1")
def agg_basic(spark, d):
    return frame(spark, d, "lineitem").group_by("l_returnflag").agg(s=("l_quantity", "sum"), m=F.round(F.avg("l_discount"), 10), lo=("l_shipdate", "min"), hi=("l_shipdate", "max"), n=("l_orderkey", "count")).df


@query("agg_std_var", "SELECT o_custkey, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(o_totalprice) END, 4) AS s, round(CASE WHEN count(*) = 1 THEN 0 ELSE var_samp(o_totalprice) END, 2) AS v FROM orders GROUP BY 1")
def agg_std_var(spark, d):
    out = frame(spark, d, "orders").group_by("o_custkey").agg(s=("o_totalprice", "std"), v=("o_totalprice", "var"))
    return out.with_columns(s=F.round("s", 4), v=F.round("v", 2)).df


@query("agg_quantile_linear", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(median(l_extendedprice), 6) AS med, round(quantile_cont(l_extendedprice, 0.9), 6) AS q9 FROM lineitem GROUP BY 1")
def agg_quantile_linear(spark, d):
    out = frame(spark, d, "lineitem").group_by("l_returnflag").agg(q1=("l_extendedprice", "quantile", 0.25), med=("l_extendedprice", "median"), q9=("l_extendedprice", "quantile", 0.9))
    return out.with_columns(**{c: F.round(c, 6) for c in ("q1", "med", "q9")}).df


@query("agg_quantile_type6", """WITH s AS (SELECT o_custkey, list_sort(list(o_totalprice)) AS v FROM orders GROUP BY 1), p AS (SELECT *, least(greatest(0.25 * (len(v) + 1) - 1, 0), len(v) - 1) AS pos FROM s)
SELECT o_custkey, round(v[floor(pos)::INT + 1] + (v[least(floor(pos)::INT + 2, len(v))] - v[floor(pos)::INT + 1]) * (pos - floor(pos)), 4) AS q FROM p""")
def agg_quantile_type6(spark, d):
    return frame(spark, d, "orders").group_by("o_custkey").agg(q=("o_totalprice", "quantile", 0.25, "minitab")).with_columns(q=F.round("q", 4)).df


@query("agg_nunique", "SELECT l_shipdate, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def agg_nunique(spark, d):
    return frame(spark, d, "lineitem").group_by("l_shipdate").agg(suppliers=("l_suppkey", "nunique"), parts=("l_partkey", "nunique")).df


@query("agg_first_last", "SELECT user_id, arg_min(event_type, event_id) AS first, arg_max(event_type, event_id) AS last FROM events GROUP BY 1")
def agg_first_last(spark, d):
    return frame(spark, d, "events", "event_id").group_by("user_id").agg(first=("event_type", "first"), last=("event_type", "last")).df


@query("group_count", "SELECT p_brand, count(*) AS count FROM part GROUP BY 1")
def group_count(spark, d):
    return frame(spark, d, "part").group_by("p_brand").count().df


@query("value_counts", "SELECT event_type, count(*)::DOUBLE AS count FROM events GROUP BY 1")
def value_counts(spark, d):
    return frame(spark, d, "events").value_counts("event_type").df


@query("value_counts_norm", "SELECT event_type, round(count(*) / (SELECT count(*) FROM events), 10) AS proportion FROM events GROUP BY 1")
def value_counts_norm(spark, d):
    return frame(spark, d, "events").value_counts("event_type", normalize=True).with_columns(proportion=F.round("proportion", 10)).df


_D = {"count": "count({c})::DOUBLE", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c}) + 0.0", "25%": "quantile_cont({c}, 0.25)", "50%": "quantile_cont({c}, 0.5)", "75%": "quantile_cont({c}, 0.75)", "max": "max({c})"}


@query("describe_lineitem", " UNION ALL ".join(f"SELECT '{k}' AS stat, round({v.format(c='l_quantity')}, 6) AS l_quantity, round({v.format(c='l_tax')}, 6) + 0.0 AS l_tax FROM lineitem" for k, v in _D.items()))
def describe_lineitem(spark, d):
    return frame(spark, d, "lineitem").describe("l_quantity", "l_tax").with_columns(l_quantity=F.round("l_quantity", 6), l_tax=F.round("l_tax", 6)).df


@query("corr_matrix", "SELECT 'l_quantity' AS \"column\", 1.0::DOUBLE AS l_quantity, round(corr(l_quantity, l_extendedprice), 8) AS l_extendedprice FROM lineitem UNION ALL SELECT 'l_extendedprice', round(corr(l_quantity, l_extendedprice), 8), 1.0 FROM lineitem")
def corr_matrix(spark, d):
    return frame(spark, d, "lineitem").corr("l_quantity", "l_extendedprice").with_columns(l_quantity=F.round("l_quantity", 8), l_extendedprice=F.round("l_extendedprice", 8)).df


@query("cov_matrix", "SELECT 'l_quantity' AS \"column\", round(var_samp(l_quantity), 5) AS l_quantity, round(covar_samp(l_quantity, l_tax), 8) AS l_tax FROM lineitem UNION ALL SELECT 'l_tax', round(covar_samp(l_quantity, l_tax), 8), round(var_samp(l_tax), 5) FROM lineitem")
def cov_matrix(spark, d):
    m = frame(spark, d, "lineitem").cov("l_quantity", "l_tax")
    return m.df.select("column", F.when(_c("column") == "l_quantity", F.round("l_quantity", 5)).otherwise(F.round("l_quantity", 8)).alias("l_quantity"), F.when(_c("column") == "l_tax", F.round("l_tax", 5)).otherwise(F.round("l_tax", 8)).alias("l_tax"))


@query("spearman", "WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_tax) - 1) / 2.0 AS b FROM lineitem) SELECT 'l_quantity' AS \"column\", 1.0::DOUBLE AS l_quantity, round(corr(a, b), 8) AS l_tax FROM r UNION ALL SELECT 'l_tax', round(corr(a, b), 8), 1.0 FROM r")
def spearman(spark, d):
    return frame(spark, d, "lineitem").corr("l_quantity", "l_tax", method="spearman").with_columns(l_quantity=F.round("l_quantity", 8), l_tax=F.round("l_tax", 8)).df


@query("profile_nulls", "SELECT 'c_custkey' AS \"column\", '0' AS null_count, min(c_custkey)::VARCHAR AS min, max(c_custkey)::VARCHAR AS max FROM customer UNION ALL SELECT 'c_mktsegment', '0', min(c_mktsegment), max(c_mktsegment) FROM customer")
def profile_nulls(spark, d):
    return frame(spark, d, "customer").select("c_custkey", "c_mktsegment").profile().drop("approx_unique").df


@query("broadcast_agg", "SELECT p_partkey, round(p_retailprice - avg(p_retailprice) OVER (), 8) AS centred FROM part")
def broadcast_agg(spark, d):
    f = frame(spark, d, "part").broadcast_agg(m=F.avg("p_retailprice"))
    return f.select("p_partkey", F.round(_c("p_retailprice") - _c("m"), 8).alias("centred")).df


@query("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, d):
    return frame(spark, d, "lineitem").cube("l_returnflag", "l_linestatus", n=F.count(F.lit(1))).df


@query("rollup", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, d):
    return frame(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus", q=("l_quantity", "sum")).df


# -- joins ------------------------------------------------------------------------------------------------------
def _oc(spark, d):
    o = frame(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").filter(_c("o_totalprice") > 200000)
    c = frame(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").filter(_c("c_acctbal") > 0)
    return o, c


_OC = "(SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000) o {} JOIN (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey"
for _how, _sql in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL")):

    def _join(spark, d, how=_how):
        o, c = _oc(spark, d)
        return o.join(c, how=how, left_on="o_custkey", right_on="c_custkey").df

    query(f"join_{_how}", f"SELECT * FROM {_OC.format(_sql)}")(_join)


@query("join_semi", f"SELECT * FROM {_OC.format('SEMI')}")
def join_semi(spark, d):
    o, c = _oc(spark, d)
    return o.join(c, how="semi", left_on="o_custkey", right_on="c_custkey").df


@query("join_anti", f"SELECT * FROM {_OC.format('ANTI')}")
def join_anti(spark, d):
    o, c = _oc(spark, d)
    return o.join(c, how="anti", left_on="o_custkey", right_on="c_custkey").df


@query("join_cross", "SELECT n.*, r.* FROM nation n CROSS JOIN region r")
def join_cross(spark, d):
    return frame(spark, d, "nation").cross_join(frame(spark, d, "region")).df


@query("join_multikey", "SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_extendedprice, b.n FROM lineitem a JOIN (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) b USING (l_orderkey, l_linenumber)")
def join_multikey(spark, d):
    li = frame(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return li.inner_join(li.group_by("l_orderkey", "l_linenumber").agg(n=F.count(F.lit(1))), ["l_orderkey", "l_linenumber"]).df


@query("join_suffix", "SELECT a.k, a.v AS v, b.v AS v_right FROM (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier) a JOIN (SELECT c_custkey AS k, c_acctbal AS v FROM customer) b USING (k)")
def join_suffix(spark, d):
    a = frame(spark, d, "supplier").select(_c("s_suppkey").alias("k"), _c("s_acctbal").alias("v"))
    return a.inner_join(frame(spark, d, "customer").select(_c("c_custkey").alias("k"), _c("c_acctbal").alias("v")), "k").df


_EV = "(SELECT event_id, ts, user_id FROM events WHERE event_type = 'purchase') a"
_VW = "(SELECT event_id AS view_id, ts AS view_ts, user_id FROM events WHERE event_type = 'view') b"


def _asof(spark, d, strategy, by=None):
    e = frame(spark, d, "events")
    a = e.filter(_c("event_type") == "purchase").select("event_id", "ts", "user_id")
    b = e.filter(_c("event_type") == "view").select(_c("event_id").alias("view_id"), _c("ts").alias("view_ts"), *(["user_id"] if by else []))
    return a.join_asof(b, "ts", "view_ts", strategy, by=by)


@query("asof_backward", f"SELECT a.event_id, a.ts, a.user_id, b.view_id, b.view_ts FROM {_EV} ASOF LEFT JOIN {_VW} ON a.ts >= b.view_ts")
def asof_backward(spark, d):
    return _asof(spark, d, "backward").df


@query("asof_forward", f"SELECT a.event_id, a.ts, a.user_id, b.view_id, b.view_ts FROM {_EV} ASOF LEFT JOIN {_VW} ON a.ts <= b.view_ts")
def asof_forward(spark, d):
    return _asof(spark, d, "forward").df


@query("asof_nearest", f"""SELECT a.event_id, a.ts, a.user_id, CASE WHEN f.view_id IS NOT NULL AND (p.view_id IS NULL OR f.view_ts - a.ts <= a.ts - p.view_ts) THEN f.view_id ELSE p.view_id END AS view_id,
 CASE WHEN f.view_id IS NOT NULL AND (p.view_id IS NULL OR f.view_ts - a.ts <= a.ts - p.view_ts) THEN f.view_ts ELSE p.view_ts END AS view_ts
 FROM {_EV} ASOF LEFT JOIN {_VW.replace(" b", " p")} ON a.ts >= p.view_ts ASOF LEFT JOIN {_VW.replace(" b", " f")} ON a.ts <= f.view_ts""")
def asof_nearest(spark, d):
    return _asof(spark, d, "nearest").df


@query("asof_by", f"SELECT a.event_id, a.ts, a.user_id, b.view_id, b.view_ts FROM {_EV} ASOF LEFT JOIN {_VW} ON a.user_id = b.user_id AND a.ts >= b.view_ts")
def asof_by(spark, d):
    return _asof(spark, d, "backward", "user_id").df


# -- windows ----------------------------------------------------------------------------------------------------
_RANKS = {
    "average": "rank() OVER w + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0", "min": "rank() OVER w", "max": "rank() OVER w + count(*) OVER (PARTITION BY p_brand, p_size) - 1",
    "dense": "dense_rank() OVER w",
}
for _m, _sql in _RANKS.items():

    def _rank(spark, d, method=_m):
        return frame(spark, d, "part").with_window("r", "rank", partition_by="p_brand", order_by="p_size", method=method).select("p_partkey", "r").df

    query(f"win_rank_{_m}", f"SELECT p_partkey, ({_sql})::DOUBLE AS r FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")(_rank)


@query("win_rank_ordinal", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey DESC)::DOUBLE AS r FROM part")
def win_rank_ordinal(spark, d):
    return frame(spark, d, "part").with_window("r", "rank", partition_by="p_brand", order_by=["p_size", "p_partkey"], descending=True, method="ordinal").select("p_partkey", "r").df


@query("win_lag_lead", "SELECT event_id, lag(value, 1) OVER w AS before, lead(value, 2) OVER w AS after, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def win_lag_lead(spark, d):
    k = {"partition_by": "user_id", "order_by": "ts"}
    f = frame(spark, d, "events")
    return f.with_window("before", "lag", "value", **k).with_window("after", "lead", "value", offset=2, **k).with_window("n", "row_number", **k).select("event_id", "before", "after", "n").df


@query("win_cumsum", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) AS running FROM events")
def win_cumsum(spark, d):
    return frame(spark, d, "events").with_window("running", "cumsum", "value", "user_id", "ts").select("event_id", F.round("running", 6).alias("running")).df


@query("global_cumsum", "SELECT event_id, round(sum(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events")
def global_cumsum(spark, d):
    return frame(spark, d, "events", "event_id").cumsum("running", "value").select("event_id", F.round("running", 4).alias("running")).df


@query("over_share", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 10) AS share FROM lineitem")
def over_share(spark, d):
    f = frame(spark, d, "lineitem").over("t", "sum", "l_extendedprice", "l_orderkey")
    return f.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.round(_c("l_extendedprice") / _c("t"), 10).alias("share")).df


@query("over_stats", "SELECT o_orderkey, count(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS kinds, round(CASE WHEN count(*) OVER w = 1 THEN 0 ELSE stddev_samp(o_totalprice) OVER w END, 4) AS s, round(median(o_totalprice) OVER w, 4) AS med FROM orders WINDOW w AS (PARTITION BY o_custkey)")
def over_stats(spark, d):
    f = frame(spark, d, "orders").over("kinds", "nunique", "o_orderpriority", "o_custkey").over("s", "std", "o_totalprice", "o_custkey").over("med", "median", "o_totalprice", "o_custkey")
    return f.select("o_orderkey", "kinds", F.round("s", 4).alias("s"), F.round("med", 4).alias("med")).df


@query("over_running", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 6) AS m, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS top FROM orders")
def over_running(spark, d):
    k = {"partition_by": "o_custkey", "order_by": "o_orderkey"}
    return frame(spark, d, "orders").over("m", "mean", "o_totalprice", **k).over("top", "max", "o_totalprice", **k).select("o_orderkey", F.round("m", 6).alias("m"), "top").df


@query("rolling_mean", "SELECT event_id, round(avg(value) OVER w, 8) AS m, max(value) OVER w AS top, round(median(value) OVER w, 8) AS med FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def rolling_mean(spark, d):
    f = frame(spark, d, "events", "ts")
    for name, kind in (("m", "mean"), ("top", "max"), ("med", "median")):
        f = f.rolling(name, "value", 5, kind, by="user_id")
    return f.select("event_id", F.round("m", 8).alias("m"), "top", F.round("med", 8).alias("med")).df


@query("expanding_sum", "SELECT event_id, round(sum(value) OVER w, 6) AS s, min(value) OVER w AS lo FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)")
def expanding_sum(spark, d):
    return frame(spark, d, "events", "ts").expanding("s", "value", "sum", by="user_id").expanding("lo", "value", "min", by="user_id").select("event_id", F.round("s", 6).alias("s"), "lo").df


@query("shift_diff_pct", "SELECT event_id, lag(value) OVER w AS s, round(value - lag(value) OVER w, 8) AS d, round((value - lag(value) OVER w) / nullif(lag(value) OVER w, 0), 8) AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def shift_diff_pct(spark, d):
    f = frame(spark, d, "events", "ts").shift("s", "value", by="user_id").diff("d", "value", by="user_id").pct_change("p", "value", by="user_id")
    return f.select("event_id", "s", F.round("d", 8).alias("d"), F.round("p", 8).alias("p")).df


# -- order, limits, sets ----------------------------------------------------------------------------------------
@query("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk(spark, d):
    return frame(spark, d, "orders").select("o_orderkey", "o_totalprice").sort("o_totalprice", "o_orderkey", descending=[True, False]).limit(20).df


@query("limit_offset", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 5")
def limit_offset(spark, d):
    return frame(spark, d, "customer", "c_custkey").select("c_custkey").limit(10, 5).df


@query("tail", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey DESC LIMIT 7")
def tail(spark, d):
    return frame(spark, d, "customer", "c_custkey").select("c_custkey", "c_name").tail(7).df


@query("slice_take", "SELECT event_id FROM events ORDER BY event_id LIMIT 20 OFFSET 100")
def slice_take(spark, d):
    return frame(spark, d, "events", "event_id").select("event_id").slice(100, 120).df


@query("row_number", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row FROM orders")
def row_number(spark, d):
    return frame(spark, d, "orders", "o_orderdate", "o_orderkey").with_row_number().select("o_orderkey", "row").df


for _keep, _dir in (("first", "ASC"), ("last", "DESC")):

    def _unique(spark, d, keep=_keep):
        return frame(spark, d, "events", "event_id").select("event_id", "user_id", "event_type").unique("user_id", "event_type", keep=keep).df

    query(f"unique_{_keep}", f"SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id {_dir}) = 1")(_unique)


@query("unique_none", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1")
def unique_none(spark, d):
    return frame(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").unique("l_orderkey", "l_linenumber", keep="none").df


@query("concat_vertical", "SELECT s_suppkey AS k, s_acctbal AS v FROM supplier UNION ALL SELECT c_custkey, c_acctbal FROM customer")
def concat_vertical(spark, d):
    a = frame(spark, d, "supplier").select(_c("s_suppkey").alias("k"), _c("s_acctbal").alias("v"))
    return Frame.concat([a, frame(spark, d, "customer").select(_c("c_custkey").alias("k"), _c("c_acctbal").alias("v"))]).df


@query("concat_horizontal", "SELECT c_custkey, c_name, other_key, c_acctbal FROM (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) JOIN (SELECT c_custkey AS other_key, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS i FROM customer) USING (i)")
def concat_horizontal(spark, d):
    c = frame(spark, d, "customer")
    by_balance = c.select(_c("c_custkey").alias("other_key"), "c_acctbal").with_order("c_acctbal", "other_key")
    return Frame.concat([c.select("c_custkey", "c_name").with_order("c_custkey"), by_balance], "horizontal").df


@query("intersect_except", "(SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL (SELECT -1 - c_custkey FROM customer EXCEPT SELECT -1 - o_custkey FROM orders)")
def intersect_except(spark, d):
    o, c = frame(spark, d, "orders").select(_c("o_custkey").alias("k")), frame(spark, d, "customer")
    both = o.intersect(c.filter(_c("c_acctbal") > 0).select(_c("c_custkey").alias("k")))
    minus = c.select((-1 - _c("c_custkey")).alias("k")).subtract(o.select((-1 - _c("k")).alias("k")))
    return Frame.concat([both, minus]).df


# -- missing data, shape ----------------------------------------------------------------------------------------
def _holes(spark, d):
    return frame(spark, d, "events", "ts").select("event_id", "ts", "user_id", F.when(_c("event_type") != "view", _c("value")).alias("v"))


_H = "(SELECT event_id, ts, user_id, CASE WHEN event_type <> 'view' THEN value END AS v FROM events)"


@query("fill_null", f"SELECT event_id, coalesce(v, -1) AS v FROM {_H}")
def fill_null(spark, d):
    return _holes(spark, d).fill_null(-1, "v").select("event_id", "v").df


@query("drop_null", f"SELECT event_id, v FROM {_H} WHERE v IS NOT NULL")
def drop_null(spark, d):
    return _holes(spark, d).drop_null("v").select("event_id", "v").df


@query("ffill_bfill", f"SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS f, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM {_H}")
def ffill_bfill(spark, d):
    h = _holes(spark, d).with_columns(f=_c("v"), b=_c("v"))
    return h.ffill("f", by="user_id").bfill("b", by="user_id").select("event_id", "f", "b").df


@query("interpolate", f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM {_H}),
 p AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS pi, last_value(v IGNORE NULLS) OVER a AS pv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER z AS ni, first_value(v IGNORE NULLS) OVER z AS nv FROM n
 WINDOW a AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), z AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT event_id, round(coalesce(v, pv + (nv - pv) * (i - pi) / nullif(ni - pi, 0), pv, nv), 8) AS v FROM p""")
def interpolate(spark, d):
    return _holes(spark, d).interpolate("v", by="user_id").select("event_id", F.round("v", 8).alias("v")).df


@query("melt", "SELECT s_suppkey, 's_nationkey' AS variable, s_nationkey::DOUBLE AS value FROM supplier UNION ALL SELECT s_suppkey, 's_acctbal', s_acctbal FROM supplier")
def melt(spark, d):
    return frame(spark, d, "supplier").melt("s_suppkey", ["s_nationkey", "s_acctbal"]).df


@query("pivot", "SELECT user_id, " + ", ".join(f"round(sum(value) FILTER (event_type = '{t}'), 6) AS {t}" for t in ("click", "purchase", "view")) + " FROM events GROUP BY 1")
def pivot(spark, d):
    return frame(spark, d, "events").pivot("user_id", "event_type", "value", labels=["click", "purchase", "view"]).with_columns(**{t: F.round(t, 6) for t in ("click", "purchase", "view")}).df


@query("explode_list", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def explode_list(spark, d):
    return frame(spark, d, "part").select("p_partkey", F.replace(_c("p_name"), F.lit(" "), F.lit(", ")).alias("word")).explode("word").df


@query("unnest_props", "SELECT event_id, (props::JSON->>'k')::DOUBLE AS \"props.k\" FROM events")
def unnest_props(spark, d):
    return frame(spark, d, "events").select("event_id", "props").unnest("props").df


# -- combined ---------------------------------------------------------------------------------------------------
@query("shipping_priority", "SELECT o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'MACHINERY' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY 1, 2")
def shipping_priority(spark, d):
    day = F.lit("1998-03-15").cast("timestamp_ntz")
    c = frame(spark, d, "customer").filter(_c("c_mktsegment") == "MACHINERY").select("c_custkey")
    o = frame(spark, d, "orders").filter(_c("o_orderdate") < day).select("o_orderkey", "o_custkey", "o_orderdate")
    li = frame(spark, d, "lineitem").filter(_c("l_shipdate") > day).select("l_orderkey", "l_extendedprice", "l_discount")
    j = o.join(c, left_on="o_custkey", right_on="c_custkey", how="semi").join(li, left_on="o_orderkey", right_on="l_orderkey")
    return j.group_by("o_orderkey", "o_orderdate").agg(revenue=F.round(F.sum(_c("l_extendedprice") * (1 - _c("l_discount"))), 2)).df


@query("local_supplier_volume", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AFRICA' GROUP BY 1")
def local_supplier_volume(spark, d):
    n = frame(spark, d, "nation").join(frame(spark, d, "region").filter(_c("r_name") == "AFRICA"), left_on="n_regionkey", right_on="r_regionkey", how="semi").select("n_nationkey", "n_name")
    s = frame(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(n, left_on="s_nationkey", right_on="n_nationkey")
    li = frame(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount").join(s, left_on="l_suppkey", right_on="s_suppkey")
    oc = frame(spark, d, "orders").select("o_orderkey", "o_custkey").join(frame(spark, d, "customer").select("c_custkey", "c_nationkey"), left_on="o_custkey", right_on="c_custkey")
    j = li.join(oc, left_on=["l_orderkey", "s_nationkey"], right_on=["o_orderkey", "c_nationkey"])
    return j.group_by("n_name").agg(revenue=F.round(F.sum(_c("l_extendedprice") * (1 - _c("l_discount"))), 2)).df


@query("forecast_revenue", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def forecast_revenue(spark, d):
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    li = frame(spark, d, "lineitem").filter((_c("l_shipdate") >= t("1997-01-01")) & (_c("l_shipdate") < t("1998-01-01")) & _c("l_discount").between(0.05, 0.07) & (_c("l_quantity") < 24))
    return li.agg(revenue=F.round(F.sum(_c("l_extendedprice") * _c("l_discount")), 2)).df


@query(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2""",
)
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem")
    return (
        li.filter(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").alias("sum_qty"),
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
            F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
            F.count(F.lit(1)).alias("n"),
        )
    )


# -- statistics -------------------------------------------------------------------------------------------------
def _one_row(spark, **values):
    """A one-row frame of plain numbers."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


@query("ttest_sums", """WITH m AS (SELECT event_type AS g, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events WHERE event_type IN ('click', 'view') GROUP BY 1), a AS (SELECT * FROM m WHERE g = 'click'), b AS (SELECT * FROM m WHERE g = 'view')
SELECT round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 8) AS t, round(power(a.v / a.n + b.v / b.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1)), 4) AS df FROM a, b""")
def ttest_sums(spark, d):
    from ashlar.stats import basic

    r = basic.ttest2(table(spark, d, "events").filter(_c("event_type").isin("click", "view")), "value", "event_type")
    return _one_row(spark, t=round(r["t"], 8), df=round(r["df"], 4))


@query("anova_sums", """WITH m AS (SELECT event_type AS g, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1), t AS (SELECT sum(n * m) / sum(n) AS gm, sum(n) AS n, count(*) AS k FROM m)
SELECT round((SELECT sum(m.n * power(m.m - t.gm, 2)) FROM m, t) / (k - 1) / ((SELECT sum((n - 1) * v) FROM m) / (n - k)), 6) AS f, (k - 1)::INT AS df1, (n - k)::INT AS df2 FROM t""")
def anova_sums(spark, d):
    from ashlar.stats import basic

    r = basic.anova(table(spark, d, "events"), "value", "event_type")
    return _one_row(spark, f=round(r["f"], 6), df1=r["df_between"], df2=r["df_within"])


@query("ols_sums", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem")
def ols_sums(spark, d):
    from ashlar.stats import regression

    r = regression.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    c = {x["term"]: x["estimate"] for x in r["coefficients"]}
    return _one_row(spark, slope=round(c["l_quantity"], 6), intercept=round(c["(intercept)"], 4), r2=round(r["r_squared"], 8))


@query("mann_whitney", """WITH r AS (SELECT event_type, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM events WHERE event_type IN ('click', 'view'))
SELECT round(sum(r) - count(*) * (count(*) + 1) / 2.0, 3) AS u FROM r WHERE event_type = 'click'""")
def mann_whitney(spark, d):
    from ashlar.stats import nonparam

    r = nonparam.mann_whitney(table(spark, d, "events").filter(_c("event_type").isin("click", "view")), "value", "event_type")
    return _one_row(spark, u=round(r["u"], 3))


@query("kruskal", """WITH r AS (SELECT event_type, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM events), g AS (SELECT event_type, count(*) AS n, sum(r) AS w FROM r GROUP BY 1), t AS (SELECT sum(power(c, 3) - c) AS s FROM (SELECT count(*) AS c FROM events GROUP BY value)), n AS (SELECT sum(n) AS n FROM g)
SELECT round((12 / (n.n * (n.n + 1)) * (SELECT sum(w * w / n) FROM g) - 3 * (n.n + 1)) / (1 - t.s / (power(n.n, 3) - n.n)), 5) AS h FROM n, t""")
def kruskal(spark, d):
    from ashlar.stats import nonparam

    return _one_row(spark, h=round(nonparam.kruskal(table(spark, d, "events"), "value", "event_type")["h"], 5))


@query("xbar_r_limits", "WITH g AS (SELECT o_orderkey // 5 AS g, count(*) AS n, avg(o_totalprice) AS m, max(o_totalprice) - min(o_totalprice) AS r FROM orders GROUP BY 1) SELECT round(sum(m * n) / sum(n), 4) AS centre, round(avg(r) / 2.326, 4) AS sigma FROM g")
def xbar_r_limits(spark, d):
    from ashlar.stats import spc

    o = table(spark, d, "orders").select(F.floor(_c("o_orderkey") / 5).alias("g"), "o_totalprice")
    r = spc.xbar_chart(o, "o_totalprice", "g")
    return _one_row(spark, centre=round(r["centre"], 4), sigma=round(r["sigma"], 4))


@query("capability", "SELECT round(4000 / (6 * stddev_samp(l_quantity)) / 100, 8) AS pp, round(least(50 - avg(l_quantity), avg(l_quantity) - 10) / (3 * stddev_samp(l_quantity)), 8) AS ppk FROM lineitem")
def capability(spark, d):
    from ashlar.stats import spc

    r = spc.capability(table(spark, d, "lineitem"), "l_quantity", 10, 50)
    return _one_row(spark, pp=round(r["pp"], 8), ppk=round(r["ppk"], 8))


@query("pareto", "WITH g AS (SELECT p_brand AS category, count(*)::DOUBLE AS count FROM part GROUP BY 1) SELECT category, count, round(100 * sum(count) OVER (ORDER BY count DESC, category ROWS UNBOUNDED PRECEDING) / sum(count) OVER (), 8) AS cumulative FROM g")
def pareto(spark, d):
    from ashlar.stats import spc

    p = spc.pareto(table(spark, d, "part"), "p_brand")
    return p.withColumn("cumulative", F.round("cumulative", 8))


@query("kaplan_meier", """WITH t AS (SELECT p_size::DOUBLE AS t, count(*) FILTER (p_partkey % 4 <> 0) AS d, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS risk FROM t)
SELECT t AS time, risk::BIGINT AS risk, d AS events, round(CASE WHEN max(CASE WHEN d = risk THEN 1 ELSE 0 END) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN d < risk THEN ln(1 - d / risk) ELSE 0 END) OVER w) END, 8) AS survival FROM r WINDOW w AS (ORDER BY t ROWS UNBOUNDED PRECEDING) QUALIFY d > 0""")
def kaplan_meier(spark, d):
    from ashlar.stats import reliability

    p = table(spark, d, "part").select("p_size", F.when(_c("p_partkey") % 4 == 0, 1).otherwise(0).alias("c"))
    k = reliability.kaplan_meier(p, "p_size", "c")
    return k.select("time", "risk", "events", F.round("survival", 8).alias("survival"))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    from ashlar.streaming import events

    w = events.windowed(table(spark, d, "events"), "1 day")
    return w.select(F.to_timestamp_ntz(F.date_format("start", "yyyy-MM-dd HH:mm:ss")).alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


from ashlar.plans import models, ordered, statistics  # noqa: E402,F401  they register their queries here
