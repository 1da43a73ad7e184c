"""Registered statistics: each query calls a function of ``ashlar.stats``, its SQL works the statistic out by itself.

Probabilities of distributions are beyond SQL and are tested in ``tests/test_stats.py``; here are the statistics themselves.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ashlar.plans.catalog import query, table
from ashlar.stats import basic as B
from ashlar.stats import multivariate as M
from ashlar.stats import nonparam as N
from ashlar.stats import regression as R
from ashlar.stats import reliability as L
from ashlar.stats import spc as Q
from ashlar.stats import timeseries as T

_c = F.col


def numbers(spark, digits: int = 6, **values):
    """A one-row frame of doubles."""
    return spark.range(1).select(*[F.lit(round(float(v), digits)).alias(k) for k, v in values.items()])


def rows(spark, data: list[dict], ddl: str):
    return spark.createDataFrame([tuple(r.values()) for r in data], ddl)


def events(spark, d):
    return table(spark, d, "events")


def two(spark, d):
    """Events of two kinds."""
    return events(spark, d).filter(_c("event_type").isin("click", "view"))


#: n, mean and variance of the two kinds, as one row a (click) and one row b (view)
_AB = "WITH m AS (SELECT event_type AS g, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1), a AS (SELECT * FROM m WHERE g = 'click'), b AS (SELECT * FROM m WHERE g = 'view') "
_G = "WITH g AS (SELECT event_type AS g, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1) "


# -- means ------------------------------------------------------------------------------------------------------
@query("ttest_one", "SELECT round((avg(o_totalprice) - 150000) / (stddev_samp(o_totalprice) / sqrt(count(*))), 6) AS t, (count(*) - 1)::DOUBLE AS df, round(avg(o_totalprice), 6) AS estimate FROM orders")
def ttest_one(spark, d):
    r = B.ttest1(table(spark, d, "orders"), "o_totalprice", 150000)
    return numbers(spark, t=r["t"], df=r["df"], estimate=r["estimate"])


@query("ttest_paired", "SELECT round(avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))), 6) AS t, round(avg(l_discount - l_tax), 6) AS estimate FROM lineitem")
def ttest_paired(spark, d):
    r = B.ttest_paired(table(spark, d, "lineitem"), "l_discount", "l_tax")
    return numbers(spark, t=r["t"], estimate=r["estimate"])


@query("ttest_pooled", _AB + "SELECT round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)), 6) AS t, (a.n + b.n - 2)::DOUBLE AS df FROM a, b")
def ttest_pooled(spark, d):
    r = B.ttest2(two(spark, d), "value", "event_type", equal_var=True)
    return numbers(spark, t=r["t"], df=r["df"])


@query("ztest", "SELECT round((avg(value) - 10) / (3 / sqrt(count(*))), 6) AS z FROM events")
def ztest(spark, d):
    return numbers(spark, z=B.ztest1(events(spark, d), "value", 3, 10)["z"])


@query("welch_anova", _G + """, w AS (SELECT *, n / v AS w FROM g), s AS (SELECT sum(w) AS s, sum(w * m) / sum(w) AS gm, count(*) AS k FROM w),
 l AS (SELECT sum(power(1 - w / s, 2) / (n - 1)) AS l FROM w, s)
 SELECT round((SELECT sum(w * power(m - gm, 2)) FROM w, s) / (k - 1) / (1 + 2 * (k - 2) * l / (k * k - 1)), 6) AS f, round((k * k - 1) / (3 * l), 4) AS df2 FROM s, l""")
def welch_anova(spark, d):
    r = B.welch_anova(events(spark, d), "value", "event_type")
    return numbers(spark, 6, f=r["f"], df2=round(r["df2"], 4))


_MSW = ", w AS (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS msw FROM g) "
_PAIRS = "SELECT x.g AS a, y.g AS b, round(y.m - x.m, 6) AS difference, round({se}, 6) AS se FROM g x, g y{more} WHERE x.g < y.g"


def _pairs(spark, got):
    return rows(spark, [{"a": r["a"], "b": r["b"], "difference": round(r["difference"], 6), "se": round(r["se"], 6)} for r in got], "a string, b string, difference double, se double")


@query("tukey_hsd", _G + _MSW + _PAIRS.format(se="sqrt(msw / 2 * (1.0 / x.n + 1.0 / y.n))", more=", w"))
def tukey_hsd(spark, d):
    return _pairs(spark, B.tukey_hsd(events(spark, d), "value", "event_type"))


@query("fisher_lsd", _G + _MSW + _PAIRS.format(se="sqrt(msw * (1.0 / x.n + 1.0 / y.n))", more=", w"))
def fisher_lsd(spark, d):
    return _pairs(spark, B.fisher_lsd(events(spark, d), "value", "event_type"))


@query("games_howell", _G + _PAIRS.format(se="sqrt((x.v / x.n + y.v / y.n) / 2)", more=""))
def games_howell(spark, d):
    return _pairs(spark, B.games_howell(events(spark, d), "value", "event_type"))


# -- variances --------------------------------------------------------------------------------------------------
def _levene(centre: str) -> str:
    return f"""WITH c AS (SELECT event_type AS g, {centre}(value) AS c FROM events GROUP BY 1), z AS (SELECT g, abs(value - c) AS z FROM events JOIN c ON event_type = g),
 m AS (SELECT g, count(*) AS n, avg(z) AS m, var_samp(z) AS v FROM z GROUP BY 1), t AS (SELECT sum(n * m) / sum(n) AS gm, sum(n) AS n, count(*) AS k FROM m)
 SELECT round((SELECT sum(m.n * power(m.m - t.gm, 2)) FROM m, t) / (k - 1) / ((SELECT sum((n - 1) * v) FROM m) / (n - k)), 6) AS f FROM t"""


@query("levene_median", _levene("median"))
def levene_median(spark, d):
    return numbers(spark, f=B.levene(events(spark, d), "value", "event_type")["f"])


@query("levene_mean", _levene("avg"))
def levene_mean(spark, d):
    return numbers(spark, f=B.levene(events(spark, d), "value", "event_type", "mean")["f"])


@query("bartlett", _G + """, t AS (SELECT count(*) AS k, sum(n) AS n, sum((n - 1) * v) / (sum(n) - count(*)) AS p, sum((n - 1) * ln(v)) AS s, sum(1.0 / (n - 1)) AS r FROM g)
 SELECT round(((n - k) * ln(p) - s) / (1 + (r - 1.0 / (n - k)) / (3 * (k - 1))), 6) AS chi2, (k - 1)::DOUBLE AS df FROM t""")
def bartlett(spark, d):
    r = B.bartlett(events(spark, d), "value", "event_type")
    return numbers(spark, chi2=r["chi2"], df=r["df"])


@query("var_tests", _AB + "SELECT round(a.v / b.v, 6) AS f, (SELECT round((count(*) - 1) * var_samp(value) / 100, 6) FROM events) AS chi2 FROM a, b")
def var_tests(spark, d):
    return numbers(spark, f=B.var_test2(two(spark, d), "value", "event_type")["f"], chi2=B.var_test1(events(spark, d), "value", 10)["chi2"])


# -- counts -----------------------------------------------------------------------------------------------------
_CHI2 = """t AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {t} GROUP BY 1, 2), r AS (SELECT a, sum(n) AS r FROM t GROUP BY 1), c AS (SELECT b, sum(n) AS c FROM t GROUP BY 1), s AS (SELECT sum(n) AS s FROM t),
 x AS (SELECT sum(power(coalesce(n, 0) - r * c / s, 2) / (r * c / s)) AS chi2, (count(DISTINCT r.a) - 1) * (count(DISTINCT c.b) - 1) AS df, least(count(DISTINCT r.a), count(DISTINCT c.b)) - 1 AS k, any_value(s) AS s FROM r CROSS JOIN c CROSS JOIN s LEFT JOIN t ON t.a = r.a AND t.b = c.b)"""


@query("chi2_independence", "WITH " + _CHI2.format(a="c_mktsegment", b="c_nationkey::VARCHAR", t="customer") + " SELECT round(chi2, 6) AS chi2, df::DOUBLE AS df, round(sqrt(chi2 / s / k), 6) AS cramers_v FROM x")
def chi2_independence(spark, d):
    r = B.chi2_test(B.crosstab(table(spark, d, "customer"), "c_mktsegment", "c_nationkey")["table"])
    return numbers(spark, chi2=r["chi2"], df=r["df"], cramers_v=r["cramers_v"])


@query("crosstab", "SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2")
def crosstab(spark, d):
    t = B.crosstab(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    cells = [{"a": a, "b": b, "n": float(t["table"][i, j])} for i, a in enumerate(t["rows"]) for j, b in enumerate(t["columns"]) if t["table"][i, j]]
    return rows(spark, cells, "a string, b string, n double")


@query("chi2_gof", "WITH t AS (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus), s AS (SELECT sum(n) / count(*) AS e FROM t) SELECT round(sum(power(n - e, 2) / e), 6) AS chi2, (count(*) - 1)::DOUBLE AS df FROM t, s")
def chi2_gof(spark, d):
    r = B.chi2_gof([x["count"] for x in table(spark, d, "orders").groupBy("o_orderstatus").count().collect()])  # a row a status
    return numbers(spark, chi2=r["chi2"], df=r["df"])


def _flags(spark, d):
    li = table(spark, d, "lineitem")
    return li.select((_c("l_quantity") > 25).cast("int").alias("a"), (_c("l_discount") > 0.05).cast("int").alias("b"), (_c("l_tax") > 0.04).cast("int").alias("c"))


_F3 = "f AS (SELECT (l_quantity > 25)::INT AS a, (l_discount > 0.05)::INT AS b, (l_tax > 0.04)::INT AS c FROM lineitem)"


@query("cochran_q", "WITH " + _F3 + """, s AS (SELECT sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(power(a + b + c, 2)) AS q FROM f)
 SELECT round(2 * (3 * (a * a + b * b + c * c) - power(a + b + c, 2)) / (3 * (a + b + c) - q), 6) AS q FROM s""")
def cochran_q(spark, d):
    return numbers(spark, q=B.cochran_q(_flags(spark, d), ["a", "b", "c"])["q"])


@query("mcnemar", "WITH " + _F3 + ", s AS (SELECT count(*) FILTER (a = 1 AND b = 0) AS x, count(*) FILTER (a = 0 AND b = 1) AS y FROM f) SELECT round(power(abs(x - y) - 1, 2) / (x + y), 6) AS statistic FROM s")
def mcnemar(spark, d):
    t = B.crosstab(_flags(spark, d), "a", "b")["table"]
    return numbers(spark, statistic=B.mcnemar(int(t[1, 0]), int(t[0, 1]), exact=False)["statistic"])


@query("bowker", """WITH p AS (SELECT least(p_size // 17, 2) AS a, least((p_partkey % 50) // 17, 2) AS b FROM part), t AS (SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2)
 SELECT round(sum(power(x.n - coalesce(y.n, 0), 2) / (x.n + coalesce(y.n, 0))), 6) AS chi2 FROM (SELECT i.a, j.b, coalesce(t.n, 0) AS n FROM (SELECT unnest([0, 1, 2]) AS a) i CROSS JOIN (SELECT unnest([0, 1, 2]) AS b) j LEFT JOIN t ON t.a = i.a AND t.b = j.b) x
 LEFT JOIN t y ON y.a = x.b AND y.b = x.a WHERE x.a > x.b AND x.n + coalesce(y.n, 0) > 0""")
def bowker(spark, d):
    p = table(spark, d, "part").select(F.least(F.floor(_c("p_size") / 17), F.lit(2)).alias("a"), F.least(F.floor((_c("p_partkey") % 50) / 17), F.lit(2)).alias("b"))
    return numbers(spark, chi2=B.bowker(B.crosstab(p, "a", "b")["table"])["chi2"])


_EN = "e AS (SELECT count(*) FILTER (l_returnflag = 'R' AND l_quantity > 25)::DOUBLE AS e1, count(*) FILTER (l_returnflag = 'R')::DOUBLE AS n1, count(*) FILTER (l_returnflag <> 'R' AND l_quantity > 25)::DOUBLE AS e2, count(*) FILTER (l_returnflag <> 'R')::DOUBLE AS n2 FROM lineitem)"


def _en(spark, d):
    big, back = _c("l_quantity") > 25, _c("l_returnflag") == "R"
    return tuple(table(spark, d, "lineitem").agg(F.count_if(big & back), F.count_if(back), F.count_if(big & ~back), F.count_if(~back)).first())


@query("prop_tests", "WITH " + _EN + " SELECT round((e1 / n1 - 0.5) / sqrt(0.25 / n1), 6) AS z1, round((e1 / n1 - e2 / n2) / sqrt((e1 + e2) / (n1 + n2) * (1 - (e1 + e2) / (n1 + n2)) * (1 / n1 + 1 / n2)), 6) AS z2 FROM e")
def prop_tests(spark, d):
    e1, n1, e2, n2 = _en(spark, d)
    return numbers(spark, z1=B.prop_test1(e1, n1, method="normal")["z"], z2=B.prop_test2(e1, n1, e2, n2)["z"])


_W = "({e} / {n} + 1.959963984540054 * 1.959963984540054 / (2 * {n}) {s} 1.959963984540054 * sqrt({e} / {n} * (1 - {e} / {n}) / {n} + 1.959963984540054 * 1.959963984540054 / (4 * {n} * {n}))) / (1 + 1.959963984540054 * 1.959963984540054 / {n})"


@query("proportion_intervals", "WITH " + _EN + f", w AS (SELECT *, {_W.format(e='e1', n='n1', s='-')} AS l1, {_W.format(e='e1', n='n1', s='+')} AS u1, {_W.format(e='e2', n='n2', s='-')} AS l2, {_W.format(e='e2', n='n2', s='+')} AS u2 FROM e) SELECT round(l1, 6) AS wilson_low, round(u1, 6) AS wilson_high, round(e1 / n1 - e2 / n2 - sqrt(power(e1 / n1 - l1, 2) + power(u2 - e2 / n2, 2)), 6) AS newcombe_low, round(e1 / n1 - e2 / n2 + sqrt(power(u1 - e1 / n1, 2) + power(e2 / n2 - l2, 2)), 6) AS newcombe_high FROM w")
def proportion_intervals(spark, d):
    e1, n1, e2, n2 = _en(spark, d)
    w, n = B.wilson_interval(e1, n1), B.newcombe_interval(e1, n1, e2, n2)
    return numbers(spark, wilson_low=w[0], wilson_high=w[1], newcombe_low=n[0], newcombe_high=n[1])


# -- association, effect size ------------------------------------------------------------------------------------
@query("corr_pearson", "SELECT round(r, 6) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 4) AS t FROM (SELECT corr(l_extendedprice, l_quantity) AS r, count(*) AS n FROM lineitem)")
def corr_pearson(spark, d):
    r = B.corr_test(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity")
    return numbers(spark, r=r["r"], t=round(r["t"], 4))


_AVG_RANK = "(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0)"


@query("corr_spearman", f"SELECT round(corr(a, b), 6) AS r FROM (SELECT {_AVG_RANK.format(x='p_retailprice')} AS a, {_AVG_RANK.format(x='p_size')} AS b FROM part)")
def corr_spearman(spark, d):
    return numbers(spark, r=B.corr_test(table(spark, d, "part"), "p_retailprice", "p_size", "spearman")["r"])


@query("kendall_tau", """WITH s AS (SELECT s_acctbal AS x, s_nationkey AS y, s_suppkey AS i FROM supplier), p AS (SELECT sign(a.x - b.x) AS dx, sign(a.y - b.y) AS dy FROM s a JOIN s b ON a.i > b.i)
 SELECT round(sum(dx * dy) / sqrt(count(*) FILTER (dx <> 0) * count(*) FILTER (dy <> 0)::DOUBLE), 6) AS tau FROM p""")
def kendall_tau(spark, d):
    return numbers(spark, tau=B.kendall(table(spark, d, "supplier"), "s_acctbal", "s_nationkey")["tau"])


@query("partial_corr", """WITH r AS (SELECT corr(l_extendedprice, l_tax) AS xy, corr(l_extendedprice, l_quantity) AS xz, corr(l_tax, l_quantity) AS yz FROM lineitem) SELECT round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS r FROM r""")
def partial_corr(spark, d):
    return numbers(spark, r=B.partial_corr(table(spark, d, "lineitem"), "l_extendedprice", "l_tax", ["l_quantity"])["r"])


@query("grubbs", "WITH m AS (SELECT max(value) AS hi, min(value) AS lo, avg(value) AS m, stddev_samp(value) AS s FROM events) SELECT round(greatest(hi - m, m - lo) / s, 6) AS g, round(CASE WHEN hi - m >= m - lo THEN hi ELSE lo END, 6) AS outlier FROM m")
def grubbs(spark, d):
    r = B.grubbs(events(spark, d), "value")
    return numbers(spark, g=r["g"], outlier=r["outlier"])


@query("effect_sizes", _AB + ", s AS (SELECT a.m - b.m AS d, sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS p, sqrt(b.v) AS sb, (a.n + b.n - 2)::DOUBLE AS k FROM a, b) SELECT round(d / p, 6) AS cohen, round(d / p * exp(lgamma(k / 2) - lgamma((k - 1) / 2)) / sqrt(k / 2), 6) AS hedges, round(d / sb, 6) AS glass FROM s")
def effect_sizes(spark, d):
    e = two(spark, d)
    return numbers(spark, cohen=B.cohens_d(e, "value", "event_type"), hedges=B.hedges_g(e, "value", "event_type"), glass=B.glass_delta(e, "value", "event_type"))


# -- description -------------------------------------------------------------------------------------------------
_T6 = "(SELECT v[greatest(1, least(n, floor(({q}) * (n + 1))::BIGINT))] + (v[greatest(1, least(n, floor(({q}) * (n + 1))::BIGINT + 1))] - v[greatest(1, least(n, floor(({q}) * (n + 1))::BIGINT))]) * greatest(0, least(1, ({q}) * (n + 1) - floor(({q}) * (n + 1)))))"
_DESC = "WITH l AS (SELECT event_type AS g, count(*) AS n, avg(value) AS m, stddev_samp(value) AS s, list_sort(list(value)) AS v FROM events GROUP BY 1), q AS (SELECT *, " + ", ".join(f"{_T6.format(q=p)} AS q{i}" for i, p in ((1, 0.25), (2, 0.5), (3, 0.75))) + " FROM l) "


@query("descriptive_stats", _DESC + "SELECT g AS \"group\", n::DOUBLE AS n, round(m, 6) AS mean, round(s / sqrt(n), 6) AS se, round(100 * s / m, 6) AS cv, round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3 FROM q")
def descriptive_stats(spark, d):
    got = B.descriptive_stats(events(spark, d), "value", "event_type")
    return rows(spark, [{"group": r["group"], "n": float(r["n"])} | {k: round(r[k], 6) for k in ("mean", "se", "cv", "q1", "median", "q3")} for r in got], "group string, n double, mean double, se double, cv double, q1 double, median double, q3 double")


@query("boxplot_stats", _DESC + ", b AS (SELECT *, list_filter(v, lambda x: x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)) AS i FROM q) SELECT g AS \"group\", round(list_min(i), 6) AS low, round(list_max(i), 6) AS high, (n - len(i))::DOUBLE AS outliers FROM b")
def boxplot_stats(spark, d):
    got = B.boxplot_stats(events(spark, d), "value", "event_type")
    return rows(spark, [{"group": r["group"], "low": round(r["low"], 6), "high": round(r["high"], 6), "outliers": float(r["outliers"])} for r in got], "group string, low double, high double, outliers double")


@query("histogram_bins", "WITH m AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 12 AS w FROM orders), b AS (SELECT least(floor((o_totalprice - lo) / w), 11)::INT AS b, count(*) AS n FROM orders, m GROUP BY 1) SELECT round(lo + i * w, 4) AS low, coalesce(n, 0)::DOUBLE AS count FROM (SELECT unnest(range(12)) AS i) CROSS JOIN m LEFT JOIN b ON b = i")
def histogram_bins(spark, d):
    got = B.histogram_bins(table(spark, d, "orders"), "o_totalprice", 12)
    return rows(spark, [{"low": round(r["low"], 4), "count": float(r["count"])} for r in got], "low double, count double")


@query("ecdf", "SELECT p_size::DOUBLE AS x, round(sum(count(*)) OVER (ORDER BY p_size) / sum(count(*)) OVER (), 8) AS p FROM part GROUP BY p_size")
def ecdf(spark, d):
    return B.ecdf(table(spark, d, "part"), "p_size").select("x", F.round("p", 8).alias("p"))


@query("anova_two_way", """WITH c AS (SELECT c_mktsegment AS a, n_regionkey AS b, avg(c_acctbal) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), g AS (SELECT avg(m) AS g, count(DISTINCT a) AS p, count(DISTINCT b) AS q FROM c),
 s AS (SELECT (SELECT sum(power(ma - g, 2)) * any_value(q) FROM (SELECT a, avg(m) AS ma FROM c GROUP BY 1), g) AS sa, (SELECT sum(power(mb - g, 2)) * any_value(p) FROM (SELECT b, avg(m) AS mb FROM c GROUP BY 1), g) AS sb, (SELECT sum(power(m - g, 2)) FROM c, g) AS st)
 SELECT round(sa / (p - 1) / ((st - sa - sb) / ((p - 1) * (q - 1))), 6) AS fa, round(sb / (q - 1) / ((st - sa - sb) / ((p - 1) * (q - 1))), 6) AS fb FROM s, g""")
def anova_two_way(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), _c("c_nationkey") == _c("n_nationkey")).groupBy("c_mktsegment", "n_regionkey").agg(F.avg("c_acctbal").alias("m"))
    r = B.anova_two_way(c, "m", "c_mktsegment", "n_regionkey")
    return numbers(spark, fa=r["a"]["f"], fb=r["b"]["f"])


# -- ranks -------------------------------------------------------------------------------------------------------
@query("mood_median", "WITH m AS (SELECT median(value) AS m FROM events), e AS (SELECT event_type, value > m AS up FROM events, m), " + _CHI2.format(a="event_type", b="up", t="e") + " SELECT round(chi2, 6) AS chi2, (SELECT round(m, 6) FROM m) AS median FROM x")
def mood_median(spark, d):
    r = N.mood_median(events(spark, d), "value", "event_type")
    return numbers(spark, chi2=r["chi2"], median=r["median"])


@query("sign_test", "SELECT count(*) FILTER (s_acctbal > 4000)::DOUBLE AS above, count(*) FILTER (s_acctbal < 4000)::DOUBLE AS below FROM supplier")
def sign_test(spark, d):
    r = N.sign_test(table(spark, d, "supplier"), "s_acctbal", 4000)
    return numbers(spark, above=r["above"], below=r["below"])


@query("wilcoxon_signed", "WITH a AS (SELECT c_acctbal - 4500 AS d FROM customer WHERE c_acctbal <> 4500), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM a) SELECT round(sum(r) FILTER (d > 0), 3) AS w, count(*)::DOUBLE AS n FROM r")
def wilcoxon_signed(spark, d):
    r = N.wilcoxon_signed(table(spark, d, "customer"), "c_acctbal", 4500)
    return numbers(spark, 3, w=r["w"], n=r["n"])


@query("friedman", """WITH c AS (SELECT c_mktsegment AS t, c_nationkey AS b, avg(c_acctbal) AS x FROM customer GROUP BY 1, 2), f AS (SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY b) = (SELECT count(DISTINCT t) FROM c)), r AS (SELECT t, b, rank() OVER (PARTITION BY b ORDER BY x) AS r FROM f),
 g AS (SELECT t, sum(r) AS s FROM r GROUP BY 1), n AS (SELECT count(DISTINCT b) AS n, count(DISTINCT t) AS k FROM r) SELECT round(12.0 / (n * k * (k + 1)) * (SELECT sum(s * s) FROM g) - 3 * n * (k + 1), 6) AS s FROM n""")
def friedman(spark, d):
    c = table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.avg("c_acctbal").alias("x"))
    k = c.select("c_mktsegment").distinct().count()
    whole = c.groupBy("c_nationkey").count().filter(_c("count") == k).select("c_nationkey")
    return numbers(spark, s=N.friedman(c.join(whole, "c_nationkey"), "x", "c_mktsegment", "c_nationkey")["s"])


@query("runs_test", """WITH m AS (SELECT avg(value) AS m FROM events), u AS (SELECT value > m AS up, lag(value > m) OVER (ORDER BY event_id) AS before FROM events, m) SELECT (1 + count(*) FILTER (up <> before))::DOUBLE AS runs, count(*) FILTER (up)::DOUBLE AS above FROM u""")
def runs_test(spark, d):
    r = N.runs_test(events(spark, d), "value", "event_id")
    return numbers(spark, runs=r["runs"], above=r["above"])


@query("ks_two_sample", """WITH c AS (SELECT value AS x, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b FROM events WHERE event_type IN ('click', 'view') GROUP BY 1), s AS (SELECT sum(a) AS na, sum(b) AS nb FROM c),
 r AS (SELECT sum(a) OVER w / na - sum(b) OVER w / nb AS d FROM c, s WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING)) SELECT round(max(abs(d)), 8) AS d FROM r""")
def ks_two_sample(spark, d):
    return numbers(spark, 8, d=N.ks_two_sample(two(spark, d), "value", "event_type")["d"])


@query("jarque_bera", "WITH m AS (SELECT avg(c_acctbal) AS m FROM customer), k AS (SELECT count(*) AS n, avg(power(c_acctbal - m, 2)) AS m2, avg(power(c_acctbal - m, 3)) AS m3, avg(power(c_acctbal - m, 4)) AS m4 FROM customer, m) SELECT round(n / 6.0 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4), 5) AS jb FROM k")
def jarque_bera(spark, d):
    return numbers(spark, 5, jb=N.jarque_bera(table(spark, d, "customer"), "c_acctbal")["jb"])


@query("brunner_munzel", f"""WITH e AS (SELECT event_type AS g, value AS x FROM events WHERE event_type IN ('click', 'view')), r AS (SELECT g, {_AVG_RANK.format(x='x')} AS r, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS q FROM e),
 s AS (SELECT g, count(*) AS n, avg(r) AS m, var_samp(r - q) AS v FROM r GROUP BY 1) SELECT round(a.n * b.n * (b.m - a.m) / ((a.n + b.n) * sqrt(a.n * a.v + b.n * b.v)), 6) AS statistic FROM s a, s b WHERE a.g < b.g""")
def brunner_munzel(spark, d):
    return numbers(spark, statistic=N.brunner_munzel(two(spark, d), "value", "event_type")["statistic"])


# -- regression --------------------------------------------------------------------------------------------------
#: two regressors by Cramer's rule on centred sums
_OLS2 = """WITH s AS (SELECT avg({y}) AS my, avg({a}) AS ma, avg({b}) AS mb, covar_pop({a}, {a}) AS aa, covar_pop({b}, {b}) AS bb, covar_pop({a}, {b}) AS ab, covar_pop({a}, {y}) AS ay, covar_pop({b}, {y}) AS by_, covar_pop({y}, {y}) AS yy, count(*) AS n FROM {t}),
 c AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ca, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM s) """


def _terms(r) -> dict:
    return {x["term"]: x["estimate"] for x in r["coefficients"]}


@query("ols_two", _OLS2.format(y="l_extendedprice", a="l_quantity", b="l_tax", t="lineitem") + "SELECT round(my - ca * ma - cb * mb, 3) AS intercept, round(ca, 5) AS a, round(cb, 3) AS b, round((ca * ay + cb * by_) / yy, 8) AS r2 FROM c")
def ols_two(spark, d):
    r = R.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_tax"])
    c = _terms(r)
    return numbers(spark, 8, intercept=round(c["(intercept)"], 3), a=round(c["l_quantity"], 5), b=round(c["l_tax"], 3), r2=r["r_squared"])


@query("fitted_line_quadratic", "WITH p AS (SELECT p_retailprice AS y, p_size::DOUBLE AS a, power(p_size, 2)::DOUBLE AS b FROM part), " + _OLS2.format(y="y", a="a", b="b", t="p")[5:] + "SELECT round(ca, 5) AS a, round(cb, 6) AS b, round((ca * ay + cb * by_) / yy, 8) AS r2 FROM c")
def fitted_line_quadratic(spark, d):
    r = R.fitted_line(table(spark, d, "part"), "p_retailprice", "p_size", 2)
    c = _terms(r)
    return numbers(spark, 8, a=round(c["p_size"], 5), b=round(c["p_size^2"], 6), r2=r["r_squared"])


@query("ols_predict", "SELECT o_orderkey, round(o_totalprice * s.b + s.a, 4) AS prediction FROM orders, (SELECT regr_slope(o_custkey, o_totalprice) AS b, regr_intercept(o_custkey, o_totalprice) AS a FROM orders) s")
def ols_predict(spark, d):
    o = table(spark, d, "orders")
    return R.predict(o, R.ols(o, "o_custkey", ["o_totalprice"])).select("o_orderkey", F.round("prediction", 4).alias("prediction"))


@query("ridge_lasso", "WITH s AS (SELECT covar_pop(l_quantity, l_extendedprice) / stddev_pop(l_quantity) AS c, stddev_pop(l_quantity) AS sx FROM lineitem) SELECT round(c / 1.5 / sx, 4) AS ridge, round(sign(c) * greatest(abs(c) - 100, 0) / sx, 4) AS lasso, round(sign(c) * greatest(abs(c) - 50, 0) / 1.5 / sx, 4) AS net FROM s")
def ridge_lasso(spark, d):
    li, x = table(spark, d, "lineitem"), ["l_quantity"]
    slope = lambda r: _terms(r)["l_quantity"]
    return numbers(spark, 4, ridge=slope(R.ridge(li, "l_extendedprice", x, 0.5)), lasso=slope(R.lasso(li, "l_extendedprice", x, 100.0)), net=_net(R, li, x))


def _net(R, li, x):
    # penalty lam * alpha = 50 and lam * (1 - alpha) = 0.5
    lam, alpha = 50.5, 50 / 50.5
    return _terms(R.elastic_net(li, "l_extendedprice", x, lam, alpha))["l_quantity"]


@query("logistic_binary", """WITH t AS (SELECT (l_quantity > 25)::INT AS x, (l_returnflag = 'R')::INT AS y FROM lineitem), g AS (SELECT ln(avg(y) FILTER (x = 0) / (1 - avg(y) FILTER (x = 0))) AS a, ln(avg(y) FILTER (x = 1) / (1 - avg(y) FILTER (x = 1))) AS b FROM t) SELECT round(a, 6) AS intercept, round(b - a, 6) AS slope FROM g""")
def logistic_binary(spark, d):
    t = table(spark, d, "lineitem").select((_c("l_quantity") > 25).cast("int").alias("x"), (_c("l_returnflag") == "R").cast("int").alias("y"))
    c = _terms(R.logistic(t, "y", ["x"]))
    return numbers(spark, intercept=c["(intercept)"], slope=c["x"])


@query("poisson_regression", "SELECT round(ln(avg(l_linenumber) FILTER (l_tax <= 0.04)), 6) AS intercept, round(ln(avg(l_linenumber) FILTER (l_tax > 0.04) / avg(l_linenumber) FILTER (l_tax <= 0.04)), 6) AS slope FROM lineitem")
def poisson_regression(spark, d):
    t = table(spark, d, "lineitem").select((_c("l_tax") > 0.04).cast("int").alias("x"), "l_linenumber")
    c = _terms(R.poisson_regression(t, "l_linenumber", ["x"]))
    return numbers(spark, intercept=c["(intercept)"], slope=c["x"])


@query("orthogonal_regression", "WITH s AS (SELECT var_samp(p_size) AS xx, var_samp(p_retailprice) AS yy, covar_samp(p_size, p_retailprice) AS xy FROM part) SELECT round((yy - xx + sqrt(power(yy - xx, 2) + 4 * xy * xy)) / (2 * xy), 3) AS slope FROM s")
def orthogonal_regression(spark, d):
    return numbers(spark, 3, slope=R.orthogonal_regression(table(spark, d, "part"), "p_retailprice", "p_size")["slope"])


@query("best_subsets", """WITH s AS (SELECT power(corr(l_extendedprice, l_quantity), 2) AS a, power(corr(l_extendedprice, l_tax), 2) AS b, count(*) AS n FROM lineitem), """ + _OLS2.format(y="l_extendedprice", a="l_quantity", b="l_tax", t="lineitem")[5:].replace("s AS (", "s2 AS (").replace("FROM s)", "FROM s2)") + """
 SELECT 'l_quantity' AS terms, round(a, 8) AS r2 FROM s UNION ALL SELECT 'l_tax', round(b, 8) FROM s UNION ALL SELECT 'l_quantity+l_tax', round((ca * ay + cb * by_) / yy, 8) FROM c""")
def best_subsets(spark, d):
    got = R.best_subsets(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_tax"])
    return rows(spark, [{"terms": "+".join(r["terms"]), "r2": round(float(r["r_squared"]), 8)} for r in got], "terms string, r2 double")


# -- series ------------------------------------------------------------------------------------------------------
_DAILY = "s AS (SELECT o_orderdate AS o, sum(o_totalprice) AS x, row_number() OVER (ORDER BY o_orderdate) AS i FROM orders GROUP BY 1)"


def daily(spark, d):
    return table(spark, d, "orders").groupBy("o_orderdate").agg(F.sum("o_totalprice").alias("x"))


_ACF = "WITH " + _DAILY + ", m AS (SELECT avg(x) AS m, var_pop(x) * count(*) AS c0, count(*) AS n FROM s), a AS (SELECT k, sum((p.x - m) * (q.x - m)) / any_value(c0) AS acf, any_value(n) AS n FROM s p CROSS JOIN (SELECT unnest(range(1, 6)) AS k) JOIN s q ON q.i = p.i + k CROSS JOIN m GROUP BY 1) "


@query("acf", _ACF + "SELECT k::DOUBLE AS lag, round(acf, 8) AS acf FROM a")
def acf(spark, d):
    return rows(spark, [{"lag": float(r["lag"]), "acf": round(r["acf"], 8)} for r in T.acf(daily(spark, d), "x", "o_orderdate", 5)], "lag double, acf double")


@query("pacf", _ACF + "SELECT 1::DOUBLE AS lag, round(acf, 8) AS pacf FROM a WHERE k = 1 UNION ALL SELECT 2, round((b.acf - a.acf * a.acf) / (1 - a.acf * a.acf), 8) FROM a JOIN a b ON a.k = 1 AND b.k = 2")
def pacf(spark, d):
    return rows(spark, [{"lag": float(r["lag"]), "pacf": round(r["pacf"], 8)} for r in T.pacf(daily(spark, d), "x", "o_orderdate", 2)], "lag double, pacf double")


@query("ljung_box", _ACF + "SELECT round(any_value(n) * (any_value(n) + 2) * sum(acf * acf / (n - k)), 6) AS q FROM a")
def ljung_box(spark, d):
    return numbers(spark, q=T.ljung_box(daily(spark, d), "x", "o_orderdate", 5)["q"])


@query("ccf", "WITH s AS (SELECT o_orderdate AS o, sum(o_totalprice) AS x, count(*)::DOUBLE AS y, row_number() OVER (ORDER BY o_orderdate) AS i FROM orders GROUP BY 1), m AS (SELECT avg(x) AS mx, avg(y) AS my, sqrt(var_pop(x) * var_pop(y)) * count(*) AS d FROM s) SELECT k::DOUBLE AS lag, round(sum((p.x - mx) * (q.y - my)) / any_value(d), 8) AS ccf FROM s p CROSS JOIN (SELECT unnest(range(-2, 3)) AS k) JOIN s q ON q.i = p.i + k CROSS JOIN m GROUP BY 1")
def ccf(spark, d):
    s = table(spark, d, "orders").groupBy("o_orderdate").agg(F.sum("o_totalprice").alias("x"), F.count(F.lit(1)).cast("double").alias("y"))
    return rows(spark, [{"lag": float(r["lag"]), "ccf": round(r["ccf"], 8)} for r in T.ccf(s, "x", "y", "o_orderdate", 2)], "lag double, ccf double")


@query("trend_analysis", "WITH " + _DAILY + " SELECT round(regr_slope(x, i), 4) AS slope, round(regr_intercept(x, i), 2) AS intercept FROM s")
def trend_analysis(spark, d):
    c = _terms(T.trend_analysis(daily(spark, d), "x", "o_orderdate")["model"])
    return numbers(spark, 4, slope=c["t"], intercept=round(c["(intercept)"], 2))


@query("kpss", "WITH " + _DAILY + ", m AS (SELECT avg(x) AS m, count(*) AS n, var_pop(x) AS v FROM s), c AS (SELECT sum(x - m) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS c FROM s, m) SELECT round(sum(c * c) / any_value(n * n) / any_value(v), 6) AS statistic FROM c, m")
def kpss(spark, d):
    return numbers(spark, statistic=T.kpss_test(daily(spark, d), "x", "o_orderdate", 0)["statistic"])


@query("periodogram", "WITH " + _DAILY + ", m AS (SELECT avg(x) AS m, count(*) AS n FROM s) SELECT round(k::DOUBLE / any_value(n), 10) AS frequency, round((power(sum((x - m) * cos(2 * pi() * k * (i - 1) / n)), 2) + power(sum((x - m) * sin(2 * pi() * k * (i - 1) / n)), 2)) / any_value(n) / 1e9, 5) AS power FROM s, m, (SELECT unnest(range(1, 8)) AS k) GROUP BY k")
def periodogram(spark, d):
    got = T.periodogram(daily(spark, d), "x", "o_orderdate")[:7]
    return rows(spark, [{"frequency": round(r["frequency"], 10), "power": round(r["power"] / 1e9, 5)} for r in got], "frequency double, power double")


@query("moving_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 3 PRECEDING), 8) AS ma FROM events")
def moving_average(spark, d):
    e = events(spark, d).withColumn("o", F.struct("ts", "event_id"))
    return T.moving_average(e, "value", "o", 4, by=["user_id"]).select("event_id", F.round("ma", 8).alias("ma"))


# -- quality -----------------------------------------------------------------------------------------------------
@query("imr_limits", "WITH " + _DAILY + ", r AS (SELECT x, abs(x - lag(x) OVER (ORDER BY i)) AS r FROM s) SELECT round(avg(x), 3) AS centre, round(avg(r) / 1.128, 3) AS sigma FROM r")
def imr_limits(spark, d):
    r = Q.imr_chart(daily(spark, d), "x", "o_orderdate")
    return numbers(spark, 3, centre=r["centre"], sigma=r["sigma"])


@query("gage_type1", "SELECT round(avg(l_quantity) - 25, 6) AS bias, round((avg(l_quantity) - 25) / (stddev_samp(l_quantity) / sqrt(count(*))), 6) AS t FROM lineitem")
def gage_type1(spark, d):
    r = Q.gage_type1(table(spark, d, "lineitem"), "l_quantity", 25, 50)
    return numbers(spark, bias=r["bias"], t=r["t"])


@query("capability_target", "WITH m AS (SELECT avg(l_quantity) AS m, var_samp(l_quantity) AS v, 1e6 * avg((l_quantity < 5 OR l_quantity > 48)::INT) AS ppm FROM lineitem) SELECT round(43 / (6 * sqrt(v + power(m - 25, 2))), 8) AS cpm, round((48 - m) / (3 * sqrt(v)), 8) AS ppu, round((m - 5) / (3 * sqrt(v)), 8) AS ppl, round(ppm, 4) AS ppm FROM m")
def capability_target(spark, d):
    r = Q.capability(table(spark, d, "lineitem"), "l_quantity", 5, 48, 25)
    return numbers(spark, 8, cpm=r["cpm"], ppu=r["ppu"], ppl=r["ppl"], ppm=round(r["ppm_observed"], 4))


# -- reliability, multivariate ------------------------------------------------------------------------------------
@query("exponential_fit", "SELECT round(sum(p_size)::DOUBLE / count(*) FILTER (p_partkey % 4 <> 0), 8) AS mean FROM part")
def exponential_fit(spark, d):
    p = table(spark, d, "part").select("p_size", F.when(_c("p_partkey") % 4 == 0, 1).otherwise(0).alias("c"))
    return numbers(spark, 8, mean=L.exponential_fit(p, "p_size", "c")["mean"])


@query("log_rank", """WITH p AS (SELECT p_size AS t, p_partkey % 4 <> 0 AS e, p_partkey % 3 = 0 AS g FROM part), t AS (SELECT t, count(*) FILTER (e) AS d, count(*) FILTER (e AND g) AS d1, count(*) AS n, count(*) FILTER (g) AS n1 FROM p GROUP BY 1),
 r AS (SELECT t, d, d1, sum(n) OVER w AS n, sum(n1) OVER w AS n1 FROM t WINDOW w AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT round(power(sum(d1 - n1 * d / n), 2) / sum(CASE WHEN n > 1 THEN d * (n - d) / (n - 1) * (n1 / n) * (1 - n1 / n) ELSE 0 END), 6) AS chi2 FROM r""")
def log_rank(spark, d):
    p = table(spark, d, "part").select("p_size", F.when(_c("p_partkey") % 4 == 0, 1).otherwise(0).alias("c"), (_c("p_partkey") % 3 == 0).alias("g"))
    return numbers(spark, chi2=L.log_rank(p, "p_size", "c", "g")["chi2"])


@query("pca_two", "SELECT round(1 + abs(corr(l_extendedprice, l_quantity)), 8) AS first, round(1 - abs(corr(l_extendedprice, l_quantity)), 8) AS second FROM lineitem")
def pca_two(spark, d):
    v = sorted(map(float, M.pca(table(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"])["eigenvalues"]), reverse=True)
    return numbers(spark, 8, first=v[0], second=v[1])


@query("mahalanobis", "WITH s AS (SELECT avg(p_size) AS ma, avg(p_retailprice) AS mb, var_samp(p_size) AS aa, var_samp(p_retailprice) AS bb, covar_samp(p_size, p_retailprice) AS ab FROM part) SELECT p_partkey, round((bb * power(p_size - ma, 2) - 2 * ab * (p_size - ma) * (p_retailprice - mb) + aa * power(p_retailprice - mb, 2)) / (aa * bb - ab * ab), 6) AS d2 FROM part, s")
def mahalanobis(spark, d):
    return M.mahalanobis(table(spark, d, "part"), ["p_size", "p_retailprice"]).select("p_partkey", F.round("d2", 6).alias("d2"))


@query("item_analysis", "SELECT round(1.5 * (1 - (var_samp(l_quantity) + var_samp(l_discount * 100) + var_samp(l_tax * 100)) / var_samp(l_quantity + l_discount * 100 + l_tax * 100)), 6) AS alpha FROM lineitem")
def item_analysis(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", (_c("l_discount") * 100).alias("b"), (_c("l_tax") * 100).alias("c"))
    return numbers(spark, alpha=M.item_analysis(li, ["l_quantity", "b", "c"])["alpha"])


@query("correspondence", "WITH " + _CHI2.format(a="c_mktsegment", b="c_nationkey::VARCHAR", t="customer") + " SELECT round(chi2 / s, 8) AS inertia FROM x")
def correspondence(spark, d):
    return numbers(spark, 8, inertia=sum(map(float, M.correspondence(table(spark, d, "customer"), "c_mktsegment", "c_nationkey")["inertia"])))
