"""Linear models, scale tests, series, processes, responses, life data and studies against closed forms and plain numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ashlar.stats import basic, life, linear, process, regression, reliability, response, scale, series, spc, studies
from ashlar.stats import dist as D


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(7)
    rows = []
    for i in range(240):
        a, b = "abc"[r.integers(3)], "uv"[r.integers(2)]
        x = float(r.normal())
        y = {"a": 0.0, "b": 1.0, "c": -0.5}[a] + (0.7 if b == "u" else 0) + 2 * x + float(r.normal())
        rows.append((i, a, b, x, y, float(r.gamma(2.0, 3.0)), f"g{i % 12}"))
    return rows


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame([*data, (999, None, "u", 1.0, 2.0, 1.0, "g0")], "i long, a string, b string, x double, y double, w double, g string").repartition(4).cache()


def design(data, terms):
    """Sum-to-zero coding by hand."""
    def eff(v, levels):
        return [1.0 if v == q else -1.0 if v == levels[-1] else 0.0 for q in levels[:-1]]

    out = []
    for _, a, b, x, *_ in data:
        ea, eb = eff(a, "abc"), eff(b, "uv")
        parts = {"a": ea, "b": eb, "x": [x], "a:b": [p * q for p in ea for q in eb]}
        out.append([1.0, *[v for t in terms for v in parts[t]]])
    return np.array(out)


def rss(m, y):
    return float(((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum())


# -- linear models ----------------------------------------------------------------------------------------------
def test_formula():
    f = linear.parse_formula("y ~ a*b + x - 1")
    assert f["terms"] == [("a",), ("b",), ("x",), ("a", "b")] and not f["intercept"]
    assert linear.parse_formula("y ~ a*b - a:b")["terms"] == [("a",), ("b",)]
    with pytest.raises(ValueError):
        linear.parse_formula("a + b")


def test_linear_model(df, data):
    y = np.array([r[4] for r in data])
    m = linear.linear_model(df, "y ~ a*b + x")
    full = design(data, ["a", "b", "x", "a:b"])
    b = np.linalg.lstsq(full, y, rcond=None)[0]
    assert [c["estimate"] for c in m["coefficients"]] == pytest.approx(b, abs=1e-8) and m["n"] == len(data)
    for t, left in (("a", ["b", "x", "a:b"]), ("b", ["a", "x", "a:b"]), ("x", ["a", "b", "a:b"]), ("a:b", ["a", "b", "x"])):
        got = next(r for r in m["terms"] if r["term"] == t)
        assert got["ss"] == pytest.approx(rss(design(data, left), y) - rss(full, y), rel=1e-6)
    assert sum(t["sequential_ss"] for t in m["terms"]) == pytest.approx(((y - y.mean()) ** 2).sum() - m["rss"])
    v = linear.linear_model_vector(m, {"a": "b", "b": "v", "x": 0.5})
    p = linear.predict_linear_model(df, m).filter("a = 'b' and b = 'v'").select("x", "prediction").first()
    at = linear.linear_model_contrast(m, linear.linear_model_vector(m, {"a": "b", "b": "v", "x": p["x"]}))
    assert at["estimate"] == pytest.approx(p["prediction"]) and len(v) == len(b) and at["se"] > 0
    c = linear.compare_linear_means(m, "a")
    assert len(c["comparisons"]) == 3 and all(r["p_adjusted"] >= r["p_value"] for r in c["comparisons"])
    w = linear.linear_workbench(df, "y ~ a + x")
    assert w["residuals"]["mean"] == pytest.approx(0, abs=1e-9) and "a" in w["comparisons"]
    an = linear.ancova(df, "y", "a", "x")
    assert an["group"]["ss"] == pytest.approx(rss(design(data, ["x"]), y) - rss(design(data, ["a", "x"]), y), rel=1e-6)
    two = linear.anova_two_way_adjusted(df, "y", "a", "b")
    assert two["a:b"]["df"] == 2 and two["error"]["df"] == len(data) - 6


def test_adjusted_p():
    p = [0.01, 0.04, 0.03]
    assert linear.adjust_comparison_p(p, "bonferroni") == pytest.approx([0.03, 0.12, 0.09])
    assert linear.adjust_comparison_p(p, "holm") == pytest.approx([0.03, 0.06, 0.06])
    assert linear.adjust_comparison_p(p, "bh") == pytest.approx([0.03, 0.04, 0.04])


def test_dunnett_and_hsu(df):
    half = math.sqrt(0.5)
    # published critical values: three treatments, infinite and 20 degrees of freedom
    assert linear.qdunnett(0.95, [half] * 3, math.inf) == pytest.approx(2.349, abs=2e-3)
    assert linear.qdunnett(0.95, [half] * 3, 20) == pytest.approx(2.54, abs=6e-3)
    assert linear.pdunnett(D.t(12).ppf(0.975), [half], 12) == pytest.approx(0.95, abs=1e-5)
    d = linear.dunnett(df, "y", "a", "a")
    assert d["control"] == "a" and [c["group"] for c in d["comparisons"]] == ["b", "c"]
    assert all((c["p_value"] < 0.05) == (c["ci"][0] > 0 or c["ci"][1] < 0) for c in d["comparisons"])
    h = linear.hsu_mcb(df, "y", "a")
    assert all(g["ci"][0] <= 0 <= g["ci"][1] for g in h["groups"])
    assert linear.pooled_groups(df, "y", "a")["df"] == 237


def test_grouping_letters():
    far = lambda x, y: abs({"p": 1, "q": 2, "r": 3}[x] - {"p": 1, "q": 2, "r": 3}[y]) > 1
    got = linear.grouping_letters(["p", "q", "r"], [1, 2, 3], far)
    assert not set(got["p"]) & set(got["r"]) and set(got["p"]) & set(got["q"]) and set(got["q"]) & set(got["r"])


def test_manova(df, data):
    y = np.array([[r[4], r[5]] for r in data])
    g = np.array([r[1] for r in data])
    e = sum((len(v) - 1) * np.cov(v.T) for v in (y[g == k] for k in "abc"))
    t = (len(y) - 1) * np.cov(y.T)
    m = linear.manova(df, ["y", "w"], "a")
    assert m["wilks"]["statistic"] == pytest.approx(np.linalg.det(e) / np.linalg.det(t))
    h = t - e
    assert m["pillai"]["statistic"] == pytest.approx(np.trace(h @ np.linalg.inv(t))) and m["lawley_hotelling"]["statistic"] == pytest.approx(np.trace(h @ np.linalg.inv(e)))
    # with one response all four are the F test
    one = linear.manova(df, ["y"], "a")
    f = basic.anova(df, "y", "a")["f"]
    assert [one[k]["f"] for k in ("wilks", "pillai", "lawley_hotelling", "roy")] == pytest.approx([f] * 4)
    assert set(linear.manova_model(df, ["y", "w"], "a + x")) == {"a", "x"}


def test_nested_and_mixed(spark):
    r = np.random.default_rng(3)
    rows, eff = [], r.normal(scale=2, size=8)
    for a in range(8):
        for b in range(3):
            e = r.normal()
            rows += [(f"a{a}", f"a{a}b{b}", float(10 + eff[a] + e + r.normal(scale=0.5))) for _ in range(4)]
    d = spark.createDataFrame(rows, "a string, b string, y double")
    n = linear.nested_anova(d, "y", ["a", "b"])["table"]
    y = np.array([v[2] for v in rows]).reshape(8, 3, 4)
    msb = 12 * ((y.mean((1, 2)) - y.mean()) ** 2).sum() / 7
    msc = 4 * ((y.mean(2) - y.mean((1, 2))[:, None]) ** 2).sum() / 16
    mse = ((y - y.mean(2)[:, :, None]) ** 2).sum() / 72
    assert [x["ms"] for x in n] == pytest.approx([msb, msc, mse])
    assert [x["variance"] for x in n] == pytest.approx([max(0, (msb - msc) / 12), max(0, (msc - mse) / 4), mse])
    # a balanced one-way layout: restricted likelihood and analysis of variance agree
    m = linear.mixed_model(d, "y", [], "a")
    msw = (12 - 1) * np.array([np.var(v, ddof=1) for v in y.reshape(8, 12)]).mean() / 11
    assert m["variance"]["error"] == pytest.approx(msw, rel=1e-3) and m["variance"]["group"] == pytest.approx((msb - msw) / 12, rel=1e-3)
    assert m["effects"].count() == 8 and m["coefficients"][0]["estimate"] == pytest.approx(y.mean())
    assert process.variance_component_reml(d, "y", "a")["between"] == pytest.approx(m["variance"]["group"])


def test_glmm(spark):
    r = np.random.default_rng(5)
    rows = []
    for g in range(30):
        u = r.normal()
        for _ in range(40):
            x = float(r.normal())
            rows.append((f"g{g}", x, float(r.random() < 1 / (1 + math.exp(-(0.3 + x + u))))))
    m = linear.glmm(spark.createDataFrame(rows, "g string, x double, y double"), "y", ["x"], "g")
    assert m["coefficients"][1]["estimate"] == pytest.approx(1, abs=0.25) and 0.3 < m["variance"]["group"] < 2.5


# -- scale, distribution ------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def pair(spark):
    r = random.Random(9)
    rows = [("p", round(r.gauss(0, 1), 1)) for _ in range(41)] + [("q", round(r.gauss(0, 2), 1)) for _ in range(36)]
    return rows, spark.createDataFrame(rows, "g string, x double")


def ranks(x):
    x = np.asarray(x)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_scale_tests(pair):
    rows, df = pair
    x, first = np.array([v for _, v in rows]), np.array([g == "p" for g, _ in rows])
    order = np.argsort(x, kind="stable")
    n = len(x)
    raw = np.minimum(np.arange(1, n + 1), n - np.arange(n))
    score = np.empty(n)
    sq = np.empty(n)
    for v in np.unique(x):
        at = np.flatnonzero(x[order] == v)
        score[order[at]] = raw[at].mean()
        sq[order[at]] = ((at + 1 - (n + 1) / 2) ** 2).mean()
    assert scale.ansari_bradley(df, "x", "g")["statistic"] == pytest.approx(score[first].sum())
    m = scale.mood_two_sample(df, "x", "g")
    assert m["statistic"] == pytest.approx(sq[first].sum()) and m["p_value"] < 0.05
    e = scale.epps_singleton(df, "x", "g")
    assert e["df"] == 4 and 0 <= e["p_value"] <= 1
    b2 = scale.bonett2(df, "x", "g")
    assert b2["ratio"] == pytest.approx(np.var(x[first], ddof=1) / np.var(x[~first], ddof=1)) and b2["ci"][0] < b2["ratio"] < b2["ci"][1]
    assert (b2["p_value"] < 0.05) == (not b2["ci"][0] < 1 < b2["ci"][1])
    assert scale.bonett(df, "x", "g")["df"] == 1 and scale.equal_variances(df, "x", "g", "f")["f"] == pytest.approx(b2["ratio"])
    assert len(scale.variance_analysis(df, "x", "g")["tests"]) == 5


def test_distribution_tests(pair):
    rows, df = pair
    x, g = np.array([v for _, v in rows]), np.array([k for k, _ in rows])
    s = np.sort(x)
    n = len(s)
    cdf = np.array([D.normal().cdf(v) for v in s])
    assert scale.kolmogorov_smirnov(df, "x")["d"] == pytest.approx(max((np.arange(1, n + 1) / n - cdf).max(), (cdf - np.arange(n) / n).max()))
    a = 0.0
    for k in "pq":
        v = x[g == k]
        t = 0.0
        for z in np.unique(x):
            l, f = (x == z).sum(), (v == z).sum()
            b, m = (x < z).sum() + l / 2, (v < z).sum() + f / 2
            t += l / n * (n * m - len(v) * b) ** 2 / (b * (n - b) - n * l / 4)
        a += t / len(v)
    assert scale.anderson_k_sample(df, "x", "g")["a2"] == pytest.approx((n - 1) / n * a)


def test_dixon(spark):
    d = scale.dixon(spark.createDataFrame([(v,) for v in (0.189, 0.167, 0.187, 0.183, 0.186, 0.182, 0.181, 0.184, 0.181, 0.177)], "x double"), "x", "less")
    # published: Q = 0.455, above the one-sided 95 % value of 0.41 for ten values
    assert d["statistic"] == pytest.approx(10 / 22) and d["outlier"] == 0.167 and d["critical"] == pytest.approx(0.41, abs=0.01)


def test_kth():
    r = np.random.default_rng(1)
    a, b = np.round(r.normal(size=13), 1), np.round(r.normal(size=9), 1)
    every = np.sort((a[:, None] + b).ravel())
    assert [scale.kth_pair_sum(a, b, k) for k in (1, 20, 60, 117)] == pytest.approx(every[[0, 19, 59, 116]])
    i, j = np.triu_indices(13)
    walsh = np.sort((a[i] + a[j]) / 2)
    assert [scale.kth_walsh_average(a, k) for k in (1, 30, 91)] == pytest.approx(walsh[[0, 29, 90]])


def test_power_and_intervals(df, pair):
    assert scale.power("t2", effect=0.5, power=0.8)["n"] == 64 and scale.power("prop2", effect=0.6, p0=0.5, power=0.8)["n"] == pytest.approx(388, abs=1)
    assert len(scale.power_study("t1", [10, 20], [0.5, 1.0])) == 4
    assert scale.proportion_interval(81, 263)[0] == pytest.approx(0.2553, abs=1e-3) and scale.proportion_interval(0, 10, "exact")[0] == 0
    assert scale.poisson_rate_interval(10)[0] == pytest.approx(4.795, abs=1e-3)
    x = np.array([v for g, v in pair[0] if g == "p"])
    i, j = np.triu_indices(len(x))
    assert scale.hodges_lehmann(pair[1].filter("g = 'p'"), "x") == pytest.approx(np.median((x[i] + x[j]) / 2))


def test_displays(df, data):
    s = scale.graphical_summary(df, "y")
    assert s["median_ci"][0] < s["description"]["median"] < s["median_ci"][1] and s["sd_ci"][0] < s["description"]["sd"] < s["sd_ci"][1]
    assert len(scale.interval_plot(df, "y", "a")) == 3 and sum(r["n"] for r in scale.interaction_plot(df, "y", "a", "b")) == len(data)
    means = {(r["factor"], r["level"]): r["mean"] for r in scale.main_effects_plot(df, "y", ["a", "b"])}
    assert means["a", "b"] == pytest.approx(np.mean([r[4] for r in data if r[1] == "b"]))
    assert scale.dotplot(df, "y").agg(F.sum("count")).first()[0] == len(data) + 1
    assert scale.cause_and_effect("late", {"men": ["few"], "method": ["old", "slow"]})["n"] == 3
    c = scale.contingency_analysis(df, "a", "b")
    assert c["likelihood_ratio"]["g"] == pytest.approx(c["chi2"]["chi2"], rel=0.1)
    assert scale.goodness_of_fit_analysis(df, "a")["test"]["df"] == 2 and len(scale.proportion_analysis(df, "b", "u", "a")["groups"]) == 3
    assert scale.binary_sample(df, "b", "u")[1] == len(data) + 1


# -- series -------------------------------------------------------------------------------------------------------
def test_stl(spark):
    t = np.arange(120)
    season = np.tile([3.0, -1, 0, 2, -4, 0], 20)
    y = 0.1 * t + season
    s = series.stl(spark.createDataFrame([(int(i), float(v)) for i, v in zip(t, y, strict=True)], "t long, y double"), "y", "t", 6)
    assert np.abs(s["residual"]).max() < 0.05 and np.abs(s["seasonal"] - season).max() < 0.1 and s["trend"] + s["seasonal"] + s["residual"] == pytest.approx(y)


def test_arima(spark):
    r = np.random.default_rng(11)
    e, x = r.normal(size=600), np.zeros(600)
    for i in range(1, 600):
        x[i] = 0.7 * x[i - 1] + e[i]
    d = spark.createDataFrame([(i, float(v + 5)) for i, v in enumerate(x)], "t long, y double")
    m = series.arima(d, "y", "t", (1, 0, 0))
    y = x + 5
    assert m["ar"][0] == pytest.approx(0.7, abs=0.08) and m["mean"] == pytest.approx(5, abs=0.4) and m["variance"] == pytest.approx(1, abs=0.15)
    f = series.forecast(m, 200)
    assert f[0]["forecast"] == pytest.approx(m["mean"] + m["ar"][0] * (y[-1] - m["mean"])) and f[-1]["forecast"] == pytest.approx(m["mean"], abs=1e-3)
    assert (f[-1]["high"] - f[-1]["forecast"]) / 1.96 == pytest.approx(math.sqrt(m["variance"] / (1 - m["ar"][0] ** 2)), rel=1e-3)
    # exact likelihood of an AR(1)
    phi, mu, s2, n = m["ar"][0], m["mean"], m["variance"], 600
    u = y - mu
    ll = -0.5 * (n * math.log(2 * math.pi * s2) - math.log(1 - phi**2) + ((1 - phi**2) * u[0] ** 2 + ((u[1:] - phi * u[:-1]) ** 2).sum()) / s2)
    assert m["log_likelihood"] == pytest.approx(ll, rel=1e-6)
    ma = np.convolve(e, [1, 0.6])[1:600]
    q = series.arima(spark.createDataFrame([(i, float(v)) for i, v in enumerate(ma)], "t long, y double"), "y", "t", (0, 0, 1))
    assert q["ma"][0] == pytest.approx(0.6, abs=0.1)
    walk = spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.cumsum(e[:300]))], "t long, y double")
    auto = series.auto_arima(walk, "y", "t", max_p=1, max_q=1)
    assert auto["order"][1] == 1 and auto["tried"] >= 3
    white = series.cumulative_periodogram(spark.createDataFrame([(i, float(v)) for i, v in enumerate(e)], "t long, y double"), "y", "t")
    assert white["p_value"] > 0.01 and series.cumulative_periodogram(d, "y", "t")["p_value"] < 1e-6


def test_transfer(spark):
    r = np.random.default_rng(2)
    x = np.zeros(400)
    for i in range(1, 400):
        x[i] = 0.5 * x[i - 1] + r.normal()
    y = np.r_[np.zeros(3), 2 * x[:-3]] + 0.1 * r.normal(size=400)
    got = series.transfer_identify(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "t long, x double, y double"), "x", "y", "t")
    assert got["delay"] == 3 and got["weights"][3] == pytest.approx(2, abs=0.2)


# -- processes ------------------------------------------------------------------------------------------------------
def test_charts_and_estimates(spark, df, data):
    r = np.random.default_rng(4)
    rows = [(i, f"s{i // 40}", i // 4, float(r.normal(i // 40, 1)), float(r.normal(2, 1))) for i in range(120)]
    d = spark.createDataFrame(rows, "i long, s string, g long, x double, z double")
    x = np.array([v[3] for v in rows])
    st = process.staged_control_chart(d, "x", "i", "s")
    assert st[1]["centre"] == pytest.approx(x[40:80].mean()) and st[2]["sigma"] == pytest.approx(np.abs(np.diff(x[80:])).mean() / 1.128)
    assert process.quality_moving_ranges(d, "x", "i").agg(F.sum("mr")).first()[0] == pytest.approx(np.abs(np.diff(x)).sum())
    assert process.within_estimate(d, "x", order="i") == pytest.approx(spc.imr_chart(d, "x", "i")["sigma"])
    pooled = math.sqrt(np.mean([np.var(x[k : k + 4], ddof=1) for k in range(0, 120, 4)]))
    assert process.within_estimate(d, "x", subgroup="g") == pytest.approx(pooled, rel=0.01)
    z = np.array([v[4] for v in rows])
    gv = process.generalized_variance_chart(d, ["x", "z"], "g")
    mats = [np.cov(x[k : k + 4], z[k : k + 4]) for k in range(0, 120, 4)]
    assert gv["centre"] == pytest.approx(np.linalg.det(np.mean(mats, 0))) and gv["points"][5]["value"] == pytest.approx(np.linalg.det(mats[5]))
    assert process.process_control_chart(d, "x", subgroup="g")["kind"] == "xbar-r" and process.control_chart(d, "imr", "x", order="i")["centre"] == pytest.approx(x.mean())
    bw = process.between_within_capability(d, "x", "g", -5, 8)
    assert bw["between_within"] == pytest.approx(math.hypot(bw["between"], bw["within"])) and bw["cpk"] <= bw["cp"]
    assert len(process.multi_vari(df, "y", ["a", "b"])) == 1 + 3 + 6
    assert len(process.capability_sixpack(d, "x", "g", -5, 8)["last_subgroups"]) == 25


def test_nonnormal(spark, df):
    assert process.nonnormal_capability(df, "y", -10, 10, "normal")["pp"] == pytest.approx(spc.capability(df, "y", -10, 10)["pp"], rel=1e-3)
    ids = process.individual_distribution_id(df, "w")
    assert ids[0]["distribution"] in ("gamma", "weibull") and len(ids) == 8
    r = np.random.default_rng(8)
    for kind, x in (("SU", np.sinh((r.normal(size=4000) - 0.5) / 1.3)), ("SB", 1 / (1 + np.exp(-(r.normal(size=4000) - 0.3) / 1.2)))):
        j = process.johnson_fit(spark.createDataFrame([(float(v),) for v in x], "x double"), "x")
        z = np.array([j["transform"](v) for v in x if kind == "SU" or j["epsilon"] < v < j["epsilon"] + j["lambda"]])
        assert j["kind"] == kind and abs(z.mean()) < 0.12 and z.std() == pytest.approx(1, abs=0.12)
    q = process.normal_qq(df, "y").orderBy("x").toPandas()
    assert q["z"].is_monotonic_increasing and process.symmetry_test(df, "w")["p_value"] < 0.01
    h = process.quality_histogram(df, "y", -2, 4)
    assert sum(b["count"] for b in h["bins"]) == 241 and h["below"] + h["above"] < 1 and process.quality_moments(df, "y")["n"] == 241
    a = process.attribute_capability(spark.createDataFrame([(3, 100), (2, 100)], "d long, n long"), "binomial", "d", "n")
    assert a["proportion"] == 0.025 and a["ci"][0] < 0.025 < a["ci"][1]


def test_expanded_gage(spark):
    r = np.random.default_rng(6)
    p, o = r.normal(scale=3, size=10), r.normal(scale=1, size=3)
    rows = [(f"p{i}", f"o{j}", float(p[i] + o[j] + r.normal(scale=0.7))) for i in range(10) for j in range(3) for _ in range(2)]
    d = spark.createDataFrame(rows, "p string, o string, x double")
    a, b = process.expanded_gage_rr(d, "x", "p", "o")["variance"], spc.gage_rr(d, "x", "p", "o")["variance"]
    assert [a[k] for k in ("part", "repeatability")] == pytest.approx([b["part"], b["repeatability"]], rel=0.02)
    assert process.expanded_gage_rr(d.limit(57), "x", "p", "o")["variance"]["total"] > 0
    assert "gage" in studies.msa_study(d, "x", "p", "o")


# -- responses ------------------------------------------------------------------------------------------------------
def test_ordinal_and_nominal(spark):
    r = np.random.default_rng(12)
    rows = []
    for _ in range(1500):
        x, z = r.normal(size=2)
        u = 1.2 * x - 0.6 * z + r.logistic()
        rows.append((float(x), float(z), int(u > -0.5) + int(u > 1.0), int(u > 0)))
    d = spark.createDataFrame(rows, "x double, z double, y int, b int").repartition(3)
    o = response.ologit(d, "y", ["x", "z"])
    assert [c["estimate"] for c in o["coefficients"]] == pytest.approx([1.2, -0.6], abs=0.2) and [c["estimate"] for c in o["thresholds"]] == pytest.approx([-0.5, 1.0], abs=0.2)
    # two levels: both are logistic regression
    g = {c["term"]: c for c in regression.logistic(d, "b", ["x", "z"])["coefficients"]}
    two, m = response.ologit(d, "b", ["x", "z"]), response.mlogit(d, "b", ["x", "z"])
    assert [c["estimate"] for c in two["coefficients"]] == pytest.approx([g["x"]["estimate"], g["z"]["estimate"]], rel=1e-5)
    assert two["thresholds"][0]["estimate"] == pytest.approx(-g["(intercept)"]["estimate"], rel=1e-5)
    assert [c["se"] for c in two["coefficients"]] == pytest.approx([g["x"]["se"], g["z"]["se"]], rel=1e-3)
    assert [c["estimate"] for c in m["equations"][1]] == pytest.approx([g[t]["estimate"] for t in ("(intercept)", "x", "z")], rel=1e-5)
    assert set(response.mlogit(d, "y", ["x"])["equations"]) == {1, 2} and o["p_value"] < 1e-10


def test_pls_and_vif(df):
    p, o = response.pls(df, "y", ["x", "w"], 2), regression.ols(df, "y", ["x", "w"])
    assert [c["estimate"] for c in p["coefficients"]] == pytest.approx([c["estimate"] for c in o["coefficients"]]) and p["r_squared"] == pytest.approx(o["r_squared"])
    assert response.vif_from_fit(df, ["x", "w"])["x"] == pytest.approx(next(c["vif"] for c in o["coefficients"] if c["term"] == "x"))
    assert response.to_columns(df, ["x"]) == ["x"]
    with pytest.raises(ValueError):
        response.to_columns(df, ["a"])


def test_stability(spark):
    r = np.random.default_rng(13)
    rows = [(f"b{b}", float(t), float(100 - 0.5 * t + r.normal(scale=0.3))) for b in range(3) for t in (0, 3, 6, 9, 12, 18, 24) for _ in range(2)]
    s = response.stability_study(spark.createDataFrame(rows, "b string, t double, y double"), "y", "t", "b", lsl=90)
    assert 18 < s["shelf_life"] < 20.5


# -- life data ------------------------------------------------------------------------------------------------------
def test_life_fits(spark):
    r = np.random.default_rng(14)
    t = np.exp(r.normal(2, 0.5, 400))
    d = spark.createDataFrame([(float(v), 0) for v in t], "t double, c int")
    f = life.reliability_fit(d, "t", "c", "lognormal")
    assert f["location"] == pytest.approx(np.log(t).mean(), abs=1e-4) and f["scale"] == pytest.approx(np.log(t).std(), abs=1e-4)
    ws = spark.createDataFrame([(float(5 * r.weibull(2)), 0) for _ in range(300)], "t double, c int")
    sev = life.reliability_fit(ws.select(F.log("t").alias("t"), "c"), "t", "c", "smallest extreme value")
    w = life.reliability_fit(ws, "t", "c")
    assert (math.exp(sev["location"]), 1 / sev["scale"]) == pytest.approx((w["scale"], w["shape"]), rel=1e-3)
    p = life.probability_plot(ws, "t", "c")
    assert p["slope"] == pytest.approx(w["shape"], rel=0.15) and p["correlation"] > 0.98
    assert life.demonstration_test_plan(0.9, 100)["units"] == 29
    back = life.demonstration_test_plan(0.9, 100, units=29, shape=2)
    assert back["time"] == pytest.approx(100 * math.sqrt(math.log(0.05) / math.log(0.9) / 29), rel=1e-6)
    e = life.estimation_test_plan(1.5, 0.1, 2.0, 100.0)
    assert 5 < e["units"] < 200 and e["failures"] == e["units"]
    ret = spark.createDataFrame([("jan", 100.0, float(a), float(f)) for a, f in ((1, 2), (2, 3), (3, 4))] + [("feb", 120.0, float(a), float(f)) for a, f in ((1, 2), (2, 4))], "p string, n double, a double, f double")
    wp = life.warranty_prediction(ret, "p", "n", "a", "f")
    assert len(wp["expected"]) == 3 and 3 < wp["expected"][0] < 20


def test_power_law_and_probit(spark):
    t = [0.7, 3.7, 13.2, 17.6, 54.5, 99.2, 112.2, 120.9, 151.0, 163.0]
    d = spark.createDataFrame([("s", v) for v in t], "s string, t double")
    p = life.power_law_nhpp(d, "s", "t", 200.0)
    assert p["shape"] == pytest.approx(10 / sum(math.log(200 / v) for v in t)) and p["intensity"] == pytest.approx(10 / 200 ** p["shape"])
    dose = [(0.0, 2, 50), (1.0, 9, 50), (2.0, 24, 50), (3.0, 38, 50), (4.0, 47, 50)]
    one = spark.createDataFrame([(x, float(i < e)) for x, e, n in dose for i in range(n)], "x double, y double")
    g = [c["estimate"] for c in regression.logistic(one, "y", ["x"])["coefficients"]]
    q = life.probit_analysis(spark.createDataFrame(dose, "x double, e long, n long"), "e", "n", "x", "logit")
    assert [q["intercept"], q["slope"]] == pytest.approx(g, rel=1e-6)
    mid = next(r for r in q["percentiles"] if r["share"] == 0.5)
    assert mid["dose"] == pytest.approx(-g[0] / g[1]) and mid["ci"][0] < mid["dose"] < mid["ci"][1]


def test_competing_risks(spark):
    r = np.random.default_rng(15)
    rows = []
    for _ in range(400):
        x = float(r.normal())
        t, c = r.exponential(math.exp(-0.6 * x)), r.exponential(1.5)
        rows.append((float(min(t, c)), int(t <= c), int(t > c), x))
    d = spark.createDataFrame(rows, "t double, cause int, z int, x double")
    # without other causes: Cox's model, and one less the survival curve
    a, b = life.fine_gray(d, "t", "cause", ["x"]), reliability.cox_ph(d, "t", "z", ["x"])
    assert a["coefficients"][0]["estimate"] == pytest.approx(b["coefficients"][0]["estimate"], rel=1e-6)
    ci = {v["time"]: v["incidence"] for v in life.cumulative_incidence(d, "t", "cause").collect()}
    km = {v["time"]: v["survival"] for v in reliability.kaplan_meier(d, "t", "z").collect()}
    assert all(ci[t] == pytest.approx(1 - km[t], abs=1e-9) for t in km)
    two = d.withColumn("cause", F.when((F.col("cause") == 0) & (F.col("x") > 0.5), 2).otherwise(F.col("cause")))
    assert np.isfinite(life.fine_gray(two, "t", "cause", ["x"])["coefficients"][0]["estimate"])


# -- studies ----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("levels", "columns", "runs"), [(2, 7, 8), (3, 4, 9), (3, 5, 27), (4, 5, 16), (5, 6, 25)])
def test_orthogonal_arrays(levels, columns, runs):
    a = studies.orthogonal_array(levels, columns)
    assert a.shape == (runs, columns)
    for i in range(columns):
        for j in range(i):
            assert len({(x, y) for x, y in a[:, [i, j]]}) == levels**2
    assert studies.taguchi(levels, columns).min() == 1


def test_designs():
    for k in (4, 5, 6, 7, 10):
        d = studies.definitive_screening(k)
        g = d.T @ d
        assert (g == np.diag(np.diag(g))).all() and (d.sum(0) == 0).all() and (d[:, 0] ** 2 @ d == 0).all()
    x = np.array([[a, b, c] for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)])
    y = 10 + 3 * x[:, 0] - 2 * x[:, 1] * x[:, 2] + 0.01 * np.arange(8)
    e = {r["term"]: r["effect"] for r in studies.analyze_effects(x, y, order=3)["effects"]}
    assert e["A"] == pytest.approx(6, abs=0.1) and e["B*C"] == pytest.approx(-4, abs=0.1)
    t = studies.analyze_taguchi(studies.taguchi(2, 3), [[1, 1.1], [2, 2.1], [4, 4.2], [8, 8.1]], "larger")
    assert t["factors"][0]["rank"] in (1, 2, 3) and len(t["sn"]) == 4
    m = studies.mixture_design(3, "centroid", axial=True)
    assert np.allclose(m.sum(1), 1) and len(m) == 10
    z = 5 * m[:, 0] + 7 * m[:, 1] + 3 * m[:, 2] + 4 * m[:, 0] * m[:, 1]
    c = {r["term"]: r["estimate"] for r in studies.analyze_mixture(m, z)["coefficients"]}
    assert c["x1*x2"] == pytest.approx(4, abs=1e-8) and c["x3"] == pytest.approx(3)
    best = studies.response_optimizer([lambda p: -((p[0] - 1) ** 2) - (p[1] + 2) ** 2], [("max", -20.0, 0.0, 0.0)], [(-5, 5), (-5, 5)])
    assert best["at"] == pytest.approx([1, -2], abs=0.05)
    assert "effects" in studies.doe_study(x, y)


def test_multivariate_extras(df):
    a, b = np.array([[0.0, 0], [3, 4]]), np.array([[0.0, 0]])
    assert studies.cdist(a, b)[1, 0] == 5 and studies.cdist(a, b, "manhattan")[1, 0] == 7 and studies.cdist(a, b, "chebyshev")[1, 0] == 4
    l = np.array([[0.8, 0.1], [0.7, 0.2], [0.1, 0.9], [0.2, 0.6]])
    p = studies.promax(l)
    assert np.allclose(np.diag(p["correlations"]), 1) and p["pattern"] @ p["correlations"] @ p["pattern"].T == pytest.approx(l @ l.T, abs=1e-8)
    m = studies.multiple_correspondence(df, ["a", "b"])
    assert sum(m["inertia"]) == pytest.approx((5 - 2) / 2)  # categories less variables, over variables
    s = studies.mars(df.withColumn("h", F.greatest(F.col("x"), F.lit(0.0)) * 3), "h", ["x", "w"])
    assert s["r_squared"] > 0.97 and studies.mars_predict(df, s).filter("prediction is null").count() == 0


def test_matrices():
    a = studies.from_rows([[4, 2], [2, 3]])
    l = studies.cholesky(a)
    assert l @ l.T == pytest.approx(a) and studies.cholesky_solve(l, [1, 2]) == pytest.approx(np.linalg.solve(a, [1, 2]))
    q, r = studies.qr(a)
    assert q @ r == pytest.approx(a) and (np.diag(r) > 0).all() and studies.inverse(a) @ a == pytest.approx(np.eye(2))
    u, s, v = studies.svd(a)
    assert u * s @ v == pytest.approx(a) and studies.symmetric_eigen(a)["values"] == pytest.approx(sorted(np.linalg.eigvalsh(a))[::-1])
    assert studies.gram([[1, 2], [3, 4]]) == pytest.approx(np.array([[10, 14], [14, 20]])) and studies.gram_vec([[1, 2], [3, 4]], [1, 1]) == pytest.approx([4, 6])
    assert studies.matmul(a, studies.matrix(2, 1, 1))[0, 0] == 6 and studies.matvec(a, [1, 0])[1] == 2 and studies.column(studies.transpose(a), 1)[0] == 2
    assert studies.lstsq([[1, 0], [0, 1], [1, 1]], [1, 2, 3])["rss"] == pytest.approx(0)
    n = studies.newton_max(lambda x: -2 * (x - 3), lambda x: np.array([[-2.0]]), [0.0], lambda x: -float((x[0] - 3) ** 2))
    assert n["x"][0] == pytest.approx(3) and n["converged"] and studies.min_of([2, 1]) == 1 and studies.max_of([2, float("nan")]) == 2
    with pytest.raises(ValueError):
        studies.from_rows([1, 2])


def test_worksheet(df):
    d = studies.recalculate_worksheet(df, {"twice": "= [x] * 2 + if([y] > 0, 1, -1)", "share": "=twice / sum([w])"})
    r = d.filter("i = 5").first()
    total = df.agg(F.sum("w")).first()[0]
    assert r["twice"] == pytest.approx(r["x"] * 2 + (1 if r["y"] > 0 else -1)) and r["share"] == pytest.approx(r["twice"] / total)
    assert studies.worksheet_references("[a b] + c * abs(d)") == ["a b", "c", "d"]
    assert studies.worksheet_expression_text(studies.compile_worksheet_expression("if([a b]>1,2^3,0)")) == "if([a b] > 1, 2 ^ 3, 0)"
    for bad in ("__import__('os')", "x.y", "[a] if 1 else 2"):
        with pytest.raises(ValueError):
            studies.compile_worksheet_expression(bad)
    with pytest.raises(ValueError):
        studies.recalculate_worksheet(df, {"p": "q + 1", "q": "p + 1"})
    assert studies.worksheet_date("1900-01-01") == 2 and studies.worksheet_date_text(45000) == "2023-03-15"
    assert studies.worksheet_aggregate(df, "max", "i") == 999 and studies.worksheet_matrix(df, ["x", "y"]).shape == (241, 2)


def test_plots_and_reports(df, spark):
    s = studies.plot_series(df, "x", "y", "b", 20)
    assert [v["name"] for v in s] == ["u", "v"] and len(studies.render_plot_series(s).splitlines()) == 15
    text = studies.format_report({"n": 3, "rows": [{"a": 1.23456789, "b": "x"}], "more": {"k": (1.0, 2.0)}}, "Title")
    assert "1.23457" in text and text.startswith("Title\n=====")
    assert studies.engineering_study("multivariate", df, ["x", "y", "w"])["items"] and len(studies.graph_workbench(df, "interval", "y", "a")) == 3
    rel = studies.reliability_study(df, "w", distributions=("weibull", "lognormal"))
    assert set(rel["fits"]) == {"weibull", "lognormal"}
    r = np.random.default_rng(3)
    t = spark.createDataFrame([(i, float(v)) for i, v in enumerate(r.normal(size=80).cumsum())], "t long, y double")
    assert len(studies.time_series_study(t, "y", "t", ahead=3)["forecast"]) == 3


def test_generalized_variance_of_many_subgroups(spark):
    """Points stay a table; positions within few groups are numbered in slices."""
    from pyspark.sql import Window

    from ashlar.operators import positions

    d = spark.range(3000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 50 != 7, F.col("id") * 7919 % 3001).alias("o"), "id", F.rand(3).alias("x"), F.rand(4).alias("z"))
    d = d.withColumn("k", F.when(F.col("k") > 0, F.col("k"))).persist()
    want = d.select("id", (F.row_number().over(Window.partitionBy("k").orderBy(F.col("o").asc_nulls_last(), "id")) - 1).alias("i"))
    n = positions.number(d, ["o", "id"], "i", ["k"])
    assert n.columns == [*d.columns, "i"] and {tuple(r) for r in n.select("id", "i").collect()} == {tuple(r) for r in want.collect()}
    g = d.withColumn("g", F.floor(F.col("id") / 5))
    r = process.generalized_variance_limits(g, ["x", "z"], "g")
    c = process.generalized_variance_chart(g, ["x", "z"], "g")
    assert r["subgroups"] == 600 and len(c["points"]) == 600 and [p["subgroup"] for p in c["points"][:3]] == [0, 1, 2]
    assert r["points"].filter((F.col("value") > r["ucl"]) | (F.col("value") < r["lcl"])).count() == r["points"].filter("out").count() == sum(p["out"] for p in c["points"])
    with pytest.raises(ValueError, match="one size"):
        process.generalized_variance_limits(g.filter("id > 0"), ["x", "z"], "g")


def test_kendall_of_many_rows(spark):
    """Exact against all pairs, with hot values and ties, in one slice and in many; more rows than a driver's double loop bears."""
    from ashlar.stats import basic

    r = np.random.default_rng(2)
    x, y = np.where(r.random(600) < 0.4, 3.0, r.integers(0, 90, 600)), np.where(r.random(600) < 0.3, -1.0, r.normal(size=600).round(1))
    sx, sy = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
    want = (sx * sy).sum() / math.sqrt((sx != 0).sum() * (sy != 0).sum())
    assert basic.pair_signs(x, y, np.ones(600)) == (sx * sy).sum() // 2 and basic.pair_signs([], [], []) == 0
    d = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)) + [(1.0, None), (math.nan, 1.0)], "x double, y double")
    for rows in (10_000, 200, 40):
        assert basic.kendall(d, "x", "y", rows)["tau"] == pytest.approx(want, abs=1e-12)
    big = spark.range(30_000).select(F.col("id").cast("double").alias("a"), (F.col("id") % 29_999).alias("b"))
    assert basic.kendall(big, "a", "b")["tau"] == pytest.approx(((29_999 * 29_998 // 2) - 29_998) / math.sqrt((30_000 * 29_999 // 2) * (30_000 * 29_999 // 2 - 1)), abs=1e-12)


def test_gram_of_more_rows_than_a_matrix(spark):
    d = spark.range(1_000_001).select(F.lit(1.0).alias("one"), (F.col("id") % 50).alias("x"), F.when(F.col("id") > 0, 3 + 2.0 * (F.col("id") % 50)).alias("y"))
    with pytest.raises(ValueError):
        studies.worksheet_matrix(d.fillna(0.0), ["one", "x", "y"])
    g = studies.gram_of(d, ["one", "x", "y"])
    assert g[0, 0] == 1_000_000 and (g == g.T).all() and studies.cholesky_solve(studies.cholesky(g[:2, :2]), g[:2, 2]) == pytest.approx([3, 2])
    some = d.limit(40).withColumn("w", F.col("x") + 1)
    m = studies.worksheet_matrix(some, ["x", "y", "w"])
    assert studies.gram_of(some, ["x", "y"], "w") == pytest.approx(studies.gram(m[:, :2], m[:, 2])) and (studies.gram_of(d.limit(0), ["x"]) == 0).all()
