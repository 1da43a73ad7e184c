"""Tests on one, two and more samples. Columns are aggregated by Spark; formulas run on the few numbers that return.

Frames give (value, group) columns; nulls, NaN and infinities are dropped. Results are plain dicts.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.functions import aggregates as A
from ashlar.operators.positions import average_rank
from ashlar.stats import dist as D


def clean(x: Column) -> Column:
    """The number if usable, else null."""
    x = x.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def moments(df: DataFrame, value: str, by: str | None = None) -> dict:
    """n, mean, variance, central moments 3 and 4, min and max per group (key None without groups)."""
    d = df.select(clean(F.col(value)).alias("x"), *([F.col(by).cast("string").alias("g")] if by else [])).dropna()
    aggs = [F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"), F.skewness("x").alias("skew"), F.kurtosis("x").alias("kurt"), F.min("x").alias("min"), F.max("x").alias("max"), F.sum("x").alias("sum")]
    rows = (d.groupBy("g") if by else d.groupBy()).agg(*aggs).collect()
    return {(r["g"] if by else None): r.asDict() for r in sorted(rows, key=lambda r: str(r[0]))}


def _two(df, value, by) -> list[dict]:
    m = list(moments(df, value, by).values())
    if len(m) != 2:
        raise ValueError(f"two groups are needed, there are {len(m)}")
    return m


def _t_result(diff, se, df, mu, alternative, confidence) -> dict:
    d = D.t(df)
    stat = (diff - mu) / se
    q = d.ppf(1 - (1 - confidence) / 2) if alternative == "two-sided" else d.ppf(confidence)
    ci = {"two-sided": (diff - q * se, diff + q * se), "greater": (diff - q * se, math.inf), "less": (-math.inf, diff + q * se)}[alternative]
    return {"t": stat, "df": df, "p_value": D.two_sided(d, stat, alternative), "estimate": diff, "se": se, "ci": ci}


def ttest1(df, value, mu=0.0, alternative="two-sided", confidence=0.95) -> dict:
    m = moments(df, value)[None]
    return _t_result(m["mean"], math.sqrt(m["var"] / m["n"]), m["n"] - 1, mu, alternative, confidence)


def ttest2(df, value, by, mu=0.0, equal_var=False, alternative="two-sided", confidence=0.95) -> dict:
    a, b = _two(df, value, by)
    va, vb = a["var"] / a["n"], b["var"] / b["n"]
    if equal_var:
        k = a["n"] + b["n"] - 2
        s = ((a["n"] - 1) * a["var"] + (b["n"] - 1) * b["var"]) / k
        se = math.sqrt(s * (1 / a["n"] + 1 / b["n"]))
    else:
        se, k = math.sqrt(va + vb), (va + vb) ** 2 / (va**2 / (a["n"] - 1) + vb**2 / (b["n"] - 1))
    return _t_result(a["mean"] - b["mean"], se, k, mu, alternative, confidence)


def ttest_paired(df, a, b, **options) -> dict:
    return ttest1(df.select((clean(F.col(a)) - clean(F.col(b))).alias("d")), "d", **options)


def ztest1(df, value, sigma, mu=0.0, alternative="two-sided", confidence=0.95) -> dict:
    m = moments(df, value)[None]
    se, n = sigma / math.sqrt(m["n"]), D.normal()
    z = (m["mean"] - mu) / se
    q = n.ppf(1 - (1 - confidence) / 2)
    return {"z": z, "p_value": D.two_sided(n, z, alternative), "estimate": m["mean"], "ci": (m["mean"] - q * se, m["mean"] + q * se)}


def _anova(groups: list[dict]) -> dict:
    n, k = sum(g["n"] for g in groups), len(groups)
    mean = sum(g["n"] * g["mean"] for g in groups) / n
    between = sum(g["n"] * (g["mean"] - mean) ** 2 for g in groups)
    within = sum((g["n"] - 1) * (g["var"] or 0) for g in groups)
    msb, msw = between / (k - 1), within / (n - k)
    f = msb / msw if msw else math.inf
    return {"f": f, "df_between": k - 1, "df_within": n - k, "ss_between": between, "ss_within": within, "ms_within": msw, "p_value": D.f(k - 1, n - k).sf(f), "r_squared": between / (between + within) if between + within else math.nan}


def anova(df, value, by) -> dict:
    return _anova(list(moments(df, value, by).values()))


def welch_anova(df, value, by) -> dict:
    g = list(moments(df, value, by).values())
    w = [x["n"] / x["var"] for x in g]
    k, s = len(g), sum(w)
    mean = sum(a * x["mean"] for a, x in zip(w, g, strict=True)) / s
    lam = sum((1 - a / s) ** 2 / (x["n"] - 1) for a, x in zip(w, g, strict=True))
    f = sum(a * (x["mean"] - mean) ** 2 for a, x in zip(w, g, strict=True)) / (k - 1) / (1 + 2 * (k - 2) * lam / (k * k - 1))
    d2 = (k * k - 1) / (3 * lam)
    return {"f": f, "df1": k - 1, "df2": d2, "p_value": D.f(k - 1, d2).sf(f)}


def tukey_hsd(df, value, by, confidence=0.95) -> list[dict]:
    g = moments(df, value, by)
    a = _anova(list(g.values()))
    q = D.qtukey(confidence, len(g), a["df_within"])
    return [_pair(x, y, g, math.sqrt(a["ms_within"] / 2 * (1 / g[x]["n"] + 1 / g[y]["n"])), q, lambda s: 1 - D.ptukey(abs(s), len(g), a["df_within"])) for x, y in combinations(g, 2)]


def games_howell(df, value, by, confidence=0.95) -> list[dict]:
    g, out = moments(df, value, by), []
    for x, y in combinations(g, 2):
        vx, vy = g[x]["var"] / g[x]["n"], g[y]["var"] / g[y]["n"]
        k = (vx + vy) ** 2 / (vx**2 / (g[x]["n"] - 1) + vy**2 / (g[y]["n"] - 1))
        out.append(_pair(x, y, g, math.sqrt((vx + vy) / 2), D.qtukey(confidence, len(g), k), lambda s, k=k: 1 - D.ptukey(abs(s), len(g), k)))
    return out


def fisher_lsd(df, value, by, confidence=0.95) -> list[dict]:
    g = moments(df, value, by)
    a = _anova(list(g.values()))
    d = D.t(a["df_within"])
    return [_pair(x, y, g, math.sqrt(a["ms_within"] * (1 / g[x]["n"] + 1 / g[y]["n"])), d.ppf(1 - (1 - confidence) / 2), lambda s: D.two_sided(d, s)) for x, y in combinations(g, 2)]


def _pair(x, y, g, se, q, p) -> dict:
    diff = g[y]["mean"] - g[x]["mean"]
    return {"a": x, "b": y, "difference": diff, "se": se, "statistic": diff / se, "p_value": max(0.0, p(diff / se)), "ci": (diff - q * se, diff + q * se)}


def levene(df, value, by, center="median") -> dict:
    """Brown-Forsythe by default: analysis of variance of absolute deviations from the group's centre."""
    d = df.select(clean(F.col(value)).alias("x"), F.col(by).cast("string").alias("g")).dropna()
    c = d.groupBy("g").agg((A.median(F.col("x")) if center == "median" else F.avg("x")).alias("c"))
    return anova(d.join(c, "g").select(F.abs(F.col("x") - F.col("c")).alias("x"), "g"), "x", "g")


def bartlett(df, value, by) -> dict:
    g = [x for x in moments(df, value, by).values() if x["n"] > 1]
    k, n = len(g), sum(x["n"] for x in g)
    pooled = sum((x["n"] - 1) * x["var"] for x in g) / (n - k)
    stat = (n - k) * math.log(pooled) - sum((x["n"] - 1) * math.log(x["var"]) for x in g)
    stat /= 1 + (sum(1 / (x["n"] - 1) for x in g) - 1 / (n - k)) / (3 * (k - 1))
    return {"chi2": stat, "df": k - 1, "p_value": D.chi2(k - 1).sf(stat)}


def var_test1(df, value, sigma0, alternative="two-sided", confidence=0.95) -> dict:
    m = moments(df, value)[None]
    k, d = m["n"] - 1, D.chi2(m["n"] - 1)
    stat = k * m["var"] / sigma0**2
    a = (1 - confidence) / 2
    return {"chi2": stat, "df": k, "p_value": D.two_sided(d, stat, alternative), "ci": (k * m["var"] / d.ppf(1 - a), k * m["var"] / d.ppf(a))}


def var_test2(df, value, by, alternative="two-sided", confidence=0.95) -> dict:
    a, b = _two(df, value, by)
    f, d = a["var"] / b["var"], D.f(a["n"] - 1, b["n"] - 1)
    q = (1 - confidence) / 2
    return {"f": f, "df1": a["n"] - 1, "df2": b["n"] - 1, "p_value": D.two_sided(d, f, alternative), "ci": (f / d.ppf(1 - q), f / d.ppf(q))}


# -- counts -----------------------------------------------------------------------------------------------------
def crosstab(df, a, b) -> dict:
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).count().collect()
    r, c = sorted({x["a"] for x in rows}), sorted({x["b"] for x in rows})
    t = np.zeros((len(r), len(c)))
    for x in rows:
        t[r.index(x["a"]), c.index(x["b"])] = x["count"]
    return {"rows": r, "columns": c, "table": t}


def chi2_test(table, correction=False) -> dict:
    t = np.asarray(table, float)
    e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
    d = np.abs(t - e)
    if correction and t.shape == (2, 2):
        d = np.maximum(d - 0.5, 0)
    stat, k = float((d**2 / e).sum()), (t.shape[0] - 1) * (t.shape[1] - 1)
    return {"chi2": stat, "df": k, "p_value": D.chi2(k).sf(stat), "expected": e, "cramers_v": math.sqrt(stat / t.sum() / max(1, min(t.shape) - 1))}


def chi2_gof(observed, expected=None, ddof=0) -> dict:
    o = np.asarray(observed, float)
    e = np.full(len(o), o.sum() / len(o)) if expected is None else np.asarray(expected, float) * o.sum() / np.sum(expected)
    stat, k = float(((o - e) ** 2 / e).sum()), len(o) - 1 - ddof
    return {"chi2": stat, "df": k, "p_value": D.chi2(k).sf(stat)}


def fisher_exact(table) -> dict:
    (a, b), (c, d) = table
    h = D.hypergeometric(a + b + c + d, a + b, a + c)
    p0 = h.pdf(a)
    p = sum(h.pdf(k) for k in range(int(h.low), int(h.high) + 1) if h.pdf(k) <= p0 * (1 + 1e-7))
    return {"odds_ratio": a * d / (b * c) if b * c else math.inf, "p_value": min(1.0, p), "p_less": h.cdf(a), "p_greater": 1 - h.cdf(a - 1)}


def mcnemar(b: int, c: int, exact=True) -> dict:
    if exact:
        return {"statistic": min(b, c), "p_value": min(1.0, 2 * D.binomial(b + c, 0.5).cdf(min(b, c)))}
    stat = (abs(b - c) - 1) ** 2 / (b + c)
    return {"statistic": stat, "p_value": D.chi2(1).sf(stat)}


def bowker(table) -> dict:
    t = np.asarray(table, float)
    pairs = [(i, j) for i in range(len(t)) for j in range(i) if t[i, j] + t[j, i]]
    stat = sum((t[i, j] - t[j, i]) ** 2 / (t[i, j] + t[j, i]) for i, j in pairs)
    return {"chi2": stat, "df": len(pairs), "p_value": D.chi2(len(pairs)).sf(stat)}


def cochran_q(df, columns) -> dict:
    k = len(columns)
    row = sum((F.col(c).cast("double") for c in columns[1:]), F.col(columns[0]).cast("double"))
    r = df.dropna(subset=columns).agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in columns], F.sum(row).alias("_n"), F.sum(row * row).alias("_q")).first()
    total, t = r["_n"], [r[c] for c in columns]
    stat = (k - 1) * (k * sum(x * x for x in t) - total**2) / (k * total - r["_q"])
    return {"q": stat, "df": k - 1, "p_value": D.chi2(k - 1).sf(stat)}


def prop_test1(events, trials, p0=0.5, alternative="two-sided", confidence=0.95, method="exact") -> dict:
    p, a = events / trials, (1 - confidence) / 2
    if method == "normal":
        z = (p - p0) / math.sqrt(p0 * (1 - p0) / trials)
        q = D.normal().ppf(1 - a) * math.sqrt(p * (1 - p) / trials)
        return {"z": z, "p_value": D.two_sided(D.normal(), z, alternative), "estimate": p, "ci": (p - q, p + q)}
    b = D.binomial(trials, p0)
    if alternative == "less":
        pv = b.cdf(events)
    elif alternative == "greater":
        pv = 1 - b.cdf(events - 1)
    else:
        pv = sum(b.pdf(k) for k in range(trials + 1) if b.pdf(k) <= b.pdf(events) * (1 + 1e-7))
    lo = 0.0 if events == 0 else D.beta(events, trials - events + 1).ppf(a)
    hi = 1.0 if events == trials else D.beta(events + 1, trials - events).ppf(1 - a)
    return {"p_value": min(1.0, pv), "estimate": p, "ci": (lo, hi)}


def wilson_interval(events, trials, confidence=0.95) -> tuple[float, float]:
    z, p = D.normal().ppf(1 - (1 - confidence) / 2), events / trials
    mid, half = p + z * z / (2 * trials), z * math.sqrt(p * (1 - p) / trials + z * z / (4 * trials**2))
    return (mid - half) / (1 + z * z / trials), (mid + half) / (1 + z * z / trials)


def newcombe_interval(e1, n1, e2, n2, confidence=0.95) -> tuple[float, float]:
    (l1, u1), (l2, u2), d = wilson_interval(e1, n1, confidence), wilson_interval(e2, n2, confidence), e1 / n1 - e2 / n2
    return d - math.hypot(e1 / n1 - l1, u2 - e2 / n2), d + math.hypot(u1 - e1 / n1, e2 / n2 - l2)


def prop_test2(e1, n1, e2, n2, alternative="two-sided", confidence=0.95, pooled=True) -> dict:
    p1, p2 = e1 / n1, e2 / n2
    p = (e1 + e2) / (n1 + n2)
    se = math.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)
    z = (p1 - p2) / (math.sqrt(p * (1 - p) * (1 / n1 + 1 / n2)) if pooled else se)
    q = D.normal().ppf(1 - (1 - confidence) / 2)
    return {"z": z, "p_value": D.two_sided(D.normal(), z, alternative), "difference": p1 - p2, "ci": (p1 - p2 - q * se, p1 - p2 + q * se), "fisher_p": fisher_exact([[e1, n1 - e1], [e2, n2 - e2]])["p_value"]}


def poisson_rate1(events, exposure=1.0, rate0=1.0, alternative="two-sided", confidence=0.95) -> dict:
    d, a = D.poisson(rate0 * exposure), (1 - confidence) / 2
    less, more = d.cdf(events), 1 - d.cdf(events - 1)
    lo = 0.0 if events == 0 else D.chi2(2 * events).ppf(a) / 2 / exposure
    return {"p_value": {"less": less, "greater": more, "two-sided": min(1.0, 2 * min(less, more))}[alternative], "rate": events / exposure, "ci": (lo, D.chi2(2 * events + 2).ppf(1 - a) / 2 / exposure)}


def poisson_rate2(e1, t1, e2, t2, alternative="two-sided") -> dict:
    return {"ratio": (e1 / t1) / (e2 / t2), "p_value": prop_test1(e1, e1 + e2, t1 / (t1 + t2), alternative)["p_value"]}


# -- association ------------------------------------------------------------------------------------------------
def corr_test(df, a, b, method="pearson", confidence=0.95) -> dict:
    d = df.select(clean(F.col(a)).alias("x"), clean(F.col(b)).alias("y")).dropna()
    if method == "spearman":
        d = average_rank(average_rank(d, "x", "rx"), "y", "ry").select(F.col("rx").alias("x"), F.col("ry").alias("y"))
    r = d.agg(F.count("x").alias("n"), F.covar_samp("x", "y").alias("c"), F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy")).first()
    n, rho = r["n"], r["c"] / (r["sx"] * r["sy"]) if r["sx"] and r["sy"] else math.nan
    stat = rho * math.sqrt((n - 2) / (1 - rho * rho)) if abs(rho) < 1 else math.copysign(math.inf, rho)
    z, half = math.atanh(rho) if abs(rho) < 1 else math.copysign(18, rho), D.normal().ppf(1 - (1 - confidence) / 2) / math.sqrt(n - 3) if n > 3 else math.inf
    return {"r": rho, "n": n, "t": stat, "p_value": D.two_sided(D.t(n - 2), stat) if abs(rho) < 1 else 0.0, "ci": (math.tanh(z - half), math.tanh(z + half))}


def partial_corr(df, a, b, controls) -> dict:
    cols = [a, b, *controls]
    d = df.select(*[clean(F.col(c)).alias(c) for c in cols]).dropna()
    r = d.agg(F.count(F.lit(1)).alias("n"), *[F.covar_samp(x, y).alias(f"{i}_{j}") for i, x in enumerate(cols) for j, y in enumerate(cols) if i <= j]).first()
    m = np.array([[r[f"{min(i, j)}_{max(i, j)}"] for j in range(len(cols))] for i in range(len(cols))])
    p = np.linalg.inv(m)
    rho = float(-p[0, 1] / math.sqrt(p[0, 0] * p[1, 1]))
    k = r["n"] - 2 - len(controls)
    stat = rho * math.sqrt(k / (1 - rho * rho))
    return {"r": rho, "df": k, "t": stat, "p_value": D.two_sided(D.t(k), stat)}


# -- outliers, equivalence, effect size, power ------------------------------------------------------------------
def grubbs(df, value) -> dict:
    m = moments(df, value)[None]
    n, s = m["n"], math.sqrt(m["var"])
    g = max(m["max"] - m["mean"], m["mean"] - m["min"]) / s
    t2 = n * (n - 2) * g * g / ((n - 1) ** 2 - n * g * g)
    return {"g": g, "p_value": min(1.0, 2 * n * D.t(n - 2).sf(math.sqrt(t2))) if t2 > 0 else 0.0, "outlier": m["max"] if m["max"] - m["mean"] >= m["mean"] - m["min"] else m["min"]}


def tost2(df, value, by, low, high, equal_var=False, alpha=0.05) -> dict:
    a = ttest2(df, value, by, low, equal_var, "greater")
    b = ttest2(df, value, by, high, equal_var, "less")
    return {"p_low": a["p_value"], "p_high": b["p_value"], "p_value": max(a["p_value"], b["p_value"]), "equivalent": max(a["p_value"], b["p_value"]) < alpha}


def tost1(df, value, low, high, alpha=0.05) -> dict:
    p = max(ttest1(df, value, low, "greater")["p_value"], ttest1(df, value, high, "less")["p_value"])
    return {"p_value": p, "equivalent": p < alpha}


def tost_paired(df, a, b, low, high, alpha=0.05) -> dict:
    return tost1(df.select((clean(F.col(a)) - clean(F.col(b))).alias("d")), "d", low, high, alpha)


def cohens_d(df, value, by) -> float:
    a, b = _two(df, value, by)
    return (a["mean"] - b["mean"]) / math.sqrt(((a["n"] - 1) * a["var"] + (b["n"] - 1) * b["var"]) / (a["n"] + b["n"] - 2))


def hedges_g(df, value, by) -> float:
    a, b = _two(df, value, by)
    k = a["n"] + b["n"] - 2
    return cohens_d(df, value, by) * math.exp(D.lgamma(k / 2) - D.lgamma((k - 1) / 2)) / math.sqrt(k / 2)


def glass_delta(df, value, by) -> float:
    a, b = _two(df, value, by)
    return (a["mean"] - b["mean"]) / math.sqrt(b["var"])


def power_t(n, delta, sd=1.0, alpha=0.05, sample="two") -> float:
    """Power of a two-sided t test with n per sample."""
    k, nc = (2 * n - 2, delta / sd * math.sqrt(n / 2)) if sample == "two" else (n - 1, delta / sd * math.sqrt(n))
    q = D.t(k).ppf(1 - alpha / 2)
    return 1 - D.nct_cdf(q, k, nc) + D.nct_cdf(-q, k, nc)


def sample_size_t(power, delta, sd=1.0, alpha=0.05, sample="two") -> int:
    n = 2
    while power_t(n, delta, sd, alpha, sample) < power:
        n += max(1, n // 20) if power_t(n + n // 20 + 1, delta, sd, alpha, sample) < power else 1
    return n


def power_anova(k, n, effect_f, alpha=0.05) -> float:
    d1, d2 = k - 1, k * (n - 1)
    return 1 - D.ncf_cdf(D.f(d1, d2).ppf(1 - alpha), d1, d2, k * n * effect_f**2)


# -- description ------------------------------------------------------------------------------------------------
def descriptive_stats(df, value, by=None) -> list[dict]:
    """Per group: n, mean, se, sd, cv, sample skewness and excess kurtosis, type-6 quartiles."""
    d = df.select(clean(F.col(value)).alias("x"), *([F.col(by).cast("string").alias("g")] if by else [])).filter("x is not null")
    q = {r["g"] if by else None: r for r in (d.groupBy("g") if by else d.groupBy()).agg(*[A.quantile(F.col("x"), p, "minitab").alias(k) for k, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]).collect()}
    out = []
    for g, m in moments(df, value, by).items():
        n, sd = m["n"], math.sqrt(m["var"] or 0)
        skew = m["skew"] * math.sqrt(n * (n - 1)) / (n - 2) if n > 2 and sd else math.nan
        kurt = ((n + 1) * m["kurt"] + 6) * (n - 1) / ((n - 2) * (n - 3)) if n > 3 and sd else math.nan
        out.append({"group": g, "n": n, "mean": m["mean"], "se": sd / math.sqrt(n), "sd": sd, "cv": 100 * sd / m["mean"] if m["mean"] else math.nan, "min": m["min"], "q1": q[g]["q1"], "median": q[g]["median"], "q3": q[g]["q3"], "max": m["max"], "iqr": q[g]["q3"] - q[g]["q1"], "skewness": skew, "kurtosis": kurt})
    return out


def boxplot_stats(df, value, by=None) -> list[dict]:
    out = []
    for s in descriptive_stats(df, value, by):
        lo, hi = s["q1"] - 1.5 * s["iqr"], s["q3"] + 1.5 * s["iqr"]
        d = df.select(clean(F.col(value)).alias("x"), *([F.col(by).cast("string").alias("g")] if by else [])).filter("x is not null")
        d = d.filter(F.col("g").eqNullSafe(F.lit(s["group"]))) if by else d
        inside = F.when((F.col("x") >= lo) & (F.col("x") <= hi), F.col("x"))
        r = d.agg(F.min(inside).alias("a"), F.max(inside).alias("b"), F.count_if(inside.isNull()).alias("n")).first()
        out.append({k: s[k] for k in ("group", "q1", "median", "q3")} | {"low": r["a"], "high": r["b"], "outliers": r["n"]})
    return out


def mean_interval(df, value, confidence=0.95) -> tuple[float, float]:
    return ttest1(df, value, confidence=confidence)["ci"]


def histogram_bins(df, value, bins: int | None = None) -> list[dict]:
    m = moments(df, value)[None]
    k = bins or max(1, math.ceil(math.log2(m["n"]) + 1))
    w = (m["max"] - m["min"]) / k or 1.0
    d = df.select(clean(F.col(value)).alias("x")).filter("x is not null").groupBy(F.least(F.floor((F.col("x") - m["min"]) / w), F.lit(k - 1)).alias("b")).count()
    n = {r["b"]: r["count"] for r in d.collect()}
    return [{"low": m["min"] + i * w, "high": m["min"] + (i + 1) * w, "count": n.get(i, 0)} for i in range(k)]


def ecdf(df, value) -> DataFrame:
    """(x, p) per distinct value; distributed."""
    from ashlar.operators.positions import running_sum

    n = df.select(clean(F.col(value)).alias("x")).filter("x is not null").groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = n.agg(F.sum("n")).first()[0] or 1.0
    return running_sum(n, ["x"], F.col("n"), "c").select("x", (F.col("c") / total).alias("p"))


def bootstrap(df, value, statistic=np.mean, n=1000, confidence=0.95, seed=1, most=1_000_000) -> dict:
    x = np.array([r[0] for r in df.select(clean(F.col(value)).alias("x")).filter("x is not null").limit(most + 1).collect()])
    if len(x) > most:
        raise ValueError(f"resampling is for at most {most} values")
    r = np.random.default_rng(seed)
    got = np.array([statistic(r.choice(x, len(x))) for _ in range(n)])
    a = (1 - confidence) / 2
    return {"estimate": float(statistic(x)), "se": float(got.std(ddof=1)), "ci": tuple(np.quantile(got, [a, 1 - a]))}


# -- more tests -------------------------------------------------------------------------------------------------
def pair_signs(u, v, w) -> int:
    """Sum of w w' sign(u - u') sign(v - v') over all pairs, exact, in m log m steps.

    Two rows part at the highest bit in which the ranks of their v differ; there running sums of w in the order of u count them.
    """
    u, v, w = np.unique(u, return_inverse=True)[1], np.unique(v, return_inverse=True)[1], np.asarray(w, np.int64)
    o = np.argsort(u, kind="stable")
    u, v, w, at, total = u[o], v[o], w[o], np.arange(len(o)), 0
    for bit in range(int(v.max()).bit_length() - 1 if len(v) else -1, -1, -1):
        top, high = v >> (bit + 1), (v >> bit) & 1
        new = np.r_[True, top[1:] != top[:-1]]
        run = np.maximum.accumulate(np.where(new | np.r_[True, u[1:] != u[:-1]], at, 0))
        new = np.maximum.accumulate(np.where(new, at, 0))
        up, down = w * high, w * (1 - high)
        cu, cd = np.cumsum(up) - up, np.cumsum(down) - down
        total += int((up * (cd[run] - cd[new])).sum()) - int((down * (cu[run] - cu[new])).sum())
        o = np.argsort(v >> bit, kind="stable")
        u, v, w = u[o], v[o], w[o]
    return total


def kendall(df, a, b, slice_rows: int = 1 << 17) -> dict:
    """Tau-b with ties, exact for any number of rows: no task holds more than a slice of x or y.

    Either variable is cut into slices. Two rows in different slices of both are counted from the slices' counts; those in one slice of
    x only, of y only, and in one cell of both, within that slice or cell. Equal rows are folded, so hot values do not fill a slice.
    """
    from ashlar.operators.positions import boundaries, bucket

    d = df.select(clean(F.col(a)).alias("x"), clean(F.col(b)).alias("y")).dropna().groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        rows, n = d.agg(F.count(F.lit(1)), F.sum("n")).first()
        n = n or 0
        k = min(1024, 1 + rows // slice_rows)
        c = d.select("x", "y", "n", *[bucket(d, v, boundaries(d, v, k)).cast("double").alias("b" + v) for v in "xy"])
        kinds = {0: ([], "bx", "by"), 1: (["bx"], "x", "by"), 2: (["by"], "bx", "y"), 3: (["bx", "by"], "x", "y")}
        parts = [c.groupBy(*dict.fromkeys([*g, u, v])).agg(F.sum("n").alias("n")).select(F.lit(i).alias("k"), *[F.col(v) if v in g else F.lit(-1.0).alias(v) for v in ("bx", "by")], F.col(u).alias("u"), F.col(v).alias("v"), "n") for i, (g, u, v) in kinds.items()]
        every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
        s = every.groupBy("k", "bx", "by").applyInPandas(lambda t: pd.DataFrame({"s": [str(pair_signs(t["u"], t["v"], t["n"]))]}), "s string").agg(F.sum(F.col("s").cast("decimal(38,0)"))).first()[0]
        s = int(s or 0)
        tx, ty = (int(d.groupBy(v).agg(F.sum("n").cast("decimal(19,0)").alias("n")).agg(F.sum((F.col("n") * (F.col("n") - 1)).cast("decimal(38,0)"))).first()[0] or 0) // 2 for v in "xy")
    finally:
        d.unpersist()
    n0 = n * (n - 1) // 2
    z = s / math.sqrt(n * (n - 1) * (2 * n + 5) / 18)
    return {"tau": s / math.sqrt((n0 - tx) * (n0 - ty)), "z": z, "p_value": D.two_sided(D.normal(), z)}


def anova_two_way(df, value, a, b) -> dict:
    """Balanced two-way analysis of variance with interaction, from cell aggregates."""
    c = df.select(clean(F.col(value)).alias("x"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).dropna().groupBy("a", "b").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("v")).collect()
    p, q = sorted({r["a"] for r in c}), sorted({r["b"] for r in c})
    n = {r["n"] for r in c}
    if len(n) > 1 or len(c) != len(p) * len(q):
        raise ValueError("cells of equal size are needed")
    n = n.pop()
    m = np.array([[next(r["m"] for r in c if r["a"] == x and r["b"] == y) for y in q] for x in p])
    g = m.mean()
    ss = {"a": len(q) * n * ((m.mean(1) - g) ** 2).sum(), "b": len(p) * n * ((m.mean(0) - g) ** 2).sum()}
    ss["interaction"] = n * ((m - g) ** 2).sum() - ss["a"] - ss["b"]
    ss["error"] = sum((n - 1) * r["v"] for r in c)
    df_ = {"a": len(p) - 1, "b": len(q) - 1, "interaction": (len(p) - 1) * (len(q) - 1), "error": len(c) * (n - 1)}
    if not df_["error"]:  # one value a cell: the interaction is the error
        ss["error"], df_["error"] = ss.pop("interaction"), df_.pop("interaction")
    mse = ss["error"] / df_["error"]
    return {k: {"ss": float(ss[k]), "df": df_[k]} | ({"f": float(ss[k] / df_[k] / mse), "p_value": D.f(df_[k], df_["error"]).sf(float(ss[k] / df_[k] / mse))} if k != "error" else {"ms": float(mse)}) for k in ss}


def permutation_test(df, value, by, n=10_000, seed=1, most=1_000_000) -> dict:
    """Difference of two means under random relabelling."""
    rows = df.select(clean(F.col(value)).alias("x"), F.col(by).cast("string").alias("g")).dropna().orderBy("g", "x").limit(most + 1).toPandas()
    names = sorted(rows["g"].unique())
    if len(names) != 2 or len(rows) > most:
        raise ValueError(f"two groups of at most {most} rows together are needed")
    x, k = rows["x"].to_numpy(), int((rows["g"] == names[0]).sum())
    r, obs, hit = np.random.default_rng(seed), abs(x[:k].mean() - x[k:].mean()), 0
    for _ in range(n):
        p = r.permutation(x)
        hit += abs(p[:k].mean() - p[k:].mean()) >= obs - 1e-12
    return {"difference": float(x[:k].mean() - x[k:].mean()), "p_value": (hit + 1) / (n + 1)}


def poisson_gof(df, value) -> dict:
    """Counts against Poisson probabilities with the sample's mean; classes with small expectation are pooled."""
    rows = {int(r[0]): r[1] for r in df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("long")).count().collect()}
    n = sum(rows.values())
    mu = sum(k * v for k, v in rows.items()) / n
    d, obs, exp, o, e, k, left = D.poisson(mu), [], [], 0, 0.0, 0, 1.0
    while left * n >= 5 or k <= max(rows):
        o, e, left = o + rows.get(k, 0), e + n * d.pdf(k), left - d.pdf(k)
        if e >= 5 and (left * n >= 5):
            obs, exp, o, e = [*obs, o], [*exp, e], 0, 0.0
        k += 1
    obs, exp = [*obs, o], [*exp, e + n * max(left, 0)]
    return chi2_gof(obs, exp, 1) | {"mean": mu}


def energy_distance(df, value, by, most: int = 5_000) -> dict:
    rows = df.select(clean(F.col(value)).alias("x"), F.col(by).cast("string").alias("g")).dropna().limit(most + 1).toPandas()
    names = sorted(rows["g"].unique())
    if len(names) != 2 or len(rows) > most:
        raise ValueError(f"two groups of at most {most} rows together are needed")
    x, y = (rows.loc[rows["g"] == g, "x"].to_numpy() for g in names)
    d = lambda a, b: np.abs(a[:, None] - b[None]).mean()
    return {"energy": float(2 * d(x, y) - d(x, x) - d(y, y))}
