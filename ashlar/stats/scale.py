"""Tests of scale, distribution and outliers, intervals, power and the displays of basic statistics.

Sums, ranks and running counts are distributed; formulas run on the numbers that return. Groups come as two columns.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ashlar.operators import positions
from ashlar.stats import basic as B
from ashlar.stats import dist as D
from ashlar.stats.basic import clean, moments


def _pair(df: DataFrame, value: str, by: str):
    d = df.select(clean(F.col(value)).alias("x"), F.col(by).cast("string").alias("g")).dropna()
    names = [r[0] for r in d.groupBy("g").count().orderBy("g").limit(3).collect()]
    if len(names) != 2:
        raise ValueError("two groups are needed")
    return d, names


# -- scale ------------------------------------------------------------------------------------------------------
def ansari_bradley(df: DataFrame, value: str, by: str) -> dict:
    """Scores min(rank, n + 1 - rank), averaged over ties; normal approximation. The statistic is the first group's sum."""
    d, names = _pair(df, value, by)
    c = d.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("c"), F.count_if(F.col("g") == names[0]).cast("double").alias("a"))
    c = positions.running_sum(c, ["x"], F.col("c"), "to")
    t = c.agg(F.sum("c").alias("n"), F.sum("a").alias("n1")).first()
    n, n1 = t["n"], t["n1"]
    half = (n + 1) / 2
    # the sum of min(r, n + 1 - r) over the tied ranks lo..hi, each side of the middle in closed form
    lo, hi = F.col("to") - F.col("c") + 1, F.col("to")
    tri = lambda a, b: (a + b) * (b - a + 1) / 2
    left = F.when(lo <= half, tri(lo, F.least(hi, F.floor(F.lit(half))))).otherwise(0.0)
    right = F.when(hi > half, tri(n + 1 - hi, n + 1 - F.greatest(lo, F.floor(F.lit(half)) + 1))).otherwise(0.0)
    score = (left + right) / F.col("c")
    r = c.agg(F.sum(F.col("a") * score).alias("w"), F.sum(F.col("c") * score).alias("s"), F.sum(F.col("c") * score * score).alias("q")).first()
    mean = n1 * r["s"] / n
    var = n1 * (n - n1) / (n * (n - 1)) * (r["q"] - r["s"] ** 2 / n)
    z = (r["w"] - mean) / math.sqrt(var) if var > 0 else 0.0
    return {"statistic": r["w"], "z": z, "p_value": D.two_sided(D.normal(), z), "n1": int(n1), "n2": int(n - n1)}


def mood_two_sample(df: DataFrame, value: str, by: str) -> dict:
    """Squared distances of the ranks from the middle; ties take the mean score of their ranks."""
    d, names = _pair(df, value, by)
    c = d.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("c"), F.count_if(F.col("g") == names[0]).cast("double").alias("a"))
    c = positions.running_sum(c, ["x"], F.col("c"), "to")
    t = c.agg(F.sum("c").alias("n"), F.sum("a").alias("n1")).first()
    n, n1 = t["n"], t["n1"]
    mid = F.col("to") - (F.col("c") - 1) / 2 - (n + 1) / 2
    score = mid * mid + (F.col("c") * F.col("c") - 1) / 12  # the mean square of consecutive ranks
    r = c.agg(F.sum(F.col("a") * score).alias("w"), F.sum(F.col("c") * score).alias("s"), F.sum(F.col("c") * score * score).alias("q")).first()
    mean = n1 * r["s"] / n
    var = n1 * (n - n1) / (n * (n - 1)) * (r["q"] - r["s"] ** 2 / n)
    z = (r["w"] - mean) / math.sqrt(var) if var > 0 else 0.0
    return {"statistic": r["w"], "z": z, "p_value": D.two_sided(D.normal(), z), "n1": int(n1), "n2": int(n - n1)}


def epps_singleton(df: DataFrame, value: str, by: str, t: tuple[float, ...] = (0.4, 0.8)) -> dict:
    """Empirical characteristic functions at points scaled by the pooled semi-interquartile range; one aggregate."""
    d, names = _pair(df, value, by)
    q = d.agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.75))).alias("q")).first()["q"]
    s = (q[1] - q[0]) / 2
    if s <= 0:
        raise ValueError("no spread in the middle half")
    cols = [f(F.col("x") * (p / s)) for p in t for f in (F.cos, F.sin)]
    k = len(cols)
    d = d.select("g", *[c.alias(f"c{i}") for i, c in enumerate(cols)])
    aggs = [F.count(F.lit(1)).alias("n"), *[F.avg(f"c{i}").alias(f"m{i}") for i in range(k)], *[F.covar_pop(f"c{i}", f"c{j}").alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]]
    a, b = d.groupBy("g").agg(*aggs).orderBy("g").collect()
    cov = lambda r: np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    n1, n2 = a["n"], b["n"]
    n = n1 + n2
    est = n / n1 * cov(a) + n / n2 * cov(b)
    diff = np.array([a[f"m{i}"] - b[f"m{i}"] for i in range(k)])
    rank = int(np.linalg.matrix_rank(est))
    w = float(n * diff @ np.linalg.pinv(est) @ diff)
    if max(n1, n2) < 25:
        w /= 1 + n**-0.45 + 10.1 * (n1**-1.7 + n2**-1.7)
    return {"statistic": w, "df": rank, "p_value": D.chi2(rank).sf(w), "n1": n1, "n2": n2}


def _bonett_parts(df: DataFrame, value: str, by: str):
    """Per group: n, variance, and the sum of fourth powers about the trimmed mean (1 / (2 sqrt(n - 4)) cut at each end)."""
    d = df.select(clean(F.col(value)).alias("x"), F.col(by).cast("string").alias("g")).dropna()
    w = Window.partitionBy("g")
    r = d.withColumn("i", F.row_number().over(w.orderBy("x"))).withColumn("n", F.count(F.lit(1)).over(w))
    cut = F.floor(F.col("n") / (2 * F.sqrt(F.greatest(F.col("n") - 4, F.lit(1)))))
    trimmed = r.filter((F.col("i") > cut) & (F.col("i") <= F.col("n") - cut)).groupBy("g").agg(F.avg("x").alias("t"))
    p = F.pow(F.col("x") - F.col("t"), F.lit(4))
    return d.join(trimmed, "g").groupBy("g").agg(F.count("x").alias("n"), F.var_samp("x").alias("v"), F.sum(p).alias("q")).orderBy("g").collect()


def bonett2(df: DataFrame, value: str, by: str, confidence: float = 0.95) -> dict:
    """Two-sample test of variances that stands departures from normality, with an interval of the ratio."""
    g = _bonett_parts(df, value, by)
    if len(g) != 2:
        raise ValueError("two groups are needed")
    a, b = g
    ratio = a["v"] / b["v"]

    def kurtosis(rho: float) -> float:
        # pooled fourth moment, the second group's scaled to the first's variance under the ratio
        top = a["q"] + rho * rho * b["q"]
        low = (a["n"] - 1) * a["v"] + rho * (b["n"] - 1) * b["v"]
        return (a["n"] + b["n"]) * top / low**2

    def se2(rho: float) -> float:
        k = kurtosis(rho)
        return sum((k - (x["n"] - 3) / x["n"]) / (x["n"] - 1) for x in g)

    n = D.normal()
    zc = n.ppf(1 - (1 - confidence) / 2)
    c = a["n"] / (a["n"] - zc) / (b["n"] / (b["n"] - zc))
    z = lambda rho: (math.log(c * ratio) - math.log(rho)) / math.sqrt(max(se2(rho), 1e-300))
    stat = z(1.0)
    ends = []
    for sign in (1, -1):
        f = lambda u, sign=sign: z(math.exp(u)) - sign * zc
        lo, hi = math.log(ratio) - 1e-9, math.log(ratio)
        step = 0.1
        while f(lo if sign > 0 else hi) * sign < 0 and step < 100:
            lo, hi = (lo - step, hi) if sign > 0 else (lo, hi + step)
            step *= 1.5
        ends.append(math.exp(D.brentq(f, lo, hi)))
    return {"statistic": stat, "p_value": D.two_sided(n, stat), "ratio": ratio, "ci": (ends[0], ends[1]), "n": [a["n"], b["n"]]}


def bonett(df: DataFrame, value: str, by: str) -> dict:
    """Several groups: log variances weighted by their large-sample errors with a pooled kurtosis."""
    g = _bonett_parts(df, value, by)
    n = sum(r["n"] for r in g)
    k = n * sum(r["q"] for r in g) / sum((r["n"] - 1) * r["v"] for r in g) ** 2
    w = [(r["n"] - 1) / (k - (r["n"] - 3) / r["n"]) for r in g]
    y = [math.log(r["v"]) for r in g]
    mean = sum(a * b for a, b in zip(w, y, strict=True)) / sum(w)
    stat = sum(a * (b - mean) ** 2 for a, b in zip(w, y, strict=True))
    return {"chi2": stat, "df": len(g) - 1, "p_value": D.chi2(len(g) - 1).sf(stat), "kurtosis": k, "groups": [{"group": r["g"], "n": r["n"], "variance": r["v"]} for r in g]}


def equal_variances(df: DataFrame, value: str, by: str, method: str = "levene") -> dict:
    """levene (about medians), bartlett, bonett, bonett2, f or fligner."""
    from ashlar.stats.nonparam import fligner

    return {"levene": B.levene, "bartlett": B.bartlett, "bonett": bonett, "bonett2": bonett2, "f": B.var_test2, "fligner": fligner}[method](df, value, by)


# -- distribution -----------------------------------------------------------------------------------------------
def _kolmogorov(lam: float) -> float:
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101)))) if lam > 0.2 else 1.0


def kolmogorov_smirnov(df: DataFrame, value: str, dist=None) -> dict:
    """One sample against a distribution given whole (the standard normal if none is): the largest distance of the two curves."""
    dist = dist or D.normal()
    n = df.select(clean(F.col(value)).alias("x")).filter("x is not null").groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("c"))
    total = n.agg(F.sum("c")).first()[0] or 0.0
    c = positions.running_sum(n, ["x"], F.col("c"), "to").select("x", "c", "to")

    def gap(batches):
        for b in batches:
            p = np.array([dist.cdf(v) for v in b["x"]])
            up, low = b["to"].to_numpy() / total - p, p - (b["to"].to_numpy() - b["c"].to_numpy()) / total
            yield b.iloc[:1].assign(up=up.max(initial=0.0), low=low.max(initial=0.0))[["up", "low"]]

    r = c.mapInPandas(gap, "up double, low double").agg(F.max("up"), F.max("low")).first()
    d = max(r[0], r[1])
    root = math.sqrt(total)
    return {"d": d, "d_plus": r[0], "d_minus": r[1], "n": int(total), "p_value": _kolmogorov((root + 0.12 + 0.11 / root) * d)}


def anderson_k_sample(df: DataFrame, value: str, by: str) -> dict:
    """Scholz and Stephens' statistic for samples with ties, from running counts of the pooled values."""
    d = df.select(clean(F.col(value)).alias("x"), F.col(by).cast("string").alias("g")).dropna()
    sizes = {r["g"]: r["count"] for r in d.groupBy("g").count().collect()}
    names, k, n = sorted(sizes), len(sizes), sum(sizes.values())
    c = d.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("l"), *[F.count_if(F.col("g") == g).cast("double").alias(f"f{i}") for i, g in enumerate(names)])
    at = positions.running_sum(c, ["x"], F.col("l"), "to")
    for i in range(k):
        at = positions.running_sum(at, ["x"], F.col(f"f{i}"), f"m{i}")
    b = F.col("to") - F.col("l") / 2
    low = b * (n - b) - n * F.col("l") / 4
    terms = [F.col("l") / n * F.pow(n * (F.col(f"m{i}") - F.col(f"f{i}") / 2) - sizes[g] * b, F.lit(2)) / F.when(low > 0, low) for i, g in enumerate(names)]
    r = at.agg(*[F.sum(t).alias(f"s{i}") for i, t in enumerate(terms)]).first()
    a2 = (n - 1) / n * sum(r[f"s{i}"] / sizes[g] for i, g in enumerate(names))
    # mean and variance under equality; harmonic sums by their limits where n is large
    h = math.fsum(1 / i for i in range(1, n)) if n < 1_000_000 else math.log(n - 1) + 0.5772156649015329 + 0.5 / (n - 1)
    gsum = _double_harmonic(n)
    hk = sum(1 / s for s in sizes.values())
    a = (4 * gsum - 6) * (k - 1) + (10 - 6 * gsum) * hk
    bb = (2 * gsum - 4) * k**2 + 8 * h * k + (2 * gsum - 14 * h - 4) * hk - 8 * h + 4 * gsum - 6
    cc = (6 * h + 2 * gsum - 2) * k**2 + (4 * h - 4 * gsum + 6) * k + (2 * h - 6) * hk + 4 * h
    dd = (2 * h + 6) * k**2 - 4 * h * k
    var = (a * n**3 + bb * n**2 + cc * n + dd) / ((n - 1) * (n - 2) * (n - 3))
    m = k - 1
    t = (a2 - m) / math.sqrt(var)
    # fixed values: Scholz and Stephens (1987), table 2: quantiles at 0.25, 0.1, 0.05, 0.025, 0.01 as functions of 1 / sqrt(m)
    b0, b1, b2 = (0.675, 1.281, 1.645, 1.96, 2.326), (-0.245, 0.25, 0.678, 1.149, 1.822), (-0.105, -0.305, -0.362, -0.391, -0.396)
    crit = [x + y / math.sqrt(m) + z / m for x, y, z in zip(b0, b1, b2, strict=True)]
    fit = np.polyfit(crit, np.log([0.25, 0.1, 0.05, 0.025, 0.01]), 2)
    p = 0.25 if t < crit[0] else 0.001 if t > crit[-1] + 2 else float(np.clip(math.exp(np.polyval(fit, t)), 0.001, 0.25))
    return {"a2": a2, "statistic": t, "p_value": p, "k": k, "n": n}


def _double_harmonic(n: int) -> float:
    """Sum over i < j < n of 1 / ((n - i) j)."""
    if n > 1_000_000:
        return math.pi**2 / 6
    j = np.arange(1, n)
    inner = np.cumsum(1 / np.arange(1, n)[::-1])  # over i = 1..: 1 / (n - i)
    return float((inner[:-1] / j[1:]).sum())


def dixon(df: DataFrame, value: str, alternative: str = "two-sided", draws: int = 100_000, seed: int = 1) -> dict:
    """Dixon's ratio of the outer gap to the range, 3 to 30 values; its null distribution is drawn."""
    x = np.sort([r[0] for r in df.select(clean(F.col(value)).alias("x")).filter("x is not null").limit(31).collect()])
    n = len(x)
    if not 3 <= n <= 30:
        raise ValueError("3 to 30 values")

    def ratio(v: np.ndarray) -> np.ndarray:
        span = v[..., -1] - v[..., 0]
        up, low = (v[..., -1] - v[..., -2]) / span, (v[..., 1] - v[..., 0]) / span
        return {"two-sided": np.maximum(up, low), "greater": up, "less": low}[alternative]

    q = float(ratio(x)) if x[-1] > x[0] else 0.0
    null = ratio(np.sort(np.random.default_rng(seed).normal(size=(draws, n)), axis=1))
    up = x[-1] - x[-2] >= x[1] - x[0] if alternative == "two-sided" else alternative == "greater"
    return {"statistic": q, "p_value": float((null >= q).mean()), "critical": float(np.quantile(null, 0.95)), "outlier": float(x[-1] if up else x[0]), "n": n}


# -- order statistics of pairs ----------------------------------------------------------------------------------
def kth_pair_sum(a, b, k: int) -> float:
    """The k-th smallest (from 1) of all a_i + b_j, by bisection on counts: no pair is written down."""
    a, b = np.sort(np.asarray(a, float)), np.sort(np.asarray(b, float))
    if not 1 <= k <= len(a) * len(b):
        raise ValueError("k is out of range")
    lo, hi = a[0] + b[0], a[-1] + b[-1]
    count = lambda v: int(np.searchsorted(b, v - a, "right").sum())
    while count(lo) < k:
        mid = lo + (hi - lo) / 2
        if mid <= lo or mid >= hi:
            break
        lo, hi = (lo, mid) if count(mid) >= k else (mid, hi)
    if count(lo) >= k:
        return float(lo)
    # the smallest sum above lo
    i = np.searchsorted(b, lo - a, "right")
    ok = i < len(b)
    return float((a[ok] + b[i[ok]]).min())


def kth_walsh_average(x, k: int) -> float:
    """The k-th smallest (from 1) of all (x_i + x_j) / 2 with i <= j."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if not 1 <= k <= n * (n + 1) // 2:
        raise ValueError("k is out of range")
    at = np.arange(n)
    count = lambda v: int(np.maximum(np.searchsorted(x, 2 * v - x, "right") - at, 0).sum())
    lo, hi = x[0], x[-1]
    while count(lo) < k:
        mid = lo + (hi - lo) / 2
        if mid <= lo or mid >= hi:
            break
        lo, hi = (lo, mid) if count(mid) >= k else (mid, hi)
    if count(lo) >= k:
        return float(lo)
    i = np.maximum(np.searchsorted(x, 2 * lo - x, "right"), at)
    ok = i < n
    return float(((x[ok] + x[i[ok]]) / 2).min())


def hodges_lehmann(df: DataFrame, value: str, by: str | None = None, most: int = 1_000_000) -> float:
    """Median of the Walsh averages, or of the differences of two groups."""
    if by is None:
        x = np.array([r[0] for r in df.select(clean(F.col(value)).alias("x")).filter("x is not null").limit(most + 1).collect()])
        m = len(x) * (len(x) + 1) // 2
        pick = lambda k: kth_walsh_average(x, k)
    else:
        d, names = _pair(df, value, by)
        rows = d.limit(most + 1).toPandas()
        x, y = (rows.loc[rows["g"] == g, "x"].to_numpy() for g in names)
        m = len(x) * len(y)
        pick = lambda k: kth_pair_sum(x, -y, k)
    return (pick((m + 1) // 2) + pick(m // 2 + 1)) / 2


# -- intervals and power ----------------------------------------------------------------------------------------
def proportion_interval(events: int, trials: int, method: str = "wilson", confidence: float = 0.95) -> tuple[float, float]:
    """wilson, exact (Clopper-Pearson), normal or agresti-coull."""
    if method == "wilson":
        return B.wilson_interval(events, trials, confidence)
    if method in ("exact", "normal"):
        return B.prop_test1(events, trials, confidence=confidence, method=method)["ci"]
    if method != "agresti-coull":
        raise ValueError(f"method: {method}")
    z = D.normal().ppf(1 - (1 - confidence) / 2)
    n = trials + z * z
    p = (events + z * z / 2) / n
    half = z * math.sqrt(p * (1 - p) / n)
    return max(0.0, p - half), min(1.0, p + half)


def poisson_rate_interval(events: int, exposure: float = 1.0, confidence: float = 0.95) -> tuple[float, float]:
    return B.poisson_rate1(events, exposure, confidence=confidence)["ci"]


def power(test: str, n: int | None = None, effect: float | None = None, alpha: float = 0.05, power: float | None = None, groups: int = 2, p0: float = 0.5) -> dict:
    """Power of t1, t2, anova, z, prop1 or prop2; with ``power`` instead of ``n`` the smallest n that reaches it.

    The effect is a difference in standard deviations (t, z), Cohen's f (anova), or the other proportion (prop).
    """
    nd = D.normal()
    q = nd.ppf(1 - alpha / 2)

    def at(m: int) -> float:
        if test in ("t1", "t2"):
            return B.power_t(m, effect, 1.0, alpha, "two" if test == "t2" else "one")
        if test == "anova":
            return B.power_anova(groups, m, effect, alpha)
        if test == "z":
            s = abs(effect) * math.sqrt(m)
            return nd.sf(q - s) + nd.cdf(-q - s)
        if test == "prop1":
            s0, s1 = math.sqrt(p0 * (1 - p0) / m), math.sqrt(effect * (1 - effect) / m)
            return nd.sf((q * s0 - (effect - p0)) / s1) + nd.cdf((-q * s0 - (effect - p0)) / s1)
        if test == "prop2":
            mid = (p0 + effect) / 2
            s0, s1 = math.sqrt(2 * mid * (1 - mid) / m), math.sqrt((p0 * (1 - p0) + effect * (1 - effect)) / m)
            return nd.sf((q * s0 - (effect - p0)) / s1) + nd.cdf((-q * s0 - (effect - p0)) / s1)
        raise ValueError(f"test: {test}")

    if n is None:
        lo, hi = 1, 2
        while at(hi) < power:
            lo, hi = hi, hi * 2
            if hi > 1 << 30:
                raise ValueError("the effect is too small")
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if at(mid) >= power else (mid, hi)
        n = hi
    return {"test": test, "n": n, "effect": effect, "alpha": alpha, "power": at(n)}


def power_study(test: str, ns, effects, **options) -> list[dict]:
    """Power over a grid of sample sizes and effects."""
    return [power(test, n, e, **options) for e in effects for n in ns]


# -- displays: what a chart of each kind shows, as rows -----------------------------------------------------------
def graphical_summary(df: DataFrame, value: str, confidence: float = 0.95) -> dict:
    """Description, normality, intervals of mean, median and standard deviation, and the histogram."""
    from ashlar.stats.nonparam import anderson_darling

    s = B.descriptive_stats(df, value)[0]
    n, a = s["n"], (1 - confidence) / 2
    d = df.select(clean(F.col(value)).alias("x")).filter("x is not null")
    # the median's interval: order statistics by the binomial distribution
    b, k = D.binomial(n, 0.5), 0
    if n <= 100_000:
        while b.cdf(k) <= a:
            k += 1
    else:
        k = int(n / 2 - D.normal().ppf(1 - a) * math.sqrt(n) / 2)
    at = positions.number(d, ["x"], "i").filter(F.col("i").isin([max(0, k - 1), n - max(1, k)])).orderBy("i").collect()
    q = D.chi2(n - 1)
    return {"description": s, "normality": anderson_darling(df, value) if n >= 8 else None, "mean_ci": B.mean_interval(df, value, confidence), "median_ci": (at[0]["x"], at[-1]["x"]), "sd_ci": (s["sd"] * math.sqrt((n - 1) / q.ppf(1 - a)), s["sd"] * math.sqrt((n - 1) / q.ppf(a))), "histogram": B.histogram_bins(df, value)}


def interval_plot(df: DataFrame, value: str, by: str, confidence: float = 0.95) -> list[dict]:
    out = []
    for g, m in moments(df, value, by).items():
        half = D.t(m["n"] - 1).ppf(1 - (1 - confidence) / 2) * math.sqrt(m["var"] / m["n"]) if m["n"] > 1 else math.nan
        out.append({"group": g, "n": m["n"], "mean": m["mean"], "low": m["mean"] - half, "high": m["mean"] + half})
    return out


def main_effects_plot(df: DataFrame, value: str, factors: list[str]) -> list[dict]:
    """The mean at each level of each factor, and of all, in one pass with grouping sets."""
    d = df.select(clean(F.col(value)).alias("x"), *[F.col(f).cast("string").alias(f) for f in factors]).filter("x is not null")
    parts = d.select("x", F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("level")) for f in factors])).alias("k"))
    rows = parts.groupBy("k.factor", "k.level").agg(F.avg("x").alias("mean"), F.count("x").alias("n")).orderBy("factor", "level").collect()
    return [r.asDict() for r in rows]


def interaction_plot(df: DataFrame, value: str, a: str, b: str) -> list[dict]:
    d = df.select(clean(F.col(value)).alias("x"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).dropna()
    return [r.asDict() for r in d.groupBy("a", "b").agg(F.avg("x").alias("mean"), F.count("x").alias("n")).orderBy("a", "b").collect()]


def dotplot(df: DataFrame, value: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """Stacks of dots: a row per group and bin with its middle and count."""
    m = moments(df, value)[None]
    w = (m["max"] - m["min"]) / bins or 1.0
    d = df.select(clean(F.col(value)).alias("x"), (F.col(by).cast("string") if by else F.lit(None).cast("string")).alias("group")).filter("x is not null")
    b = F.least(F.floor((F.col("x") - m["min"]) / w), F.lit(bins - 1))
    return d.groupBy("group", b.alias("bin")).count().select("group", (m["min"] + (F.col("bin") + 0.5) * w).alias("at"), "count")


def cause_and_effect(effect: str, causes: dict[str, list[str]]) -> dict:
    """A fishbone as a tree: the effect, its branches, and their numbers of causes."""
    return {"effect": effect, "branches": [{"name": k, "causes": list(v), "n": len(v)} for k, v in causes.items()], "n": sum(map(len, causes.values()))}


# -- bundles ----------------------------------------------------------------------------------------------------
def binary_sample(df: DataFrame, value: str, event) -> tuple[int, int]:
    """(events, trials) of a column."""
    r = df.agg(F.count_if(F.col(value) == event).alias("e"), F.count(value).alias("n")).first()
    return r["e"], r["n"]


def contingency_analysis(df: DataFrame, a: str, b: str) -> dict:
    """Crosstab, chi-square and likelihood ratio, residuals, and Fisher's test of two-by-two tables."""
    t = B.crosstab(df, a, b)
    c = B.chi2_test(t["table"])
    o, e = t["table"], c["expected"]
    g = 2 * float((o[o > 0] * np.log(o[o > 0] / e[o > 0])).sum())
    out = {"table": t, "chi2": c, "likelihood_ratio": {"g": g, "df": c["df"], "p_value": D.chi2(c["df"]).sf(g)}, "residuals": (o - e) / np.sqrt(e)}
    if o.shape == (2, 2):
        out["fisher"] = B.fisher_exact(o.astype(int).tolist())
    return out


def goodness_of_fit_analysis(df: DataFrame, category: str, expected: dict | None = None) -> dict:
    rows = {str(r[0]): r[1] for r in df.filter(F.col(category).isNotNull()).groupBy(category).count().collect()}
    names = sorted(rows)
    share = [1.0] * len(names) if expected is None else [float(expected[n]) for n in names]
    total = sum(rows.values())
    e = [s / sum(share) * total for s in share]
    cells = [{"category": n, "observed": rows[n], "expected": x, "contribution": (rows[n] - x) ** 2 / x} for n, x in zip(names, e, strict=True)]
    return {"cells": cells, "test": B.chi2_gof([rows[n] for n in names], share)}


def proportion_analysis(df: DataFrame, value: str, event, by: str | None = None, p0: float = 0.5) -> dict:
    """One proportion, or one per group with the test of two."""
    if by is None:
        e, n = binary_sample(df, value, event)
        return {"events": e, "trials": n, "test": B.prop_test1(e, n, p0, method="normal" if n > 100_000 else "exact")}
    rows = df.filter(F.col(value).isNotNull() & F.col(by).isNotNull()).groupBy(F.col(by).cast("string").alias("g")).agg(F.count_if(F.col(value) == event).alias("e"), F.count(F.lit(1)).alias("n")).orderBy("g").collect()
    groups = [{"group": r["g"], "events": r["e"], "trials": r["n"], "ci": B.wilson_interval(r["e"], r["n"])} for r in rows]
    test = B.prop_test2(rows[0]["e"], rows[0]["n"], rows[1]["e"], rows[1]["n"]) if len(rows) == 2 else B.chi2_test([[r["e"], r["n"] - r["e"]] for r in rows])
    return {"groups": groups, "test": test}


def variance_summary_analysis(df: DataFrame, value: str, by: str | None = None, confidence: float = 0.95) -> list[dict]:
    """Standard deviations with chi-square intervals."""
    a, out = (1 - confidence) / 2, []
    for g, m in moments(df, value, by).items():
        q = D.chi2(m["n"] - 1)
        out.append({"group": g, "n": m["n"], "variance": m["var"], "sd": math.sqrt(m["var"]), "ci": (math.sqrt((m["n"] - 1) * m["var"] / q.ppf(1 - a)), math.sqrt((m["n"] - 1) * m["var"] / q.ppf(a)))})
    return out


def variance_analysis(df: DataFrame, value: str, by: str) -> dict:
    """The summary with every test of equal variances that the number of groups allows."""
    s = variance_summary_analysis(df, value, by)
    tests = {"levene": B.levene(df, value, by), "bartlett": B.bartlett(df, value, by), "bonett": bonett(df, value, by)}
    if len(s) == 2:
        tests |= {"f": B.var_test2(df, value, by), "bonett2": bonett2(df, value, by)}
    return {"summary": s, "tests": tests}
