"""Rank tests and tests of normality. Ranks are distributed (ties are folded before ranking); formulas run on sums."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.operators import positions
from ashlar.stats import dist as D
from ashlar.stats.basic import clean, moments


def _ranked(df: DataFrame, value: str, by: str):
    d = positions.average_rank(df.select(clean(F.col(value)).alias("x"), F.col(by).cast("string").alias("g")).dropna(), "x", "r")
    ties = d.groupBy("x").count().agg(F.sum(F.pow("count", F.lit(3)) - F.col("count"))).first()[0] or 0.0
    return d.groupBy("g").agg(F.count("x").alias("n"), F.sum("r").alias("w"), F.sum(F.col("r") * F.col("r")).alias("q")).orderBy("g").collect(), ties


def mann_whitney(df, value, by, alternative="two-sided") -> dict:
    """U of the first group; normal approximation with ties and continuity."""
    g, ties = _ranked(df, value, by)
    if len(g) != 2:
        raise ValueError("two groups are needed")
    n1, n2 = g[0]["n"], g[1]["n"]
    n, u = n1 + n2, g[0]["w"] - n1 * (n1 + 1) / 2
    mid, sd = n1 * n2 / 2, math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    shift = {"two-sided": math.copysign(min(0.5, abs(u - mid)), u - mid), "greater": 0.5, "less": -0.5}[alternative]
    z = (u - mid - shift) / sd if sd else 0.0
    return {"u": u, "w": g[0]["w"], "z": z, "p_value": D.two_sided(D.normal(), z, alternative)}


def kruskal(df, value, by) -> dict:
    g, ties = _ranked(df, value, by)
    n = sum(x["n"] for x in g)
    h = 12 / (n * (n + 1)) * sum(x["w"] ** 2 / x["n"] for x in g) - 3 * (n + 1)
    h /= 1 - ties / (n**3 - n) if n > 1 else 1
    return {"h": h, "df": len(g) - 1, "p_value": D.chi2(len(g) - 1).sf(h), "mean_ranks": {x["g"]: x["w"] / x["n"] for x in g}}


def mood_median(df, value, by) -> dict:
    from ashlar.stats.basic import chi2_test

    d = df.select(clean(F.col(value)).alias("x"), F.col(by).cast("string").alias("g")).dropna()
    m = d.agg(F.percentile("x", F.lit(0.5))).first()[0]
    t = d.groupBy("g").agg(F.count_if(F.col("x") <= m).alias("low"), F.count_if(F.col("x") > m).alias("high")).orderBy("g").collect()
    return chi2_test([[r["low"], r["high"]] for r in t]) | {"median": m}


def sign_test(df, value, median=0.0, alternative="two-sided") -> dict:
    x = clean(F.col(value))
    r = df.agg(F.count_if(x > median).alias("a"), F.count_if(x < median).alias("b")).first()
    n, k = r["a"] + r["b"], r["a"]
    b = D.binomial(n, 0.5)
    less, more = b.cdf(k), 1 - b.cdf(k - 1)
    return {"above": k, "below": r["b"], "p_value": {"less": less, "greater": more, "two-sided": min(1.0, 2 * min(less, more))}[alternative]}


def wilcoxon_signed(df, value, median=0.0, alternative="two-sided") -> dict:
    d = df.select((clean(F.col(value)) - F.lit(float(median))).alias("d")).filter("d <> 0").withColumn("a", F.abs("d"))
    d = positions.average_rank(d, "a", "r")
    ties = d.groupBy("a").count().agg(F.sum(F.pow("count", F.lit(3)) - F.col("count"))).first()[0] or 0.0
    r = d.agg(F.count("d").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w")).first()
    n, w = r["n"], r["w"] or 0.0
    mid, sd = n * (n + 1) / 4, math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    shift = {"two-sided": math.copysign(min(0.5, abs(w - mid)), w - mid), "greater": 0.5, "less": -0.5}[alternative]
    z = (w - mid - shift) / sd if sd else 0.0
    return {"w": w, "n": n, "z": z, "p_value": D.two_sided(D.normal(), z, alternative)}


def friedman(df, value, treatment, block) -> dict:
    """Ranks within blocks, which are small, by a window."""
    from pyspark.sql import Window

    d = df.select(clean(F.col(value)).alias("x"), F.col(treatment).cast("string").alias("t"), F.col(block).alias("b")).dropna()
    w = Window.partitionBy("b").orderBy("x")
    n_ties = F.count(F.lit(1)).over(Window.partitionBy("b", "x"))
    d = d.withColumn("r", F.rank().over(w) + (n_ties - 1) / 2)
    g = d.groupBy("t").agg(F.sum("r").alias("s")).orderBy("t").collect()
    n = d.select("b").distinct().count()
    k = len(g)
    ties = d.groupBy("b", "x").count().agg(F.sum(F.pow("count", F.lit(3)) - F.col("count"))).first()[0]
    s = 12 / (n * k * (k + 1)) * sum(x["s"] ** 2 for x in g) - 3 * n * (k + 1)
    s /= 1 - ties / (n * (k**3 - k))
    return {"s": s, "df": k - 1, "p_value": D.chi2(k - 1).sf(s), "rank_sums": {x["t"]: x["s"] for x in g}}


def runs_test(df, value, order, cut=None) -> dict:
    """Runs above and below the mean (or ``cut``) in the order of ``order``."""
    from pyspark.sql import Window

    cut = moments(df, value)[None]["mean"] if cut is None else cut
    d = df.select(clean(F.col(value)).alias("x"), F.col(order).alias("o")).filter("x is not null")
    d = d.withColumn("up", (F.col("x") > cut).cast("int"))
    # runs are counted per slice of the order; slices meet at their ends
    cuts = positions.boundaries(d, "o")
    d = d.withColumn("b", positions.bucket(d, "o", cuts))
    w = Window.partitionBy("b").orderBy("o")
    d = d.withColumn("new", (F.col("up") != F.lag("up").over(w)).cast("int"))
    s = d.groupBy("b").agg(F.sum("new").alias("c"), F.min_by("up", "o").alias("first"), F.max_by("up", "o").alias("last"), F.sum("up").alias("up"), F.count("x").alias("n")).orderBy("b").collect()
    runs = 1 + sum(x["c"] or 0 for x in s) + sum(a["last"] != b["first"] for a, b in zip(s, s[1:], strict=False))
    n, n1 = sum(x["n"] for x in s), sum(x["up"] for x in s)
    n2 = n - n1
    mean, var = 1 + 2 * n1 * n2 / n, 2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1))
    z = (runs - mean) / math.sqrt(var)
    return {"runs": runs, "expected": mean, "above": n1, "below": n2, "z": z, "p_value": D.two_sided(D.normal(), z)}


def ks_two_sample(df, value, by) -> dict:
    d = df.select(clean(F.col(value)).alias("x"), F.col(by).cast("string").alias("g")).dropna()
    names = [r[0] for r in d.select("g").distinct().orderBy("g").collect()]
    if len(names) != 2:
        raise ValueError("two groups are needed")
    c = d.groupBy("x").agg(*[F.count_if(F.col("g") == g).cast("double").alias(f"n{i}") for i, g in enumerate(names)])
    n = c.agg(F.sum("n0"), F.sum("n1")).first()
    step = F.col("n0") / n[0] - F.col("n1") / n[1]
    stat = positions.running_sum(c, ["x"], step, "d").agg(F.max(F.abs("d"))).first()[0]
    e = math.sqrt(n[0] * n[1] / (n[0] + n[1]))
    lam = stat * e
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101)) if lam > 0.2 else 1.0
    return {"d": stat, "p_value": min(1.0, max(0.0, p))}


# -- normality --------------------------------------------------------------------------------------------------
def _normal_p(a: float) -> float:
    if a >= 13:
        return 0.0
    if a >= 0.6:
        return math.exp(1.2937 - 5.709 * a + 0.0186 * a * a)
    if a > 0.34:
        return math.exp(0.9177 - 4.279 * a - 1.38 * a * a)
    if a > 0.2:
        return 1 - math.exp(-8.318 + 42.796 * a - 59.938 * a * a)
    return 1 - math.exp(-13.436 + 101.14 * a - 223.73 * a * a)


def anderson_darling(df, value) -> dict:
    """Positions are numbered in two phases and the normal tails computed in Arrow batches, so any size will do."""
    m = moments(df, value)[None]
    n, mean, sd = m["n"], m["mean"], math.sqrt(m["var"])
    if n < 8:
        raise ValueError("at least 8 values are needed")
    d = positions.number(df.select(clean(F.col(value)).alias("x")).filter("x is not null"), ["x"], "i")

    def term(batches):
        for b in batches:
            z = (b["x"].to_numpy() - mean) / sd
            lo = np.log(np.maximum([D.normal().cdf(v) for v in z], 1e-300))
            hi = np.log(np.maximum([D.normal().sf(v) for v in z], 1e-300))
            i = b["i"].to_numpy()
            yield b.iloc[:1].assign(s=float(((2 * i + 1) * lo + (2 * (n - i) - 1) * hi).sum()))[["s"]]

    a = -n - (d.mapInPandas(term, "s double").agg(F.sum("s")).first()[0]) / n
    star = a * (1 + 0.75 / n + 2.25 / n**2)
    return {"a2": a, "a2_adjusted": star, "p_value": min(1.0, max(0.0, _normal_p(star))), "n": n}


def jarque_bera(df, value) -> dict:
    m = moments(df, value)[None]
    jb = m["n"] / 6 * (m["skew"] ** 2 + m["kurt"] ** 2 / 4)
    return {"jb": jb, "skewness": m["skew"], "kurtosis": m["kurt"], "p_value": D.chi2(2).sf(jb)}


def dagostino_k2(df, value) -> dict:
    """From skewness and raw kurtosis, as published."""
    m = moments(df, value)[None]
    n, g1, b2 = m["n"], m["skew"], m["kurt"] + 3
    y = g1 * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (beta - 1))
    z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(math.log(math.sqrt(w2)))
    e, v = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (b2 - e) / math.sqrt(v)
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / s * (2 / s + math.sqrt(1 + 4 / s**2))
    z2 = (1 - 2 / (9 * a) - np.cbrt((1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4))))) / math.sqrt(2 / (9 * a))
    k = z1 * z1 + float(z2) ** 2
    return {"k2": k, "z_skewness": z1, "z_kurtosis": float(z2), "p_value": D.chi2(2).sf(k)}


def normality_test(df, value, method="anderson-darling") -> dict:
    return {"anderson-darling": anderson_darling, "jarque-bera": jarque_bera, "dagostino": dagostino_k2}[method](df, value)


def _values(df, value, most: int) -> np.ndarray:
    x = df.select(clean(F.col(value)).alias("x")).filter("x is not null").orderBy("x").limit(most + 1).toArrow()["x"].to_numpy()
    if len(x) > most:
        raise ValueError(f"this test is for at most {most} values")
    return x


def shapiro_wilk(df, value) -> dict:
    """Royston's approximation, 4 to 5000 values."""
    x = _values(df, value, 5000)
    n = len(x)
    if n < 4:
        raise ValueError("at least 4 values are needed")
    nd = D.normal()
    m = np.array([nd.ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, s = 1 / math.sqrt(n), float(m @ m)
    a = m / math.sqrt(s)
    last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, a[-1]], u)
    if n > 5:
        second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, a[-2]], u)
        phi = (s - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
        a = m / math.sqrt(phi)
        a[[0, 1, -2, -1]] = -last, -second, second, last
    else:
        a = m / math.sqrt((s - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[[0, -1]] = -last, last
    w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    if n > 11:
        l = math.log(n)
        mu, sd, y = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], l), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], l)), math.log(1 - w)
    else:
        g = -2.273 + 0.459 * n
        mu, sd, y = np.polyval([-0.0006714, 0.025054, -0.39978, 0.544], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n)), -math.log(g - math.log(1 - w))
    return {"w": w, "p_value": nd.sf((y - mu) / sd), "n": n}


def ryan_joiner(df, value, most: int = 100_000) -> dict:
    """Correlation with normal scores."""
    x = _values(df, value, most)
    n = len(x)
    b = np.array([D.normal().ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    return {"r": float((x @ b) / math.sqrt(((x - x.mean()) ** 2).sum() * (b @ b))), "n": n}


def lilliefors(df, value, most: int = 1_000_000) -> dict:
    """Kolmogorov-Smirnov distance to the fitted normal, with the Dallal-Wilkinson p-value (exact below 0.1)."""
    x = _values(df, value, most)
    n = len(x)
    p = np.array([D.normal().cdf(v) for v in (x - x.mean()) / x.std(ddof=1)])
    i = np.arange(1, n + 1)
    d = float(max((i / n - p).max(), (p - (i - 1) / n).max()))
    dd, m = (d, n) if n <= 100 else (d * (n / 100) ** 0.49, 100)
    pv = math.exp(-7.01256 * dd * dd * (m + 2.78019) + 2.99587 * dd * math.sqrt(m + 2.78019) - 0.122119 + 0.974598 / math.sqrt(m) + 1.67997 / m)
    return {"d": d, "p_value": min(1.0, pv)}


def cramer_von_mises(df, value, most: int = 1_000_000) -> dict:
    x = _values(df, value, most)
    n = len(x)
    p = np.array([D.normal().cdf(v) for v in (x - x.mean()) / x.std(ddof=1)])
    w = float(1 / (12 * n) + ((p - (2 * np.arange(1, n + 1) - 1) / (2 * n)) ** 2).sum())
    s = w * (1 + 0.5 / n)
    pv = 1 - math.exp(-13.953 + 775.5 * s - 12542.61 * s * s) if s < 0.0275 else 1 - math.exp(-5.903 + 179.546 * s - 1515.29 * s * s) if s < 0.051 else math.exp(0.886 - 31.62 * s + 10.897 * s * s) if s < 0.092 else math.exp(1.111 - 34.242 * s + 12.832 * s * s) if s < 1.1 else 7.37e-10
    return {"w2": w, "p_value": min(1.0, max(0.0, pv))}


def fligner(df, value, by) -> dict:
    """Fligner-Killeen: normal scores of the ranks of absolute deviations from the medians; distributed."""
    d = df.select(clean(F.col(value)).alias("x"), F.col(by).cast("string").alias("g")).dropna()
    m = d.groupBy("g").agg(F.percentile("x", F.lit(0.5)).alias("m"))
    d = positions.average_rank(d.join(m, "g").select("g", F.abs(F.col("x") - F.col("m")).alias("a")), "a", "r")
    n = d.count()

    def score(batches):
        for b in batches:
            yield b.assign(s=[D.normal().ppf(0.5 + r / (2 * (n + 1))) for r in b["r"]])[["g", "s"]]

    s = d.select("g", "r").mapInPandas(score, "g string, s double")
    t = s.agg(F.avg("s"), F.var_samp("s")).first()
    g = s.groupBy("g").agg(F.count("s").alias("n"), F.avg("s").alias("m")).collect()
    stat = sum(r["n"] * (r["m"] - t[0]) ** 2 for r in g) / t[1]
    return {"chi2": stat, "df": len(g) - 1, "p_value": D.chi2(len(g) - 1).sf(stat)}


def brunner_munzel(df, value, by) -> dict:
    """Overall and within-group ranks, all from distributed ranks and one aggregate."""
    d = df.select(clean(F.col(value)).alias("x"), F.col(by).cast("string").alias("g")).dropna()
    names = [r[0] for r in d.select("g").distinct().orderBy("g").collect()]
    if len(names) != 2:
        raise ValueError("two groups are needed")
    d = positions.average_rank(d, "x", "r")
    parts = [positions.average_rank(d.filter(F.col("g") == g), "x", "q").agg(F.count("x").alias("n"), F.avg("r").alias("m"), F.var_samp(F.col("r") - F.col("q")).alias("v")).first() for g in names]
    (n1, m1, v1), (n2, m2, v2) = parts
    n = n1 + n2
    stat = n1 * n2 * (m2 - m1) / (n * math.sqrt(n1 * v1 + n2 * v2))
    k = (n1 * v1 + n2 * v2) ** 2 / ((n1 * v1) ** 2 / (n1 - 1) + (n2 * v2) ** 2 / (n2 - 1))
    return {"statistic": stat, "df": k, "p_value": D.two_sided(D.t(k), stat), "estimate": (m2 - m1) / n + 0.5}
