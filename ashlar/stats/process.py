"""Charts by name, staged charts, capability beyond the normal distribution, and measurement studies of any layout."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from ashlar.operators import positions
from ashlar.stats import basic as B
from ashlar.stats import dist as D
from ashlar.stats import spc as Q
from ashlar.stats.basic import clean, moments


# -- charts -----------------------------------------------------------------------------------------------------
def control_chart(df: DataFrame, kind: str, value: str, subgroup: str | None = None, order: str | None = None, size: str | None = None, **options):
    """imr, xbar-r, xbar-s, p, np, c, u, ewma, cusum, ma, g or t."""
    if kind == "imr":
        return Q.imr_chart(df, value, order)
    if kind in ("xbar-r", "xbar-s"):
        return Q.xbar_chart(df, value, subgroup, kind[-1].upper())
    if kind in ("p", "np", "c", "u"):
        return Q.attribute_chart(df, kind, value, size)
    one = {"ewma": Q.ewma, "cusum": Q.cusum, "ma": Q.moving_average_chart, "g": Q.g_chart, "t": Q.t_chart}
    return one[kind](df, value, order, **options)


def staged_control_chart(df: DataFrame, value: str, order: str, stage: str) -> list[dict]:
    """Individuals limits per stage: centre, sigma from moving ranges within the stage, and points beyond three sigma."""
    d = df.select(clean(F.col(value)).alias("x"), F.col(order).alias("o"), F.col(stage).cast("string").alias("s")).dropna()
    d = d.withColumn("mr", F.abs(F.col("x") - F.lag("x").over(Window.partitionBy("s").orderBy("o"))))
    lim = d.groupBy("s").agg(F.count("x").alias("n"), F.avg("x").alias("m"), (F.avg("mr") / Q.D2[0]).alias("sd"), F.min("o").alias("first"))
    out = d.join(lim, "s").groupBy("s").agg(F.count_if(F.abs(F.col("x") - F.col("m")) > 3 * F.col("sd")).alias("out"))
    rows = lim.join(out, "s").orderBy("first").collect()
    return [{"stage": r["s"], "n": r["n"], "centre": r["m"], "sigma": r["sd"], "ucl": r["m"] + 3 * r["sd"], "lcl": r["m"] - 3 * r["sd"], "out": r["out"]} if r["sd"] is not None else {"stage": r["s"], "n": r["n"], "centre": r["m"], "sigma": None, "ucl": None, "lcl": None, "out": 0} for r in rows]


def generalized_variance_limits(df: DataFrame, xs: list[str], subgroup: str) -> dict:
    """Determinants of the subgroups' covariance matrices as a table ``points``, with limits from their pooled matrix.

    Only the pooled matrix and the number of ``subgroups`` reach the driver, so there may be any number of them.
    """
    p = len(xs)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    d = df.select(F.col(subgroup).alias("g"), *[clean(F.col(x)).alias(f"x{i}") for i, x in enumerate(xs)]).dropna()
    per = d.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.covar_samp(f"x{i}", f"x{j}").alias(f"s{i}_{j}") for i, j in pairs])
    r = per.agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n"), F.max("n").alias("most"), *[F.avg(f"s{i}_{j}").alias(f"s{i}_{j}") for i, j in pairs]).first()
    n = r["n"]
    if n is None or n != r["most"] or n <= p:
        raise ValueError("subgroups of one size above the number of variables are needed")
    pooled = float(np.linalg.det(np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])))
    b1 = math.prod((n - i) / (n - 1) for i in range(1, p + 1))
    b2 = (n - 1) ** (-2 * p) * math.prod(n - i for i in range(1, p + 1)) * (math.prod(n - j + 2 for j in range(1, p + 1)) - math.prod(n - j for j in range(1, p + 1)))
    centre, half = pooled, 3 * pooled / b1 * math.sqrt(b2)
    ucl, lcl = centre + half, max(0.0, centre - half)

    def run(batches):
        for t in batches:
            m = np.stack([t[f"s{min(i, j)}_{max(i, j)}"].to_numpy(float) for i in range(p) for j in range(p)], 1).reshape(-1, p, p)
            v = np.linalg.det(m)
            yield t[["g"]].rename(columns={"g": "subgroup"}).assign(value=v, out=(v > ucl) | (v < lcl))

    points = per.mapInPandas(run, StructType([StructField("subgroup", d.schema["g"].dataType), StructField("value", DoubleType()), StructField("out", BooleanType())]))
    return {"centre": centre, "ucl": ucl, "lcl": lcl, "subgroups": r["k"], "points": points}


def generalized_variance_chart(df: DataFrame, xs: list[str], subgroup: str) -> dict:
    """``generalized_variance_limits`` with the points as a list in the order of the subgroups, for charts that are drawn."""
    r = generalized_variance_limits(df, xs, subgroup)
    return r | {"points": [t.asDict() for t in r["points"].orderBy("subgroup").collect()]}  # a row a plotted point


def within_estimate(df: DataFrame, value: str, order: str | None = None, subgroup: str | None = None, method: str = "pooled") -> float:
    """Within standard deviation: pooled, rbar or sbar over subgroups; moving-range or its median over an order."""
    if subgroup is None:
        mr = quality_moving_ranges(df, value, order)
        return mr.agg(F.avg("mr")).first()[0] / Q.D2[0] if method != "median-moving-range" else mr.agg(F.percentile("mr", F.lit(0.5))).first()[0] / 0.954
    if method in ("rbar", "sbar"):
        return Q.xbar_chart(df, value, subgroup, method[0].upper())["sigma"]
    d = df.select(clean(F.col(value)).alias("x"), F.col(subgroup).alias("g")).dropna()
    r = d.groupBy("g").agg(F.count("x").alias("n"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("v")).agg(F.sum((F.col("n") - 1) * F.col("v")).alias("s"), F.sum(F.col("n") - 1).alias("d")).first()
    sd, k = math.sqrt(r["s"] / r["d"]), r["d"] + 1
    return sd / (math.sqrt(2 / (k - 1)) * math.exp(math.lgamma(k / 2) - math.lgamma((k - 1) / 2)))


def quality_moments(df: DataFrame, value: str) -> dict:
    m = moments(df, value)[None]
    return {"n": m["n"], "mean": m["mean"], "sd": math.sqrt(m["var"]), "skewness": m["skew"], "kurtosis": m["kurt"], "min": m["min"], "max": m["max"]}


def quality_moving_ranges(df: DataFrame, value: str, order: str) -> DataFrame:
    """(o, mr) of every point but the first; neighbours meet within blocks of numbered rows, so no task orders all."""
    d = positions.number(df.select(F.col(order).alias("o"), clean(F.col(value)).alias("x")).filter("x is not null"), ["o"], "i")
    b = F.floor(F.col("i") / 65536)
    both = d.select("o", "x", "i", F.explode(F.array(F.struct(b.alias("b"), F.lit(True).alias("own")), F.struct(F.when(F.col("i") % 65536 == 65535, b + 1).alias("b"), F.lit(False).alias("own")))).alias("k")).select("o", "x", "i", "k.*").filter("b is not null")
    w = Window.partitionBy("b").orderBy("i")
    return both.withColumn("mr", F.abs(F.col("x") - F.lag("x").over(w))).filter("own and i > 0").select("o", "mr")


def process_control_chart(df: DataFrame, value: str, order: str | None = None, subgroup: str | None = None, kind: str | None = None) -> dict:
    """The chart that fits the data's layout: individuals without subgroups, ranges up to eight, standard deviations beyond."""
    if subgroup is None:
        return {"kind": "imr"} | Q.imr_chart(df, value, order)
    size = df.groupBy(subgroup).count().agg(F.avg("count")).first()[0]
    kind = kind or ("xbar-r" if size <= 8 else "xbar-s")
    return {"kind": kind} | Q.xbar_chart(df, value, subgroup, kind[-1].upper())


def multi_vari(df: DataFrame, value: str, factors: list[str]) -> list[dict]:
    """Means at every level of nesting, the outermost factor first."""
    d = df.select(clean(F.col(value)).alias("x"), *[F.col(f).cast("string").alias(f) for f in factors]).dropna()
    out = []
    for k in range(len(factors) + 1):
        keys = factors[:k]
        means = (d.groupBy(*keys) if keys else d.groupBy()).agg(F.avg("x").alias("mean"), F.count("x").alias("n"))
        rows = (means.orderBy(*keys) if keys else means).collect()
        out += [{"levels": tuple(r[f] for f in keys), "mean": r["mean"], "n": r["n"]} for r in rows]
    return out


def quality_histogram(df: DataFrame, value: str, lsl: float | None = None, usl: float | None = None, bins: int | None = None) -> dict:
    """Bins with the counts a normal of the sample's mean and deviation would give, and the shares outside the limits."""
    m = quality_moments(df, value)
    n = D.normal(m["mean"], m["sd"])
    rows = [r | {"expected": m["n"] * (n.cdf(r["high"]) - n.cdf(r["low"]))} for r in B.histogram_bins(df, value, bins)]
    x = clean(F.col(value))
    out = df.agg(*[(F.count_if(c) if c is not None else F.lit(0)).alias(k) for k, c in (("low", x < lsl if lsl is not None else None), ("high", x > usl if usl is not None else None))]).first()
    return {"bins": rows, "below": out["low"] / m["n"], "above": out["high"] / m["n"], "moments": m}


def normal_qq(df: DataFrame, value: str) -> DataFrame:
    """(x, z): every value with the normal score of its position, numbered in two phases."""
    d = positions.number(df.select(clean(F.col(value)).alias("x")).filter("x is not null"), ["x"], "i")
    n = d.count()
    normal = D.normal()

    def score(batches):
        for b in batches:
            yield b.assign(z=[normal.ppf((i + 1 - 0.375) / (n + 0.25)) for i in b["i"]])[["x", "z"]]

    return d.mapInPandas(score, "x double, z double")


def symmetry_test(df: DataFrame, value: str) -> dict:
    """Mean less median over its large-sample error (Miao, Gel and Gastwirth)."""
    x = clean(F.col(value))
    r = df.agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.percentile(x, F.lit(0.5)).alias("med")).first()
    j = math.sqrt(math.pi / 2) * df.agg(F.avg(F.abs(x - r["med"]))).first()[0]
    t = math.sqrt(r["n"]) * (r["m"] - r["med"]) / (j * math.sqrt(math.pi / 2 - 1))
    return {"statistic": t, "mean": r["m"], "median": r["med"], "p_value": D.two_sided(D.normal(), t)}


# -- distributions of a process -----------------------------------------------------------------------------------
def _moment_fits(df: DataFrame, value: str) -> dict:
    """Distributions fitted by sums alone; those that need positive values are left out where there are others."""
    x = clean(F.col(value))
    m = moments(df, value)[None]
    sd = math.sqrt(m["var"])
    fits = {"normal": D.normal(m["mean"], sd), "logistic": D.logistic(m["mean"], sd * math.sqrt(3) / math.pi), "gumbel": D.gumbel(m["mean"] - 0.5772156649015329 * sd * math.sqrt(6) / math.pi, sd * math.sqrt(6) / math.pi), "smallest extreme value": D.smallest_extreme_value(m["mean"] + 0.5772156649015329 * sd * math.sqrt(6) / math.pi, sd * math.sqrt(6) / math.pi)}
    if m["min"] > 0:
        from ashlar.stats.reliability import weibull_fit

        r = df.agg(F.avg(F.log(x)).alias("l"), F.stddev_samp(F.log(x)).alias("s")).first()
        w = weibull_fit(df, value)
        # the gamma's shape by Newton from its closed approximation
        g = math.log(m["mean"]) - r["l"]
        k = (3 - g + math.sqrt((g - 3) ** 2 + 24 * g)) / (12 * g)
        for _ in range(50):
            h = 1e-5 * k
            psi = (math.lgamma(k + h) - math.lgamma(k - h)) / (2 * h)
            tri = (math.lgamma(k + h) - 2 * math.lgamma(k) + math.lgamma(k - h)) / (h * h)
            step = (math.log(k) - psi - g) / (1 / k - tri)
            k -= step
            if abs(step) < 1e-9 * k:
                break
        fits |= {"lognormal": D.lognormal(r["l"], r["s"]), "weibull": D.weibull(w["shape"], w["scale"]), "exponential": D.exponential(m["mean"]), "gamma": D.gamma(k, m["mean"] / k)}
    return fits


def fitted_ad(df: DataFrame, value: str, dist) -> dict:
    """Anderson-Darling distance of the values to a given distribution, by numbered positions in Arrow batches."""
    d = positions.number(df.select(clean(F.col(value)).alias("x")).filter("x is not null"), ["x"], "i")
    n = d.count()

    def term(batches):
        for b in batches:
            lo = np.log(np.maximum([dist.cdf(v) for v in b["x"]], 1e-300))
            hi = np.log(np.maximum([dist.sf(v) for v in b["x"]], 1e-300))
            i = b["i"].to_numpy()
            yield b.iloc[:1].assign(s=float(((2 * i + 1) * lo + (2 * (n - i) - 1) * hi).sum()))[["s"]]

    return {"a2": -n - d.mapInPandas(term, "s double").agg(F.sum("s")).first()[0] / n, "n": n}


def fit_capability_distribution(df: DataFrame, value: str, name: str):
    return _moment_fits(df, value)[name]


def individual_distribution_id(df: DataFrame, value: str) -> list[dict]:
    """Every distribution that fits the sign of the values, by rising Anderson-Darling distance."""
    return sorted(({"distribution": k, "a2": fitted_ad(df, value, f)["a2"]} for k, f in _moment_fits(df, value).items()), key=lambda r: r["a2"])


def nonnormal_capability(df: DataFrame, value: str, lsl: float | None = None, usl: float | None = None, distribution: str = "weibull") -> dict:
    """Indices from the fitted 0.135, 50 and 99.865 percentiles."""
    f = fit_capability_distribution(df, value, distribution)
    lo, mid, hi = f.ppf(0.00135), f.ppf(0.5), f.ppf(0.99865)
    ppl = (mid - lsl) / (mid - lo) if lsl is not None else math.inf
    ppu = (usl - mid) / (hi - mid) if usl is not None else math.inf
    ppm = 1e6 * ((f.cdf(lsl) if lsl is not None else 0.0) + (f.sf(usl) if usl is not None else 0.0))
    return {"distribution": distribution, "percentiles": (lo, mid, hi), "pp": (usl - lsl) / (hi - lo) if None not in (lsl, usl) else math.nan, "ppl": ppl, "ppu": ppu, "ppk": min(ppl, ppu), "ppm_expected": ppm}


def johnson_fit(df: DataFrame, value: str, z: float = 0.524) -> dict:
    """Slifker and Shapiro's choice of SU, SB or SL from four percentiles; the transformation makes the values near normal."""
    nd = D.normal()
    at = [nd.cdf(k * z) for k in (-3, -1, 1, 3)]
    a, b, c, d = df.agg(F.percentile(clean(F.col(value)), F.array(*[F.lit(p) for p in at])).alias("q")).first()["q"]
    m, n, p = d - c, b - a, c - b
    r = m * n / p**2
    if abs(r - 1) < 0.02:
        eta = 2 * z / math.log(m / p)
        gamma = eta * math.log((m / p - 1) / (p * math.sqrt(m / p)))
        eps = (b + c) / 2 - p / 2 * (m / p + 1) / (m / p - 1)
        return {"kind": "SL", "gamma": gamma, "eta": eta, "epsilon": eps, "transform": lambda x: gamma + eta * math.log(x - eps)}
    if r > 1:
        eta = 2 * z / math.acosh((m / p + n / p) / 2)
        gamma = eta * math.asinh((n / p - m / p) / (2 * math.sqrt(r - 1)))
        lam = 2 * p * math.sqrt(r - 1) / ((m / p + n / p - 2) * math.sqrt(m / p + n / p + 2))
        eps = (b + c) / 2 + p * (n / p - m / p) / (2 * (m / p + n / p - 2))
        return {"kind": "SU", "gamma": gamma, "eta": eta, "lambda": lam, "epsilon": eps, "transform": lambda x: gamma + eta * math.asinh((x - eps) / lam)}
    u, v = p / m, p / n
    eta = z / math.acosh(math.sqrt((1 + u) * (1 + v)) / 2)
    gamma = eta * math.asinh((v - u) * math.sqrt((1 + u) * (1 + v) - 4) / (2 * (u * v - 1)))
    lam = p * math.sqrt(((1 + u) * (1 + v) - 2) ** 2 - 4) / (u * v - 1)
    eps = (b + c) / 2 - lam / 2 + p * (v - u) / (2 * (u * v - 1))
    return {"kind": "SB", "gamma": gamma, "eta": eta, "lambda": lam, "epsilon": eps, "transform": lambda x: gamma + eta * math.log((x - eps) / (lam + eps - x))}


def between_within_capability(df: DataFrame, value: str, subgroup: str, lsl: float | None = None, usl: float | None = None) -> dict:
    """Between from the moving ranges of subgroup means less their within share; indices from both together."""
    d = df.select(clean(F.col(value)).alias("x"), F.col(subgroup).alias("g")).dropna()
    within = within_estimate(df, value, subgroup=subgroup)
    means = d.groupBy("g").agg(F.avg("x").alias("m"), F.count("x").alias("n"))
    size = means.agg(F.avg("n")).first()[0]
    sx = quality_moving_ranges(means, "m", "g").agg(F.avg("mr")).first()[0] / Q.D2[0]
    between = math.sqrt(max(0.0, sx**2 - within**2 / size))
    both = math.hypot(between, within)
    m = moments(df, value)[None]
    up = (usl - m["mean"]) / (3 * both) if usl is not None else math.inf
    lo = (m["mean"] - lsl) / (3 * both) if lsl is not None else math.inf
    return {"between": between, "within": within, "between_within": both, "overall": math.sqrt(m["var"]), "cp": (usl - lsl) / (6 * both) if None not in (lsl, usl) else math.nan, "cpl": lo, "cpu": up, "cpk": min(lo, up)}


def capability_sixpack(df: DataFrame, value: str, subgroup: str, lsl: float | None = None, usl: float | None = None) -> dict:
    """Chart, spread chart, last subgroups, histogram, normality and indices together."""
    chart = Q.xbar_chart(df, value, subgroup)
    from ashlar.stats.nonparam import anderson_darling

    last = df.select(clean(F.col(value)).alias("x"), F.col(subgroup).alias("g")).dropna().groupBy("g").agg(F.sort_array(F.collect_list("x")).alias("values")).orderBy(F.desc("g")).limit(25).collect()
    return {"chart": chart, "last_subgroups": [r.asDict() for r in last][::-1], "histogram": quality_histogram(df, value, lsl, usl), "normality": anderson_darling(df, value), "capability": Q.capability(df, value, lsl, usl, subgroup=subgroup)}


def attribute_capability(df: DataFrame, kind: str, count: str, size: str, confidence: float = 0.95) -> dict:
    """binomial: share defective, its interval and process Z; poisson: defects a unit."""
    r = df.filter(F.col(count).isNotNull() & F.col(size).isNotNull()).agg(F.sum(count).alias("d"), F.sum(size).alias("n")).first()
    d, n = int(r["d"]), r["n"]
    if kind == "poisson":
        return {"dpu": d / n, "ci": B.poisson_rate1(d, float(n), confidence=confidence)["ci"], "defects": d, "units": n}
    p = d / n
    a = (1 - confidence) / 2
    ci = (0.0 if d == 0 else D.beta(d, n - d + 1).ppf(a), 1.0 if d == n else D.beta(d + 1, n - d).ppf(1 - a))
    return {"proportion": p, "ci": ci, "ppm": 1e6 * p, "z": -D.normal().ppf(p) if 0 < p < 1 else math.inf, "defectives": d, "units": n}


# -- measurement --------------------------------------------------------------------------------------------------
def variance_component_reml(df: DataFrame, value: str, group: str) -> dict:
    """Between and within variance of one random factor by restricted maximum likelihood."""
    from ashlar.stats.linear import mixed_model

    r = mixed_model(df, value, [], group)
    return {"between": r["variance"]["group"], "within": r["variance"]["error"], "icc": r["icc"], "n": r["n"], "groups": r["groups"]}


def expanded_gage_rr(df: DataFrame, value: str, part: str, operator: str, tolerance: float | None = None) -> dict:
    """Crossed study of any cell sizes: components by equating adjusted sums of squares to their expectations (Henderson III)."""
    d = df.select(clean(F.col(value)).alias("x"), F.col(part).cast("string").alias("p"), F.col(operator).cast("string").alias("o")).dropna()
    c = d.groupBy("p", "o").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).collect()  # a row a cell
    ps, os_ = sorted({r["p"] for r in c}), sorted({r["o"] for r in c})
    n, mean, ss = np.array([r["n"] for r in c], float), np.array([r["s"] / r["n"] for r in c]), sum(r["q"] for r in c)
    one = np.ones((len(c), 1))
    zp = np.array([[r["p"] == x for x in ps] for r in c], float)
    zo = np.array([[r["o"] == x for x in os_] for r in c], float)
    zc = np.eye(len(c))

    def projected(x: np.ndarray):
        """(fitted sum of squares, its coefficients of the part, operator, cell and error variances)."""
        g = np.linalg.pinv((x * n[:, None]).T @ x)
        h = x @ g @ x.T
        w = lambda z: float(np.trace(z.T @ (n[:, None] * h * n[None]) @ z))
        return float((n * mean) @ h @ (n * mean)), np.array([w(zp), w(zo), w(zc), np.linalg.matrix_rank(x)])

    f0, f_p, f_o = projected(one), projected(np.hstack([one, zp])), projected(np.hstack([one, zo]))
    f_po, f_c = projected(np.hstack([one, zp, zo])), projected(zc)
    total = n.sum()
    rows = [(f_po[0] - f_o[0], f_po[1] - f_o[1]), (f_po[0] - f_p[0], f_po[1] - f_p[1]), (f_c[0] - f_po[0], f_c[1] - f_po[1]), (ss - f_c[0], np.array([0, 0, 0, total - len(c)]))]
    del f0
    keep = [i for i, r in enumerate(rows) if r[1][3] > 0]
    a, b = np.array([rows[i][1] for i in keep]), np.array([rows[i][0] for i in keep])
    est = np.maximum(np.linalg.lstsq(a, b, rcond=None)[0], 0)
    v = {"part": est[0], "operator": est[1], "interaction": est[2], "repeatability": est[3]}
    v["reproducibility"] = v["operator"] + v["interaction"]
    v["gage"] = v["repeatability"] + v["reproducibility"]
    v["total"] = v["gage"] + v["part"]
    v = {k: float(x) for k, x in v.items()}
    sd = {k: math.sqrt(x) for k, x in v.items()}
    return {"variance": v, "sd": sd, "study": {k: 100 * x / sd["total"] for k, x in sd.items()} if sd["total"] else None, "tolerance": {k: 600 * x / tolerance for k, x in sd.items()} if tolerance else None}
