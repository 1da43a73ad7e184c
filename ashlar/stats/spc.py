"""Control charts, capability, measurement systems and quality tools."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ashlar.stats import dist as D
from ashlar.stats.basic import clean, moments

# fixed values: expected range of n standard normals (d2) and its standard deviation (d3), n = 2 to 25
D2 = (1.128, 1.693, 2.059, 2.326, 2.534, 2.704, 2.847, 2.97, 3.078, 3.173, 3.258, 3.336, 3.407, 3.472, 3.532, 3.588, 3.64, 3.689, 3.735, 3.778, 3.819, 3.858, 3.895, 3.931)
D3 = (0.853, 0.888, 0.88, 0.864, 0.848, 0.833, 0.82, 0.808, 0.797, 0.787, 0.778, 0.77, 0.763, 0.756, 0.75, 0.744, 0.739, 0.734, 0.729, 0.724, 0.72, 0.716, 0.712, 0.708)


def spc_constants(n: int) -> dict:
    if not 2 <= n <= 25:
        raise ValueError("subgroups of 2 to 25")
    d2, d3 = D2[n - 2], D3[n - 2]
    c4 = math.sqrt(2 / (n - 1)) * math.exp(D.lgamma(n / 2) - D.lgamma((n - 1) / 2))
    w = 3 * math.sqrt(1 - c4 * c4) / c4
    return {"d2": d2, "d3": d3, "c4": c4, "a2": 3 / (d2 * math.sqrt(n)), "a3": 3 / (c4 * math.sqrt(n)), "b3": max(0.0, 1 - w), "b4": 1 + w, "D3": max(0.0, 1 - 3 * d3 / d2), "D4": 1 + 3 * d3 / d2}


def nelson_rules(df: DataFrame, x: str, centre, sigma, order: str, rules=tuple(range(1, 9))) -> DataFrame:
    """``df`` with ``rules``: the numbers of the rules a point completes, by windows of at most 15 rows."""
    z = (F.col(x) - centre) / sigma
    w = Window.orderBy(order)
    d = df.withColumn("_z", z).withColumn("_d", F.col(x) - F.lag(x).over(w))
    last = lambda k: w.rowsBetween(-(k - 1), 0)
    cnt = lambda c, k: F.sum(c.cast("int")).over(last(k))
    z = F.col("_z")
    turn = (F.signum("_d") * F.signum(F.lag("_d").over(w)) < 0).cast("int")
    d = d.withColumn("_t", F.coalesce(turn, F.lit(0)))
    made = {
        1: F.abs(z) > 3, 2: (cnt(z > 0, 9) == 9) | (cnt(z < 0, 9) == 9), 3: (cnt(F.col("_d") > 0, 5) == 5) | (cnt(F.col("_d") < 0, 5) == 5), 4: F.sum("_t").over(last(12)) == 12,
        5: ((cnt(z > 2, 3) >= 2) & (z > 2)) | ((cnt(z < -2, 3) >= 2) & (z < -2)), 6: ((cnt(z > 1, 5) >= 4) & (z > 1)) | ((cnt(z < -1, 5) >= 4) & (z < -1)),
        7: cnt(F.abs(z) < 1, 15) == 15, 8: cnt(F.abs(z) > 1, 8) == 8,
    }
    hit = F.array(*[F.when(F.coalesce(made[r], F.lit(False)), F.lit(r)) for r in rules])
    return d.withColumn("rules", F.filter(hit, lambda v: v.isNotNull())).drop("_z", "_d", "_t")


def imr_chart(df: DataFrame, value: str, order: str) -> dict:
    d = df.select(F.col(order).alias("o"), clean(F.col(value)).alias("x")).filter("x is not null")
    d = d.withColumn("mr", F.abs(F.col("x") - F.lag("x").over(Window.orderBy("o"))))
    r = d.agg(F.avg("x").alias("m"), F.avg("mr").alias("mr")).first()
    s, c = r["mr"] / D2[0], spc_constants(2)
    return {"centre": r["m"], "sigma": s, "ucl": r["m"] + 3 * s, "lcl": r["m"] - 3 * s, "mr_centre": r["mr"], "mr_ucl": c["D4"] * r["mr"], "mr_lcl": c["D3"] * r["mr"], "points": nelson_rules(d, "x", F.lit(r["m"]), F.lit(s), "o")}


def xbar_chart(df: DataFrame, value: str, subgroup: str, kind: str = "R") -> dict:
    """X-bar with R or S; unequal subgroups get their own limits. Points stay distributed."""
    d = df.select(F.col(subgroup).alias("g"), clean(F.col(value)).alias("x")).dropna()
    g = d.groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), (F.max("x") - F.min("x")).alias("range"), F.stddev_samp("x").alias("sd"))
    c = [spc_constants(n) for n in range(2, 26)]
    pick = lambda k: F.element_at(F.array(*[F.lit(v[k]) for v in c]), (F.col("n") - 1).cast("int"))
    g = g.filter("n between 2 and 25")
    spread = F.col("range") / pick("d2") if kind == "R" else F.col("sd") / pick("c4")
    r = g.agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("m"), F.avg(spread).alias("s"), F.avg("range").alias("rbar"), F.avg("sd").alias("sbar"), F.min("n").alias("a"), F.max("n").alias("b")).first()
    m, s = r["m"], r["s"]
    points = g.withColumn("ucl", m + 3 * s / F.sqrt("n")).withColumn("lcl", m - 3 * s / F.sqrt("n"))
    if kind == "R":
        points = points.withColumn("spread_ucl", s * (pick("d2") + 3 * pick("d3"))).withColumn("spread_lcl", s * F.greatest(pick("d2") - 3 * pick("d3"), F.lit(0.0)))
        out = (F.col("range") > F.col("spread_ucl")) | (F.col("range") < F.col("spread_lcl"))
    else:
        points = points.withColumn("spread_ucl", s * pick("c4") * pick("b4")).withColumn("spread_lcl", s * pick("c4") * pick("b3"))
        out = (F.col("sd") > F.col("spread_ucl")) | (F.col("sd") < F.col("spread_lcl"))
    points = points.withColumn("out", (F.col("mean") > F.col("ucl")) | (F.col("mean") < F.col("lcl"))).withColumn("spread_out", out)
    return {"centre": m, "sigma": s, "rbar": r["rbar"], "sbar": r["sbar"], "points": points}


def attribute_chart(df: DataFrame, kind: str, count: str, size: str | None = None) -> dict:
    """p, np, c, u charts; limits per point."""
    n = F.col(size).cast("double") if size else F.lit(1.0)
    r = df.agg(F.sum(count).alias("c"), F.sum(n).alias("n"), F.count(count).alias("k"), F.min(n).alias("lo"), F.max(n).alias("hi")).first()
    if kind == "np" and r["lo"] != r["hi"]:
        raise ValueError("an np chart needs equal sizes")
    p = r["c"] / r["n"]
    x, centre, se, top = {
        "p": (F.col(count) / n, F.lit(p), F.sqrt(F.lit(p * (1 - p)) / n), F.lit(1.0)), "np": (F.col(count).cast("double"), n * p, F.sqrt(n * p * (1 - p)), n),
        "u": (F.col(count) / n, F.lit(p), F.sqrt(F.lit(p) / n), F.lit(math.inf)), "c": (F.col(count).cast("double"), F.lit(r["c"] / r["k"]), F.sqrt(F.lit(r["c"] / r["k"])), F.lit(math.inf)),
    }[kind]
    d = df.withColumn("x", x).withColumn("centre", centre).withColumn("ucl", F.least(centre + 3 * se, top)).withColumn("lcl", F.greatest(centre - 3 * se, F.lit(0.0)))
    return {"centre": p if kind != "c" else r["c"] / r["k"], "points": d.withColumn("out", (F.col("x") > F.col("ucl")) | (F.col("x") < F.col("lcl")))}


def _ordered(df, value, order, most=5_000_000) -> np.ndarray:
    rows = df.select(F.col(order).alias("o"), clean(F.col(value)).alias("x")).filter("x is not null").orderBy("o").limit(most + 1).select("x").toArrow()["x"].to_numpy()
    if len(rows) > most:
        raise ValueError(f"a recursive chart is for at most {most} points")
    return rows


def ewma(df, value, order, lam=0.2, width=3.0, centre=None, sigma=None) -> list[dict]:
    x = _ordered(df, value, order)
    m = x.mean() if centre is None else centre
    s = np.abs(np.diff(x)).mean() / D2[0] if sigma is None else sigma
    z, out = m, []
    for i, v in enumerate(x):
        z = lam * v + (1 - lam) * z
        e = width * s * math.sqrt(lam / (2 - lam) * (1 - (1 - lam) ** (2 * (i + 1))))
        out.append({"z": z, "ucl": m + e, "lcl": m - e, "out": abs(z - m) > e})
    return out


def cusum(df, value, order, target=None, k=0.5, h=5.0, sigma=None) -> list[dict]:
    x = _ordered(df, value, order)
    m = x.mean() if target is None else target
    s = np.abs(np.diff(x)).mean() / D2[0] if sigma is None else sigma
    up = down = 0.0
    out = []
    for v in x:
        z = (v - m) / s
        up, down = max(0.0, up + z - k), min(0.0, down + z + k)
        out.append({"upper": up, "lower": down, "out": up > h or down < -h})
    return out


def capability(df, value, lsl=None, usl=None, target=None, subgroup=None, order=None, confidence=0.95) -> dict:
    m = moments(df, value)[None]
    overall = math.sqrt(m["var"])
    if subgroup:
        within = xbar_chart(df, value, subgroup)["sigma"]
    elif order:
        within = imr_chart(df, value, order)["sigma"]
    else:
        within = overall
    if not overall or not within:
        raise ValueError("no variation")

    def indices(s):
        up = (usl - m["mean"]) / (3 * s) if usl is not None else math.inf
        lo = (m["mean"] - lsl) / (3 * s) if lsl is not None else math.inf
        return ((usl - lsl) / (6 * s) if usl is not None and lsl is not None else math.nan), lo, up, min(lo, up)

    cp, cpl, cpu, cpk = indices(within)
    pp, ppl, ppu, ppk = indices(overall)
    q = D.normal().ppf(1 - (1 - confidence) / 2) * math.sqrt(1 / (9 * m["n"]) + cpk**2 / (2 * (m["n"] - 1)))
    n = D.normal(m["mean"], overall)
    ppm = 1e6 * ((n.cdf(lsl) if lsl is not None else 0) + (n.sf(usl) if usl is not None else 0))
    cpm = (usl - lsl) / (6 * math.sqrt(m["var"] + (m["mean"] - target) ** 2)) if None not in (usl, lsl, target) else math.nan
    x = clean(F.col(value))
    bad = df.agg(F.count_if((x < lsl) if lsl is not None else F.lit(False)) + F.count_if((x > usl) if usl is not None else F.lit(False))).first()[0]
    return {"n": m["n"], "mean": m["mean"], "sigma_within": within, "sigma_overall": overall, "cp": cp, "cpl": cpl, "cpu": cpu, "cpk": cpk, "cpk_ci": (cpk - q, cpk + q), "pp": pp, "ppl": ppl, "ppu": ppu, "ppk": ppk, "cpm": cpm, "ppm_expected": ppm, "ppm_observed": 1e6 * bad / m["n"]}


def boxcox_lambda(df, value, grid=tuple(np.round(np.arange(-5, 5.01, 0.1), 2))) -> dict:
    """Profile likelihood for all lambdas in one aggregate."""
    x = clean(F.col(value))
    power = lambda l: F.log(x) if l == 0 else (F.pow(x, F.lit(float(l))) - 1) / float(l)
    r = df.filter(x > 0).agg(F.count(x).alias("n"), F.sum(F.log(x)).alias("s"), *[F.var_pop(power(l)).alias(f"v{i}") for i, l in enumerate(grid)]).first()
    ll = [-r["n"] / 2 * math.log(r[f"v{i}"]) + (l - 1) * r["s"] if r[f"v{i}"] and r[f"v{i}"] > 0 else -math.inf for i, l in enumerate(grid)]
    i = int(np.argmax(ll))
    return {"lambda": float(grid[i]), "log_likelihood": ll[i]}


def tolerance_interval(df, value, coverage=0.95, confidence=0.95) -> dict:
    """Two-sided normal (Howe) and the count of a nonparametric one."""
    m = moments(df, value)[None]
    n = m["n"]
    k = D.normal().ppf((1 + coverage) / 2) * math.sqrt((n - 1) * (1 + 1 / n) / D.chi2(n - 1).ppf(1 - confidence))
    sd = math.sqrt(m["var"])
    return {"k": k, "low": m["mean"] - k * sd, "high": m["mean"] + k * sd}


def gage_rr(df, value, part, operator, tolerance=None) -> dict:
    """Crossed, balanced; interaction kept."""
    d = df.select(clean(F.col(value)).alias("x"), F.col(part).alias("p"), F.col(operator).alias("o")).dropna()
    c = d.groupBy("p", "o").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("v")).collect()
    ps, os_ = sorted({r["p"] for r in c}, key=str), sorted({r["o"] for r in c}, key=str)
    n = {r["n"] for r in c}
    if len(n) > 1 or len(c) != len(ps) * len(os_) or min(n) < 2 or len(os_) < 2:
        raise ValueError("a balanced crossed study with two operators and two replicates is needed")
    r, p, o = n.pop(), len(ps), len(os_)
    cell = np.array([[next(x["m"] for x in c if x["p"] == a and x["o"] == b) for b in os_] for a in ps])
    g = cell.mean()
    ms_p = o * r * ((cell.mean(1) - g) ** 2).sum() / (p - 1)
    ms_o = p * r * ((cell.mean(0) - g) ** 2).sum() / (o - 1)
    ms_po = r * ((cell - cell.mean(1, keepdims=True) - cell.mean(0, keepdims=True) + g) ** 2).sum() / ((p - 1) * (o - 1))
    ms_e = float(np.mean([x["v"] for x in c]))
    v = {"repeatability": ms_e, "operator": max(0.0, (ms_o - ms_po) / (p * r)), "interaction": max(0.0, (ms_po - ms_e) / r), "part": max(0.0, (ms_p - ms_po) / (o * r))}
    v["reproducibility"] = v["operator"] + v["interaction"]
    v["gage"] = v["repeatability"] + v["reproducibility"]
    v["total"] = v["gage"] + v["part"]
    sd = {k: math.sqrt(x) for k, x in v.items()}
    return {"variance": v, "sd": sd, "contribution": {k: 100 * x / v["total"] for k, x in v.items()}, "study": {k: 100 * x / sd["total"] for k, x in sd.items()}, "tolerance": {k: 600 * x / tolerance for k, x in sd.items()} if tolerance else None, "categories": int(math.sqrt(2) * sd["part"] / sd["gage"]) if sd["gage"] else math.inf}


def pareto(df: DataFrame, category: str, weight: str | None = None) -> DataFrame:
    """Categories by falling weight with cumulative percent."""
    g = df.filter(F.col(category).isNotNull()).groupBy(F.col(category).cast("string").alias("category")).agg((F.sum(weight) if weight else F.count(F.lit(1))).cast("double").alias("count"))
    w = Window.orderBy(F.desc("count"), "category")
    return g.withColumn("cumulative", 100 * F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def acceptance_sampling(aql, rql, alpha=0.05, beta=0.1, most=5000) -> dict:
    """Smallest single plan (n, c) that accepts ``aql`` at 1 - alpha and ``rql`` at most at beta."""
    n, c = 1, 0
    while n <= most:
        if D.binomial(n, rql).cdf(c) > beta:
            n += 1
        elif D.binomial(n, aql).cdf(c) >= 1 - alpha:
            return {"n": n, "c": c, "alpha": 1 - D.binomial(n, aql).cdf(c), "beta": D.binomial(n, rql).cdf(c)}
        else:
            c += 1
    raise ValueError("no plan within the limit")


def moving_average_chart(df, value, order, span: int = 5, width: float = 3.0) -> DataFrame:
    m = imr_chart(df, value, order)
    w = Window.orderBy("o").rowsBetween(-(span - 1), 0)
    d = m["points"].select("o", "x").withColumn("ma", F.avg("x").over(w)).withColumn("_n", F.count("x").over(w))
    half = F.lit(width * m["sigma"]) / F.sqrt("_n")
    return d.withColumn("ucl", m["centre"] + half).withColumn("lcl", m["centre"] - half).drop("_n")


def laney(df: DataFrame, kind: str, count: str, size: str, order: str) -> dict:
    """p' and u' charts: limits widened by the spread of z-scores between neighbours."""
    c = attribute_chart(df, kind, count, size)
    se = (F.col("ucl") - F.col("centre")) / 3
    base = F.sqrt(F.lit(c["centre"]) * (1 - F.lit(c["centre"]) if kind == "p" else F.lit(1.0)) / F.col(size))
    d = c["points"].withColumn("_z", (F.col("x") - F.col("centre")) / base)
    s = d.withColumn("_m", F.abs(F.col("_z") - F.lag("_z").over(Window.orderBy(order)))).agg(F.avg("_m")).first()[0] / D2[0]
    half = 3 * s * base
    d = d.withColumn("ucl", F.col("centre") + half).withColumn("lcl", F.greatest(F.col("centre") - half, F.lit(0.0))).drop("_z")
    return {"sigma_z": s, "centre": c["centre"], "points": d.withColumn("out", (F.col("x") > F.col("ucl")) | (F.col("x") < F.col("lcl"))), "se": se}


def t2_chart(df: DataFrame, xs: list[str], alpha: float = 0.00135) -> dict:
    """Hotelling's chart of single observations, with the beta limit of a retrospective study."""
    from ashlar.stats.multivariate import covariance, mahalanobis

    n, _, _ = covariance(df, xs)
    p = len(xs)
    ucl = (n - 1) ** 2 / n * D.beta(p / 2, (n - p - 1) / 2).ppf(1 - alpha)
    return {"ucl": ucl, "points": mahalanobis(df, xs, "t2").withColumn("out", F.col("t2") > ucl)}


def run_chart(df, value, order) -> dict:
    """Runs about the median and runs up or down, on one ordered series."""
    x = _ordered(df, value, order)
    med = np.median(x)
    s = x[x != med] > med
    n1, n2 = int(s.sum()), int((~s).sum())
    runs = 1 + int((s[1:] != s[:-1]).sum())
    mean = 1 + 2 * n1 * n2 / (n1 + n2)
    sd = math.sqrt(2 * n1 * n2 * (2 * n1 * n2 - n1 - n2) / ((n1 + n2) ** 2 * (n1 + n2 - 1)))
    d = np.sign(np.diff(x))
    d = d[d != 0]
    up = 1 + int((d[1:] != d[:-1]).sum())
    m2, s2 = (2 * len(x) - 1) / 3, math.sqrt((16 * len(x) - 29) / 90)
    z, z2 = (runs - mean) / sd, (up - m2) / s2
    n = D.normal()
    return {"runs": runs, "expected": mean, "clustering": n.cdf(z), "mixtures": n.sf(z), "runs_up_down": up, "trends": n.cdf(z2), "oscillation": n.sf(z2)}


def g_chart(df, value, order) -> dict:
    """Counts between rare events; limits from the geometric distribution."""
    x = _ordered(df, value, order)
    p = (len(x) - 1) / len(x) / (x.mean() + 1)
    q = lambda a: math.log(1 - a) / math.log(1 - p) - 1
    lo, mid, hi = max(0.0, q(0.00135)), q(0.5), q(0.99865)
    return {"centre": mid, "lcl": lo, "ucl": hi, "out": [i for i, v in enumerate(x) if v > hi or v < lo]}


def t_chart(df, value, order) -> dict:
    """Times between rare events; limits from a fitted Weibull."""
    from ashlar.stats.reliability import weibull_fit

    w = weibull_fit(df.filter(F.col(value) > 0), value)
    d = D.weibull(w["shape"], w["scale"])
    x = _ordered(df, value, order)
    lo, mid, hi = d.ppf(0.00135), d.ppf(0.5), d.ppf(0.99865)
    return {"centre": mid, "lcl": lo, "ucl": hi, "out": [i for i, v in enumerate(x) if v > hi or v < lo]}


def mewma(df, xs, order, lam=0.1, limit=None) -> list[dict]:
    """Multivariate exponentially weighted averages; the limit defaults to the chi-square of 0.005."""
    from ashlar.stats.multivariate import covariance

    _, m, s = covariance(df, xs)
    x = np.column_stack([_ordered(df.dropna(subset=xs), c, order) for c in xs]) - m
    inv, z, out = np.linalg.inv(s), np.zeros(len(xs)), []
    h = D.chi2(len(xs)).ppf(0.995) if limit is None else limit
    for i, v in enumerate(x):
        z = lam * v + (1 - lam) * z
        t2 = float(z @ inv @ z) / (lam / (2 - lam) * (1 - (1 - lam) ** (2 * (i + 1))))
        out.append({"t2": t2, "ucl": h, "out": t2 > h})
    return out


def gage_type1(df, value, reference, tolerance, share=0.2) -> dict:
    m = moments(df, value)[None]
    s = math.sqrt(m["var"])
    b = m["mean"] - reference
    t = b / (s / math.sqrt(m["n"]))
    return {"bias": b, "t": t, "p_value": D.two_sided(D.t(m["n"] - 1), t), "cg": share * tolerance / (6 * s), "cgk": (share * tolerance / 2 - abs(b)) / (3 * s)}


def gage_linearity(df, value, reference) -> dict:
    """Bias against reference by least squares, and the mean bias per reference."""
    from ashlar.stats.regression import ols

    d = df.select((clean(F.col(value)) - clean(F.col(reference))).alias("bias"), clean(F.col(reference)).alias("reference")).dropna()
    return {"model": ols(d, "bias", ["reference"]), "bias": {r[0]: r[1] for r in d.groupBy("reference").agg(F.avg("bias")).collect()}}


def attribute_agreement(df, rating, part, appraiser) -> dict:
    """Fleiss' kappa over appraisers, from counts per part and rating."""
    c = df.filter(F.col(rating).isNotNull()).groupBy(F.col(part).alias("p"), F.col(rating).cast("string").alias("r")).count()
    per = c.groupBy("p").agg(F.sum("count").alias("n"), F.sum(F.col("count") * (F.col("count") - 1)).alias("a"))
    t = per.filter("n > 1").agg(F.avg(F.col("a") / (F.col("n") * (F.col("n") - 1))).alias("p"), F.sum("n").alias("n")).first()
    share = [r["count"] / t["n"] for r in c.groupBy("r").agg(F.sum("count").alias("count")).collect()]
    e = sum(s * s for s in share)
    whole = df.groupBy(part).agg(F.count_distinct(rating).alias("k")).agg(F.avg((F.col("k") == 1).cast("double"))).first()[0]
    return {"kappa": (t["p"] - e) / (1 - e) if e < 1 else 1.0, "agreement": t["p"], "all_agree": whole, "appraisers": df.select(appraiser).distinct().count()}
