"""Life data beyond the basic fits: plots, warranty, plans, repairable systems, probit and competing risks.

Sums by distinct time are distributed; what runs on the driver is one number a time, or one a unit of a study.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ashlar.stats import dist as D
from ashlar.stats import reliability as R
from ashlar.stats.basic import clean


def reliability_fit(df: DataFrame, time: str, censor: str | None = None, distribution: str = "weibull") -> dict:
    """Maximum likelihood for weibull, exponential, lognormal, normal, loglogistic or smallest extreme value, right censoring allowed."""
    if distribution == "weibull":
        return R.weibull_fit(df, time, censor) | {"distribution": distribution}
    if distribution == "exponential":
        return R.exponential_fit(df, time, censor) | {"distribution": distribution}
    log = distribution in ("lognormal", "loglogistic")
    x = clean(F.col(time))
    d = df.select((F.log(x) if log else x).alias("x"), (F.col(censor) == 0 if censor else F.lit(True)).alias("e")).dropna()
    # times fold into distinct values: what the likelihood needs is a count of deaths and of censored per time
    t = d.groupBy("x").agg(F.count_if("e").cast("double").alias("d"), F.count_if(~F.col("e")).cast("double").alias("c")).orderBy("x").toArrow()
    v, dead, out = (t[c].to_numpy() for c in ("x", "d", "c"))
    erfc = np.vectorize(math.erfc)

    def parts(z):
        if distribution in ("lognormal", "normal"):
            return -0.5 * z * z - 0.5 * math.log(2 * math.pi), np.log(np.maximum(0.5 * erfc(z / math.sqrt(2)), 1e-300))
        if distribution == "loglogistic":
            return -z - 2 * np.logaddexp(0, -z), -np.logaddexp(0, z)
        return z - np.exp(z), -np.exp(z)  # smallest extreme value

    def loss(p):
        s = math.exp(p[1])
        f, sf = parts((v - p[0]) / s)
        return -float(dead @ (f - p[1]) + out @ sf)

    from ashlar.stats.series import _minimise

    w = dead + out
    m = float(w @ v / w.sum())
    sd = math.sqrt(max(float(w @ (v - m) ** 2 / w.sum()), 1e-12))
    p = _minimise(loss, np.array([m, math.log(sd)]), np.array([sd, 0.5]))
    return {"distribution": distribution, "location": float(p[0]), "scale": math.exp(p[1]), "log_likelihood": -loss(p) - (float(dead @ v) if log else 0.0), "events": int(dead.sum()), "n": int(w.sum())}


def probability_plot(df: DataFrame, time: str, censor: str | None = None, distribution: str = "weibull") -> dict:
    """Plotting positions from the modified survival estimate, on scales where the distribution is a line, with that line."""
    km = R.kaplan_meier(df, time, censor).select("time", "survival", "events").orderBy("time").collect()  # one row a distinct time
    before, points = 1.0, []
    for r in km:
        f = 1 - (before + r["survival"]) / 2  # the middle of the step
        before = r["survival"]
        if distribution == "weibull":
            x, y = math.log(r["time"]), math.log(-math.log(1 - f))
        elif distribution == "exponential":
            x, y = r["time"], -math.log(1 - f)
        elif distribution == "lognormal":
            x, y = math.log(r["time"]), D.normal().ppf(f)
        elif distribution == "normal":
            x, y = r["time"], D.normal().ppf(f)
        elif distribution == "loglogistic":
            x, y = math.log(r["time"]), math.log(f / (1 - f))
        else:
            raise ValueError(f"distribution: {distribution}")
        points.append((r["time"], f, x, y, r["events"]))
    a = np.array(points)
    w = a[:, 4]
    mx, my = w @ a[:, 2] / w.sum(), w @ a[:, 3] / w.sum()
    sxx, sxy, syy = w @ (a[:, 2] - mx) ** 2, w @ ((a[:, 2] - mx) * (a[:, 3] - my)), w @ (a[:, 3] - my) ** 2
    slope = sxy / sxx if sxx else math.nan
    return {"points": [{"time": p[0], "f": p[1], "x": p[2], "y": p[3]} for p in points], "slope": float(slope), "intercept": float(my - slope * mx), "correlation": float(sxy / math.sqrt(sxx * syy)) if sxx and syy else math.nan}


def warranty_prediction(returns: DataFrame, period: str, shipped: str, age: str, failed: str, ahead: int = 3) -> dict:
    """Weibull fit of failures by age, and expected returns of the units still out in the next ``ahead`` periods.

    Rows: one a shipping period and age, with how many were shipped and how many failed at that age.
    """
    d = returns.select(F.col(period).alias("p"), clean(F.col(shipped)).alias("n"), clean(F.col(age)).alias("t"), clean(F.col(failed)).alias("f")).dropna()
    out = d.groupBy("p").agg(F.max("n").alias("n"), F.max("t").alias("last"), F.sum("f").alias("f"))
    fails = d.filter("f > 0").select("t", F.col("f").alias("w"), F.lit(0).alias("c"))
    left = out.filter("n > f").select(F.col("last").alias("t"), (F.col("n") - F.col("f")).alias("w"), F.lit(1).alias("c"))
    rows = fails.unionByName(left).groupBy("t", "c").agg(F.sum("w").alias("w")).toPandas()  # ages, not units
    b, eta = _weighted_weibull(rows["t"].to_numpy(float), rows["w"].to_numpy(float), rows["c"].to_numpy() == 0)
    s = lambda x: math.exp(-((x / eta) ** b))
    now = out.filter("n > f").groupBy("last").agg(F.sum(F.col("n") - F.col("f")).alias("r")).collect()
    future = [sum(r["r"] * (s(r["last"] + h) - s(r["last"] + h + 1)) / s(r["last"]) for r in now if s(r["last"]) > 0) for h in range(ahead)]
    return {"shape": b, "scale": eta, "expected": future, "total": sum(future)}


def _weighted_weibull(t: np.ndarray, w: np.ndarray, dead: np.ndarray) -> tuple[float, float]:
    l, d = np.log(t), w * dead

    def g(b: float) -> float:
        p = w * np.exp(b * (l - l.max()))
        return float(p @ l / p.sum() - 1 / b - d @ l / d.sum())

    b = D.brentq(g, 0.01, 100.0)
    return b, float((w @ t**b / d.sum()) ** (1 / b))


# -- plans ------------------------------------------------------------------------------------------------------
def demonstration_test_plan(reliability: float, mission: float, confidence: float = 0.95, shape: float = 1.0, failures: int = 0, time: float | None = None, units: int | None = None) -> dict:
    """Units for a test time, or test time for units, that shows a reliability at a mission time with at most ``failures`` failures."""
    def p_ok(n: float, t: float) -> float:
        r = reliability ** ((t / mission) ** shape)
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)) * (1 - r) ** k * r ** (n - k) for k in range(failures + 1))

    if units is None:
        t = mission if time is None else time
        n = failures + 1
        while p_ok(n, t) > 1 - confidence:
            n += max(1, n // 50) if p_ok(n + n // 50 + 1, t) > 1 - confidence else 1
        return {"units": n, "time": t, "failures": failures, "risk": p_ok(n, t)}
    t = D.brentq(lambda u: p_ok(units, math.exp(u)) - (1 - confidence), math.log(mission) - 20, math.log(mission) + 20)
    return {"units": units, "time": math.exp(t), "failures": failures, "risk": 1 - confidence}


def estimation_test_plan(precision: float, percentile: float, shape: float, scale: float, confidence: float = 0.95, censor_time: float | None = None) -> dict:
    """Units for a Weibull percentile's interval to have this ratio of upper bound to estimate, by the information of one unit."""
    b, z = shape, D.normal().ppf(1 - (1 - confidence) / 2)
    u = np.linspace(1e-6, 1 - 1e-6, 200_001)
    t = -np.log1p(-u)  # standard exponential quantiles: (time / scale) ** shape
    end = math.inf if censor_time is None else (censor_time / scale) ** b
    obs = t <= end
    w = np.log(t)
    # score of (mu = log scale, s = 1 / shape) for one unit; information is its mean square
    dm = np.where(obs, b * (t - 1), b * (end if end < math.inf else 0.0))
    we = math.log(end) if 0 < end < math.inf else 0.0
    ds = np.where(obs, b * (w * (t - 1) - 1), b * (we * end if end < math.inf else 0.0))
    info = np.array([[np.mean(dm * dm), np.mean(dm * ds)], [np.mean(dm * ds), np.mean(ds * ds)]])
    c = np.array([1.0, math.log(-math.log(1 - percentile))])
    v = float(c @ np.linalg.solve(info, c))
    n = math.ceil(v * (z / math.log(precision)) ** 2)
    return {"units": n, "failures": n * float(obs.mean()), "log_se": math.sqrt(v / n), "percentile_time": scale * (-math.log(1 - percentile)) ** (1 / b)}


# -- repairable systems -----------------------------------------------------------------------------------------
def power_law_nhpp(df: DataFrame, system: str, time: str, end: dict | float | None = None, confidence: float = 0.95) -> dict:
    """Crow's process of many systems: closed forms where all end at one time, else Newton; trend by Military Handbook's statistic.

    ``end``: the time at which all systems were last seen, or one a system; without it the last event (failure truncated).
    """
    d = df.select(F.col(system).cast("string").alias("s"), clean(F.col(time)).alias("t")).dropna().filter("t > 0")
    per = d.groupBy("s").agg(F.count("t").alias("n"), F.max("t").alias("last"), F.sum(F.log("t")).alias("l")).collect()  # a row a system
    ends = {r["s"]: (r["last"] if end is None else end[r["s"]] if isinstance(end, dict) else end) for r in per}
    n, k = sum(r["n"] for r in per), len(per)
    logs = sum(r["n"] * math.log(ends[r["s"]]) - r["l"] for r in per)
    tail = 0 if end is not None else k  # the last failure of a failure-truncated system adds nothing
    ts = np.array([ends[r["s"]] for r in per])

    def g(b: float) -> float:
        p = ts**b
        return n / b + sum(r["l"] for r in per) - n * float(p @ np.log(ts) / p.sum())

    b = n / logs if np.allclose(ts, ts[0]) else D.brentq(g, 1e-3, 50.0)
    lam = n / float((ts**b).sum())
    stat, free = 2 * logs, 2 * (n - tail)
    q = D.normal().ppf(1 - (1 - confidence) / 2)
    chi = D.chi2(free)
    p = 2 * min(chi.cdf(stat), chi.sf(stat))
    now = lam * b * float((ts ** (b - 1)).mean())
    return {"shape": b, "scale": lam ** (-1 / b), "intensity": lam, "ci": (b * math.exp(-q / math.sqrt(n)), b * math.exp(q / math.sqrt(n))), "events": n, "systems": k, "trend": {"chi2": stat, "df": free, "p_value": min(1.0, p)}, "current_rate": now, "mtbf": 1 / now}


# -- dose and competing risks -------------------------------------------------------------------------------------
def probit_analysis(df: DataFrame, events: str, trials: str, dose: str, link: str = "probit", log: bool = False, percents=(0.01, 0.05, 0.1, 0.5, 0.9, 0.95, 0.99), confidence: float = 0.95) -> dict:
    """Events of trials against a dose by probit, logit or cloglog; doses of given shares with Fieller intervals.

    Rows with one dose fold into one, so what the scoring steps run on is a row a dose.
    """
    x = F.log(clean(F.col(dose))) if log else clean(F.col(dose))
    t = df.select(x.alias("x"), clean(F.col(events)).alias("e"), clean(F.col(trials)).alias("n")).dropna().groupBy("x").agg(F.sum("e").alias("e"), F.sum("n").alias("n")).orderBy("x").toPandas()
    xv, e, n = (t[c].to_numpy(float) for c in ("x", "e", "n"))
    nd = D.normal()
    erfc = np.vectorize(math.erfc)
    cdf, pdf, inv = {
        "probit": (lambda v: 0.5 * erfc(-v / math.sqrt(2)), lambda v: np.exp(-v * v / 2) / math.sqrt(2 * math.pi), nd.ppf),
        "logit": (lambda v: 1 / (1 + np.exp(-v)), lambda v: np.exp(-np.abs(v)) / (1 + np.exp(-np.abs(v))) ** 2, lambda p: math.log(p / (1 - p))),
        "cloglog": (lambda v: -np.expm1(-np.exp(np.minimum(v, 30))), lambda v: np.exp(np.minimum(v, 30) - np.exp(np.minimum(v, 30))), lambda p: math.log(-math.log(1 - p))),
    }[link]
    p0 = np.clip((e + 0.5) / (n + 1), 1e-3, 1 - 1e-3)
    a = np.stack([np.ones(len(xv)), xv], 1)
    y = np.array([inv(p) for p in p0])
    b = np.linalg.lstsq(a * np.sqrt(n)[:, None], y * np.sqrt(n), rcond=None)[0]
    for _ in range(100):
        v = a @ b
        p, f = np.clip(cdf(v), 1e-12, 1 - 1e-12), pdf(v)
        w = n * f * f / (p * (1 - p))
        info = (a * w[:, None]).T @ a
        step = np.linalg.solve(info, a.T @ ((e - n * p) * f / (p * (1 - p))))
        b = b + step
        if np.abs(step).max() < 1e-10:
            break
    p = np.clip(cdf(a @ b), 1e-12, 1 - 1e-12)
    cov = np.linalg.inv(info)
    z = nd.ppf(1 - (1 - confidence) / 2)
    out = []
    for q in percents:
        u = inv(q)
        m = (u - b[0]) / b[1]
        g = z * z * cov[1, 1] / b[1] ** 2
        mid = m + g / (1 - g) * (m + cov[0, 1] / cov[1, 1]) if g < 1 else math.nan
        half = z / (b[1] * (1 - g)) * math.sqrt(max(0.0, cov[0, 0] + 2 * m * cov[0, 1] + m * m * cov[1, 1] - g * (cov[0, 0] - cov[0, 1] ** 2 / cov[1, 1]))) if g < 1 else math.nan
        ends = (mid - abs(half), mid + abs(half))
        out.append({"share": q, "dose": math.exp(m) if log else m, "ci": tuple(math.exp(v) for v in ends) if log else ends})
    chi = float(((e - n * p) ** 2 / (n * p * (1 - p))).sum())
    k = len(xv) - 2
    return {"intercept": float(b[0]), "slope": float(b[1]), "se": np.sqrt(np.diag(cov)).tolist(), "percentiles": out, "pearson": {"chi2": chi, "df": k, "p_value": D.chi2(k).sf(chi) if k > 0 else math.nan}, "log_likelihood": float((e * np.log(p) + (n - e) * np.log(1 - p)).sum())}


def cumulative_incidence(df: DataFrame, time: str, cause: str, of=1) -> DataFrame:
    """Aalen-Johansen curve of one cause (0 is censored): per event time the risk set, events and cumulative incidence."""
    t = df.select(clean(F.col(time)).alias("t"), F.col(cause).alias("c")).dropna().groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c") != 0).alias("d"), F.count_if(F.col("c") == of).alias("own"))
    w = Window.orderBy("t")
    t = t.withColumn("risk", F.sum("n").over(Window.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)))
    step = F.when(F.col("d") < F.col("risk"), F.log(1 - F.col("d") / F.col("risk"))).otherwise(F.lit(-745.0))
    t = t.withColumn("before", F.exp(F.coalesce(F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))))
    return t.withColumn("incidence", F.sum(F.col("before") * F.col("own") / F.col("risk")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("own > 0").select(F.col("t").alias("time"), "risk", F.col("own").alias("events"), "incidence")


def fine_gray(df: DataFrame, time: str, cause: str, xs: list[str], of=1, most: int = 30, tol: float = 1e-9) -> dict:
    """Subdistribution hazards: those with other causes stay at risk with weights from the censoring curve; Breslow ties.

    Per distinct time the sums over that time's rows are distributed; the weights only need those sums twice.
    """
    d = df.select(clean(F.col(time)).alias("t"), F.col(cause).alias("c"), *[clean(F.col(x)).alias(f"x{i}") for i, x in enumerate(xs)]).dropna().persist()
    try:
        k = len(xs)
        s = d.agg(*[F.avg(f"x{i}") for i in range(k)]).first()
        cols = [F.col(f"x{i}") - s[i] for i in range(k)]
        c = d.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c") == 0).alias("z")).orderBy("t").toPandas()
        ts, n, z = c["t"].to_numpy(), c["n"].to_numpy(float), c["z"].to_numpy(float)
        risk = n[::-1].cumsum()[::-1]
        dead = n - z
        surv = np.cumprod(1 - np.divide(z, risk - dead, out=np.zeros_like(z), where=risk - dead > 0))
        left = np.r_[1.0, surv[:-1]]  # the censoring curve just before each time
        b = np.zeros(k)
        for it in range(most):
            w = F.exp(sum((F.lit(float(v)) * x for v, x in zip(b, cols, strict=True)), F.lit(0.0)))
            kind = F.when(F.col("c") == of, 0).when(F.col("c") == 0, 1).otherwise(2)
            rows = d.groupBy("t", kind.alias("kind")).agg(F.count(F.lit(1)).alias("m"), F.sum(w).alias("w"), *[F.sum(w * x).alias(f"a{i}") for i, x in enumerate(cols)], *[F.sum(w * cols[i] * cols[j]).alias(f"b{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(x).alias(f"e{i}") for i, x in enumerate(cols)]).collect()
            at = {t: i for i, t in enumerate(ts)}
            m = len(ts)
            own, add = np.zeros((m, 1 + k)), np.zeros((m, 1 + k + k * k))
            other = np.zeros_like(add)
            for r in rows:
                i = at[r["t"]]
                v = np.r_[r["w"], [r[f"a{j}"] for j in range(k)], [r[f"b{min(p, q)}_{max(p, q)}"] for p in range(k) for q in range(k)]]
                add[i] += v
                if r["kind"] == 0:
                    own[i] += np.r_[r["m"], [r[f"e{j}"] for j in range(k)]]
                if r["kind"] == 2:
                    other[i] += v / max(left[i], 1e-12)
            # at risk now, and those with another cause before now, weighted by the censoring curve since
            here = add[::-1].cumsum(0)[::-1]
            past = np.vstack([np.zeros(add.shape[1]), other.cumsum(0)[:-1]]) * left[:, None]
            tot = here + past
            s0, s1, s2 = tot[:, 0], tot[:, 1 : 1 + k], tot[:, 1 + k :].reshape(m, k, k)
            mean = s1 / s0[:, None]
            u = own[:, 1:].sum(0) - (own[:, :1] * mean).sum(0)
            info = (own[:, 0][:, None, None] * (s2 / s0[:, None, None] - mean[:, :, None] * mean[:, None, :])).sum(0)
            step = np.linalg.solve(info, u)
            b = b + step
            if np.abs(step).max() < tol:
                break
    finally:
        d.unpersist()
    se = np.sqrt(np.diag(np.linalg.inv(info)))
    nd = D.normal()
    return {"coefficients": [{"term": x, "estimate": float(v), "se": float(e), "subhazard_ratio": math.exp(v), "z": float(v / e), "p_value": D.two_sided(nd, float(v / e))} for x, v, e in zip(xs, b, se, strict=True)], "events": int(own[:, 0].sum()), "iterations": it + 1}
