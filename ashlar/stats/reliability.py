"""Survival and reliability; risk sets come from per-time aggregates. ``censor``: 0 is an event, 1 right-censored."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ashlar.stats import dist as D
from ashlar.stats.basic import clean


def _times(df: DataFrame, time: str, censor: str | None, by: str | None) -> DataFrame:
    d = df.select(clean(F.col(time)).alias("t"), (F.col(censor) == 0 if censor else F.lit(True)).alias("e"), (F.col(by).cast("string") if by else F.lit("")).alias("g")).dropna()
    return d.groupBy("g", "t").agg(F.count_if(F.col("e")).alias("d"), F.count(F.lit(1)).alias("n"))


def kaplan_meier(df: DataFrame, time: str, censor: str | None = None, by: str | None = None, confidence: float = 0.95) -> DataFrame:
    """Per group and event time: at risk, events, survival, Greenwood se and log-log interval; distributed by group."""
    t = _times(df, time, censor, by)
    w = Window.partitionBy("g").orderBy("t")
    risk = F.sum("n").over(Window.partitionBy("g").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("risk", risk)
    ran = w.rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("gone", F.max(F.when(F.col("d") == F.col("risk"), 1).otherwise(0)).over(ran))
    step = F.when(F.col("d") < F.col("risk"), F.log(1 - F.col("d") / F.col("risk"))).otherwise(0.0)
    var = F.when(F.col("d") < F.col("risk"), F.col("d") / (F.col("risk") * (F.col("risk") - F.col("d")))).otherwise(0.0)
    t = t.withColumn("survival", F.when(F.col("gone") == 1, 0.0).otherwise(F.exp(F.sum(step).over(ran)))).withColumn("_v", F.sum(var).over(ran))
    z = D.normal().ppf(1 - (1 - confidence) / 2)
    inner = (F.col("survival") > 0) & (F.col("survival") < 1)
    c = F.exp(z * F.sqrt("_v") / F.log(F.when(inner, F.col("survival"))))
    out = t.withColumn("se", F.col("survival") * F.sqrt("_v")).withColumn("low", F.pow("survival", 1 / c)).withColumn("high", F.pow("survival", c))
    return out.filter("d > 0").select(F.col("g").alias("group"), F.col("t").alias("time"), "risk", F.col("d").alias("events"), "survival", "se", "low", "high")


def log_rank(df, time, censor, by, weight: str = "log-rank") -> dict:
    """Two or more groups; weight log-rank, wilcoxon (n at risk) or tarone-ware (its root)."""
    rows = _times(df, time, censor, by).collect()  # one row per group and distinct time
    gs = sorted({r["g"] for r in rows})
    ts = sorted({r["t"] for r in rows})
    at = {t: i for i, t in enumerate(ts)}
    d, n = np.zeros((len(ts), len(gs))), np.zeros((len(ts), len(gs)))
    for r in rows:
        d[at[r["t"]], gs.index(r["g"])], n[at[r["t"]], gs.index(r["g"])] = r["d"], r["n"]
    risk = n[::-1].cumsum(0)[::-1]
    k, total, dead = len(gs), risk.sum(1), d.sum(1)
    w = {"log-rank": np.ones(len(ts)), "wilcoxon": total, "tarone-ware": np.sqrt(total)}[weight]
    e = risk * (dead / total)[:, None]
    u = (w[:, None] * (d - e)).sum(0)
    v = np.zeros((k, k))
    for i in range(len(ts)):
        if total[i] > 1 and dead[i]:
            p = risk[i] / total[i]
            v += w[i] ** 2 * dead[i] * (total[i] - dead[i]) / (total[i] - 1) * (np.diag(p) - np.outer(p, p))
    stat = float(u[:-1] @ np.linalg.solve(v[:-1, :-1], u[:-1]))
    return {"chi2": stat, "df": k - 1, "p_value": D.chi2(k - 1).sf(stat), "observed": dict(zip(gs, d.sum(0), strict=True)), "expected": dict(zip(gs, e.sum(0), strict=True))}


def weibull_fit(df, time, censor=None, most=200) -> dict:
    """Maximum likelihood with right censoring; every Newton step is one aggregate."""
    d = df.select(clean(F.col(time)).alias("t"), (F.col(censor) == 0 if censor else F.lit(True)).cast("double").alias("e")).dropna().filter("t > 0")
    r = d.agg(F.sum("e").alias("r"), F.sum(F.col("e") * F.log("t")).alias("s"), F.stddev_pop(F.log("t")).alias("sd"), F.count("t").alias("n"), F.max("t").alias("top")).first()
    if not r["r"]:
        raise ValueError("no events")
    b = 1.2 / r["sd"] if r["sd"] else 1.0
    x, l = F.col("t") / r["top"], F.log(F.col("t") / r["top"])
    mean = r["s"] / r["r"] - math.log(r["top"])
    for _ in range(most):
        p = F.pow(x, F.lit(b))
        s = d.agg(F.sum(p), F.sum(p * l), F.sum(p * l * l)).first()
        g = s[1] / s[0] - 1 / b - mean
        step = g / (s[2] / s[0] - (s[1] / s[0]) ** 2 + 1 / b**2)
        b = max(b / 2, b - step)
        if abs(step) < 1e-10 * b:
            break
    eta = r["top"] * (s[0] / r["r"]) ** (1 / b)
    return {"shape": b, "scale": eta, "events": r["r"], "n": r["n"], "b10": eta * (-math.log(0.9)) ** (1 / b), "mean": eta * math.gamma(1 + 1 / b)}


def exponential_fit(df, time, censor=None, confidence=0.95) -> dict:
    r = df.agg(F.sum(clean(F.col(time))).alias("t"), (F.count_if(F.col(censor) == 0) if censor else F.count(time)).alias("r")).first()
    a = (1 - confidence) / 2
    return {"mean": r["t"] / r["r"], "rate": r["r"] / r["t"], "ci": (2 * r["t"] / D.chi2(2 * r["r"] + 2).ppf(1 - a), 2 * r["t"] / D.chi2(2 * r["r"]).ppf(a))}


def cox_ph(df: DataFrame, time: str, censor: str, xs: list[str], most=30, tol=1e-9) -> dict:
    """Breslow ties. Sums by distinct time are distributed; the cumulation over times is on the driver."""
    d = df.select(clean(F.col(time)).alias("t"), (F.col(censor) == 0).alias("e"), *[clean(F.col(x)).alias(f"x{i}") for i, x in enumerate(xs)]).dropna()
    k = len(xs)
    s = d.agg(*[F.avg(f"x{i}") for i in range(k)]).first()
    cols = [F.col(f"x{i}") - s[i] for i in range(k)]
    b = np.zeros(k)
    for _ in range(most):
        w = F.exp(sum((F.lit(float(v)) * c for v, c in zip(b, cols, strict=True)), F.lit(0.0)))
        rows = d.groupBy("t").agg(F.count_if("e").alias("d"), F.sum(w).alias("w"), *[F.sum(w * c).alias(f"a{i}") for i, c in enumerate(cols)], *[F.sum(w * cols[i] * cols[j]).alias(f"b{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(F.when(F.col("e"), c).otherwise(0.0)).alias(f"e{i}") for i, c in enumerate(cols)]).orderBy(F.desc("t")).collect()
        dead = np.array([r["d"] for r in rows], float)
        s0 = np.cumsum([r["w"] for r in rows])
        s1 = np.cumsum([[r[f"a{i}"] for i in range(k)] for r in rows], 0)
        s2 = np.cumsum([[[r[f"b{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)] for r in rows], 0)
        m = s1 / s0[:, None]
        u = np.array([sum(r[f"e{i}"] for r in rows) for i in range(k)]) - (dead[:, None] * m).sum(0)
        info = (dead[:, None, None] * (s2 / s0[:, None, None] - m[:, :, None] * m[:, None, :])).sum(0)
        step = np.linalg.solve(info, u)
        b = b + step
        if np.abs(step).max() < tol:
            break
    se = np.sqrt(np.diag(np.linalg.inv(info)))
    return {"coefficients": [{"term": x, "estimate": float(v), "se": float(e), "hazard_ratio": math.exp(v), "z": float(v / e), "p_value": D.two_sided(D.normal(), v / e)} for x, v, e in zip(xs, b, se, strict=True)]}
