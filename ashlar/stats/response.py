"""Ordinal and nominal logistic regression, partial least squares and stability studies, from sums over the rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.stats import dist as D
from ashlar.stats.basic import clean
from ashlar.stats.regression import _complete, _gram


def to_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Numeric columns of a model, checked; text is refused."""
    kinds = dict(df.dtypes)
    for c in columns:
        if kinds.get(c, "string") in ("string", "boolean", "binary"):
            raise ValueError(f"{c}: a number is needed")
    return list(columns)


def vif_from_fit(df: DataFrame, xs: list[str]) -> dict[str, float]:
    """Variance inflation: the diagonal of the inverse of the correlation matrix."""
    d = df.select(*[clean(F.col(x)).alias(f"x{i}") for i, x in enumerate(xs)]).dropna()
    k = len(xs)
    r = d.agg(*[F.corr(f"x{i}", f"x{j}").alias(f"r{i}_{j}") for i in range(k) for j in range(i + 1, k)]).first() if k > 1 else None
    m = np.eye(k)
    for i in range(k):
        for j in range(i + 1, k):
            m[i, j] = m[j, i] = r[f"r{i}_{j}"]
    return dict(zip(xs, np.diag(np.linalg.inv(m)).tolist(), strict=True))


def _levels(df: DataFrame, y: str, most: int = 100) -> list[str]:
    rows = df.filter(F.col(y).isNotNull()).select(F.col(y)).distinct().orderBy(y).limit(most + 1).collect()
    if not 2 <= len(rows) <= most:
        raise ValueError(f"the response has 2 to {most} levels")
    return [r[0] for r in rows]


def _newton(parts, b: np.ndarray, most: int, tol: float):
    """Damped Newton; ``parts(b)`` gives (log likelihood, gradient, information), one aggregate each time."""
    ll, g, h = parts(b)
    for i in range(most):
        step = np.linalg.solve(h, g)
        a = 1.0
        while True:
            now = parts(b + a * step)
            if np.isfinite(now[0]) and now[0] >= ll - 1e-12 * abs(ll):
                break
            a /= 2
            if a < 1e-8:
                return b, ll, h, i
        b = b + a * step
        done = abs(now[0] - ll) < tol * (abs(ll) + 0.1)
        ll, g, h = now
        if done:
            break
    return b, ll, h, i + 1


def _table(names, est, cov, confidence: float) -> list[dict]:
    nd = D.normal()
    q, out = nd.ppf(1 - (1 - confidence) / 2), []
    for t, e, v in zip(names, est, np.diag(cov), strict=True):
        se = math.sqrt(v)
        out.append({"term": t, "estimate": float(e), "se": se, "z": float(e) / se, "p_value": D.two_sided(nd, float(e) / se), "ci": (float(e) - q * se, float(e) + q * se), "odds_ratio": math.exp(min(float(e), 700))})
    return out


def ologit(df: DataFrame, y: str, xs: list[str], confidence: float = 0.95, most: int = 50, tol: float = 1e-10) -> dict:
    """Proportional odds: logit P(y <= j) = threshold_j - x b; every Newton step is one aggregate of per-level terms."""
    lv = _levels(df, y)
    j, k = len(lv), len(xs)
    d = df.select(F.col(y).alias("y"), *[clean(F.col(x)).alias(f"x{i}") for i, x in enumerate(xs)]).dropna()
    code = F.lit(None).cast("int")
    for i, v in enumerate(lv):
        code = F.when(F.col("y") == F.lit(v), i).otherwise(code)
    d = d.withColumn("c", code).persist()
    try:
        count = {r["c"]: r["count"] for r in d.groupBy("c").count().collect()}
        n = sum(count.values())
        s = d.agg(*[f(f"x{i}").alias(f"{m}{i}") for i in range(k) for m, f in (("m", F.avg), ("s", F.stddev_pop))]).first() if k else None
        cols = [(F.col(f"x{i}") - s[f"m{i}"]) / (s[f"s{i}"] or 1.0) for i in range(k)]
        cum = np.cumsum([count.get(i, 0) for i in range(j)])[:-1] / n
        start = np.r_[np.log(cum / (1 - cum)), np.zeros(k)]

        def parts(b):
            if (np.diff(b[: j - 1]) <= 0).any():
                return -math.inf, None, None
            eta = sum((F.lit(float(v)) * c for v, c in zip(b[j - 1 :], cols, strict=True)), F.lit(0.0))
            th = F.array(*[F.lit(float(v)) for v in b[: j - 1]])
            up = F.when(F.col("c") < j - 1, 1 / (1 + F.exp(eta - F.get(th, F.col("c"))))).otherwise(1.0)
            lo = F.when(F.col("c") > 0, 1 / (1 + F.exp(eta - F.get(th, F.col("c") - 1)))).otherwise(0.0)
            e = d.select("c", *[c.alias(f"z{i}") for i, c in enumerate(cols)], up.alias("u"), lo.alias("l"))
            p, du, dl = F.greatest(F.col("u") - F.col("l"), F.lit(1e-300)), F.col("u") * (1 - F.col("u")), F.col("l") * (1 - F.col("l"))
            hu, hl = du * (1 - 2 * F.col("u")), dl * (1 - 2 * F.col("l"))
            # per level: sums of the derivatives by threshold above (a), below (b) and the line, with products of the columns
            z = [F.lit(1.0), *[F.col(f"z{i}") for i in range(k)]]
            ga, gb = du / p, -dl / p
            haa, hbb, hab = hu / p - ga * ga, -hl / p - gb * gb, -ga * gb
            t = {"ga": ga, "gb": gb, "aa": haa, "bb": hbb, "ab": hab}
            aggs = [F.sum(F.log(p)).alias("ll")]
            aggs += [F.sum(v * c).alias(f"{m}{i}") for m, v in t.items() for i, c in enumerate(z)]
            full = haa + hbb + 2 * hab
            aggs += [F.sum(full * z[i + 1] * z[h + 1]).alias(f"x{i}_{h}") for i in range(k) for h in range(i, k)]
            g, h, ll = np.zeros(len(b)), np.zeros((len(b), len(b))), 0.0
            for r in e.groupBy("c").agg(*aggs).collect():
                c, a = r["c"], j - 1
                ll += r["ll"]
                if c < a:
                    g[c] += r["ga0"]
                    h[c, c] += r["aa0"]
                if c > 0:
                    g[c - 1] += r["gb0"]
                    h[c - 1, c - 1] += r["bb0"]
                if 0 < c < a:
                    h[c, c - 1] += r["ab0"]
                    h[c - 1, c] += r["ab0"]
                for i in range(k):
                    g[a + i] -= r[f"ga{i + 1}"] + r[f"gb{i + 1}"]
                    if c < a:
                        v = r[f"aa{i + 1}"] + r[f"ab{i + 1}"]
                        h[c, a + i] -= v
                        h[a + i, c] -= v
                    if c > 0:
                        v = r[f"bb{i + 1}"] + r[f"ab{i + 1}"]
                        h[c - 1, a + i] -= v
                        h[a + i, c - 1] -= v
                    for m in range(i, k):
                        h[a + i, a + m] += r[f"x{i}_{m}"]
                        if m > i:
                            h[a + m, a + i] += r[f"x{i}_{m}"]
            return ll, g, -h

        b, ll, info, steps = _newton(parts, start, most, tol)
    finally:
        d.unpersist()
    back = np.eye(len(b))
    for i in range(k):
        back[j - 1 + i, j - 1 + i] = 1 / (s[f"s{i}"] or 1.0)
        back[: j - 1, j - 1 + i] = s[f"m{i}"] / (s[f"s{i}"] or 1.0)
    est, cov = back @ b, back @ np.linalg.inv(info) @ back.T
    null = float(sum(c * math.log(c / n) for c in count.values()))
    rows = _table([*[f"<= {v}" for v in lv[:-1]], *xs], est, cov, confidence)
    return {"levels": lv, "thresholds": rows[: j - 1], "coefficients": rows[j - 1 :], "n": n, "log_likelihood": ll, "null_log_likelihood": null, "g": 2 * (ll - null), "p_value": D.chi2(k).sf(max(0.0, 2 * (ll - null))) if k else math.nan, "aic": 2 * len(b) - 2 * ll, "bic": math.log(n) * len(b) - 2 * ll, "iterations": steps}


def mlogit(df: DataFrame, y: str, xs: list[str], reference=None, confidence: float = 0.95, most: int = 50, tol: float = 1e-10) -> dict:
    """Multinomial logit against a reference level (the first if not given); every Newton step is one aggregate."""
    lv = _levels(df, y)
    ref = lv[0] if reference is None else reference
    others = [v for v in lv if v != ref]
    q, k = len(others), len(xs) + 1
    d = df.select(F.col(y).alias("y"), *[clean(F.col(x)).alias(f"x{i}") for i, x in enumerate(xs)]).dropna().persist()
    try:
        s = d.agg(F.count(F.lit(1)).alias("n"), *[f(f"x{i}").alias(f"{m}{i}") for i in range(k - 1) for m, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        n = s["n"]
        z = [F.lit(1.0), *[(F.col(f"x{i}") - s[f"m{i}"]) / (s[f"s{i}"] or 1.0) for i in range(k - 1)]]
        count = {r["y"]: r["count"] for r in d.groupBy("y").count().collect()}
        start = np.zeros((q, k))
        start[:, 0] = [math.log(count[v] / count[ref]) for v in others]

        def parts(b):
            b = b.reshape(q, k)
            eta = [sum((F.lit(float(v)) * c for v, c in zip(row, z, strict=True)), F.lit(0.0)) for row in b]
            e = d.select("y", *[c.alias(f"z{i}") for i, c in enumerate(z)], *[v.alias(f"e{i}") for i, v in enumerate(eta)])
            top = F.greatest(F.lit(0.0), *[F.col(f"e{i}") for i in range(q)]) if q else F.lit(0.0)
            norm = F.exp(-top) + sum((F.exp(F.col(f"e{i}") - top) for i in range(q)), F.lit(0.0))
            e = e.withColumn("ln", top + F.log(norm))
            e = e.select("y", "ln", *[f"z{i}" for i in range(k)], *[f"e{i}" for i in range(q)], *[F.exp(F.col(f"e{i}") - F.col("ln")).alias(f"p{i}") for i in range(q)])
            own = F.lit(0.0)
            for i, v in enumerate(others):
                own = F.when(F.col("y") == F.lit(v), F.col(f"e{i}")).otherwise(own)
            zc = [F.col(f"z{i}") for i in range(k)]
            aggs = [F.sum(own - F.col("ln")).alias("ll")]
            aggs += [F.sum(((F.col("y") == F.lit(v)).cast("double") - F.col(f"p{i}")) * c).alias(f"g{i}_{m}") for i, v in enumerate(others) for m, c in enumerate(zc)]
            aggs += [F.sum(F.col(f"p{i}") * ((1.0 if i == h else 0.0) - F.col(f"p{h}")) * zc[m] * zc[o]).alias(f"h{i}_{h}_{m}_{o}") for i in range(q) for h in range(i, q) for m in range(k) for o in range(k)]
            r = e.agg(*aggs).first()
            g = np.array([r[f"g{i}_{m}"] for i in range(q) for m in range(k)])
            info = np.zeros((q * k, q * k))
            for i in range(q):
                for h in range(i, q):
                    block = np.array([[r[f"h{i}_{h}_{m}_{o}"] for o in range(k)] for m in range(k)])
                    info[i * k : i * k + k, h * k : h * k + k] = block
                    info[h * k : h * k + k, i * k : i * k + k] = block.T
            return r["ll"], g, info

        b, ll, info, steps = _newton(parts, start.ravel(), most, tol)
    finally:
        d.unpersist()
    one = np.eye(k)
    for i in range(k - 1):
        one[i + 1, i + 1] = 1 / (s[f"s{i}"] or 1.0)
        one[0, i + 1] = -s[f"m{i}"] / (s[f"s{i}"] or 1.0)
    back = np.kron(np.eye(q), one)
    est, cov = back @ b, back @ np.linalg.inv(info) @ back.T
    rows = _table([t for _ in others for t in ["(intercept)", *xs]], est, cov, confidence)
    null = float(sum(c * math.log(c / n) for c in count.values()))
    df_ = q * (k - 1)
    return {"levels": lv, "reference": ref, "equations": {v: rows[i * k : i * k + k] for i, v in enumerate(others)}, "n": n, "log_likelihood": ll, "null_log_likelihood": null, "g": 2 * (ll - null), "p_value": D.chi2(df_).sf(max(0.0, 2 * (ll - null))) if df_ else math.nan, "aic": 2 * q * k - 2 * ll, "bic": math.log(n) * q * k - 2 * ll, "iterations": steps}


def pls(df: DataFrame, y: str, xs: list[str], components: int = 2) -> dict:
    """Partial least squares of one response: the kernel form works on the standardised cross products, one aggregate."""
    d = _complete(df, y, xs)
    k = len(xs)
    s = d.agg(F.avg("y").alias("my"), F.stddev_samp("y").alias("sy"), *[f(f"x{i}").alias(f"{m}{i}") for i in range(k) for m, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    cols = [(F.col(f"x{i}") - s[f"m{i}"]) / (s[f"s{i}"] or 1.0) for i in range(k)] + [(F.col("y") - s["my"]) / (s["sy"] or 1.0)]
    n, g, _ = _gram(d, cols)
    a, c, yy = g[:k, :k], g[:k, k].copy(), g[k, k]
    xx = a.trace()
    w, p, q, explained_x, explained_y = [], [], [], [], []
    r: list[np.ndarray] = []
    for _ in range(min(components, k)):
        v = c / (np.linalg.norm(c) or 1.0)
        u = v - sum((pj @ v) * rj for pj, rj in zip(p, r, strict=True)) if r else v
        t2 = float(u @ a @ u)
        if t2 <= 1e-12 * n:
            break
        load, weight = a @ u / t2, float(c @ u) / t2
        c = c - load * (weight * t2)
        w.append(v)
        r.append(u)
        p.append(load)
        q.append(weight)
        explained_x.append(float(t2 * (load @ load) / xx))
        explained_y.append(float(weight**2 * t2 / yy))
    b = sum((qi * ri for qi, ri in zip(q, r, strict=True)), np.zeros(k))
    beta = [float(v * (s["sy"] or 1.0) / (s[f"s{i}"] or 1.0)) for i, v in enumerate(b)]
    vip = np.sqrt(k * (np.array(w).T ** 2 @ np.array(explained_y)) / sum(explained_y)) if w and sum(explained_y) else np.zeros(k)
    coef = [{"term": "(intercept)", "estimate": s["my"] - sum(v * s[f"m{i}"] for i, v in enumerate(beta))}, *[{"term": x, "estimate": v} for x, v in zip(xs, beta, strict=True)]]
    return {"coefficients": coef, "standardised": b.tolist(), "weights": np.array(w).T, "loadings": np.array(p).T, "x_variance": explained_x, "r_squared": sum(explained_y), "y_variance": explained_y, "vip": dict(zip(xs, vip.tolist(), strict=True)), "n": n}


def stability_study(df: DataFrame, value: str, time: str, batch: str, lsl: float | None = None, usl: float | None = None, alpha: float = 0.25, confidence: float = 0.95, horizon: float = 120.0) -> dict:
    """Shelf life: batches share slopes, then intercepts, where tests at ``alpha`` allow; the life ends where the mean's bound meets a limit."""
    from ashlar.stats import linear as L

    full = L.linear_model(df, f"{value} ~ {time} * {batch}", [batch])
    p = {t["term"]: t["p_value"] for t in full["terms"]}
    if next(v for k, v in p.items() if ":" in k) < alpha:
        m, kind = full, "separate slopes"
    else:
        m = L.linear_model(df, f"{value} ~ {time} + {batch}", [batch])
        p2 = {t["term"]: t["p_value"] for t in m["terms"]}
        kind = "common slope"
        if p2[batch] >= alpha:
            m, kind = L.linear_model(df, f"{value} ~ {time}"), "common line"
    t = D.t(m["df"])
    q = t.ppf(confidence if None in (lsl, usl) else 1 - (1 - confidence) / 2)
    levels = m["coding"].get(batch) or [None]
    lives = {}
    for b in levels:
        def margin(x: float, b=b) -> float:
            c = L.linear_model_contrast(m, L.linear_model_vector(m, {time: x} | ({batch: b} if b is not None else {})))
            return min(c["estimate"] - q * c["se"] - lsl if lsl is not None else math.inf, usl - c["estimate"] - q * c["se"] if usl is not None else math.inf)

        if margin(0.0) <= 0:
            lives[b] = 0.0
        elif margin(horizon) > 0:
            lives[b] = math.inf
        else:
            lives[b] = D.brentq(margin, 0.0, horizon, 1e-9)
    return {"model": m, "kind": kind, "lives": lives, "shelf_life": min(lives.values())}
