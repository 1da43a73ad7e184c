"""Linear and generalised linear models from cross-product aggregates: the data are read once (linear) or once an iteration."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.stats import dist as D
from ashlar.stats.basic import clean


def _complete(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    return df.select(clean(F.col(y)).alias("y"), *[clean(F.col(x)).alias(f"x{i}") for i, x in enumerate(xs)]).dropna()


def _gram(d: DataFrame, cols: list[Column], w: Column | None = None, extra: dict[str, Column] | None = None):
    """Sums of products of the columns (weighted) and of ``extra``, in one aggregate."""
    w = F.lit(1.0) if w is None else w
    k = len(cols)
    aggs = [F.sum(w * cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    r = d.agg(F.count(F.lit(1)).alias("n"), *aggs, *[F.sum(v).alias(n) for n, v in (extra or {}).items()]).first()
    return r["n"], np.array([[r[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]), r


def ols(df: DataFrame, y: str, xs: list[str], intercept: bool = True, confidence: float = 0.95) -> dict:
    """Coefficients with se, t, p, intervals and VIF; R squared, F, AIC, BIC. Columns are centred and scaled for stability."""
    d = _complete(df, y, xs)
    k = len(xs)
    s = d.agg(F.count("y").alias("n"), *[f(c).alias(f"{m}{c}") for c in ["y", *[f"x{i}" for i in range(k)]] for m, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    mid = lambda c: s["m" + c] if intercept else 0.0
    scale = [s[f"sx{i}"] or 1.0 for i in range(k)]
    cols = [(F.col(f"x{i}") - mid(f"x{i}")) / scale[i] for i in range(k)] + [F.col("y") - mid("y")]
    n, g, _ = _gram(d, cols)
    xtx, xty, yty = g[:k, :k], g[:k, k], g[k, k]
    inv = np.linalg.inv(xtx) if k else np.zeros((0, 0))
    b = inv @ xty
    rss, p = float(yty - b @ xty), k + intercept
    dof = n - p
    mse = rss / dof
    t, out = D.t(dof), []
    q = t.ppf(1 - (1 - confidence) / 2)

    def term(name, est, se, vif=None):
        out.append({"term": name, "estimate": est, "se": se, "t": est / se if se else math.inf, "p_value": D.two_sided(t, est / se) if se else 0.0, "ci": (est - q * se, est + q * se)} | ({} if vif is None else {"vif": vif}))

    beta = b / scale
    if intercept:
        m = np.array([s[f"mx{i}"] / scale[i] for i in range(k)])
        term("(intercept)", s["my"] - float(beta @ [s[f"mx{i}"] for i in range(k)]), math.sqrt(mse * (1 / n + float(m @ inv @ m))))
    for i, x in enumerate(xs):
        term(x, float(beta[i]), math.sqrt(mse * inv[i, i]) / scale[i], float(inv[i, i] * xtx[i, i]))
    f = (yty - rss) / k / mse if k and mse > 0 else math.inf
    ll = -n / 2 * (math.log(2 * math.pi * rss / n) + 1) if rss > 0 else math.inf
    return {"coefficients": out, "n": n, "df": dof, "rss": rss, "s": math.sqrt(mse), "r_squared": 1 - rss / yty, "r_squared_adj": 1 - (rss / dof) / (yty / (n - intercept)), "f": f, "f_p_value": D.f(k, dof).sf(f) if k else math.nan, "aic": 2 * (p + 1) - 2 * ll, "bic": math.log(n) * (p + 1) - 2 * ll}


def predict(df: DataFrame, model: dict, name: str = "prediction") -> DataFrame:
    c = {x["term"]: x["estimate"] for x in model["coefficients"]}
    out = F.lit(c.get("(intercept)", 0.0))
    for k, v in c.items():
        if k != "(intercept)":
            out = out + F.lit(v) * F.col(k)
    return df.withColumn(name, out)


def fitted_line(df, y, x, degree=1) -> dict:
    d = df.select(F.col(y), *[F.pow(F.col(x), F.lit(k)).alias(f"{x}^{k}" if k > 1 else x) for k in range(1, degree + 1)])
    return ols(d, y, d.columns[1:])


def stepwise(df, y, xs, enter=0.15, remove=0.15) -> dict:
    chosen: list[str] = []
    steps = []
    for _ in range(4 * len(xs)):
        best = min(((next(c["p_value"] for c in ols(df, y, [*chosen, x])["coefficients"] if c["term"] == x), x) for x in xs if x not in chosen), default=(1, None))
        if best[0] < enter:
            chosen.append(best[1])
            steps.append(("enter", best[1], best[0]))
        worst = max(((c["p_value"], c["term"]) for c in ols(df, y, chosen)["coefficients"][1:]), default=(0, None)) if chosen else (0, None)
        if worst[0] > remove:
            chosen.remove(worst[1])
            steps.append(("remove", *worst[::-1]))
        elif best[0] >= enter:
            break
    return {"selected": chosen, "steps": steps, "model": ols(df, y, chosen) if chosen else None}


def best_subsets(df, y, xs, most: int | None = None) -> list[dict]:
    """All subsets from one cross-product matrix, ranked by adjusted R squared."""
    d = _complete(df, y, xs)
    k = len(xs)
    means = d.agg(*[F.avg(c) for c in ["y", *[f"x{i}" for i in range(k)]]]).first()
    n, g, _ = _gram(d, [F.col(f"x{i}") - means[i + 1] for i in range(k)] + [F.col("y") - means[0]])
    out = []
    full = g[k, k] - g[:k, k] @ np.linalg.solve(g[:k, :k], g[:k, k])
    for size in range(1, (most or k) + 1):
        for s in combinations(range(k), size):
            i = list(s)
            rss = float(g[k, k] - g[i, k] @ np.linalg.solve(g[np.ix_(i, i)], g[i, k]))
            out.append({"terms": [xs[j] for j in i], "r_squared": 1 - rss / g[k, k], "r_squared_adj": 1 - (rss / (n - size - 1)) / (g[k, k] / (n - 1)), "cp": rss / (full / (n - k - 1)) - n + 2 * (size + 1), "s": math.sqrt(rss / (n - size - 1))})
    return sorted(out, key=lambda x: -x["r_squared_adj"])


def ridge(df, y, xs, lam: float = 1.0) -> dict:
    """Penalty on standardised columns."""
    return _penalised(df, y, xs, lam, 0.0)


def elastic_net(df, y, xs, lam: float = 1.0, alpha: float = 0.5) -> dict:
    """Coordinate descent on the correlation matrix, which is one aggregate."""
    return _penalised(df, y, xs, lam, alpha)


def lasso(df, y, xs, lam: float = 1.0) -> dict:
    return _penalised(df, y, xs, lam, 1.0)


def _penalised(df, y, xs, lam, alpha) -> dict:
    d = _complete(df, y, xs)
    k = len(xs)
    cols = ["y", *[f"x{i}" for i in range(k)]]
    s = d.agg(*[f(c).alias(m + c) for c in cols for m, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    n, g, _ = _gram(d, [(F.col(c) - s["m" + c]) / (s["s" + c] or 1.0) if c != "y" else F.col(c) - s["my"] for c in [*cols[1:], "y"]])
    a, c = g[:k, :k] / n, g[:k, k] / n
    b = np.zeros(k)
    if alpha == 0:
        b = np.linalg.solve(a + lam * np.eye(k), c)
    else:
        for _ in range(10_000):
            old = b.copy()
            for j in range(k):
                r = c[j] - a[j] @ b + a[j, j] * b[j]
                b[j] = math.copysign(max(abs(r) - lam * alpha, 0), r) / (a[j, j] + lam * (1 - alpha))
            if np.abs(b - old).max() < 1e-12:
                break
    beta = b / [s[f"sx{i}"] or 1.0 for i in range(k)]
    coef = [{"term": "(intercept)", "estimate": s["my"] - float(sum(beta[i] * s[f"mx{i}"] for i in range(k)))}, *[{"term": x, "estimate": float(v)} for x, v in zip(xs, beta, strict=True)]]
    return {"coefficients": coef, "lambda": lam, "alpha": alpha, "n": n}


_LINKS = {
    "logit": (lambda e: 1 / (1 + F.exp(-e)), lambda m: m * (1 - m), lambda y, m: -2 * (F.when(y > 0, y * F.log(F.greatest(m, F.lit(1e-300)))).otherwise(0.0) + F.when(y < 1, (1 - y) * F.log(F.greatest(1 - m, F.lit(1e-300)))).otherwise(0.0))),
    "poisson": (lambda e: F.exp(e), lambda m: m, lambda y, m: 2 * (F.when(y > 0, y * F.log(F.greatest(y, F.lit(1e-300)) / m)).otherwise(0.0) - (y - m))),
}


def glm(df: DataFrame, y: str, xs: list[str], family: str = "logit", most: int = 50, tol: float = 1e-9, confidence: float = 0.95) -> dict:
    """Iteratively reweighted least squares; each iteration is one aggregate."""
    mean, var, dev = _LINKS[family]
    d = _complete(df, y, xs).persist()
    try:
        k = len(xs) + 1
        s = d.agg(F.avg("y").alias("my"), *[f(f"x{i}").alias(f"{m}{i}") for i in range(k - 1) for m, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        cols = [F.lit(1.0)] + [(F.col(f"x{i}") - s[f"m{i}"]) / (s[f"s{i}"] or 1.0) for i in range(k - 1)]
        b = np.zeros(k)
        b[0] = math.log(s["my"] / (1 - s["my"])) if family == "logit" else math.log(s["my"])
        null = last = None
        for _ in range(most):
            eta = sum((F.lit(float(v)) * c for v, c in zip(b[1:], cols[1:], strict=True)), F.lit(float(b[0])))
            m = mean(eta)
            n, g, r = _gram(d, cols, var(m), {f"u{i}": c * (F.col("y") - m) for i, c in enumerate(cols)} | {"dev": dev(F.col("y"), m)})
            null = r["dev"] if null is None else null
            if last is not None and abs(last - r["dev"]) < tol * (abs(last) + 0.1):
                break
            last = r["dev"]
            b = b + np.linalg.solve(g, np.array([r[f"u{i}"] for i in range(k)]))
    finally:
        d.unpersist()
    j = np.eye(k)
    for i in range(k - 1):
        j[0, i + 1], j[i + 1, i + 1] = -s[f"m{i}"] / (s[f"s{i}"] or 1.0), 1 / (s[f"s{i}"] or 1.0)
    est, cov = j @ b, j @ np.linalg.inv(g) @ j.T
    q, out = D.normal().ppf(1 - (1 - confidence) / 2), []
    for name, e, v in zip(["(intercept)", *xs], est, np.diag(cov), strict=True):
        se = math.sqrt(v)
        out.append({"term": name, "estimate": float(e), "se": se, "z": float(e) / se, "p_value": D.two_sided(D.normal(), float(e) / se), "ci": (float(e) - q * se, float(e) + q * se), "exp": math.exp(min(float(e), 700))})
    return {"coefficients": out, "n": n, "deviance": r["dev"], "null_deviance": null, "p_value": D.chi2(k - 1).sf(null - r["dev"]) if k > 1 else math.nan}


def logistic(df, y, xs, **options) -> dict:
    return glm(df, y, xs, "logit", **options)


def poisson_regression(df, y, xs, **options) -> dict:
    return glm(df, y, xs, "poisson", **options)


def orthogonal_regression(df, y, x, ratio: float = 1.0) -> dict:
    """Deming regression; ``ratio`` is the error variance of y over that of x."""
    r = _complete(df, y, [x]).agg(F.avg("x0").alias("mx"), F.avg("y").alias("my"), F.var_samp("x0").alias("xx"), F.var_samp("y").alias("yy"), F.covar_samp("x0", "y").alias("xy")).first()
    d = r["yy"] - ratio * r["xx"]
    slope = (d + math.sqrt(d * d + 4 * ratio * r["xy"] ** 2)) / (2 * r["xy"])
    return {"slope": slope, "intercept": r["my"] - slope * r["mx"]}


def isotonic(df, y, x) -> list[tuple[float, float]]:
    """Pool-adjacent-violators over distinct x (bounded to a million)."""
    rows = _complete(df, y, [x]).groupBy("x0").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("x0").limit(1_000_001).collect()
    if len(rows) > 1_000_000:
        raise ValueError("isotonic is for at most a million distinct x")
    blocks: list[list] = []
    for r in rows:
        blocks.append([r["y"], r["n"], [r["x0"]]])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b = blocks.pop()
            a = blocks[-1]
            a[0], a[1], a[2] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]
    return [(v, b[0]) for b in blocks for v in b[2]]


def nls(df: DataFrame, y: str, model, start: dict[str, float], most: int = 100, tol: float = 1e-9) -> dict:
    """Gauss-Newton; ``model(params)`` gives a Column, derivatives are central differences inside one aggregate."""
    names, b = list(start), np.array(list(start.values()), float)
    v = clean(F.col(y))
    at = lambda p: model(dict(zip(names, map(float, p), strict=True)))
    last = None
    for it in range(most):
        steps = np.maximum(np.abs(b), 1e-3) * 1e-6
        j = [(at(b + np.eye(len(b))[i] * s) - at(b - np.eye(len(b))[i] * s)) / (2 * s) for i, s in enumerate(steps)]
        n, g, r = _gram(df.filter(v.isNotNull()), j, None, {"rss": F.pow(v - at(b), F.lit(2))} | {f"u{i}": c * (v - at(b)) for i, c in enumerate(j)})
        if last is not None and abs(last - r["rss"]) <= tol * (last + tol):
            break
        last = r["rss"]
        b = b + np.linalg.solve(g, [r[f"u{i}"] for i in range(len(b))])
    s2 = r["rss"] / (n - len(b))
    se = np.sqrt(np.diag(np.linalg.inv(g)) * s2)
    return {"parameters": {k: {"estimate": float(e), "se": float(s)} for k, e, s in zip(names, b, se, strict=True)}, "rss": r["rss"], "n": n, "iterations": it + 1}


def quantile_regression(df: DataFrame, y: str, xs: list[str], q: float = 0.5, most: int = 60) -> dict:
    """Iteratively reweighted least squares on the smoothed check loss; an aggregate an iteration."""
    d = _complete(df, y, xs).persist()
    try:
        cols = [F.lit(1.0), *[F.col(f"x{i}") for i in range(len(xs))]]
        b, w, eps = np.zeros(len(cols)), None, 1.0
        for _ in range(most):
            _, g, r = _gram(d, cols, w, {f"u{i}": (F.lit(1.0) if w is None else w) * c * F.col("y") for i, c in enumerate(cols)})
            new = np.linalg.solve(g, [r[f"u{i}"] for i in range(len(cols))])
            if w is not None and eps <= 1e-6 and np.abs(new - b).max() < 1e-7:
                break
            b, eps = new, max(eps / 3, 1e-6)
            e = F.col("y") - sum((F.lit(float(v)) * c for v, c in zip(b, cols, strict=True)), F.lit(0.0))
            w = F.when(e > 0, F.lit(q)).otherwise(F.lit(1 - q)) / F.greatest(F.abs(e), F.lit(eps))
    finally:
        d.unpersist()
    return {"q": q, "coefficients": [{"term": t, "estimate": float(v)} for t, v in zip(["(intercept)", *xs], b, strict=True)]}


def lowess(df: DataFrame, y: str, x: str, span: float = 0.5, robust: int = 2, most: int = 20_000) -> list[tuple[float, float]]:
    """Locally weighted lines with robustness passes, on one ordered series."""
    rows = _complete(df, y, [x]).orderBy("x0").limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"lowess is for at most {most} rows")
    xv, yv = rows["x0"].to_numpy(), rows["y"].to_numpy()
    n, k = len(xv), max(2, int(math.ceil(span * len(xv))))
    rob, fit = np.ones(n), np.zeros(n)
    for _ in range(robust + 1):
        for i in range(n):
            d = np.abs(xv - xv[i])
            h = np.partition(d, k - 1)[k - 1] or 1e-12
            w = np.clip(1 - (d / h) ** 3, 0, 1) ** 3 * rob
            s = w.sum()
            mx, my = (w @ xv) / s, (w @ yv) / s
            var = w @ (xv - mx) ** 2
            fit[i] = my + ((w @ ((xv - mx) * (yv - my))) / var * (xv[i] - mx) if var > 1e-12 else 0.0)
        r = np.abs(yv - fit)
        m = 6 * np.median(r)
        rob = np.clip(1 - (r / m) ** 2, 0, 1) ** 2 if m > 0 else np.ones(n)
    return list(zip(xv.tolist(), fit.tolist(), strict=True))
