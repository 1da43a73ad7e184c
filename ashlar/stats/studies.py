"""Designs and their analysis beyond two levels, multivariate extras, matrices, worksheet formulas and study bundles.

Designs and matrices are small by nature and plain numpy; anything that takes a DataFrame aggregates first.
"""

from __future__ import annotations

import ast
import math
from datetime import date, datetime, timedelta

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.stats import basic as B
from ashlar.stats import dist as D
from ashlar.stats import doe as E
from ashlar.stats.basic import clean


# -- designs ----------------------------------------------------------------------------------------------------
def _field(q: int):
    """Addition and multiplication tables of the field of q = p or 4 elements."""
    if q == 4:
        add = np.array([[a ^ b for b in range(4)] for a in range(4)])
        mul = np.array([[0, 0, 0, 0], [0, 1, 2, 3], [0, 2, 3, 1], [0, 3, 1, 2]])
        return add, mul
    r = np.arange(q)
    return (r[:, None] + r) % q, (r[:, None] * r) % q


def orthogonal_array(levels: int, columns: int) -> np.ndarray:
    """The smallest array of strength two from linear forms over a field (2, 3, 4 or 5 levels), coded from 0."""
    if levels not in (2, 3, 4, 5):
        raise ValueError("2 to 5 levels")
    add, mul = _field(levels)
    k = 2
    while (levels**k - 1) // (levels - 1) < columns:
        k += 1
    points = np.array(np.meshgrid(*[np.arange(levels)] * k, indexing="ij")).reshape(k, -1).T
    forms = [f for f in np.ndindex(*[levels] * k) if any(f) and next(v for v in f if v) == 1]
    forms.sort(key=lambda f: (sum(v != 0 for v in f), f[::-1]))
    out = []
    for f in forms[:columns]:
        v = np.zeros(len(points), int)
        for c, x in zip(f, points.T, strict=True):
            v = add[v, mul[c, x]]
        out.append(v)
    return np.stack(out, 1)


def taguchi(levels: int, factors: int) -> np.ndarray:
    """An orthogonal array with levels numbered from 1."""
    return orthogonal_array(levels, factors) + 1


def analyze_taguchi(design, y, kind: str = "nominal") -> dict:
    """Means and signal-to-noise ratios by level, ranked by their range; ``y`` has a row of replicates per run."""
    d, y = np.asarray(design), np.atleast_2d(np.asarray(y, float))
    y = y.T if y.shape[0] != len(d) else y
    sn = np.array([E.signal_to_noise(r, kind) for r in y])
    out = []
    for j in range(d.shape[1]):
        lv = sorted(set(d[:, j].tolist()))
        s = [float(sn[d[:, j] == v].mean()) for v in lv]
        m = [float(y[d[:, j] == v].mean()) for v in lv]
        out.append({"factor": j, "levels": lv, "sn": s, "means": m, "delta_sn": max(s) - min(s), "delta_mean": max(m) - min(m), "best": lv[int(np.argmax(s))]})
    for rank, r in enumerate(sorted(out, key=lambda r: -r["delta_sn"]), 1):
        r["rank"] = rank
    return {"factors": out, "sn": sn.tolist()}


def _conference(m: int) -> np.ndarray:
    """A conference matrix of even order m - 1 = prime power q (here primes), by Paley's construction."""
    q = m - 1
    if any(q % p == 0 for p in range(2, int(q**0.5) + 1)):
        raise ValueError(f"no conference matrix of order {m} here")
    squares = {(i * i) % q for i in range(1, q)}
    chi = np.array([0] + [1 if i in squares else -1 for i in range(1, q)])
    core = chi[(np.arange(q)[:, None] - np.arange(q)) % q]
    c = np.zeros((m, m), int)
    c[0, 1:] = 1
    c[1:, 0] = 1 if q % 4 == 1 else -1
    c[1:, 1:] = core
    return c


def definitive_screening(factors: int, centre: int = 1) -> np.ndarray:
    """Fold-over pairs of a conference matrix and centre runs: 2 m + 1 runs for the smallest order m that holds the factors."""
    m = max(4, factors + factors % 2)
    while True:
        try:
            c = _conference(m)
            break
        except ValueError:
            m += 2
    c = c[:, :factors]
    return np.vstack([c, -c, np.zeros((centre, factors), int)])


def analyze_effects(design, y, names: list[str] | None = None, order: int = 2) -> dict:
    """Effects of a two-level design (twice the coefficients) and Lenth's pseudo standard error with its margin."""
    d, y = np.asarray(design, float), np.asarray(y, float)
    from itertools import combinations

    names = names or [chr(65 + i) for i in range(d.shape[1])]
    cols, labels = [], []
    for k in range(1, order + 1):
        for c in combinations(range(d.shape[1]), k):
            v = d[:, list(c)].prod(1)
            if not any(abs(v @ u) == len(v) for u in cols):  # aliased terms stand for the first
                cols.append(v)
                labels.append("*".join(names[i] for i in c))
    x = np.stack([np.ones(len(y)), *cols], 1)
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    e = 2 * b[1:]
    s0 = 1.5 * np.median(np.abs(e))
    inner = np.abs(e)[np.abs(e) < 2.5 * s0]
    pse = 1.5 * np.median(inner) if len(inner) else s0
    t = D.t(max(1.0, len(e) / 3))
    margin = t.ppf(0.975) * pse
    return {"mean": float(b[0]), "pse": float(pse), "margin": float(margin), "effects": [{"term": n, "effect": float(v), "t": float(v / pse) if pse else math.inf, "significant": bool(abs(v) > margin)} for n, v in sorted(zip(labels, e, strict=True), key=lambda r: -abs(r[1]))]}


def mixture_design(components: int, kind: str = "lattice", degree: int = 2, axial: bool = False) -> np.ndarray:
    """Simplex lattice or simplex centroid, with axial points halfway between the middle and the corners if wanted."""
    if kind == "lattice":
        d = E.simplex_lattice(components, degree)
    elif kind == "centroid":
        d = np.array([[1 / bin(m).count("1") if m >> i & 1 else 0.0 for i in range(components)] for m in range(1, 1 << components)])
    else:
        raise ValueError(f"kind: {kind}")
    if axial:
        mid = np.full(components, 1 / components)
        d = np.vstack([d, mid, (mid + np.eye(components)) / 2])
    return np.unique(np.round(d, 12), axis=0)[::-1]


def analyze_mixture(design, y, model: str = "quadratic") -> dict:
    """Scheffe's canonical polynomial: linear, quadratic or special cubic, without intercept."""
    from itertools import combinations

    d, y = np.asarray(design, float), np.asarray(y, float)
    q = d.shape[1]
    terms = [(i,) for i in range(q)]
    if model in ("quadratic", "cubic"):
        terms += list(combinations(range(q), 2))
    if model == "cubic":
        terms += list(combinations(range(q), 3))
    x = np.stack([d[:, list(t)].prod(1) for t in terms], 1)
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ b
    dof = len(y) - np.linalg.matrix_rank(x)
    s2 = float(e @ e / dof) if dof > 0 else math.nan
    cov = np.linalg.pinv(x.T @ x) * s2
    t = D.t(dof) if dof > 0 else None
    out = []
    for term, v, c in zip(terms, b, np.diag(cov), strict=True):
        se = math.sqrt(c) if c == c else math.nan
        out.append({"term": "*".join(f"x{i + 1}" for i in term), "estimate": float(v), "se": se, "p_value": D.two_sided(t, float(v) / se) if t and se else math.nan})
    return {"coefficients": out, "s": math.sqrt(s2) if s2 == s2 else math.nan, "r_squared": 1 - float(e @ e) / float(((y - y.mean()) ** 2).sum()), "df": dof, "predict": lambda z: float(sum(v * np.prod([z[i] for i in term]) for term, v in zip(terms, b, strict=True)))}


def response_optimizer(responses, goals, bounds, steps: int = 11, rounds: int = 6) -> dict:
    """The point of greatest joint desirability: a grid, then grids around its best point."""
    lo, hi = np.array([b[0] for b in bounds], float), np.array([b[1] for b in bounds], float)
    a, b, best = lo.copy(), hi.copy(), None
    for _ in range(rounds):
        for p in np.stack(np.meshgrid(*[np.linspace(x, y, steps) for x, y in zip(a, b, strict=True)], indexing="ij"), -1).reshape(-1, len(lo)):
            v = [f(p) for f in responses]
            d = E.desirability(v, goals)
            if best is None or d > best[0]:
                best = (d, p.copy(), v)
        span = (b - a) / (steps - 1)
        a, b = np.maximum(lo, best[1] - span), np.minimum(hi, best[1] + span)
    return {"desirability": float(best[0]), "at": best[1].tolist(), "responses": [float(v) for v in best[2]]}


# -- several variables ------------------------------------------------------------------------------------------
def cdist(a, b, metric: str = "euclidean", p: float = 2.0) -> np.ndarray:
    """Distances of the rows of two arrays: euclidean, manhattan, chebyshev, minkowski or cosine."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if metric == "cosine":
        return 1 - (a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
    d = np.abs(a[:, None] - b[None])
    return {"euclidean": lambda: np.sqrt((d**2).sum(2)), "manhattan": lambda: d.sum(2), "chebyshev": lambda: d.max(2), "minkowski": lambda: (d**p).sum(2) ** (1 / p)}[metric]()


def promax(loadings, power: float = 4.0) -> dict:
    """Oblique rotation: the varimax loadings' powers as target, factor variances scaled to one."""
    a = np.asarray(loadings, float)
    p, k = a.shape
    h = np.sqrt((a**2).sum(1, keepdims=True))
    x, r, last = a / np.where(h > 0, h, 1), np.eye(k), 0.0
    for _ in range(500):
        y = x @ r
        u, s, v = np.linalg.svd(x.T @ (y**3 - y @ np.diag((y**2).sum(0)) / p))
        r = u @ v
        if s.sum() - last < 1e-12 * s.sum():
            break
        last = s.sum()
    y = (x @ r) * h
    t = np.linalg.lstsq(y, y * np.abs(y) ** (power - 1), rcond=None)[0]
    t = t @ np.diag(np.sqrt(np.diag(np.linalg.inv(t.T @ t))))
    inv = np.linalg.inv(t)
    return {"pattern": y @ t, "rotation": r @ t, "correlations": inv @ inv.T, "structure": y @ t @ inv @ inv.T}


def multiple_correspondence(df: DataFrame, columns: list[str], most: int = 500) -> dict:
    """Principal inertias of the Burt table, which is one distributed count of pairs of categories."""
    d = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).dropna()
    cats = F.array(*[F.concat(F.lit(f"{c}="), F.col(c)) for c in columns])
    pairs = d.select(cats.alias("k")).select(F.explode("k").alias("a"), "k").select("a", F.explode("k").alias("b")).groupBy("a", "b").count().collect()
    names = sorted({r["a"] for r in pairs})
    if len(names) > most:
        raise ValueError(f"at most {most} categories")
    t = np.zeros((len(names), len(names)))
    for r in pairs:
        t[names.index(r["a"]), names.index(r["b"])] = r["count"]
    p = t / t.sum()
    m = p.sum(1)
    s = (p - np.outer(m, m)) / np.sqrt(np.outer(m, m))
    val, vec = np.linalg.eigh(s)
    order = np.argsort(-val)
    q = len(columns)
    keep = [i for i in order if val[i] > 1e-12][: len(names) - q]
    lam = val[keep]  # of the indicator matrix; the Burt table's are their squares
    adjusted = [float((q / (q - 1) * (x - 1 / q)) ** 2) if x > 1 / q else 0.0 for x in lam]
    return {"inertia": lam.tolist(), "burt_inertia": (lam**2).tolist(), "adjusted": adjusted, "categories": {n: (vec[i, keep] / math.sqrt(m[i]) * np.sqrt(lam)).tolist() for i, n in enumerate(names)}}


def mars(df: DataFrame, y: str, xs: list[str], terms: int = 11, knots: int = 10, penalty: float = 3.0) -> dict:
    """Additive regression splines: hinge pairs at quantiles enter greedily, then leave by generalised cross-validation.

    All candidate hinges' cross products are one aggregate, so both passes run on one small matrix.
    """
    d = df.select(clean(F.col(y)).alias("y"), *[clean(F.col(x)).alias(f"x{i}") for i, x in enumerate(xs)]).dropna()
    at = [(k + 1) / (knots + 1) for k in range(knots)]
    q = d.agg(*[F.percentile_approx(f"x{i}", at, 10_000).alias(f"q{i}") for i in range(len(xs))]).first()
    hinges = [(i, k, s) for i in range(len(xs)) for k in sorted(set(q[f"q{i}"])) for s in (1, -1)]
    cols: list[Column] = [F.lit(1.0), *[F.greatest((F.col(f"x{i}") - F.lit(float(k))) * s, F.lit(0.0)) for i, k, s in hinges], F.col("y")]
    from ashlar.stats.regression import _gram

    n, g, _ = _gram(d, cols)
    last = len(cols) - 1

    def rss(idx) -> float:
        i = list(idx)
        return float(g[last, last] - g[i, last] @ np.linalg.lstsq(g[np.ix_(i, i)], g[i, last], rcond=None)[0])

    def gcv(idx) -> float:
        c = len(idx) + penalty * (len(idx) - 1) / 2
        return rss(idx) / n / (1 - c / n) ** 2 if c < n else math.inf

    chosen = [0]
    while len(chosen) + 2 <= terms:
        pairs = [(2 * j + 1, 2 * j + 2) for j in range(len(hinges) // 2) if 2 * j + 1 not in chosen]
        if not pairs:
            break
        best = min(pairs, key=lambda p: rss([*chosen, *p]))
        if rss(chosen) - rss([*chosen, *best]) < 1e-6 * g[last, last]:
            break
        chosen += best
    best, now = list(chosen), list(chosen)
    while len(now) > 1:
        now = min(([k for k in now if k != out] for out in now if out), key=rss)
        if gcv(now) <= gcv(best):
            best = list(now)
    b = np.linalg.lstsq(g[np.ix_(best, best)], g[best, last], rcond=None)[0]
    tss = float(g[last, last] - g[0, last] ** 2 / n)
    basis = [{"variable": None, "knot": None, "sign": 0, "estimate": float(v)} if i == 0 else {"variable": xs[hinges[i - 1][0]], "knot": float(hinges[i - 1][1]), "sign": hinges[i - 1][2], "estimate": float(v)} for i, v in zip(best, b, strict=True)]
    return {"basis": basis, "gcv": gcv(best), "r_squared": 1 - rss(best) / tss, "n": n}


def mars_predict(df: DataFrame, model: dict, name: str = "prediction") -> DataFrame:
    out = F.lit(0.0)
    for t in model["basis"]:
        out = out + (F.lit(t["estimate"]) if t["variable"] is None else F.lit(t["estimate"]) * F.greatest((F.col(t["variable"]) - F.lit(t["knot"])) * t["sign"], F.lit(0.0)))
    return df.withColumn(name, out)


# -- matrices ---------------------------------------------------------------------------------------------------
def matrix(rows: int, cols: int, fill: float = 0.0) -> np.ndarray:
    return np.full((rows, cols), float(fill))


def from_rows(rows) -> np.ndarray:
    a = np.array(rows, float)
    if a.ndim != 2:
        raise ValueError("rows of one length are needed")
    return a


def column(a, j: int) -> np.ndarray:
    return np.asarray(a, float)[:, j].copy()


def transpose(a) -> np.ndarray:
    return np.asarray(a, float).T.copy()


def matmul(a, b) -> np.ndarray:
    return np.asarray(a, float) @ np.asarray(b, float)


def matvec(a, x) -> np.ndarray:
    return np.asarray(a, float) @ np.asarray(x, float)


def gram(a, w=None) -> np.ndarray:
    a = np.asarray(a, float)
    return a.T @ (a if w is None else a * np.asarray(w, float)[:, None])


def gram_of(df: DataFrame, columns: list[str], w: str | None = None) -> np.ndarray:
    """``gram`` over the complete rows of a table of any size, by one aggregate; the cross products with another column are in it too."""
    d = df.select(*[clean(F.col(c)).alias(f"x{i}") for i, c in enumerate(columns)], (clean(F.col(w)) if w else F.lit(1.0)).alias("w")).dropna()
    k = len(columns)
    r = d.agg(*[F.coalesce(F.sum(F.col(f"x{i}") * F.col(f"x{j}") * F.col("w")), F.lit(0.0)) for i in range(k) for j in range(i, k)]).first()
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = list(r)
    return out + np.triu(out, 1).T


def gram_vec(a, y, w=None) -> np.ndarray:
    y = np.asarray(y, float)
    return np.asarray(a, float).T @ (y if w is None else y * np.asarray(w, float))


def cholesky(a) -> np.ndarray:
    return np.linalg.cholesky(np.asarray(a, float))


def cholesky_solve(l, b) -> np.ndarray:
    l = np.asarray(l, float)
    return np.linalg.solve(l.T, np.linalg.solve(l, np.asarray(b, float)))


def inverse(a) -> np.ndarray:
    return np.linalg.inv(np.asarray(a, float))


def qr(a) -> tuple[np.ndarray, np.ndarray]:
    """Q and R with a positive diagonal."""
    q, r = np.linalg.qr(np.asarray(a, float))
    s = np.where(np.diag(r) < 0, -1.0, 1.0)
    return q * s, r * s[:, None]


def lstsq(a, b) -> dict:
    x, _, rank, _ = np.linalg.lstsq(np.asarray(a, float), np.asarray(b, float), rcond=None)
    return {"x": x, "rank": int(rank), "rss": float(((np.asarray(a, float) @ x - np.asarray(b, float)) ** 2).sum())}


def svd(a) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.linalg.svd(np.asarray(a, float), full_matrices=False)


def symmetric_eigen(a) -> dict:
    """Falling eigenvalues and their vectors, the largest entry of each positive."""
    val, vec = np.linalg.eigh(np.asarray(a, float))
    vec = vec[:, ::-1]
    vec = vec * np.sign(vec[np.abs(vec).argmax(0), np.arange(vec.shape[1])])
    return {"values": val[::-1].copy(), "vectors": vec}


def newton_max(gradient, hessian, x0, value=None, most: int = 100, tol: float = 1e-10) -> dict:
    """Newton's ascent; with ``value`` steps are halved until it rises."""
    x = np.asarray(x0, float)
    for i in range(most):
        step = -np.linalg.solve(np.atleast_2d(hessian(x)), np.atleast_1d(gradient(x)))
        a = 1.0
        while value is not None and value(x + a * step) < value(x) and a > 1e-8:
            a /= 2
        x = x + a * step
        if np.abs(a * step).max() < tol * (1 + np.abs(x).max()):
            break
    return {"x": x, "iterations": i + 1, "converged": bool(np.abs(step).max() < 1e-4 * (1 + np.abs(x).max()))}


def min_of(x) -> float:
    return float(np.nanmin(np.asarray(list(x), float)))


def max_of(x) -> float:
    return float(np.nanmax(np.asarray(list(x), float)))


# -- text output ------------------------------------------------------------------------------------------------
def plot_series(df: DataFrame, x: str, y: str, by: str | None = None, points: int = 500) -> list[dict]:
    """Series for a line chart: at most ``points`` equal slices of x, each with the mean, least and greatest y."""
    d = df.select(clean(F.col(x)).alias("x"), clean(F.col(y)).alias("y"), (F.col(by).cast("string") if by else F.lit("")).alias("g")).dropna()
    r = d.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if r["lo"] is None:
        return []
    w = (r["hi"] - r["lo"]) / points or 1.0
    b = F.least(F.floor((F.col("x") - r["lo"]) / w), F.lit(points - 1))
    rows = d.groupBy("g", b.alias("b")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.min("y").alias("low"), F.max("y").alias("high")).orderBy("g", "b").collect()
    names = sorted({q["g"] for q in rows})
    return [{"name": g, "points": [(q["x"], q["y"], q["low"], q["high"]) for q in rows if q["g"] == g]} for g in names]


def render_plot_series(series: list[dict], width: int = 60, height: int = 15) -> str:
    """The series as text, one letter each."""
    pts = [(p[0], p[1]) for s in series for p in s["points"]]
    if not pts:
        return ""
    (x0, y0), (x1, y1) = map(min, zip(*pts, strict=True)), map(max, zip(*pts, strict=True))
    grid = [[" "] * width for _ in range(height)]
    for i, s in enumerate(series):
        for p in s["points"]:
            c = int((p[0] - x0) / (x1 - x0 or 1) * (width - 1))
            r = int((p[1] - y0) / (y1 - y0 or 1) * (height - 1))
            grid[height - 1 - r][c] = chr(97 + i % 26)
    return "\n".join("".join(r).rstrip() for r in grid)


def format_report(result, title: str = "", digits: int = 6) -> str:
    """A result as aligned text: scalars by name, lists of records as tables."""
    def show(v) -> str:
        return f"{v:.{digits}g}" if isinstance(v, float) else "(" + ", ".join(map(show, v)) + ")" if isinstance(v, tuple) else str(v)

    lines = [title, "=" * len(title)] if title else []
    items = result.items() if isinstance(result, dict) else [("", result)]
    for k, v in items:
        if isinstance(v, list) and v and isinstance(v[0], dict):
            head = list(v[0])
            body = [[show(r.get(h)) for h in head] for r in v]
            w = [max(len(h), *(len(r[i]) for r in body)) for i, h in enumerate(head)]
            lines += [f"{k}:", "  " + "  ".join(h.ljust(n) for h, n in zip(head, w, strict=True)), *["  " + "  ".join(c.rjust(n) for c, n in zip(r, w, strict=True)) for r in body]]
        elif isinstance(v, dict):
            lines += [f"{k}:", *["  " + x for x in format_report(v, digits=digits).splitlines()]]
        elif not callable(v) and not isinstance(v, DataFrame):
            lines.append(f"{k}: {show(v)}")
    return "\n".join(lines)


# -- bundles ----------------------------------------------------------------------------------------------------
def doe_study(design, y, names: list[str] | None = None, order: int = 2) -> dict:
    return {"effects": analyze_effects(design, y, names, order), "model": E.analyze(np.asarray(design, float), y, 1)}


def msa_study(df: DataFrame, value: str, part: str, operator: str, tolerance: float | None = None) -> dict:
    from ashlar.stats import process

    return {"gage": process.expanded_gage_rr(df, value, part, operator, tolerance), "by_operator": B.descriptive_stats(df, value, operator)}


def time_series_study(df: DataFrame, value: str, order: str, period: int | None = None, ahead: int = 10) -> dict:
    from ashlar.stats import series, timeseries

    m = series.auto_arima(df, value, order, period or 1, seasonal=bool(period))
    out = {"acf": timeseries.acf(df, value, order, 20), "trend": timeseries.trend_analysis(df, value, order), "arima": m, "forecast": series.forecast(m, ahead), "whiteness": series.cumulative_periodogram(df, value, order)}
    return out | ({"stl": series.stl(df, value, order, period)} if period else {})


def reliability_study(df: DataFrame, time: str, censor: str | None = None, distributions=("weibull", "lognormal", "exponential")) -> dict:
    from ashlar.stats import life

    return {"fits": {d: life.reliability_fit(df, time, censor, d) for d in distributions}, "plots": {d: life.probability_plot(df, time, censor, d)["correlation"] for d in distributions}}


def multivariate_study(df: DataFrame, xs: list[str]) -> dict:
    from ashlar.stats import multivariate as M

    return {"pca": M.pca(df, xs), "items": M.item_analysis(df, xs), "clusters": M.cluster_variables(df, xs)}


def engineering_study(kind: str, *args, **options) -> dict:
    """doe, msa, series, reliability or multivariate."""
    return {"doe": doe_study, "msa": msa_study, "series": time_series_study, "reliability": reliability_study, "multivariate": multivariate_study}[kind](*args, **options)


def graph_workbench(df: DataFrame, kind: str, *args, **options):
    """The rows of a chart by its name."""
    from ashlar.stats import scale as S

    one = {"histogram": B.histogram_bins, "boxplot": B.boxplot_stats, "interval": S.interval_plot, "main-effects": S.main_effects_plot, "interaction": S.interaction_plot, "dotplot": S.dotplot, "line": plot_series}
    return one[kind](df, *args, **options)


# -- worksheet formulas -----------------------------------------------------------------------------------------
_EPOCH = date(1899, 12, 30)
_AGGREGATES = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp, "var": F.var_samp, "median": lambda c: F.percentile(c, F.lit(0.5))}
_FUNCTIONS = {"abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "ln": F.log, "log10": F.log10, "round": F.round, "floor": F.floor, "ceil": F.ceil, "sin": F.sin, "cos": F.cos, "upper": F.upper, "lower": F.lower, "length": F.char_length, "concat": F.concat}


def worksheet_date(value) -> float:
    """Serial number of a date or ISO text, 1 being 31 December 1899."""
    v = datetime.fromisoformat(value) if isinstance(value, str) else value
    day = v.date() if isinstance(v, datetime) else v
    rest = (v - datetime(v.year, v.month, v.day)).total_seconds() / 86400 if isinstance(v, datetime) else 0.0
    return (day - _EPOCH).days + rest


def worksheet_date_text(serial: float) -> str:
    d = datetime(_EPOCH.year, _EPOCH.month, _EPOCH.day) + timedelta(days=serial)
    return d.date().isoformat() if serial == int(serial) else d.isoformat(sep=" ", timespec="seconds")


def compile_worksheet_expression(text: str) -> ast.Expression:
    """A checked formula: names in brackets or plain, arithmetic, comparisons, ``if(c, a, b)`` and the functions above."""
    source, names, i = "", {}, 0
    while i < len(text):
        if text[i] == "[":
            end = text.index("]", i)
            key = f"_c{len(names)}"
            names[key] = text[i + 1 : end]
            source, i = source + key, end + 1
        else:
            source, i = source + text[i], i + 1
    source = source.lstrip("=").replace("<>", "!=").replace("^", "**").replace("if(", "if_(")
    tree = ast.parse(source.strip(), mode="eval")
    ok = (ast.Expression, ast.BinOp, ast.UnaryOp, ast.Compare, ast.Call, ast.Name, ast.Constant, ast.Load, ast.operator, ast.unaryop, ast.cmpop, ast.BoolOp, ast.boolop)
    for n in ast.walk(tree):
        if not isinstance(n, ok) or (isinstance(n, ast.Call) and (not isinstance(n.func, ast.Name) or n.func.id not in {*_FUNCTIONS, *_AGGREGATES, "if_"} or n.keywords)):
            raise ValueError(f"not allowed in a formula: {ast.unparse(n) if hasattr(n, 'lineno') else n}")
    tree.names = names
    return tree


def worksheet_references(expr) -> list[str]:
    tree = compile_worksheet_expression(expr) if isinstance(expr, str) else expr
    calls = {n.func.id for n in ast.walk(tree) if isinstance(n, ast.Call)}
    return list(dict.fromkeys(tree.names.get(n.id, n.id) for n in ast.walk(tree) if isinstance(n, ast.Name) and n.id not in calls))


def worksheet_expression_text(expr) -> str:
    out = ast.unparse(expr).replace("if_(", "if(").replace("**", "^")
    for k, v in expr.names.items():
        out = out.replace(k, f"[{v}]")
    return out


def worksheet_aggregate(df: DataFrame, name: str, col: str):
    return df.agg(_AGGREGATES[name](F.col(col))).first()[0]


def evaluate_worksheet_expression(df: DataFrame, expr) -> Column:
    """The formula as a Column; aggregates inside it are worked out first, one pass each."""
    tree = compile_worksheet_expression(expr) if isinstance(expr, str) else expr
    ops = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.try_divide(a, b), ast.Mod: lambda a, b: a % b, ast.Pow: lambda a, b: F.pow(a, b)}
    tests = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}

    def col(n) -> Column:
        if isinstance(n, ast.Expression):
            return col(n.body)
        if isinstance(n, ast.Constant):
            return F.lit(n.value)
        if isinstance(n, ast.Name):
            return F.col(f"`{tree.names.get(n.id, n.id)}`")
        if isinstance(n, ast.BinOp):
            return ops[type(n.op)](col(n.left), col(n.right))
        if isinstance(n, ast.UnaryOp):
            return -col(n.operand) if isinstance(n.op, ast.USub) else ~col(n.operand) if isinstance(n.op, ast.Not) else col(n.operand)
        if isinstance(n, ast.Compare):
            parts = [tests[type(o)](col(a), col(b)) for o, a, b in zip(n.ops, [n.left, *n.comparators], n.comparators, strict=False)]
            out = parts[0]
            for p in parts[1:]:
                out = out & p
            return out
        if isinstance(n, ast.BoolOp):
            out = col(n.values[0])
            for v in n.values[1:]:
                out = (out & col(v)) if isinstance(n.op, ast.And) else (out | col(v))
            return out
        name = n.func.id
        if name == "if_":
            return F.when(col(n.args[0]), col(n.args[1])).otherwise(col(n.args[2]))
        if name in _AGGREGATES and name not in _FUNCTIONS:
            return F.lit(df.agg(_AGGREGATES[name](col(n.args[0]))).first()[0])
        if name == "round" and len(n.args) == 2:
            return F.round(col(n.args[0]), n.args[1].value)
        return _FUNCTIONS[name](*[col(a) for a in n.args])

    return col(tree)


def recalculate_worksheet(df: DataFrame, formulas: dict[str, str]) -> DataFrame:
    """All formula columns in the order of their references; a circle is refused."""
    left, done = dict(formulas), df
    while left:
        ready = [k for k, f in left.items() if not set(worksheet_references(f)) & set(left)]
        if not ready:
            raise ValueError(f"formulas refer to each other in a circle: {sorted(left)}")
        for k in ready:
            done = done.withColumn(k, evaluate_worksheet_expression(done, left.pop(k)))
    return done


def worksheet_matrix(df: DataFrame, columns: list[str], most: int = 1_000_000) -> np.ndarray:
    """Complete rows of numeric columns as an array; refused beyond ``most`` rows."""
    t = df.select(*[clean(F.col(c)).alias(c) for c in columns]).dropna().limit(most + 1).toArrow()
    if t.num_rows > most:
        raise ValueError(f"at most {most} rows")
    return np.stack([t[c].to_numpy() for c in columns], 1)
