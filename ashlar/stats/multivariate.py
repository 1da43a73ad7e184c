"""Principal components, clustering, discrimination, correspondence and item analysis on distributed cross products."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.stats.basic import clean, crosstab


def covariance(df: DataFrame, xs: list[str], correlation: bool = False):
    """(n, means, matrix) over complete rows: one pass for the means, one for centred products."""
    d = df.select(*[clean(F.col(x)).alias(f"x{i}") for i, x in enumerate(xs)]).dropna()
    k = len(xs)
    m = d.agg(F.count(F.lit(1)), *[F.avg(f"x{i}") for i in range(k)]).first()
    c = [F.col(f"x{i}") - m[i + 1] for i in range(k)]
    r = d.agg(*[F.sum(c[i] * c[j]).alias(f"{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    s = np.array([[r[f"{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / (m[0] - 1)
    if correlation:
        sd = np.sqrt(np.diag(s))
        s = s / np.outer(sd, sd)
    return m[0], np.array(m[1:], float), s


def pca(df, xs, correlation=True) -> dict:
    n, mean, s = covariance(df, xs, correlation)
    val, vec = np.linalg.eigh(s)
    val, vec = val[::-1], vec[:, ::-1]
    vec = vec * np.where(np.abs(vec).max(0) == vec.max(0), 1, -1)  # the largest loading is positive
    return {"n": n, "eigenvalues": val, "proportion": val / val.sum(), "loadings": vec, "means": mean, "terms": xs}


def pca_scores(df: DataFrame, model: dict, k: int = 2) -> DataFrame:
    out = df
    for j in range(k):
        out = out.withColumn(f"pc{j + 1}", sum((F.lit(float(v)) * (F.col(x) - float(m)) for v, x, m in zip(model["loadings"][:, j], model["terms"], model["means"], strict=True)), F.lit(0.0)))
    return out


def factor_analysis(df, xs, k: int, rotate: bool = True) -> dict:
    """Principal-component factors with varimax."""
    p = pca(df, xs)
    a = p["loadings"][:, :k] * np.sqrt(p["eigenvalues"][:k])
    if rotate and k > 1:
        r, last = np.eye(k), 0.0
        for _ in range(500):
            l = a @ r
            u, s, v = np.linalg.svd(a.T @ (l**3 - l * (l**2).mean(0)))
            r = u @ v
            if s.sum() < last * (1 + 1e-12):
                break
            last = s.sum()
        a = a @ r
    return {"loadings": a, "communality": (a**2).sum(1), "variance": (a**2).sum(0)}


def kmeans(df: DataFrame, xs: list[str], k: int, seed: int = 1, most: int = 50) -> dict:
    """Lloyd's iterations as aggregates, by Spark's own implementation."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    d = df.select(*[clean(F.col(x)).alias(x) for x in xs]).dropna()
    v = VectorAssembler(inputCols=xs, outputCol="features").transform(d)
    m = KMeans(k=k, seed=seed, maxIter=most).fit(v)
    return {"centres": np.array(m.clusterCenters()), "cost": m.summary.trainingCost, "sizes": m.summary.clusterSizes}


def discriminant(df: DataFrame, xs: list[str], group: str) -> dict:
    """Linear discriminant functions from pooled within-group products."""
    d = df.select(F.col(group).cast("string").alias("g"), *[clean(F.col(x)).alias(f"x{i}") for i, x in enumerate(xs)]).dropna()
    k = len(xs)
    rows = d.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(k)], *[F.covar_samp(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).orderBy("g").collect()
    n = sum(r["n"] for r in rows)
    s = sum((r["n"] - 1) * np.array([[r[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]) for r in rows) / (n - len(rows))
    inv, out = np.linalg.inv(s), {}
    for r in rows:
        m = np.array([r[f"m{i}"] for i in range(k)])
        out[r["g"]] = {"constant": float(-0.5 * m @ inv @ m + math.log(r["n"] / n)), "coefficients": dict(zip(xs, inv @ m, strict=True)), "n": r["n"]}
    return {"functions": out, "pooled": s}


def classify(df: DataFrame, model: dict, name: str = "predicted") -> DataFrame:
    s = [F.struct((F.lit(f["constant"]) + sum((F.lit(float(v)) * F.col(x) for x, v in f["coefficients"].items()), F.lit(0.0))).alias("s"), F.lit(g).alias("g")) for g, f in model["functions"].items()]
    return df.withColumn(name, F.greatest(*s)["g"])


def correspondence(df, a, b) -> dict:
    t = crosstab(df, a, b)
    p = t["table"] / t["table"].sum()
    r, c = p.sum(1), p.sum(0)
    u, s, v = np.linalg.svd((p - np.outer(r, c)) / np.sqrt(np.outer(r, c)), full_matrices=False)
    keep = s > 1e-10
    return {"inertia": s[keep] ** 2, "rows": dict(zip(t["rows"], (u / np.sqrt(r)[:, None] * s)[:, keep].tolist(), strict=True)), "columns": dict(zip(t["columns"], (v.T / np.sqrt(c)[:, None] * s)[:, keep].tolist(), strict=True))}


def item_analysis(df, xs) -> dict:
    """Cronbach's alpha, and without each item."""
    _, _, s = covariance(df, xs)
    alpha = lambda m: len(m) / (len(m) - 1) * (1 - np.trace(m) / m.sum())
    without = {x: float(alpha(np.delete(np.delete(s, i, 0), i, 1))) for i, x in enumerate(xs)} if len(xs) > 2 else {}
    return {"alpha": float(alpha(s)), "without": without}


def mahalanobis(df: DataFrame, xs: list[str], name: str = "d2") -> DataFrame:
    """Squared distance of each row to the mean (Hotelling's T2 of single observations)."""
    _, m, s = covariance(df, xs)
    inv = np.linalg.inv(s)
    z = [F.col(x).cast("double") - float(v) for x, v in zip(xs, m, strict=True)]
    return df.withColumn(name, sum((z[i] * z[j] * float(inv[i, j]) for i in range(len(xs)) for j in range(len(xs))), F.lit(0.0)))


def _linked(d: np.ndarray, method: str) -> list[tuple[int, int, float, int]]:
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    ids, size, out = list(range(n)), [1] * n, []
    for step in range(n - 1):
        i, j = divmod(int(d.argmin()), n)
        i, j = min(i, j), max(i, j)
        out.append((ids[i], ids[j], float(d[i, j]), size[i] + size[j]))
        a, b = d[i], d[j]
        new = {"single": np.minimum(a, b), "complete": np.where(np.isinf(a) | np.isinf(b), np.inf, np.maximum(a, b)), "average": (size[i] * a + size[j] * b) / (size[i] + size[j])}[method]
        d[i, :] = d[:, i] = new
        d[i, i] = np.inf
        d[j, :] = d[:, j] = np.inf
        ids[i], size[i] = n + step, size[i] + size[j]
    return out


def cluster_variables(df, xs, method="average") -> list[tuple[int, int, float, int]]:
    """Merges (a, b, distance, size) of variables by 1 - correlation."""
    return _linked(1 - covariance(df, xs, True)[2], method)


def hclust(x: np.ndarray, method: str = "average") -> list[tuple[int, int, float, int]]:
    """Merges of the rows of a small matrix."""
    return _linked(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), method)


def cut_tree(merges, n: int, k: int) -> list[int]:
    label = {i: [i] for i in range(n)}
    for s, (a, b, _, _) in enumerate(merges[: n - k]):
        label[n + s] = label.pop(a) + label.pop(b)
    out = [0] * n
    for c, rows in enumerate(sorted(label.values(), key=min)):
        for r in rows:
            out[r] = c
    return out
