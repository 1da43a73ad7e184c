"""Small dense numerics, quadrature, optimisation, density estimates and generated data."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.stats.basic import clean, moments


def trapz(y, x=None) -> float:
    y = np.asarray(y, float)
    x = np.arange(len(y)) if x is None else np.asarray(x, float)
    return float((np.diff(x) * (y[1:] + y[:-1]) / 2).sum())


def simpson(y, x=None) -> float:
    """Composite rule on pairs of intervals of any width; a last odd interval is a trapezium."""
    y = np.asarray(y, float)
    x = np.arange(len(y), dtype=float) if x is None else np.asarray(x, float)
    n = (len(y) - 1) // 2 * 2
    h0, h1 = np.diff(x)[0:n:2], np.diff(x)[1:n:2]
    a, b, c = y[0:n:2], y[1 : n + 1 : 2], y[2 : n + 1 : 2]
    out = ((h0 + h1) / 6 * ((2 - h1 / h0) * a + (h0 + h1) ** 2 / (h0 * h1) * b + (2 - h0 / h1) * c)).sum()
    return float(out + (trapz(y[n:], x[n:]) if n < len(y) - 1 else 0.0))


def num_gradient(f: Callable, x, h: float = 1e-6) -> np.ndarray:
    x = np.asarray(x, float)
    e = np.eye(len(x)) * np.maximum(np.abs(x), 1) * h
    return np.array([(f(x + d) - f(x - d)) / (2 * d.sum()) for d in e])


def num_hessian(f: Callable, x, h: float = 1e-4) -> np.ndarray:
    x = np.asarray(x, float)
    e = np.eye(len(x)) * np.maximum(np.abs(x), 1) * h
    return np.array([[(f(x + a + b) - f(x + a - b) - f(x - a + b) + f(x - a - b)) / (4 * a.sum() * b.sum()) for b in e] for a in e])


def nelder_mead(f: Callable, x0, most: int = 2000, tol: float = 1e-10) -> dict:
    x0 = np.asarray(x0, float)
    s = [x0] + [x0 + np.eye(len(x0))[i] * (0.05 * x0[i] if x0[i] else 0.00025) for i in range(len(x0))]
    v = [f(p) for p in s]
    for it in range(most):
        o = np.argsort(v)
        s, v = [s[i] for i in o], [v[i] for i in o]
        if abs(v[-1] - v[0]) < tol * (abs(v[0]) + tol) and max(np.abs(p - s[0]).max() for p in s) < 1e-8:
            break
        c = np.mean(s[:-1], axis=0)
        r = 2 * c - s[-1]
        fr = f(r)
        if fr < v[0]:
            e = 3 * c - 2 * s[-1]
            fe = f(e)
            s[-1], v[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < v[-2]:
            s[-1], v[-1] = r, fr
        else:
            k = c + 0.5 * ((r if fr < v[-1] else s[-1]) - c)
            fk = f(k)
            if fk < min(fr, v[-1]):
                s[-1], v[-1] = k, fk
            else:
                s = [s[0]] + [s[0] + 0.5 * (p - s[0]) for p in s[1:]]
                v = [v[0]] + [f(p) for p in s[1:]]
    return {"x": s[0], "value": v[0], "iterations": it + 1}


def nnls(a, b, most: int = 1000) -> np.ndarray:
    """Non-negative least squares by active sets."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(most):
        w = a.T @ (b - a @ x)
        if active.all() or w[~active].max() < 1e-10:
            break
        active[np.where(~active, w, -np.inf).argmax()] = True
        while True:
            z = np.zeros_like(x)
            z[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if (z[active] > 0).all():
                break
            low = active & (z <= 0)
            step = (x[low] / (x[low] - z[low])).min()
            x = x + step * (z - x)
            active &= x > 1e-14
        x = z
    return x


def gaussian_kde(df: DataFrame, value: str, points: int = 128) -> list[dict]:
    """Density on a grid: one aggregate of kernel sums, whatever the number of rows."""
    m = moments(df, value)[None]
    h = 1.06 * math.sqrt(m["var"]) * m["n"] ** -0.2
    grid = np.linspace(m["min"] - 3 * h, m["max"] + 3 * h, points)
    x = clean(F.col(value))
    r = df.agg(*[F.sum(F.exp(-F.pow((x - float(g)) / h, F.lit(2)) / 2)).alias(f"k{i}") for i, g in enumerate(grid)]).first()
    return [{"x": float(g), "density": r[f"k{i}"] / (m["n"] * h * math.sqrt(2 * math.pi))} for i, g in enumerate(grid)]


def random(spark: SparkSession, n: int, dist=None, seed: int = 1, name: str = "x") -> DataFrame:
    """n values of a distribution of ``dist`` (uniform without), drawn on the executors by inversion."""
    u = spark.range(n).select(F.rand(seed).alias("u"))
    if dist is None:
        return u.select(F.col("u").alias(name))

    def run(batches):
        for b in batches:
            yield b.assign(**{name: [dist.ppf(min(max(v, 1e-15), 1 - 1e-15)) for v in b["u"]]})[[name]]

    return u.mapInPandas(run, f"{name} double")


def patterned(spark: SparkSession, start: float, stop: float, step: float = 1.0, each: int = 1, times: int = 1) -> DataFrame:
    k = int(math.floor((stop - start) / step + 1e-9)) + 1
    return spark.range(k * each * times).select("id", (F.lit(start) + F.floor(F.col("id") / each) % k * step).alias("x"))
