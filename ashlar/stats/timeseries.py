"""Time series: lagged sums are distributed; recursions run on one ordered series, or per group through applyInPandas."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ashlar.operators import positions
from ashlar.stats import dist as D
from ashlar.stats.basic import clean
from ashlar.stats.spc import _ordered


def acf(df: DataFrame, value: str, order: str, lags: int | None = None, confidence: float = 0.95) -> list[dict]:
    """Biased autocorrelations, all lags in one aggregate over numbered rows."""
    d = positions.number(df.select(F.col(order).alias("o"), clean(F.col(value)).alias("x")).filter("x is not null"), ["o"], "i")
    s = d.agg(F.count("x").alias("n"), F.avg("x").alias("m")).first()
    n, m = s["n"], s["m"]
    lags = min(40, n // 2) if lags is None else lags
    # a row meets the rows up to ``lags`` ahead of it within its block of positions, blocks overlapping by ``lags``
    width = max(lags, 4096)
    block = F.floor(F.col("i") / width)
    both = d.select("i", (F.col("x") - m).alias("x"), F.explode(F.array(F.struct(block.alias("b"), F.lit(True).alias("own")), F.struct((block - 1).alias("b"), F.lit(False).alias("own")))).alias("k")).select("i", "x", "k.*")
    w = Window.partitionBy("b").orderBy("i")
    cols = [F.lead("x", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)]
    r = both.select("x", "own", *cols).filter("own").agg(F.sum(F.col("x") * F.col("x")).alias("c0"), *[F.sum(F.col("x") * F.col(f"l{k}")).alias(f"c{k}") for k in range(1, lags + 1)]).first()
    z = D.normal().ppf(1 - (1 - confidence) / 2) / math.sqrt(n)
    return [{"lag": k, "acf": (r[f"c{k}"] or 0.0) / r["c0"], "band": z} for k in range(1, lags + 1)]


def pacf(df, value, order, lags: int | None = None) -> list[dict]:
    """Durbin-Levinson on the autocorrelations."""
    a = acf(df, value, order, lags)
    r = np.array([1.0] + [x["acf"] for x in a])
    out, phi = [], np.zeros(0)
    for k in range(1, len(r)):
        last = (r[k] - phi @ r[1:k][::-1]) / (1 - phi @ r[1:k]) if k > 1 else r[1]
        phi = np.append(phi - last * phi[::-1], last)
        out.append({"lag": k, "pacf": float(last), "band": a[k - 1]["band"]})
    return out


def ljung_box(df, value, order, lags=10, fitted=0) -> dict:
    n = df.agg(F.count(clean(F.col(value)))).first()[0]
    q = n * (n + 2) * sum(x["acf"] ** 2 / (n - x["lag"]) for x in acf(df, value, order, lags))
    return {"q": q, "df": lags - fitted, "p_value": D.chi2(lags - fitted).sf(q)}


def ccf(df, a, b, order, lags=20) -> list[dict]:
    d = df.select(F.col(order).alias("o"), clean(F.col(a)).alias("a"), clean(F.col(b)).alias("b")).dropna()
    x, y = _ordered(d, "a", "o"), _ordered(d, "b", "o")
    x, y = x - x.mean(), y - y.mean()
    s = math.sqrt((x @ x) * (y @ y))
    return [{"lag": k, "ccf": float((x[: len(x) - k] @ y[k:]) / s if k >= 0 else (x[-k:] @ y[: len(y) + k]) / s)} for k in range(-lags, lags + 1)]


def trend_analysis(df, value, order, kind="linear") -> dict:
    """linear, quadratic or growth trend against position, by least squares on distributed sums."""
    from ashlar.stats.regression import ols

    d = positions.number(df.select(F.col(order).alias("o"), clean(F.col(value)).alias("y")).filter("y is not null"), ["o"], "i").select((F.col("i") + 1).cast("double").alias("t"), "y")
    if kind == "growth":
        d = d.withColumn("y", F.log("y"))
    if kind == "quadratic":
        d = d.withColumn("t2", F.col("t") * F.col("t"))
    m = ols(d, "y", ["t", "t2"] if kind == "quadratic" else ["t"])
    return {"kind": kind, "model": m}


def decompose(df, value, order, period: int, model="multiplicative") -> dict:
    """Centred moving average, seasonal indices normalised to mean 1 (or 0), one ordered series."""
    x = _ordered(df, value, order)
    w = np.ones(period) / period if period % 2 else np.r_[0.5, np.ones(period - 1), 0.5] / period
    h = len(w) // 2
    trend = np.full(len(x), np.nan)
    if len(x) >= len(w):
        trend[h : len(x) - h] = np.convolve(x, w, "valid")
    r = x / trend if model == "multiplicative" else x - trend
    idx = np.array([np.nanmedian(r[i::period]) for i in range(period)])
    idx = idx / idx.mean() if model == "multiplicative" else idx - idx.mean()
    s = np.resize(idx, len(x))
    return {"trend": trend, "seasonal": idx, "adjusted": x / s if model == "multiplicative" else x - s, "residual": (x / (trend * s)) if model == "multiplicative" else x - trend - s}


def ets(df, value, order, alpha=None, beta=None) -> dict:
    """Simple, or with ``beta`` (0 lets it be found) double exponential smoothing; weights by grid when not given."""
    x = _ordered(df, value, order)

    def run(a, b):
        level, slope, sse = x[0], (x[1] - x[0]) if b is not None and len(x) > 1 else 0.0, 0.0
        for v in x[1:]:
            f = level + slope
            sse += (v - f) ** 2
            new = a * v + (1 - a) * f
            slope = b * (new - level) + (1 - b) * slope if b is not None else 0.0
            level = new
        return sse, level, slope

    grid = np.linspace(0.05, 0.95, 19)
    pick = [(run(a, b), a, b) for a in ([alpha] if alpha is not None else grid) for b in ([None] if beta is None else [beta] if beta else grid)]
    (sse, level, slope), a, b = min(pick, key=lambda p: p[0][0])
    return {"alpha": float(a), "beta": None if b is None else float(b), "level": float(level), "slope": float(slope), "mse": sse / max(1, len(x) - 1), "forecast": lambda k: [float(level + slope * (i + 1)) for i in range(k)]}


def adf_test(df, value, order, lags=1) -> dict:
    """Dickey-Fuller regression with constant; the statistic, and MacKinnon's large-sample 5 % value (-2.86)."""
    x = _ordered(df, value, order)
    d = np.diff(x)
    y = d[lags:]
    cols = [np.ones(len(y)), x[lags:-1], *[d[lags - k : -k] for k in range(1, lags + 1)]]
    a = np.stack(cols, 1)
    b, *_ = np.linalg.lstsq(a, y, rcond=None)
    e = y - a @ b
    se = math.sqrt(e @ e / (len(y) - a.shape[1]) * np.linalg.inv(a.T @ a)[1, 1])
    return {"statistic": float(b[1] / se), "critical_5": -2.86, "stationary": b[1] / se < -2.86}


def kpss_test(df, value, order, lags=None) -> dict:
    x = _ordered(df, value, order)
    e = x - x.mean()
    n = len(e)
    k = int(4 * (n / 100) ** 0.25) if lags is None else lags
    s = e @ e / n + 2 * sum((1 - i / (k + 1)) * (e[i:] @ e[:-i]) / n for i in range(1, k + 1))
    stat = float((np.cumsum(e) ** 2).sum() / n**2 / s)
    return {"statistic": stat, "critical_5": 0.463, "stationary": stat < 0.463}


def periodogram(df, value, order) -> list[dict]:
    x = _ordered(df, value, order)
    p = np.abs(np.fft.rfft(x - x.mean())) ** 2 / len(x)
    return [{"frequency": float(f), "power": float(v)} for f, v in zip(np.fft.rfftfreq(len(x))[1:], p[1:], strict=True)]


def dft(df, value, order) -> np.ndarray:
    return np.fft.fft(_ordered(df, value, order))


def welch_psd(df, value, order, segment=256) -> list[dict]:
    x = _ordered(df, value, order)
    n = min(segment, len(x))
    w = np.hanning(n)
    parts = [x[i : i + n] for i in range(0, len(x) - n + 1, max(1, n // 2))]
    p = np.mean([np.abs(np.fft.rfft((v - v.mean()) * w)) ** 2 for v in parts], axis=0) / (w**2).sum()
    return [{"frequency": float(f), "power": float(v)} for f, v in zip(np.fft.rfftfreq(n), p, strict=True)]


def savitzky_golay(df, value, order, window=5, degree=2) -> np.ndarray:
    x = _ordered(df, value, order)
    h = window // 2
    a = np.vander(np.arange(-h, h + 1), degree + 1, increasing=True)
    c = np.linalg.pinv(a)[0]
    return np.convolve(np.pad(x, h, "edge"), c[::-1], "valid")


def moving_average(df: DataFrame, value: str, order: str, span: int, name: str = "ma", by=()) -> DataFrame:
    return df.withColumn(name, F.avg(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-(span - 1), 0)))
