"""Trees, forests and boosting by Spark's own learners, cross-validation, and survival regression."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import AFTSurvivalRegression, DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.stats.basic import clean

_MODELS = {
    ("cart", True): DecisionTreeClassifier, ("cart", False): DecisionTreeRegressor, ("forest", True): RandomForestClassifier, ("forest", False): RandomForestRegressor,
    ("boosted", True): GBTClassifier, ("boosted", False): GBTRegressor, ("linear", True): LogisticRegression, ("linear", False): LinearRegression,
}


def prepared(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    d = df.select(*[c for c in df.columns if c not in (*xs, y)], clean(F.col(y)).alias(y), *[clean(F.col(x)).alias(x) for x in xs]).dropna(subset=[y, *xs])
    return VectorAssembler(inputCols=xs, outputCol="features").transform(d)


def fit(df: DataFrame, y: str, xs: list[str], kind: str = "cart", classify: bool = False, **options):
    """cart, forest, boosted or linear; returns the fitted model of Spark's library."""
    seed = {"seed": 1} if kind != "linear" else {}
    return _MODELS[kind, classify](labelCol=y, featuresCol="features", **(seed | options)).fit(prepared(df, y, xs))


def importance(model, xs: list[str]) -> dict[str, float]:
    return dict(sorted(zip(xs, model.featureImportances.toArray().tolist(), strict=True), key=lambda p: -p[1]))


def cross_validate(df: DataFrame, y: str, xs: list[str], kind: str = "cart", classify: bool = False, folds: int = 5, seed: int = 1, **options) -> dict:
    """Folds by a hash of the row, so that they don't depend on partitioning; accuracy or R squared."""
    d = prepared(df, y, xs).withColumn("_fold", F.pmod(F.xxhash64(*xs, y, F.lit(seed)), F.lit(folds))).persist()
    got = []
    try:
        total = d.agg(F.var_pop(y)).first()[0]
        for k in range(folds):
            seeded = {"seed": seed} if kind != "linear" else {}
            m = _MODELS[kind, classify](labelCol=y, featuresCol="features", **(seeded | options)).fit(d.filter(F.col("_fold") != k))
            p = m.transform(d.filter(F.col("_fold") == k))
            r = p.agg(F.avg((F.col("prediction") == F.col(y)).cast("double")), F.avg(F.pow(F.col("prediction") - F.col(y), F.lit(2)))).first()
            if r[0] is not None:
                got.append(r[0] if classify else 1 - r[1] / total)
    finally:
        d.unpersist()
    return {"scores": got, "mean": float(np.mean(got)), "sd": float(np.std(got))}


def auto_model(df: DataFrame, y: str, xs: list[str], classify: bool = False, folds: int = 3) -> dict:
    """The kind with the best cross-validated score, fitted on everything."""
    s = {k: cross_validate(df, y, xs, k, classify, folds)["mean"] for k in ("linear", "cart", "forest", "boosted")}
    best = max(s, key=s.get)
    return {"scores": s, "best": best, "model": fit(df, y, xs, best, classify)}


def probabilities(model, df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    return model.transform(prepared(df, y, xs)).withColumn("probability", vector_to_array("probability")).drop("features", "rawPrediction")


def life_regression(df: DataFrame, time: str, censor: str, xs: list[str]) -> dict:
    """Weibull accelerated failure times."""
    d = df.select(clean(F.col(time)).alias("t"), (F.col(censor) == 0).cast("double").alias("e"), *[clean(F.col(x)).alias(x) for x in xs]).dropna().filter("t > 0")
    m = AFTSurvivalRegression(labelCol="t", censorCol="e", featuresCol="features").fit(VectorAssembler(inputCols=xs, outputCol="features").transform(d))
    return {"intercept": m.intercept, "coefficients": dict(zip(xs, m.coefficients.toArray().tolist(), strict=True)), "scale": m.scale, "shape": 1 / m.scale}


def dbscan(x: np.ndarray, eps: float, least: int = 5) -> list[int]:
    """Labels of the rows of a small matrix; -1 is noise."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = [np.flatnonzero(r <= eps) for r in d]
    label, k = [-1] * len(x), 0
    for i in range(len(x)):
        if label[i] != -1 or len(near[i]) < least:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if label[j] == -1:
                label[j] = k
                if len(near[j]) >= least:
                    todo += [int(v) for v in near[j] if label[v] == -1]
        k += 1
    return label


def pdist(x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


def corr_p_value(r: float, n: int) -> float:
    from ashlar.stats import dist as D

    return D.two_sided(D.t(n - 2), r * math.sqrt((n - 2) / (1 - r * r))) if abs(r) < 1 else 0.0
