"""Linear models by formula: factors and covariates, adjusted tests, contrasts, comparisons, MANOVA and mixed models.

A formula is ``y ~ a + b + a:b + x`` (``a*b`` stands for both and their product, ``- 1`` drops the intercept). Text columns
and those named in ``factors`` are factors, coded by sums to zero, so that adjusted sums of squares test what they name.
The design is never written out: its cross products are one aggregate of column expressions. Levels of factors come to the
driver and are bounded by ``most``; rows never do. Rows with a null in any column of the model are left out.
"""

from __future__ import annotations

import math
from itertools import combinations, product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from ashlar.stats import dist as D
from ashlar.stats.basic import _anova, clean, moments
from ashlar.stats.regression import _gram


def parse_formula(formula: str) -> dict:
    """response, terms (tuples of column names, main effects first) and intercept of a formula."""
    left, tilde, right = formula.partition("~")
    if not tilde or not left.strip():
        raise ValueError(f"not a formula: {formula}")
    terms: list[tuple[str, ...]] = []
    intercept = True
    for part in right.replace("-", "+-").split("+"):
        part = part.strip()
        if not part or part == "1":
            continue
        if part in ("-1", "- 1", "0"):
            intercept = False
            continue
        if part.startswith("-"):
            gone = frozenset(x.strip() for x in part[1:].split(":"))
            terms = [t for t in terms if frozenset(t) != gone]
            continue
        names = [x.strip() for x in part.split("*")]
        groups = [tuple(x.strip() for x in n.split(":")) for n in names]
        for k in range(1, len(groups) + 1):
            terms += [tuple(dict.fromkeys(n for g in c for n in g)) for c in combinations(groups, k)]
    unique = list({frozenset(t): t for t in terms}.values())
    return {"response": left.strip(), "terms": sorted(unique, key=len), "intercept": intercept}


def _coding(df: DataFrame, names: list[str], factors, most: int) -> dict[str, list[str] | None]:
    """Levels of every factor, None for covariates."""
    kinds = {f.name: f.dataType for f in df.schema}
    out: dict[str, list[str] | None] = {}
    for n in names:
        if n in (factors or ()) or isinstance(kinds[n], (StringType, BooleanType)):
            got = sorted(r[0] for r in df.filter(F.col(n).isNotNull()).select(F.col(n).cast("string")).distinct().limit(most + 1).collect())
            if not 2 <= len(got) <= most:
                raise ValueError(f"{n}: a factor has 2 to {most} levels")
            out[n] = got
        else:
            out[n] = None
    return out


def _effects(name: str, levels: list[str] | None) -> list[tuple[str, Column]]:
    """The columns of one variable: itself, or its levels but the last against the last."""
    if levels is None:
        return [(name, clean(F.col(name)))]
    c = F.col(name).cast("string")
    return [(f"{name}[{v}]", F.when(c == v, 1.0).when(c == levels[-1], -1.0).when(c.isNotNull(), 0.0)) for v in levels[:-1]]


def _columns(terms, coding) -> list[tuple[int, str, Column]]:
    """(term, name, column) of the whole design without the intercept."""
    out = []
    for i, t in enumerate(terms):
        for parts in product(*[_effects(n, coding[n]) for n in t]):
            c = parts[0][1]
            for p in parts[1:]:
                c = c * p[1]
            out.append((i, ":".join(p[0] for p in parts), c))
    return out


def linear_model(df: DataFrame, formula: str, factors=None, confidence: float = 0.95, most: int = 200) -> dict:
    """Coefficients, adjusted (Type III) and sequential sums of squares per term, R squared and the covariance of the terms."""
    f = parse_formula(formula)
    names = list(dict.fromkeys(n for t in f["terms"] for n in t))
    coding = _coding(df, names, factors, most)
    d = df.filter(clean(F.col(f["response"])).isNotNull())
    for n, levels in coding.items():
        d = d.filter((F.col(n) if levels else clean(F.col(n))).isNotNull())
    design = _columns(f["terms"], coding)
    one = [(-1, "(intercept)", F.lit(1.0))] if f["intercept"] else []
    cols = [*one, *design]
    y = clean(F.col(f["response"]))
    n, g, r = _gram(d, [*[c for _, _, c in cols], y], None, {"_y": y})
    k = len(cols)
    xtx, xty, yty = g[:k, :k], g[:k, k], g[k, k]
    tss = yty - r["_y"] ** 2 / n if f["intercept"] else yty

    def rss(keep) -> float:
        i = list(keep)
        return float(yty - xty[i] @ np.linalg.lstsq(xtx[np.ix_(i, i)], xty[i], rcond=None)[0]) if i else float(yty)

    inv = np.linalg.pinv(xtx)
    rank = int(np.linalg.matrix_rank(xtx))
    b, full, dof = inv @ xty, rss(range(k)), n - rank
    mse = full / dof
    t = D.t(dof)
    q = t.ppf(1 - (1 - confidence) / 2)
    coef = [{"term": name, "estimate": float(e), "se": se, "t": float(e) / se if se else math.inf, "p_value": D.two_sided(t, float(e) / se) if se else 0.0, "ci": (float(e) - q * se, float(e) + q * se)} for (_, name, _), e, se in zip(cols, b, np.sqrt(np.maximum(mse * np.diag(inv), 0)), strict=True)]
    table, held = [], [i for i in range(k) if cols[i][0] < 0]
    last = rss(held)
    for i, term in enumerate(f["terms"]):
        own = [j for j in range(k) if cols[j][0] == i]
        adjusted = rss(j for j in range(k) if j not in own) - full
        held += own
        now = rss(held)
        fv = adjusted / len(own) / mse if mse > 0 else math.inf
        table.append({"term": ":".join(term), "df": len(own), "ss": adjusted, "sequential_ss": last - now, "ms": adjusted / len(own), "f": fv, "p_value": D.f(len(own), dof).sf(fv)})
        last = now
    return {"formula": f, "coding": coding, "coefficients": coef, "terms": table, "n": n, "df": dof, "rss": full, "ms_error": mse, "s": math.sqrt(mse), "r_squared": 1 - full / tss, "r_squared_adj": 1 - mse / (tss / (n - f["intercept"])), "covariance": mse * inv}


def linear_model_vector(model: dict, at: dict) -> np.ndarray:
    """The design row of given factor levels and covariates; a factor that isn't given is averaged over its levels."""
    f, coding = model["formula"], model["coding"]

    def values(n: str) -> list[float]:
        levels = coding[n]
        if levels is None:
            return [float(at[n])]
        if n not in at:
            return [0.0] * (len(levels) - 1)
        return [1.0 if at[n] == v else -1.0 if at[n] == levels[-1] else 0.0 for v in levels[:-1]]

    row = [1.0] if f["intercept"] else []
    for t in f["terms"]:
        row += [math.prod(p) for p in product(*[values(n) for n in t])]
    return np.array(row)


def linear_model_contrast(model: dict, vector, confidence: float = 0.95) -> dict:
    """Estimate, se, t, p-value and interval of a linear combination of the coefficients."""
    v = np.asarray(vector, float)
    est, se = float(v @ [c["estimate"] for c in model["coefficients"]]), math.sqrt(max(0.0, float(v @ model["covariance"] @ v)))
    t = D.t(model["df"])
    q = t.ppf(1 - (1 - confidence) / 2)
    return {"estimate": est, "se": se, "t": est / se if se else math.inf, "p_value": D.two_sided(t, est / se) if se else 0.0, "ci": (est - q * se, est + q * se)}


def predict_linear_model(df: DataFrame, model: dict, name: str = "prediction") -> DataFrame:
    cols = [c for _, _, c in _columns(model["formula"]["terms"], model["coding"])]
    b = [c["estimate"] for c in model["coefficients"]]
    out = F.lit(b[0]) if model["formula"]["intercept"] else F.lit(0.0)
    for e, c in zip(b[1:] if model["formula"]["intercept"] else b, cols, strict=True):
        out = out + F.lit(float(e)) * c
    return df.withColumn(name, out)


def adjust_comparison_p(p: list[float], method: str = "holm") -> list[float]:
    """Bonferroni, Sidak, Holm or false discovery rate (bh)."""
    x = np.asarray(p, float)
    m = len(x)
    if method == "none":
        return x.tolist()
    if method == "bonferroni":
        return np.minimum(1, m * x).tolist()
    if method == "sidak":
        return (1 - (1 - x) ** m).tolist()
    order = np.argsort(x)
    if method == "holm":
        y = np.maximum.accumulate((m - np.arange(m)) * x[order])
    elif method == "bh":
        y = np.minimum.accumulate((m / np.arange(1, m + 1) * x[order])[::-1])[::-1]
    else:
        raise ValueError(f"method: {method}")
    out = np.empty(m)
    out[order] = np.minimum(1, y)
    return out.tolist()


def compare_linear_means(model: dict, factor: str, method: str = "holm", confidence: float = 0.95, at: dict | None = None) -> dict:
    """Adjusted means of a factor's levels (covariates at ``at``, 0 where not given) and all their differences."""
    base = {n: 0.0 for n, levels in model["coding"].items() if levels is None} | (at or {})
    levels = model["coding"][factor]
    rows = {v: linear_model_vector(model, base | {factor: v}) for v in levels}
    means = [{"level": v} | linear_model_contrast(model, rows[v], confidence) for v in levels]
    pairs = [{"a": a, "b": b} | linear_model_contrast(model, rows[b] - rows[a], confidence) for a, b in combinations(levels, 2)]
    for r, p in zip(pairs, adjust_comparison_p([r["p_value"] for r in pairs], method), strict=True):
        r["p_adjusted"] = p
    return {"means": means, "comparisons": pairs}


def linear_workbench(df: DataFrame, formula: str, factors=None, method: str = "holm") -> dict:
    """The model, comparisons of its main factors, and residual moments."""
    m = linear_model(df, formula, factors)
    mains = [t[0] for t in m["formula"]["terms"] if len(t) == 1 and m["coding"][t[0]]]
    covariates = {n: df.agg(F.avg(clean(F.col(n)))).first()[0] for n, levels in m["coding"].items() if levels is None}
    res = predict_linear_model(df, m, "_fit").select((clean(F.col(m["formula"]["response"])) - F.col("_fit")).alias("residual"))
    return {"model": m, "comparisons": {n: compare_linear_means(m, n, method, at=covariates) for n in mains}, "residuals": moments(res, "residual")[None]}


def ancova(df: DataFrame, value: str, by: str, covariate: str) -> dict:
    """Adjusted tests of the group and the covariate."""
    m = linear_model(df, f"{value} ~ {by} + {covariate}", [by])
    t = {x["term"]: x for x in m["terms"]}
    return {"group": t[by], "covariate": t[covariate], "df": m["df"], "ms_error": m["ms_error"], "n": m["n"], "model": m}


def anova_two_way_adjusted(df: DataFrame, value: str, a: str, b: str, interaction: bool = True) -> dict:
    """Type III two-way analysis, cells of any size."""
    m = linear_model(df, f"{value} ~ {a} {'*' if interaction else '+'} {b}", [a, b])
    return {x["term"]: x for x in m["terms"]} | {"error": {"ss": m["rss"], "df": m["df"], "ms": m["ms_error"]}}


# -- comparisons with one, or with the best ---------------------------------------------------------------------
_NODES = np.polynomial.legendre.leggauss(48)


def pdunnett(c: float, lambdas, df: float, two_sided: bool = True) -> float:
    """P of all |t| (or t) being at most c, the statistics correlating as lambda_i lambda_j; df may be infinite."""
    lam = np.asarray(lambdas, float)
    den = np.sqrt(1 - lam**2)
    cdf = np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))
    x, w = _NODES
    z, wz = 8 * x, 8 * w * np.exp(-32 * x**2) / math.sqrt(2 * math.pi)

    def inner(s: float) -> float:
        up = cdf((c * s + np.outer(z, lam)) / den)
        lo = cdf((-c * s + np.outer(z, lam)) / den) if two_sided else 0.0
        return float(wz @ np.prod(up - lo, axis=1))

    if math.isinf(df):
        return inner(1.0)
    # the scale: chi over root df, whose mass lies within ten standard deviations of 1
    half = min(1.0, 10 / math.sqrt(2 * df))
    lo, hi = max(1e-9, 1 - half), 1 + (half if df > 8 else 10 / math.sqrt(df))
    s = (lo + hi) / 2 + (hi - lo) / 2 * x
    log = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    return float(min(1.0, (hi - lo) / 2 * (w * np.exp(log)) @ [inner(v) for v in s]))


def qdunnett(p: float, lambdas, df: float, two_sided: bool = True) -> float:
    return D.brentq(lambda c: pdunnett(c, lambdas, df, two_sided) - p, 0.0, 60.0, 1e-8)


def dunnett(df: DataFrame, value: str, by: str, control: str | None = None, confidence: float = 0.95, alternative: str = "two-sided") -> dict:
    """Every group against the control (the first by name if not given)."""
    g = moments(df, value, by)
    control = next(iter(g)) if control is None else str(control)
    a = _anova(list(g.values()))
    others = [k for k in g if k != control]
    lam = [math.sqrt(g[k]["n"] / (g[k]["n"] + g[control]["n"])) for k in others]
    two = alternative == "two-sided"
    q = qdunnett(confidence, lam, a["df_within"], two)
    out = []
    for k in others:
        se = math.sqrt(a["ms_within"] * (1 / g[k]["n"] + 1 / g[control]["n"]))
        diff = g[k]["mean"] - g[control]["mean"]
        t = diff / se
        p = 1 - pdunnett(abs(t) if two else t if alternative == "greater" else -t, lam, a["df_within"], two)
        out.append({"group": k, "difference": diff, "se": se, "t": t, "p_value": min(1.0, max(0.0, p)), "ci": (diff - q * se if alternative != "less" else -math.inf, diff + q * se if alternative != "greater" else math.inf)})
    return {"control": control, "critical": q, "df": a["df_within"], "ms_within": a["ms_within"], "comparisons": out}


def hsu_mcb(df: DataFrame, value: str, by: str, best: str = "max", confidence: float = 0.95) -> dict:
    """Every group against the best of the others; intervals hold zero at one end unless that settles it."""
    g = moments(df, value, by)
    a = _anova(list(g.values()))
    out = []
    for k in g:
        others = [o for o in g if o != k]
        lam = [math.sqrt(g[o]["n"] / (g[o]["n"] + g[k]["n"])) for o in others]
        q = qdunnett(confidence, lam, a["df_within"], False)
        ends = []
        for o in others:
            se = q * math.sqrt(a["ms_within"] * (1 / g[k]["n"] + 1 / g[o]["n"]))
            d = (g[k]["mean"] - g[o]["mean"]) * (1 if best == "max" else -1)
            ends.append((d - se, d, d + se))
        lo, mid, hi = (min(e[i] for e in ends) for i in range(3))
        ci = (min(0.0, lo), max(0.0, hi))
        out.append({"group": k, "n": g[k]["n"], "mean": g[k]["mean"], "difference": mid if best == "max" else -mid, "ci": ci if best == "max" else (-ci[1], -ci[0]), "best_possible": hi > 0})
    return {"best": best, "df": a["df_within"], "ms_within": a["ms_within"], "groups": out}


def grouping_letters(names: list[str], means: list[float], different) -> dict[str, str]:
    """Letters such that two names share one exactly if ``different(a, b)`` is false for all pairs under that letter."""
    order = [n for _, n in sorted(zip(means, names, strict=True), key=lambda x: (-x[0], str(x[1])))]
    sets: list[set] = []
    for i, n in enumerate(order):
        run = [m for m in order[i:] if not different(n, m) or m == n]
        run = [m for j, m in enumerate(run) if all(m == o or not different(m, o) for o in run[:j])]
        if not any(set(run) <= s for s in sets):
            sets.append(set(run))
    return {n: "".join(chr(65 + j) if j < 26 else f"({j})" for j, s in enumerate(sets) if n in s) for n in order}


def pooled_groups(df: DataFrame, value: str, by: str) -> dict:
    """Group sizes and means with the pooled error that comparisons use."""
    g = moments(df, value, by)
    a = _anova(list(g.values()))
    return {"groups": [{"group": k, "n": v["n"], "mean": v["mean"]} for k, v in g.items()], "ms_within": a["ms_within"], "df": a["df_within"]}


# -- several responses ------------------------------------------------------------------------------------------
def _manova(h: np.ndarray, e: np.ndarray, q: int, v: int) -> dict:
    """The four statistics with their F approximations; q: degrees of the hypothesis, v: of the error."""
    p = len(h)
    lam = np.sort(np.maximum(np.linalg.eigvals(np.linalg.solve(e, h)).real, 0))[::-1]
    s, m, n = min(p, q), (abs(p - q) - 1) / 2, (v - p - 1) / 2
    wilks, pillai, lawley, roy = float(np.prod(1 / (1 + lam))), float((lam / (1 + lam)).sum()), float(lam.sum()), float(lam[0])
    t = math.sqrt((p * p * q * q - 4) / (p * p + q * q - 5)) if p * p + q * q > 5 else 1.0
    r, u = v - (p - q + 1) / 2, (p * q - 2) / 4
    d2 = r * t - 2 * u
    w = wilks ** (1 / t)
    out = {"wilks": (wilks, (1 - w) / w * d2 / (p * q), p * q, d2)}
    d1, d2 = s * (2 * m + s + 1), s * (2 * n + s + 1)
    out["pillai"] = (pillai, pillai / (s - pillai) * d2 / d1 if pillai < s else math.inf, d1, d2)
    d2 = 2 * (s * n + 1)
    out["lawley_hotelling"] = (lawley, d2 * lawley / (s * s * (2 * m + s + 1)), d1, d2)
    big = max(p, q)
    out["roy"] = (roy, roy * (v - big + q) / big, big, v - big + q)
    return {k: {"statistic": x[0], "f": x[1], "df1": x[2], "df2": x[3], "p_value": D.f(x[2], x[3]).sf(x[1]) if x[3] > 0 else math.nan} for k, x in out.items()}


def manova(df: DataFrame, ys: list[str], by: str) -> dict:
    """One-way multivariate analysis of variance from group means and cross products, one aggregate."""
    return manova_model(df, ys, by)[by]


def manova_model(df: DataFrame, ys: list[str], right: str, factors=None) -> dict:
    """Per term of the right-hand side the adjusted multivariate tests; text columns are factors, as is a lone ``right``."""
    f = parse_formula(f"{ys[0]} ~ {right}")
    names = list(dict.fromkeys(n for t in f["terms"] for n in t))
    coding = _coding(df, names, factors or ([right] if len(names) == 1 else None), 200)
    d = df.select(*[F.col(n).cast("string").alias(n) if levels else F.col(n) for n, levels in coding.items()], *[clean(F.col(y)).alias(f"_y{i}") for i, y in enumerate(ys)]).dropna()
    cols = [(-1, "", F.lit(1.0)), *_columns(f["terms"], coding)]
    n, g, _ = _gram(d, [*[c for _, _, c in cols], *[F.col(f"_y{i}") for i in range(len(ys))]])
    k = len(cols)
    xtx, xty, yty = g[:k, :k], g[:k, k:], g[k:, k:]

    def sscp(keep) -> np.ndarray:
        i = list(keep)
        return yty - xty[i].T @ np.linalg.lstsq(xtx[np.ix_(i, i)], xty[i], rcond=None)[0]

    e, v, out = sscp(range(k)), n - k, {}
    for i, term in enumerate(f["terms"]):
        own = [j for j in range(k) if cols[j][0] == i]
        out[":".join(term)] = _manova(sscp(j for j in range(k) if j not in own) - e, e, len(own), v)
    return out


def nested_anova(df: DataFrame, value: str, factors: list[str]) -> dict:
    """Fully nested analysis of variance and variance components (unbalanced sizes by their expected coefficients)."""
    d = df.select(clean(F.col(value)).alias("x"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(factors)]).dropna()
    cell = d.groupBy(*[f"f{i}" for i in range(len(factors))]).agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).persist()
    try:
        total = cell.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).first()
        n, grand = total["n"], total["s"] ** 2 / total["n"]
        fit, units, sizes = [grand], [1], []
        for i in range(len(factors)):
            keys = [f"f{j}" for j in range(i + 1)]
            up = cell.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
            r = up.agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("f")).first()
            fit.append(r["f"])
            units.append(r["k"])
            # sums over every upper level of its parts' squared sizes over its own size
            row = [up.agg(F.sum(F.col("n") * F.col("n"))).first()[0] / n]
            for j in range(i + 1):
                outer = [f"f{h}" for h in range(j + 1)]
                row.append(up.groupBy(*outer).agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("c")).agg(F.sum("c")).first()[0])
            sizes.append(row)
    finally:
        cell.unpersist()
    out = []
    for i, f in enumerate(factors):
        out.append({"source": f, "df": units[i + 1] - units[i], "ss": fit[i + 1] - fit[i]})
    out.append({"source": "error", "df": n - units[-1], "ss": total["q"] - fit[-1]})
    ms = [r["ss"] / r["df"] if r["df"] else math.nan for r in out]
    comp = [0.0] * len(out)
    comp[-1] = ms[-1]
    for i in range(len(factors) - 1, -1, -1):
        dfi = out[i]["df"]
        k = {j: (sizes[j][i + 1] - sizes[j][i]) / dfi for j in range(i, len(factors))}  # coefficient of component j in ms i
        comp[i] = max(0.0, (ms[i] - comp[-1] - sum(k[j] * comp[j] for j in range(i + 1, len(factors)))) / k[i])
    for i, r in enumerate(out):
        r |= {"ms": ms[i], "variance": comp[i], "percent": 100 * comp[i] / sum(comp)}
        if i < len(factors):
            r |= {"f": ms[i] / ms[i + 1], "p_value": D.f(r["df"], out[i + 1]["df"]).sf(ms[i] / ms[i + 1])}
    return {"table": out, "n": n}


# -- random effects ---------------------------------------------------------------------------------------------
def _grouped(d: DataFrame, cols: list[Column], y: Column, w: Column, by: str) -> DataFrame:
    """Weighted sums and cross products per group: all that a random intercept needs."""
    z = [*cols, y]
    aggs = [F.sum(w).alias("w"), F.count(F.lit(1)).alias("n"), F.sum(F.log(w)).alias("lw")]
    aggs += [F.sum(w * c).alias(f"s{i}") for i, c in enumerate(z)]
    aggs += [F.sum(w * z[i] * z[j]).alias(f"g{i}_{j}") for i in range(len(z)) for j in range(i, len(z))]
    return d.groupBy(by).agg(*aggs)


def _gls(groups: DataFrame, k: int, lam: float):
    """Cross products under variance 1/w + lam within groups, one aggregate over the groups."""
    shrink = F.lit(lam) / (1 + F.lit(lam) * F.col("w"))
    aggs = [F.sum(F.col(f"g{i}_{j}") - shrink * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"g{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
    r = groups.agg(F.sum("n").alias("n"), F.sum(F.log(1 + F.lit(lam) * F.col("w"))).alias("ld"), *aggs).first()
    g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
    b = np.linalg.solve(g[:k, :k], g[:k, k])
    return r["n"], g[:k, :k], b, float(g[k, k] - b @ g[:k, k]), r["ld"]


def _reml(groups: DataFrame, k: int) -> tuple:
    """The ratio of the two variances that maximises the restricted likelihood, by golden section on its logarithm."""

    def loss(u: float) -> float:
        n, g, _, rss, ld = _gls(groups, k, math.exp(u))
        return (n - k) * math.log(rss / (n - k)) + ld + np.linalg.slogdet(g)[1]

    lo, hi, gold = -14.0, 10.0, (math.sqrt(5) - 1) / 2
    a, b = hi - gold * (hi - lo), lo + gold * (hi - lo)
    fa, fb = loss(a), loss(b)
    while hi - lo > 1e-5:
        if fa <= fb:
            hi, b, fb = b, a, fa
            a = hi - gold * (hi - lo)
            fa = loss(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + gold * (hi - lo)
            fb = loss(b)
    u = (lo + hi) / 2
    lam = math.exp(u) if u > -13.5 else 0.0
    return lam, _gls(groups, k, lam), min(fa, fb)


def mixed_model(df: DataFrame, y: str, xs: list[str], group: str, confidence: float = 0.95) -> dict:
    """Linear model with a random intercept per group, by restricted maximum likelihood. Groups are read, never collected."""
    d = df.select(clean(F.col(y)).alias("y"), F.col(group).cast("string").alias("g"), *[clean(F.col(x)).alias(f"x{i}") for i, x in enumerate(xs)]).dropna()
    cols = [F.lit(1.0), *[F.col(f"x{i}") for i in range(len(xs))]]
    groups = _grouped(d, cols, F.col("y"), F.lit(1.0), "g").persist()
    try:
        k = len(cols)
        lam, (n, g, b, rss, _), loss = _reml(groups, k)
        s2 = rss / (n - k)
        cov = s2 * np.linalg.inv(g)
        effect = F.lit(lam) / (1 + F.lit(lam) * F.col("w")) * (F.col(f"s{k}") - sum((F.lit(float(v)) * F.col(f"s{i}") for i, v in enumerate(b)), F.lit(0.0)))
        effects = groups.select(F.col("g").alias("group"), effect.alias("effect"))
        m = groups.count()
    finally:
        groups.unpersist()
    t = D.normal()
    q = t.ppf(1 - (1 - confidence) / 2)
    out = []
    for name, e, v in zip(["(intercept)", *xs], b, np.diag(cov), strict=True):
        se = math.sqrt(v)
        out.append({"term": name, "estimate": float(e), "se": se, "z": float(e) / se, "p_value": D.two_sided(t, float(e) / se), "ci": (float(e) - q * se, float(e) + q * se)})
    return {"coefficients": out, "variance": {"group": lam * s2, "error": s2}, "icc": lam / (1 + lam), "n": n, "groups": m, "effects": effects, "reml": loss + (n - k) * (1 + math.log(2 * math.pi))}


def glmm(df: DataFrame, y: str, xs: list[str], group: str, family: str = "logit", rounds: int = 20, tol: float = 1e-5) -> dict:
    """Random intercepts in a logistic or Poisson model by penalised quasi-likelihood: weighted mixed models of working responses."""
    from ashlar.stats.regression import glm

    d = df.select(clean(F.col(y)).alias("y"), F.col(group).cast("string").alias("g"), *[clean(F.col(x)).alias(f"x{i}") for i, x in enumerate(xs)]).dropna().persist()
    try:
        cols = [F.lit(1.0), *[F.col(f"x{i}") for i in range(len(xs))]]
        k = len(cols)
        b = np.array([c["estimate"] for c in glm(d, "y", [f"x{i}" for i in range(len(xs))], family)["coefficients"]])
        effects, lam = None, 0.0
        for _ in range(rounds):
            e = d.withColumn("u", F.lit(0.0)) if effects is None else d.join(effects, "g")
            eta = sum((F.lit(float(v)) * c for v, c in zip(b, cols, strict=True)), F.col("u"))
            mu = 1 / (1 + F.exp(-eta)) if family == "logit" else F.exp(eta)
            w = F.greatest(mu * (1 - mu) if family == "logit" else mu, F.lit(1e-6))
            e = e.withColumn("w", w).withColumn("z", eta + (F.col("y") - mu) / w)
            if effects is not None:
                old.unpersist()
            old = _grouped(e, cols, F.col("z"), F.col("w"), "g").persist()
            # the scale is 1: the variance itself is found, not a ratio
            lam, now = _scaled(old, k)
            change = float(np.abs(now[2] - b).max())
            b, g = now[2], now[1]
            effect = F.lit(lam) / (1 + F.lit(lam) * F.col("w")) * (F.col(f"s{k}") - sum((F.lit(float(v)) * F.col(f"s{i}") for i, v in enumerate(b)), F.lit(0.0)))
            effects = old.select("g", effect.alias("u"))
            if change < tol:
                break
        n = now[0]
    finally:
        d.unpersist()
    se = np.sqrt(np.diag(np.linalg.inv(g)))
    coef = [{"term": t, "estimate": float(v), "se": float(s), "z": float(v / s), "p_value": D.two_sided(D.normal(), float(v / s))} for t, v, s in zip(["(intercept)", *xs], b, se, strict=True)]
    return {"coefficients": coef, "variance": {"group": lam}, "n": n, "effects": effects}


def _scaled(groups: DataFrame, k: int) -> tuple:
    """As ``_reml`` with the error scale held at 1."""

    def loss(u: float) -> float:
        _, g, _, rss, ld = _gls(groups, k, math.exp(u))
        return rss + ld + np.linalg.slogdet(g)[1]

    grid = np.linspace(-10, 4, 15)
    i = int(np.argmin([loss(u) for u in grid]))
    lo, hi = grid[max(0, i - 1)], grid[min(14, i + 1)]
    for _ in range(20):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    lam = math.exp((lo + hi) / 2)
    return lam, _gls(groups, k, lam)
