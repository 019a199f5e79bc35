"""Least squares and local regression from distributed moment sums."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.models.special import normal_critical, t_critical, t_two_sided


def _design(df: DataFrame, by: Sequence[str], y: Column, xs: Mapping[str, Column],
            weight: Column | None, origin: Mapping[str, float]) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight.cast("double")
    cols = [x.cast("double") - F.lit(float(origin.get(n, 0.0))) for n, x in xs.items()]
    rows = df.select(*by, y.cast("double").alias("_y"), w.alias("_w"),
                     *[c.alias(f"_x{i}") for i, c in enumerate(cols)])
    return rows.dropna(subset=[c for c in rows.columns if c.startswith("_")]).filter("_w > 0")


def _moments(rows: DataFrame, by: Sequence[str], p: int) -> DataFrame:
    """One row per group: every weighted product sum of (1, x1..xp, y)."""
    terms = [F.lit(1.0), *[F.col(f"_x{i}") for i in range(p)], F.col("_y")]
    sums = [F.sum(F.col("_w") * a * b) for i, a in enumerate(terms) for b in terms[i:]]
    lows = [F.min(f"_x{i}") for i in range(p)]
    highs = [F.max(f"_x{i}") for i in range(p)]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("m"),
                                 F.array(*lows).alias("lo"), F.array(*highs).alias("hi"))


def solve_moments(m: Sequence[float], p: int, n: int, shift: np.ndarray) -> dict | None:
    """Coefficients in the unshifted columns from one group's moment sums."""
    k = p + 2
    s = np.zeros((k, k))
    s[np.triu_indices(k)] = m
    s = s + np.triu(s, 1).T
    w = s[0, 0]
    centre = s[0, 1:] / w
    c = s[1:, 1:] - w * np.outer(centre, centre)       # centred sums of (x1..xp, y)
    kept = estimable(c[:p, :p], np.diag(s)[1:-1])
    df = n - len(kept) - 1
    if df <= 0:
        return None
    sxx, sxy, syy = c[np.ix_(kept, kept)], c[kept, p], c[p, p]
    scale = np.sqrt(np.diag(sxx))
    inv = np.linalg.inv(sxx / np.outer(scale, scale)) / np.outer(scale, scale)
    b = inv @ sxy
    rss = max(syy - b @ sxy, 0.0)
    sigma2 = rss / df
    mean = centre[kept] + shift[kept]
    at = np.array([0, *[j + 1 for j in kept]])
    beta, cov = np.full(p + 1, np.nan), np.full((p + 1, p + 1), np.nan)
    beta[at] = np.concatenate([[centre[p] - b @ mean], b])
    part = np.zeros((len(at), len(at)))
    part[1:, 1:] = inv
    part[0, 1:] = part[1:, 0] = -inv @ mean
    part[0, 0] = 1.0 / w + mean @ inv @ mean
    cov[np.ix_(at, at)] = sigma2 * part
    used = len(kept)
    return {"beta": beta, "cov": cov, "df": df, "sigma": np.sqrt(sigma2), "rank": used + 1,
            "r2": 1.0 - rss / syy if syy > 0 else float("nan"), "rss": rss,
            "f": ((syy - rss) / used) / sigma2 if sigma2 > 0 and used else float("nan")}


def estimable(c: np.ndarray, squares: np.ndarray) -> list[int]:
    """Regressors that are no combination of the intercept and those before them.

    ``c`` holds their centred moments and ``squares`` their plain ones.  Each pivot is what the regressors
    before it leave of a regressor's square; below 1e-10 of it, it is aliased.
    """
    left, kept = c.copy(), []
    for j in range(len(c)):
        if left[j, j] > 1e-10 * max(c[j, j], 0.0) and c[j, j] > 1e-14 * squares[j]:
            left = left - np.outer(left[:, j], left[j]) / left[j, j]
            kept.append(j)
    return kept


def linear_fit(df: DataFrame, y: Column, xs: Mapping[str, Column], by: Sequence[str] = (),
               weight: Column | None = None, origin: Mapping[str, float] | None = None,
               models: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Weighted least squares with intercept, one fit per group.

    One aggregation pass; rows with a missing value or weight 0 drop out.  ``origin`` is
    a typical value of a regressor that sits far from 0 (a year), taken off before
    squaring.  ``models`` fits several subsets of the regressors to the same rows, still in
    one pass.  Result: one row per group, model and term.  A term that is a combination of
    those before it (a constant one, too) is aliased: its row has null numbers, and the others are
    fitted without it.  Groups without residual freedom give no rows.
    """
    origin, names = dict(origin or {}), list(xs)
    models = {k: list(v) for k, v in (models or {"all": names}).items()}
    p = len(names)
    moments = _moments(_design(df, by, y, xs, weight, origin), by, p)
    schema = T.StructType(
        [moments.schema[b] for b in by]
        + [T.StructField("model_id", T.StringType()), T.StructField("term", T.StringType())]
        + [T.StructField(c, T.DoubleType()) for c in ("estimate", "std_error", "t_value",
                                                      "p_value")]
        + [T.StructField("n", T.LongType()), T.StructField("k", T.IntegerType())]
        + [T.StructField(c, T.DoubleType()) for c in ("sigma", "r_squared", "adj_r_squared",
                                                      "f_value", "rss")])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                for model, terms in models.items():
                    used = [names.index(t) for t in terms]
                    m = pick_moments(row["m"], p, used)
                    shift = np.array([float(origin.get(t, 0.0)) for t in terms])
                    fit = solve_moments(m, len(used), row["n"], shift)
                    if fit is None:
                        continue
                    se = np.sqrt(np.diag(fit["cov"]))
                    adj = 1.0 - (1.0 - fit["r2"]) * (row["n"] - 1) / fit["df"]
                    for term, est, s in zip(["(Intercept)", *terms], fit["beta"], se):
                        t = est / s if s > 0 else float("inf")
                        numbers = [est, s, t, t_two_sided(t, fit["df"])] if est == est else [None] * 4
                        out.append([*[row[b] for b in by], model, term, *numbers, row["n"], fit["rank"] + 1,
                                    fit["sigma"], fit["r2"], adj, fit["f"], fit["rss"]])
            yield pd.DataFrame(out, columns=schema.names)

    return moments.mapInPandas(solve, schema)


def pick_moments(m: Sequence[float], p: int, used: Sequence[int]) -> np.ndarray:
    """Moment sums of a subset of the regressors."""
    full = np.zeros((p + 2, p + 2))
    full[np.triu_indices(p + 2)] = m
    full = full + np.triu(full, 1).T
    at = [0, *[j + 1 for j in used], p + 1]
    part = full[np.ix_(at, at)]
    return part[np.triu_indices(len(at))]


def fit_band(df: DataFrame, y: Column, x: Column, degree: int = 1, by: Sequence[str] = (),
             weight: Column | None = None, origin: float = 0.0, level: float = 0.95,
             points: int = 80) -> DataFrame:
    """Fitted polynomial and its confidence band on an even grid over the x range."""
    shifted = x.cast("double") - F.lit(float(origin))
    xs = {f"x{d}": F.pow(shifted, F.lit(float(d))) for d in range(1, degree + 1)}
    moments = _moments(_design(df, by, y, xs, weight, {}), by, degree)
    schema = T.StructType([moments.schema[b] for b in by] + [
        T.StructField(c, T.DoubleType()) for c in ("x", "fit", "lower", "upper")])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                fit = solve_moments(row["m"], degree, row["n"], np.zeros(degree))
                if fit is None:
                    continue
                fit["beta"], fit["cov"] = np.nan_to_num(fit["beta"]), np.nan_to_num(fit["cov"])    # aliased: 0
                grid = np.linspace(row["lo"][0], row["hi"][0], points)
                basis = np.vander(grid, degree + 1, increasing=True)
                centre = basis @ fit["beta"]
                half = (t_critical(level, fit["df"])
                        * np.sqrt(np.einsum("ij,jk,ik->i", basis, fit["cov"], basis)))
                for i in range(points):
                    out.append([*[row[b] for b in by], grid[i] + origin, centre[i],
                                centre[i] - half[i], centre[i] + half[i]])
            yield pd.DataFrame(out, columns=schema.names)

    return moments.mapInPandas(solve, schema)


def weights_of(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rank models by corrected AIC: differences and Akaike weights per table.

    Input ``(model_id, loglik, k, n)`` and optional table keys; one row per model.
    """
    aic = -2 * F.col("loglik") + 2 * F.col("k")
    aicc = aic + (2 * F.col("k") * (F.col("k") + 1)) / (F.col("n") - F.col("k") - 1)
    whole = Window.partitionBy(*by)
    return (table.withColumn("AICc", aicc)
            .withColumn("delta", F.col("AICc") - F.min("AICc").over(whole))
            .withColumn("weight", F.exp(-F.col("delta") / 2)
                        / F.sum(F.exp(-F.col("delta") / 2)).over(whole)))


def average_coefficients(coefs: DataFrame, weights: DataFrame,
                         by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """Model-averaged coefficients with their intervals.

    ``conditional`` averages over the models that hold the term, ``full`` counts the term
    as 0, without error, in the others.  The standard errors add the spread between models; the
    intervals are normal ones about each average.
    """
    joined = coefs.join(weights.select(*by, "model_id", "weight"), [*by, "model_id"])
    means = joined.groupBy(*by, "term").agg(
        F.sum("weight").alias("importance"),
        F.sum(F.col("weight") * F.col("estimate")).alias("full"))
    means = means.withColumn("conditional", F.col("full") / F.col("importance"))

    def spread(about: str) -> Column:
        return F.sum(F.col("weight") * F.sqrt(F.pow("std_error", F.lit(2.0))
                                              + F.pow(F.col("estimate") - F.col(about), F.lit(2.0))))
    half = F.lit(normal_critical(level))
    out = joined.join(means, [*by, "term"]).groupBy(*by, "term", "importance", "full", "conditional").agg(
        (spread("conditional") / F.first("importance")).alias("std_error"),
        (spread("full") + F.greatest(1 - F.first("importance"), F.lit(0.0)) * F.abs(F.first("full"))).alias("full_error"))
    return out.withColumns({
        "lower": F.col("conditional") - half * F.col("std_error"), "upper": F.col("conditional") + half * F.col("std_error"),
        "full_lower": F.col("full") - half * F.col("full_error"), "full_upper": F.col("full") + half * F.col("full_error")})
