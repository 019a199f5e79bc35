"""Fits against dense numpy reimplementations on small data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import rsem
from driftline.models import boost, linear, local, mixed, special
from driftline.models.design import (Factor, Interaction, Numeric, Request, Smooth, build_design, evaluate,
                                     log_choose)


def test_tail_areas():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.07338803477, abs=1e-9)
    assert special.t_critical(0.95, 5) == pytest.approx(2.570581836, abs=1e-8)
    assert special.normal_critical(0.95) == pytest.approx(1.959963985, abs=1e-8)


def test_log_choose(spark):
    pairs = [(0, 0), (1, 1), (5, 2), (49, 20), (100000, 33333)]
    df = spark.createDataFrame([(float(n), float(k)) for n, k in pairs], "n double, k double")
    got = [r[0] for r in df.select(log_choose(F.col("n"), F.col("k"))).collect()]
    want = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for n, k in pairs]
    assert got == pytest.approx(want, rel=1e-11, abs=1e-9)


def test_linear_fit(spark):
    rng = np.random.default_rng(1)
    x, z, w = rng.normal(2000, 3, 60), rng.normal(size=60), rng.integers(0, 5, 60).astype(float)
    y = 3 + 0.2 * x - z + rng.normal(size=60)
    df = spark.createDataFrame(list(zip(*[c.tolist() for c in (x, z, w, y)])),
                               "x double, z double, w double, y double")
    got = {r["term"]: r for r in linear.linear_fit(
        df, F.col("y"), {"x": F.col("x"), "z": F.col("z")}, weight=F.col("w"),
        origin={"x": 2000}).collect()}
    keep = w > 0
    X, W = np.column_stack([np.ones(60), x, z])[keep], w[keep]
    beta = np.linalg.solve(X.T @ (W[:, None] * X), X.T @ (W * y[keep]))
    rss = np.sum(W * (y[keep] - X @ beta) ** 2)
    s2 = rss / (keep.sum() - 3)
    se = np.sqrt(s2 * np.diag(np.linalg.inv(X.T @ (W[:, None] * X))))
    for i, term in enumerate(["(Intercept)", "x", "z"]):
        assert got[term]["estimate"] == pytest.approx(beta[i], rel=1e-7)
        assert got[term]["std_error"] == pytest.approx(se[i], rel=1e-7)
    assert got["x"]["n"] == keep.sum()
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "x double, y double")
    got = {r["term"]: r for r in linear.linear_fit(flat, F.col("y"), {"x": F.col("x")}).collect()}
    assert got["(Intercept)"]["estimate"] == pytest.approx(3.0) and got["x"]["estimate"] is None


def test_aliased_terms_are_left_out_in_order(spark):
    """A doubled column, a sum of two and a constant: later ones are null, the others as without them."""
    rng = np.random.default_rng(21)
    x, z = rng.normal(2000, 5, 80), rng.normal(size=80)
    y = 3 + 0.2 * x - z + rng.normal(0, .3, 80)
    rows = [tuple(map(float, r)) for r in zip(x, 2 * x - 7, z, x + z, np.full(80, 4.0), rng.normal(size=80), y)]
    df = spark.createDataFrame(rows, "x double, twice double, z double, sum double, flat double, u double, y double")
    names = ["x", "twice", "z", "sum", "flat", "u"]
    got = {r["term"]: r for r in linear.linear_fit(df, F.col("y"), {n: F.col(n) for n in names}, origin={"x": 2000, "twice": 4000}).collect()}
    want = {r["term"]: r for r in linear.linear_fit(df, F.col("y"), {n: F.col(n) for n in ("x", "z", "u")}, origin={"x": 2000}).collect()}
    assert {n for n in names if got[n]["estimate"] is None} == {"twice", "sum", "flat"}
    for term, row in want.items():
        for c in ("estimate", "std_error", "t_value", "p_value", "sigma", "r_squared", "f_value", "k"):
            assert got[term][c] == pytest.approx(row[c], rel=1e-6)
    band = linear.fit_band(df, F.col("y"), F.col("flat"), 1, points=3).collect()
    assert all(r["fit"] == pytest.approx(y.mean()) for r in band)


def test_loess_matches_direct_fit(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.uniform(0, 10, 120), 1)
    y, w = np.sin(x) + rng.normal(0, .1, 120), rng.integers(1, 4, 120).astype(float)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), w.tolist())),
                               "x double, y double, w double")
    got = local.local_regression(df, F.col("y"), F.col("x"), weight=F.col("w"), points=7).orderBy("x").collect()
    q = int(120 * 0.75 + 1e-5)
    for row, g in zip(got, np.linspace(x.min(), x.max(), 7)):
        d = np.abs(x - g)
        h = np.sort(d)[q - 1]
        k = w * np.where(d < h, (1 - (d / h) ** 3) ** 3, 0)
        X = np.vander(x - g, 3, increasing=True)
        fit = np.linalg.solve(X.T @ (k[:, None] * X), X.T @ (k * y))[0]
        assert row["x"] == pytest.approx(g) and row["fit"] == pytest.approx(fit, rel=1e-6)


def test_loess_where_most_rows_share_one_x(spark):
    rows = [(0.0, float(k % 3), 1.0 + k % 2) for k in range(90)] + [(float(k), 1.0, 1.0) for k in range(1, 11)]
    df = spark.createDataFrame(rows, "x double, y double, w double")
    got = local.local_regression(df, F.col("y"), F.col("x"), weight=F.col("w"), points=11).orderBy("x").collect()
    assert [r["x"] for r in got] == [float(k) for k in range(11)]
    tied = [(y, w) for x, y, w in rows if x == 0]
    assert got[0]["fit"] == pytest.approx(sum(y * w for y, w in tied) / sum(w for _, w in tied))


def dense_band(x, y, w, points, span=0.75):
    """Fit and band of the operator 'local quadratic at the grid, straight between', as whole matrices."""
    n, grid = len(x), np.linspace(x.min(), x.max(), points)
    K = np.zeros((points, n))
    for i, g in enumerate(grid):
        d = np.abs(x - g)
        h = np.sort(d)[int(n * span + 1e-5) - 1]
        k = w * np.where(d < h, (1 - (d / h) ** 3) ** 3, 0)
        X = np.vander((x - g) / h, 3, increasing=True)
        K[i] = (np.linalg.pinv(X.T @ (k[:, None] * X)) @ (X * k[:, None]).T)[0]
    B = np.array([[np.interp(v, grid, e) for e in np.eye(points)] for v in x])
    M = np.eye(n) - B @ K
    one, two = np.trace(M @ M.T), np.trace(M @ M.T @ M @ M.T)
    sigma = np.sqrt(np.sum(w * (y - B @ K @ y) ** 2) / one)
    return K @ y, sigma * np.sqrt((K ** 2 / w).sum(1)), sigma, one ** 2 / two


def test_band_of_local_regression_equals_the_dense_one(spark):
    rng = np.random.default_rng(12)
    rows = []
    for g, n in (("a", 150), ("b", 90), (None, 60)):
        x = np.round(rng.gamma(2.0, 3.0, n), 1)
        rows += [(g, float(v), float(np.sin(v) + rng.normal(0, .2)), float(rng.integers(1, 9))) for v in x]
    df = spark.createDataFrame([*rows, ("a", None, 1.0, 1.0), ("a", 1.0, 1.0, 0.0)], "g string, x double, y double, w double")
    out = local.local_regression(df.repartition(7), F.col("y"), F.col("x"), ["g"], F.col("w"), points=25).collect()
    assert len(out) == 75
    for g in ("a", "b", None):
        x, y, w = np.array([r[1:] for r in rows if r[0] == g]).T
        fit, error, sigma, df_ = dense_band(x, y, w, 25)
        got = sorted((r for r in out if r.g == g), key=lambda r: r.x)
        assert np.allclose([r.fit for r in got], fit, rtol=1e-7, atol=1e-9)
        assert np.allclose([r.std_error for r in got], error, rtol=1e-6)
        assert np.allclose([[r.sigma, r.df] for r in got], [sigma, df_], rtol=1e-6)
        half = special.t_critical(0.95, df_)
        assert np.allclose([[r.lower, r.upper] for r in got], np.c_[fit - half * error, fit + half * error], rtol=1e-6)


def test_band_is_close_to_that_of_a_fit_at_every_row(spark):
    """With 80 grid points, straight lines between them change the band by little."""
    rng = np.random.default_rng(13)
    x = np.sort(rng.uniform(0, 10, 200))
    y, w = np.cos(x / 2) + rng.normal(0, .1, 200), rng.integers(1, 4, 200).astype(float)
    L = np.zeros((200, 200))
    for i, g in enumerate(x):
        d = np.abs(x - g)
        h = np.sort(d)[149]
        k = w * np.where(d < h, (1 - (d / h) ** 3) ** 3, 0)
        X = np.vander((x - g) / h, 3, increasing=True)
        L[i] = (np.linalg.pinv(X.T @ (k[:, None] * X)) @ (X * k[:, None]).T)[0]
    M = np.eye(200) - L
    one = np.trace(M @ M.T)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), w.tolist())), "x double, y double, w double")
    got = local.local_regression(df, F.col("y"), F.col("x"), weight=F.col("w")).head()
    assert got.sigma == pytest.approx(np.sqrt(np.sum(w * (y - L @ y) ** 2) / one), rel=1e-3)
    assert got.df == pytest.approx(one ** 2 / np.trace(M @ M.T @ M @ M.T), rel=1e-3)


def test_band_without_freedom_and_of_one_value(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 4.0), ("b", 0.0, 1.0), ("b", 1.0, 2.0), ("b", 2.0, 5.0)],
                               "g string, x double, y double")
    out = {(r.g, round(r.x, 6)): r for r in local.local_regression(df, F.col("y"), F.col("x"), ["g"], points=5).collect()}
    assert out["a", 1.0].fit == pytest.approx(3.0) and out["a", 1.0].df == pytest.approx(1.0)
    assert out["b", 1.0].fit == pytest.approx(2.0) and out["b", 0.0].upper is None
    assert local.local_regression(df.where("false"), F.col("y"), F.col("x"), ["g"]).count() == 0


def laplace(X, Zs, k, n, sd):
    """Penalised mode and Laplace deviance, dense."""
    Z = np.hstack([s * z for s, z in zip(sd, Zs)])
    M, P = np.hstack([X, Z]), np.r_[np.zeros(X.shape[1]), np.ones(Z.shape[1])]
    t = np.zeros(M.shape[1])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-M @ t))
        H = M.T @ ((n * mu * (1 - mu))[:, None] * M) + np.diag(P)
        t = t + np.linalg.solve(H, M.T @ (k - n * mu) - P * t)
    mu = 1 / (1 + np.exp(-M @ t))
    ll = np.sum(k * np.log(mu) + (n - k) * np.log1p(-mu))
    p = X.shape[1]
    return -2 * ll + np.sum(P * t * t) + np.linalg.slogdet(H[p:, p:])[1], t, np.linalg.inv(H)


@pytest.fixture(scope="module")
def trials(spark):
    rng = np.random.default_rng(8)
    m = 240
    g, h = rng.integers(0, 9, m), rng.integers(0, 5, m)
    x, f = np.round(rng.normal(size=m), 1), rng.integers(0, 2, m)
    eta = (-0.5 + 0.6 * x + 0.4 * f + rng.normal(0, .8, 9)[g] + rng.normal(0, .4, 5)[h])
    n = rng.integers(1, 12, m)
    k = rng.binomial(n, 1 / (1 + np.exp(-eta)))
    df = spark.createDataFrame(
        [(f"g{a}", f"h{b}", float(c), "uv"[d], int(e), int(i))
         for a, b, c, d, e, i in zip(g, h, x, f, k, n)],
        "g string, h string, x double, f string, NwP long, N long")
    return df, (g, h, x, f, k, n)


def test_mixed_model_reaches_the_laplace_optimum(trials):
    df, (g, h, x, f, k, n) = trials
    terms = [Numeric("x"), Factor("f")]
    design = build_design(df, terms, ("g", "h"))
    fit = mixed.fit_binomial(design, {"m": [t.name for t in terms]})["m"]
    X = np.column_stack([np.ones(len(x)), (x - x.mean()) / x.std(ddof=1), f])
    Zs = [np.eye(9)[g], np.eye(5)[h]]
    sd = [fit.spread["g"], fit.spread["h"]]
    dev, theta, cov = laplace(X, Zs, k, n, sd)
    const = sum(math.lgamma(b + 1) - math.lgamma(a + 1) - math.lgamma(b - a + 1)
                for a, b in zip(k, n))
    assert fit.loglik == pytest.approx(-0.5 * dev + const, abs=1e-5)
    assert fit.beta == pytest.approx(theta[:3], abs=1e-5)
    assert np.sqrt(np.diag(fit.cov)) == pytest.approx(np.sqrt(np.diag(cov))[:3], rel=1e-4)
    grid = [laplace(X, Zs, k, n, [sd[0] * a, sd[1] * b])[0]
            for a in (0.9, 0.97, 1, 1.03, 1.1) for b in (0.9, 0.97, 1, 1.03, 1.1)]
    assert dev <= min(grid) + 0.01
    lo, hi = fit.r2
    assert 0 < lo < hi < 1


def test_zero_variance_is_found(trials, spark):
    rng = np.random.default_rng(0)
    rows = [(f"g{i % 6}", int(rng.binomial(40, .3)), 40) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, NwP long, N long")
    fit = mixed.fit_binomial(build_design(df, [], ("g",)), {"m": []})["m"]
    assert fit.spread["g"] < 0.12
    share = sum(r[1] for r in rows) / 4800
    assert fit.beta[0] == pytest.approx(math.log(share / (1 - share)), abs=0.02)


def test_logistic_without_random_effects(trials):
    df, (_, _, x, f, k, n) = trials
    terms = [Numeric("x", scale=False), Factor("f"), Interaction(Numeric("x", scale=False),
                                                                Factor("f"))]
    fit = mixed.fit_binomial(build_design(df, terms), {"m": [t.name for t in terms]})["m"]
    X = np.column_stack([np.ones(len(x)), x, f, x * f])
    assert fit.beta == pytest.approx(laplace(X, [np.zeros((len(x), 1))], k, n, [0.0])[1][:4],
                                     abs=1e-5)


def test_dredge_sizes_and_ranking(trials, spark):
    d, f = Numeric("depth"), Factor("Found")
    full = [Factor("prime"), Numeric("tl"), d, f, Numeric("poll"), Factor("water"),
            Numeric("year"), Factor("brk"), Interaction(d, f)]
    assert len(mixed.submodels(full)) == 320
    df, _ = trials
    terms = [Numeric("x"), Factor("f"), Interaction(Numeric("x"), Factor("f"))]
    design = build_design(df, terms, ("g",))
    fits = mixed.dredge(design, terms)
    assert len(fits) == 5
    alone = mixed.fit_binomial(design, {"m": [terms[0].name]})["m"]
    same = next(f for f in fits if f.terms == (terms[0].name,))
    assert same.loglik == pytest.approx(alone.loglik, abs=1e-3)
    ranked = linear.weights_of(mixed.model_table(spark, fits)).collect()
    assert sum(r["weight"] for r in ranked) == pytest.approx(1.0)
    assert min(r["delta"] for r in ranked) == 0.0


def test_gaussian_mixed_model(spark):
    rng = np.random.default_rng(12)
    g, x = rng.integers(0, 8, 150), rng.normal(size=150)
    y = 1 + 0.5 * x + rng.normal(0, .7, 8)[g] + rng.normal(0, .5, 150)
    df = spark.createDataFrame([(f"g{a}", float(b), float(c)) for a, b, c in zip(g, x, y)],
                               "g string, x double, y double")
    terms = [Numeric("x", scale=False)]
    fit = mixed.fit_gaussian(build_design(df, terms, ("g",), response=F.col("y")), ["x"])
    X, Z = np.column_stack([np.ones(150), x]), np.eye(8)[g]

    def reml(s_g, s_e):
        V = s_g ** 2 * Z @ Z.T + s_e ** 2 * np.eye(150)
        Vi = np.linalg.inv(V)
        A = X.T @ Vi @ X
        b = np.linalg.solve(A, X.T @ Vi @ y)
        r = y - X @ b
        value = -0.5 * (np.linalg.slogdet(V)[1] + np.linalg.slogdet(A)[1] + r @ Vi @ r
                        + 148 * math.log(2 * math.pi))
        return value, b
    value, b = reml(fit.spread["g"], fit.residual)
    assert fit.loglik == pytest.approx(value, abs=1e-6) and fit.beta == pytest.approx(b, abs=1e-6)
    for a in (0.95, 1.05):
        assert reml(fit.spread["g"] * a, fit.residual)[0] < value
        assert reml(fit.spread["g"], fit.residual * a)[0] < value


def test_smooth_recovers_a_curve(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(0, 1, 800)
    y = np.sin(2 * math.pi * x) + rng.normal(0, .2, 800)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double")
    term = Smooth("x")
    fit = mixed.fit_gaussian(build_design(df, [term], response=F.col("y")), [term.name])
    curve = fit.curves["s(x)"]
    truth = np.sin(2 * math.pi * curve[:, 0])
    assert np.max(np.abs(curve[:, 1] - (truth - truth.mean()))) < 0.12
    assert 3 < fit.edf["s(x)"] < 9


def test_logistic_bands(trials, spark):
    rows = [(m, y, int((y + i) % 3 > 0)) for m in ("a", "b") for y in range(2010, 2016)
            for i in range(5)]
    df = spark.createDataFrame(rows, "m string, y int, v int")
    out = mixed.logistic_bands(df, "m", "y", "v").collect()
    assert len(out) == 12 and all(r["lower"] < r["fit"] < r["upper"] for r in out)


def test_requests_are_split_by_memory(trials, monkeypatch):
    """The sums do not depend on how many requests share a pass."""
    from driftline.models import design as designs
    built = build_design(trials[0], [Numeric("x")], ("g", "h"))
    width = 2 + sum(built.level_counts)
    asked = {i: Request(np.array([0, 1]), np.linspace(-.1, .1, width) * i) for i in range(5)}
    whole = evaluate(built, asked, "binomial")
    monkeypatch.setattr(designs, "PASS_BYTES", 1)
    for i, sums in evaluate(built, asked, "binomial").items():
        assert np.allclose(sums.info, whole[i].info) and np.allclose(sums.score, whole[i].score)


@pytest.mark.parametrize("n_levels, requests", [(9, 1), (9, 5), (90, 1), (90, 5)])
def test_pass_equals_dense_sums(spark, n_levels, requests):
    """One or many requests, few or many levels; at certain outcomes the value stays finite."""
    rng = np.random.default_rng(3)
    g, x = np.arange(270) % n_levels, np.round(rng.normal(size=270), 2)
    n = rng.integers(1, 9, 270)
    k = rng.integers(0, n + 1)
    df = spark.createDataFrame([(f"g{a:02d}", float(b), int(c), int(d)) for a, b, c, d in zip(g, x, k, n)],
                               "g string, x double, NwP long, N long")
    built = build_design(df, [Numeric("x", scale=False)], ("g",))
    Z = np.hstack([np.ones((270, 1)), x[:, None], np.eye(n_levels)[g]])
    asked = {7 + i: Request(np.array([0, 1]), rng.normal(size=2 + n_levels) * (1 + 9 * i)) for i in range(requests)}
    for key, sums in evaluate(built, asked, "binomial").items():
        eta = np.clip(Z @ asked[key].coef, -40, 40)
        mu = 1 / (1 + np.exp(-eta))
        assert np.allclose(sums.info, Z.T @ ((n * mu * (1 - mu))[:, None] * Z), atol=1e-9)
        assert np.allclose(sums.score, Z.T @ (k - n * mu))
        assert sums.value == pytest.approx(np.sum(k * eta - n * np.logaddexp(0, eta)))
    rows = evaluate(built, {0: Request(np.array([0, 1]), np.zeros(2 + n_levels))}, "rows")[0]
    assert np.allclose(rows.info, Z.T @ Z)


def test_averages(spark):
    coefs = spark.createDataFrame([("m1", "x", 1.0, 0.1), ("m2", "x", 2.0, 0.1),
                                   ("m2", "z", 5.0, 0.2)],
                                  "model_id string, term string, estimate double, std_error double")
    weights = spark.createDataFrame([("m1", 0.75), ("m2", 0.25)], "model_id string, weight double")
    got = {r["term"]: r for r in linear.average_coefficients(coefs, weights).collect()}
    assert got["x"]["full"] == got["x"]["conditional"] == 1.25
    assert got["z"]["full"] == 1.25 and got["z"]["conditional"] == 5.0
    z, error = special.normal_critical(0.95), 0.25 * math.hypot(0.2, 3.75) + 0.75 * 1.25
    assert (got["z"]["lower"], got["z"]["upper"]) == pytest.approx((5 - z * 0.2, 5 + z * 0.2))
    assert (got["z"]["full_lower"], got["z"]["full_upper"]) == pytest.approx((1.25 - z * error, 1.25 + z * error))
    spread = 0.75 * math.hypot(0.1, 0.25) + 0.25 * math.hypot(0.1, 0.75)
    assert got["x"]["full_error"] == pytest.approx(got["x"]["std_error"]) == pytest.approx(spread)


def test_boosted_trees(spark):
    rng = np.random.default_rng(7)
    x, f = rng.uniform(0, 1, 300).round(2), rng.integers(0, 3, 300)
    y = (x > 0.5) * 1.0 + 0.05 * rng.normal(size=300)
    df = spark.createDataFrame([(float(a), "pqr"[b], float(c)) for a, b, c in zip(x, f, y)],
                               "x double, f string, y double")
    b = boost.fit_boosted(df, F.col("y"), ["x"], ["f"], trees=4, rate=0.5, folds=2)
    assert boost.importance(b).first()["feature"] == "x"
    pdp = {r["value"]: r["prediction"] for r in boost.partial_dependence(b, "x", 3).collect()}
    assert pdp[max(pdp)] - pdp[min(pdp)] > 0.5
    assert boost.partial_dependence(b, "f").count() == 3
    assert boost.cv_table(b).count() == 4


def test_boosting_keeps_rows_with_gaps(spark):
    rng = np.random.default_rng(8)
    x, f = rng.uniform(0, 1, 300), rng.integers(0, 2, 300)
    rows = [(None if k % 3 == 0 else float(a), None if k % 5 == 0 else "ab"[b], 9.0 if k % 3 == 0 else float(a))
            for k, (a, b) in enumerate(zip(x, f))]
    df = spark.createDataFrame(rows, "x double, f string, y double")
    b = boost.fit_boosted(df, F.col("y"), ["x"], ["f"], trees=6, rate=0.5, folds=2)
    assert b.data.agg(F.sum("weight")).first()[0] == 300
    assert b.features == ["x", "x_missing", "f"]
    seen = {r["value"]: r["prediction"] for r in boost.partial_dependence(b, "x", 3).collect()}
    assert max(seen) <= 1 and max(seen.values()) < 3      # as if known, not as the rows with gaps


def test_response_filter(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("b", 3.0), ("b", 5.0), ("a", 1.0)],
                               "g string, m double")
    design = build_design(df, [Factor("g")], response=rsem.log_or_null("m"))
    assert design.n_obs == 4


def test_absorbed_factor_gives_the_same_fit(trials):
    df, _ = trials
    terms = [Numeric("x"), Factor("f")]
    names = [t.name for t in terms]
    plain = mixed.fit_binomial(build_design(df, terms, ("g", "h")), {"m": names})["m"]
    design = build_design(df, terms, ("g", "h"), max_levels=8)
    assert design.absorbed == "g"
    fit = mixed.fit_binomial(design, {"m": names})["m"]
    assert fit.loglik == pytest.approx(plain.loglik, abs=2e-3)
    assert fit.beta == pytest.approx(plain.beta, abs=5e-3)
    assert np.diag(fit.cov) == pytest.approx(np.diag(plain.cov), rel=0.05)
    for k in ("g", "h"):
        assert fit.spread[k] == pytest.approx(plain.spread[k], rel=0.05)
    table = {r["h"]: r["b"] for r in fit.absorbed_effects.collect()}
    rows = mixed.random_intercepts(df.sparkSession, fit, design, "g").collect()
    assert {r["level"]: r["intercept"] for r in rows} == pytest.approx(table)
    assert [r["intercept"] for r in rows] == sorted(table.values())
    wanted = dict(zip(build_design(df, terms, ("g", "h")).levels["g"], plain.effects["g"]))
    assert table == pytest.approx(wanted, abs=2e-2)


def test_frequent_levels_of_an_absorbed_factor(trials, monkeypatch):
    """Levels with many rows are kept with the coefficients; small blocks and pieces change nothing."""
    from driftline.models import design as designs
    df, _ = trials
    terms = [Numeric("x"), Factor("f")]
    names = [t.name for t in terms]
    whole = mixed.fit_binomial(build_design(df, terms, ("g", "h"), max_levels=8), {"m": names})["m"]
    for name, value in (("HOT_ROWS", 24), ("HOT_LEVELS", 1000), ("BLOCK_ROWS", 10)):
        monkeypatch.setattr(designs, name, value)
    monkeypatch.setattr(mixed.absorbed, "PIECE_ROWS", 30)
    design = build_design(df, terms, ("g", "h"), max_levels=8)
    assert design.hot and 0 < len(design.levels["g"]) < 9
    fit = mixed.fit_binomial(design, {"m": names})["m"]
    assert fit.loglik == pytest.approx(whole.loglik, abs=1e-4) and fit.beta == pytest.approx(whole.beta, abs=1e-4)
    assert fit.spread == pytest.approx(whole.spread, rel=1e-3)
    got, wanted = ({r["h"]: r["b"] for r in f.absorbed_effects.collect()} for f in (fit, whole))
    assert len(got) == 9 and got == pytest.approx(wanted, abs=1e-3)


def test_absorbed_factor_takes_few_passes(trials, monkeypatch):
    """All deviations are found together; each trial value used to cost several passes of its own."""
    df, _ = trials
    jobs = []
    for module in (mixed.absorbed, build_design.__globals__["evaluate"].__globals__):
        names = module if isinstance(module, dict) else vars(module)
        monkeypatch.setitem(names, "cut_lineage", lambda d, f=names["cut_lineage"]: jobs.append("table") or f(d))
    monkeypatch.setattr(mixed.absorbed, "_added", lambda d, n, f=getattr(mixed.absorbed, "_added", None): jobs.append("pass") or f(d, n),
                        raising=False)
    design = build_design(df, [Numeric("x"), Factor("f")], ("g", "h"), max_levels=8)
    fit = mixed.fit_binomial(design, {"m": ["scale(x)", "f"]})["m"]
    assert len(jobs) < 30 and fit.spread["g"] > 0.3


def test_trial_values_near_a_solved_mode_need_no_pass(spark, monkeypatch):
    """With many individuals the mode hardly moves between the trial values of a deviation."""
    rng = np.random.default_rng(4)
    g, h, x = rng.integers(0, 6, 200), rng.integers(0, 4, 200), np.round(rng.normal(size=200), 1)
    eta = -0.5 + 0.3 * x + np.linspace(-.8, .8, 6)[g] + np.array([-.4, .5, .1, -.2])[h]
    df = spark.createDataFrame([(f"g{a}", f"h{b}", float(c), int(1e6 / (1 + math.exp(-e))), 10 ** 6)
                                for a, b, c, e in zip(g, h, x, eta)], "g string, h string, x double, NwP long, N long")
    design, asked = build_design(df, [Numeric("x")], ("g", "h")), []
    monkeypatch.setattr(mixed, "evaluate", lambda d, r, f: asked.extend(r) or evaluate(d, r, f))
    fit = mixed.fit_binomial(design, {"m": ["scale(x)"]})["m"]
    few = len(asked)
    monkeypatch.setattr(mixed, "SURE", 0.0, raising=False)
    every = mixed.fit_binomial(design, {"m": ["scale(x)"]})["m"]
    assert few < 20 and few < len(asked) - few
    assert fit.loglik == pytest.approx(every.loglik, abs=1e-4) and fit.spread == pytest.approx(every.spread, rel=1e-5)
    assert fit.beta == pytest.approx(every.beta, rel=1e-6)


@pytest.mark.parametrize("requests", [1, 40])
def test_pass_over_runs_of_factor_levels(spark, requests):
    """Sums over runs of rows that agree in their factors equal dense ones, interactions and curves included."""
    rng = np.random.default_rng(5)
    m = 3000
    g, f, x, y = rng.integers(0, 3, m), rng.integers(0, 2, m), np.round(rng.normal(size=m), 2), np.round(rng.normal(size=m), 2)
    n = rng.integers(1, 9, m)
    k = rng.integers(0, n + 1)
    df = spark.createDataFrame([("abc"[a], "uv"[b], float(c), float(d), int(i), int(j)) for a, b, c, d, i, j in zip(g, f, x, y, k, n)],
                               "g string, f string, x double, y double, NwP long, N long")
    num, fac = Numeric("x", scale=False), Factor("f")
    built = build_design(df, [num, fac, Interaction(num, fac), Smooth("y", by="f", knots=4)], ("g",))
    curve = built.curves[0]
    t, v = (y - curve.low) / (curve.high - curve.low), f.astype(float)
    knots = np.abs(t[:, None] - curve.knots) ** 3
    Z = np.column_stack([np.ones(m), x, v, x * v, t * (1 - v), t * v, knots * (1 - v)[:, None], knots * v[:, None], np.eye(3)[g]])
    columns = np.arange(Z.shape[1] - 3)
    asked = {i: Request(columns, rng.normal(size=Z.shape[1]) * .2) for i in range(requests)}
    for key, sums in evaluate(built, asked, "binomial").items():
        mu = 1 / (1 + np.exp(-Z @ asked[key].coef))
        assert np.allclose(sums.info, Z.T @ ((n * mu * (1 - mu))[:, None] * Z), rtol=1e-9, atol=1e-7)
        assert np.allclose(sums.score, Z.T @ (k - n * mu), atol=1e-7)


def test_absorbed_gaussian_factor(spark):
    rng = np.random.default_rng(13)
    g, x = rng.integers(0, 12, 120), rng.normal(size=120)
    y = 1 + 0.5 * x + rng.normal(0, .7, 12)[g] + rng.normal(0, .5, 120)
    df = spark.createDataFrame([(f"g{a}", float(b), float(c)) for a, b, c in zip(g, x, y)],
                               "g string, x double, y double")
    terms = [Numeric("x", scale=False)]
    plain = mixed.fit_gaussian(build_design(df, terms, ("g",), response=F.col("y")), ["x"])
    fit = mixed.fit_gaussian(build_design(df, terms, ("g",), response=F.col("y"), max_levels=4),
                             ["x"])
    assert fit.loglik == pytest.approx(plain.loglik, abs=1e-4)
    assert fit.beta == pytest.approx(plain.beta, abs=1e-3)
    assert fit.spread["g"] == pytest.approx(plain.spread["g"], rel=1e-2)
