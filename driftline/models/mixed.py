"""Mixed, additive and logistic models fitted from distributed sums.

All data passes go through ``design.evaluate``.  The driver holds only systems whose
size is the number of coefficients.  Many models, and for each the trial values of its
variance parameters, share every pass.
"""

from __future__ import annotations

import math
from collections.abc import Generator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.models import absorbed
from driftline.models.design import Design, Interaction, Request, Sums, Term, evaluate
from driftline.models.special import normal_critical, normal_two_sided


@dataclass
class Fit:
    """A fitted model in the units of its design."""
    model_id: str
    terms: tuple[str, ...]
    names: list[str]               # fixed coefficients
    beta: np.ndarray
    cov: np.ndarray
    spread: dict[str, float]       # standard deviation per random factor or curve
    effects: dict[str, np.ndarray]  # conditional modes per random factor
    residual: float                # residual standard deviation (1 for binomial)
    loglik: float
    k: int
    n: int
    family: str
    curves: dict[str, np.ndarray]  # (x, fit, se) per curve
    edf: dict[str, float]
    var_fixed: float = float("nan")
    absorbed_effects: DataFrame | None = None     # (level, effect) of an absorbed factor

    @property
    def r2(self) -> tuple[float, float]:
        """Marginal and conditional R2 (logit residual variance pi^2 / 3)."""
        noise = math.pi ** 2 / 3 if self.family == "binomial" else self.residual ** 2
        shared = sum(s * s for name, s in self.spread.items() if name not in self.curves)
        total = self.var_fixed + shared + noise
        return self.var_fixed / total, (self.var_fixed + shared) / total


@dataclass
class _Layout:
    """How model parameters map to the raw coefficients of a pass."""
    columns: np.ndarray
    n_fixed: int
    blocks: list[tuple[str, slice]]     # penalised blocks in parameter order
    raw: np.ndarray                     # raw coefficients per unscaled parameter

    def scale(self, sd: np.ndarray) -> np.ndarray:
        out = np.ones(self.raw.shape[1])
        for s, (_, at) in zip(sd, self.blocks):
            out[at] = s
        return out

    def scaled(self, sd: np.ndarray) -> np.ndarray:
        return self.raw * self.scale(sd)

    def project(self, info: np.ndarray, scale: np.ndarray | None = None) -> np.ndarray:
        """``info`` in model parameters; levels are parameters as they are, so only the columns need products."""
        m, p = len(self.columns), self.raw.shape[1] - (self.raw.shape[0] - len(self.columns))
        top = self.raw[:m, :p]
        out = np.empty((self.raw.shape[1],) * 2)
        out[:p, :p] = top.T @ info[:m, :m] @ top
        out[:p, p:] = top.T @ info[:m, m:]
        out[p:, :p] = out[:p, p:].T
        out[p:, p:] = info[m:, m:]
        return out if scale is None else out * scale[:, None] * scale

    def penalty(self) -> np.ndarray:
        p = np.ones(self.raw.shape[1])
        p[:self.n_fixed] = 0.0
        return p


def _layout(design: Design, terms: Sequence[str]) -> _Layout:
    fixed = design.fixed_columns(terms)
    curves = [c for c in design.curves if c.linear in fixed]
    columns = np.array(fixed + [j for c in curves for j in range(c.raw.start, c.raw.stop)])
    q = sum(design.level_counts)
    width = len(fixed) + sum(c.transform.shape[1] for c in curves) + q
    raw = np.zeros((len(columns) + q, width))
    raw[:len(fixed), :len(fixed)] = np.eye(len(fixed))
    r, p, blocks = len(fixed), len(fixed), []
    for c in curves:
        rows, cols = c.transform.shape
        raw[r:r + rows, p:p + cols] = c.transform
        blocks.append((c.label, slice(p, p + cols)))
        r, p = r + rows, p + cols
    for name, levels in design.levels.items():
        raw[r:r + len(levels), p:p + len(levels)] = np.eye(len(levels))
        blocks.append((name, slice(p, p + len(levels))))
        r, p = r + len(levels), p + len(levels)
    return _Layout(columns, len(fixed), blocks, raw)


class _Approach:
    """Joint first approach: each pass moves the coefficients and the deviations.

    The coefficients take a Newton step; every variance becomes the squared length of its
    effects over their effective number.  This lands near the Laplace optimum.
    """

    def __init__(self, layout: _Layout):
        self.layout, self.sd = layout, np.full(len(layout.blocks), 0.5)
        self.theta = np.zeros(layout.raw.shape[1])
        self.last, self.rounds = None, 0
        self.done = not layout.blocks          # nothing to approach without deviations

    def request(self) -> Request:
        return Request(self.layout.columns, self.layout.raw @ self.theta)

    def update(self, sums: Sums) -> None:
        raw, p = self.layout.raw, self.layout.n_fixed
        self.rounds += 1
        if self.last is not None and sums.value < self.last[0] - 0.05 * abs(self.last[0]):
            self.theta = 0.5 * (self.theta + self.last[1])
            return
        self.last = (sums.value, self.theta)
        penalty = np.zeros(len(self.theta))
        for s, (_, at) in zip(self.sd, self.layout.blocks):
            penalty[at] = 1.0 / s ** 2
        info = self.layout.project(sums.info) + np.diag(penalty)
        info += 1e-10 * np.trace(info[:p, :p]) / p * np.eye(len(info))
        step = np.linalg.solve(info, raw.T @ sums.score - penalty * self.theta)
        self.theta = self.theta + step
        before = self.sd.copy()
        if self.rounds > 2 and len(info) > p:
            cover = np.diag(np.linalg.inv(info[p:, p:]))
            for k, (_, at) in enumerate(self.layout.blocks):
                size = at.stop - at.start
                effective = size - cover[at.start - p:at.stop - p].sum() / self.sd[k] ** 2
                length = float(self.theta[at] @ self.theta[at])
                self.sd[k] = min(max(math.sqrt(length / max(effective, 1e-12)), 1e-4), 1e3)
        shift = np.max(np.abs(np.log(self.sd / before)) * (self.sd > 0.01), initial=0.0)
        quiet = np.max(np.abs(raw @ step)) < 1e-3
        self.done = (self.rounds > 3 and quiet and shift < 0.02) or self.rounds >= 30


def _polish(sd: np.ndarray, rounds: int = 3) -> Generator[list[np.ndarray], list[float], None]:
    """Refine the deviations on the log scale; each round asks for a batch of values.

    A quadratic fitted to the batch gives the next centre.  Deviations that are almost 0
    are compared with exactly 0 first.
    """
    centre = sd.copy()
    small = centre < 0.02
    if small.any():
        zero = np.where(small, 0.0, centre)
        value = yield [centre, zero]
        if value[1] <= value[0] + 1e-3:
            centre = zero
    live = np.flatnonzero(centre > 0)
    if not len(live):
        yield [centre]
        return
    step = 0.15
    for _ in range(rounds):
        def at(move: np.ndarray) -> np.ndarray:
            out = centre.copy()
            out[live] *= np.exp(move)
            return out
        unit = np.eye(len(live)) * step
        points = [centre] + [at(s * e) for e in unit for s in (1, -1)]
        points += [at(unit[i] + unit[j]) for i, j in combinations(range(len(live)), 2)]
        value = yield points
        f0 = value[0]
        up, down = np.array(value[1:1 + 2 * len(live):2]), np.array(value[2:2 + 2 * len(live):2])
        grad, hess = (up - down) / (2 * step), np.diag((up - 2 * f0 + down) / step ** 2)
        for v, (i, j) in zip(value[1 + 2 * len(live):], combinations(range(len(live)), 2)):
            hess[i, j] = hess[j, i] = (v - up[i] - up[j] + f0) / step ** 2
        eig, vec = np.linalg.eigh(hess)
        move = -vec @ ((vec.T @ grad) / np.maximum(np.abs(eig), 1e-4))
        move = np.clip(move, -1.0, 1.0)
        centre = at(move)
        if np.max(np.abs(move)) < 0.01:
            break
    yield [centre]


class _Mode:
    """Newton iterations of one model at fixed standard deviations."""

    def __init__(self, layout: _Layout, sd: np.ndarray, theta: np.ndarray):
        self.layout, self.matrix, self.scale = layout, layout.scaled(sd), layout.scale(sd)
        self.penalty, self.theta, self.last = layout.penalty(), theta.copy(), None
        self.done, self.deviance, self.rounds = False, float("inf"), 0
        self.info, self.sums = None, None

    def request(self) -> Request:
        return Request(self.layout.columns, self.matrix @ self.theta)

    def update(self, sums: Sums) -> None:
        goal = sums.value - 0.5 * np.sum(self.penalty * self.theta ** 2)
        self.rounds += 1
        if self.last is not None and goal < self.last[0] - 1e-8 * abs(goal) and self.rounds < 40:
            self.theta = 0.5 * (self.theta + self.last[1])       # step too long
            return
        info = self.layout.project(sums.info, self.scale) + np.diag(self.penalty)
        score = self.matrix.T @ sums.score - self.penalty * self.theta
        step = np.linalg.solve(info + _ridge(info), score)
        self.last = (goal, self.theta.copy())
        self.info = info
        if score @ step < 1e-7 or self.rounds >= 40:
            self.done, self.sums = True, sums
            self.deviance = -2.0 * goal + _log_det(info, self.layout.n_fixed)
            return
        self.theta = self.theta + step


def _ridge(info: np.ndarray) -> np.ndarray:
    return 1e-10 * np.trace(info) / len(info) * np.eye(len(info))


def _log_det(info: np.ndarray, n_fixed: int) -> float:
    inner = info[n_fixed:, n_fixed:]
    return np.linalg.slogdet(inner)[1] if len(inner) else 0.0


#: A trial is taken from the expansion at a solved mode if its deviance is surely nearer than this.
SURE = 3e-5


class _Expansion:
    """The likelihood to second order about a solved mode, for trial values of the deviations close by.

    With many rows the mode hardly moves between trial values, and no pass is needed for them.
    """

    def __init__(self, design: Design, mode: _Mode):
        layout = mode.layout
        self.layout, self.value, self.at = layout, mode.sums.value, mode.theta * mode.scale
        self.info, self.score = layout.project(mode.sums.info), layout.raw.T @ mode.sums.score
        self.bounds, self.counts = design.bounds[layout.columns], design.level_counts

    def trial(self, sd: np.ndarray) -> tuple[np.ndarray, float, float]:
        """Scaled mode, deviance, and a bound of the deviance's error.

        With |row change| <= M every weight changes by a factor within exp(M): the value is off by the third
        order, the log determinant by M per penalised coefficient at most.
        """
        layout, scale, penalty = self.layout, self.layout.scale(sd), self.layout.penalty()
        info = self.info * scale[:, None] * scale + np.diag(penalty)
        mode = np.divide(self.at, scale, out=np.zeros(len(scale)), where=scale > 0)
        score = scale * (self.score + self.info @ (self.at - scale * mode)) - penalty * mode
        mode = mode + np.linalg.solve(info + _ridge(info), score)
        move = scale * mode - self.at
        square = float(move @ self.info @ move)
        goal = self.value + self.score @ move - 0.5 * square - 0.5 * np.sum(penalty * mode ** 2)
        raw = np.abs(layout.raw @ move)
        most, at = float(self.bounds @ raw[:len(self.bounds)]), len(self.bounds)
        for count in self.counts:
            most, at = most + raw[at:at + count].max(initial=0.0), at + count
        wrong = most * math.exp(min(most, 50.0)) * (square / 3 + np.sum(penalty))
        return mode, -2.0 * goal + _log_det(info, layout.n_fixed), float(wrong)


def _solve_modes(design: Design, modes: list[_Mode]) -> None:
    while True:
        active = {i: m for i, m in enumerate(modes) if not m.done}
        if not active:
            return
        sums = evaluate(design, {i: m.request() for i, m in active.items()}, "binomial")
        for i, m in active.items():
            m.update(sums[i])


def fit_binomial(design: Design, models: dict[str, Sequence[str]]) -> dict[str, Fit]:
    """Binomial models with random intercepts and/or curves, by Laplace approximation.

    ``models`` names the fixed terms of each model.  Fixed effects and conditional modes are
    found jointly for given standard deviations; those minimise the Laplace deviance.  Of each batch of
    trial values the first is solved by passes, and the others that its expansion does not settle.
    """
    if design.absorbed:
        return {k: _fit_absorbed(design, k, terms) for k, terms in models.items()}
    layouts = {k: _layout(design, terms) for k, terms in models.items()}
    first = {k: _Approach(lay) for k, lay in layouts.items()}
    while True:
        active = {i: (k, m) for i, (k, m) in enumerate(first.items()) if not m.done}
        if not active:
            break
        sums = evaluate(design, {i: m.request() for i, (_, m) in active.items()}, "binomial")
        for i, (_, m) in active.items():
            m.update(sums[i])
    searches = {k: _polish(m.sd) for k, m in first.items()}
    asked = {k: next(s) for k, s in searches.items()}
    effects = {k: m.theta for k, m in first.items()}
    # deviance, deviations, scaled mode; the solved mode if passes were made for it
    best: dict[str, tuple[float, np.ndarray, np.ndarray, _Mode | None]] = {}
    about: dict[str, _Expansion] = {}

    def start(k: str, sd: np.ndarray) -> _Mode:
        theta = effects[k].copy()
        for s, (_, at) in zip(sd, layouts[k].blocks):
            theta[at] = theta[at] / s if s > 0 else 0.0
        return _Mode(layouts[k], sd, about[k].trial(sd)[0] if k in about else theta)

    while asked:
        centres = {k: start(k, sds[0]) for k, sds in asked.items()}
        _solve_modes(design, list(centres.values()))
        found: dict[str, list[tuple[float, np.ndarray, _Mode | None]]] = {}
        for k, m in centres.items():
            about[k] = _Expansion(design, m)
            m.sums = None
            found[k] = [(m.deviance, m.theta, m)]
            for sd in asked[k][1:]:
                theta, deviance, wrong = about[k].trial(sd)
                found[k].append((deviance, theta, None) if wrong < SURE else
                                (math.inf, theta, _Mode(layouts[k], sd, theta)))
        _solve_modes(design, [m for tried in found.values() for _, _, m in tried[1:] if m is not None])
        following = {}
        for k, tried in found.items():
            values = []
            for sd, (deviance, theta, m) in zip(asked[k], tried):
                if m is not None:
                    deviance, theta, m.sums = m.deviance, m.theta, None
                values.append(deviance)
                if k not in best or deviance < best[k][0]:
                    best[k] = (deviance, sd, theta, m)
                    effects[k] = theta * layouts[k].scale(sd)
            try:
                following[k] = searches[k].send(values)
            except StopIteration:
                pass
        asked = following
    final = {k: m or _Mode(layouts[k], sd, theta) for k, (_, sd, theta, m) in best.items()}
    _solve_modes(design, [m for m in final.values()])
    moments = _row_moments(design)
    return {k: _finish(design, k, tuple(models[k]), layouts[k], best[k][1], m.theta, m.info, 1.0,
                       -0.5 * m.deviance + design.log_constant,
                       layouts[k].n_fixed + len(best[k][1]), "binomial", moments)
            for k, m in final.items()}


def _fit_absorbed(design: Design, key: str, terms: Sequence[str]) -> Fit:
    """As above for one model, with the effects of the absorbed factor kept on Spark.

    Each pass solves the effects of the absorbed levels at three trial values of their deviation, and returns
    the likelihood to second order in the other coefficients, with the slope of the log determinant.  All
    deviations and coefficients move at once to the least deviance that these predict; the prediction is
    exact to first order where the search ends.
    """
    layout, p = _layout(design, terms), len(design.fixed_columns(terms))
    raw, blocks = layout.raw, [at for _, at in layout.blocks]
    own = len(blocks) - design.hot              # frequent levels share the deviation of the absorbed factor
    low, high = math.log(1e-4), math.log(1e3)
    log_sd, log_h, theta = np.full(own, math.log(0.5)), math.log(0.5), np.zeros(raw.shape[1])
    reach, cover, last = 0.5, None, None

    def penalty(log_sd: np.ndarray, log_h: float) -> np.ndarray:
        out = np.zeros(raw.shape[1])
        for s, at in zip([*log_sd, log_h], blocks):
            out[at] = math.exp(-2.0 * s)
        return out

    def predict(state: tuple, log_sd: np.ndarray, log_h: float) -> tuple[float, np.ndarray, np.ndarray]:
        """Deviance, step to the mode, and information of a state at these deviations."""
        info, score, value, log_det, slope = state
        pen = penalty(log_sd, log_h)
        info, score = info + np.diag(pen), score - pen * theta
        ridge = 1e-10 * np.trace(info[:p, :p]) / p
        move = np.linalg.solve(info + ridge * np.eye(len(info)), score)
        spread = np.sum(np.log(pen[p:])) if len(pen) > p else 0.0
        deviance = (-2.0 * (value - 0.5 * np.sum(pen * theta ** 2)) - score @ move
                    + _log_det(info, p) - spread + log_det + slope @ move)
        return deviance, move, info

    def within(log_sd: np.ndarray, centre: np.ndarray) -> np.ndarray:
        return np.clip(np.clip(log_sd, centre - 1.0, centre + 1.0), low, high)

    for _ in range(60):
        trials = np.clip(log_h + reach * np.array([-1.0, 0.0, 1.0]), low, high)
        sums = absorbed.profile(design, layout.columns, raw @ theta, np.exp(trials), cover)
        states = [(layout.project(t.info), raw.T @ t.score, t.value, t.log_det, raw.T @ t.slope) for t in sums]
        goal = sums[1].value - 0.5 * np.sum(penalty(log_sd, log_h) * theta ** 2)
        if last is not None and goal < last[0] - 0.05 * abs(last[0]):
            theta = 0.5 * (theta + last[1])
            continue
        last = (goal, theta)
        deviance, move, info = predict(states[1], log_sd, log_h)
        gain = float((states[1][1] - penalty(log_sd, log_h) * theta) @ move)
        values, sds, moves = [], [], []
        for h, state in zip(trials, states):
            sd = log_sd
            if own:
                zero = predict(state, log_sd, h)[0]
                sd = within(_nelder_mead(lambda x: predict(state, within(x, log_sd), h)[0] - zero, log_sd,
                                         step=min(reach, 0.3), tol=1e-11), log_sd)
            value, step, _ = predict(state, sd, h)
            values.append(value)
            sds.append(sd)
            moves.append(step)
        bend, tilt = values[0] - 2 * values[1] + values[2], 0.5 * (values[2] - values[0])
        t = 0.0 if abs(tilt) < 1e-7 else float(np.clip(-tilt / bend, -1.5, 1.5)) if bend > 0 else -1.5 * np.sign(tilt)
        shares = 0.5 * t * (t - 1), 1 - t * t, 0.5 * t * (t + 1)
        next_h = float(np.clip(log_h + t * reach, low, high))
        next_sd = np.clip(sum(c * v for c, v in zip(shares, sds)), low, high)
        live = next_sd > math.log(0.01)
        drift = max(np.max(np.abs(next_sd - log_sd) * live, initial=0.0),
                    abs(next_h - log_h) * (next_h > math.log(0.01)))
        if gain < 1e-8 and drift < 2e-4 and cover is not None:
            break
        theta = theta + sum(c * v for c, v in zip(shares, moves))
        log_sd, log_h, reach = next_sd, next_h, float(np.clip(abs(next_h - log_h), 0.01, 0.5))
        cover = np.zeros((raw.shape[0],) * 2)
        if gain < 1.0 and len(info) > p:
            inner = states[1][0][p:, p:] + np.diag(penalty(log_sd, log_h)[p:])
            cover = raw[:, p:] @ np.linalg.inv(inner) @ raw[:, p:].T
    sd = np.exp([*log_sd, log_h])
    scale = layout.scale(sd[:len(blocks)])
    theta = theta + move
    fit = _finish(design, key, tuple(terms), layout, sd[:len(blocks)], theta / scale, info * scale[:, None] * scale, 1.0,
                  -0.5 * deviance + design.log_constant, p + own + 1, "binomial", _row_moments(design))
    fit.spread[design.absorbed] = float(sd[-1])
    effects = absorbed.effects(design, layout.columns, raw @ theta, float(sd[-1]))
    if design.hot:
        kept = design.rows.sparkSession.createDataFrame(
            [(h, float(b)) for h, b in zip(design.levels[design.absorbed], fit.effects.pop(design.absorbed))],
            "h string, b double")
        effects = effects.unionByName(kept)
    fit.absorbed_effects = effects
    return fit


def _row_moments(design: Design) -> np.ndarray:
    """Sample covariance of the fixed columns over the original rows."""
    cols = np.arange(design.n_fixed)
    width = design.n_fixed + sum(design.level_counts)
    s = evaluate(design, {0: Request(cols, np.zeros(width))}, "rows")[0].info
    s = s[:design.n_fixed, :design.n_fixed]
    n, mean = s[0, 0], s[0] / s[0, 0]
    return (s - n * np.outer(mean, mean)) / (n - 1)


def _finish(design: Design, key: str, terms: tuple[str, ...], layout: _Layout, sd: np.ndarray,
            theta: np.ndarray, info: np.ndarray, residual: float, loglik: float, k: int,
            family: str, moments: np.ndarray) -> Fit:
    inverse = np.linalg.pinv(info) * residual ** 2
    p = layout.n_fixed
    beta = theta[:p]
    spread, effects, curves, edf = {}, {}, {}, {}
    unpenalised = info - np.diag(layout.penalty())
    hat = np.linalg.pinv(info) @ unpenalised
    by_label = {c.label: c for c in design.curves}
    fixed = list(layout.columns[:p])
    for s, (name, at) in zip(sd, layout.blocks):
        spread[name] = float(s * residual)
        if name in by_label:
            c = by_label[name]
            grid = np.linspace(0.0, 1.0, 41)
            knots = np.abs(grid[:, None] - c.knots[None, :]) ** 3 @ c.transform * s
            basis = np.zeros((len(grid), len(theta)))
            basis[:, fixed.index(c.linear)] = grid
            basis[:, at] = knots
            basis -= basis.mean(axis=0)
            curves[name] = np.column_stack([
                c.low + grid * (c.high - c.low), basis @ theta,
                np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", basis, inverse, basis), 0.0))])
            edf[name] = float(np.trace(hat[at, at]) + hat[fixed.index(c.linear),
                                                         fixed.index(c.linear)])
        else:
            effects[name] = s * theta[at]
    columns = np.array(fixed)
    var_fixed = float(beta @ moments[np.ix_(columns, columns)] @ beta)
    return Fit(key, terms, [design.names[j] for j in fixed], beta, inverse[:p, :p], spread,
               effects, residual, loglik, k, design.n_obs, family, curves, edf, var_fixed)


def _nelder_mead(f, x: np.ndarray, step: float = 0.3, tol: float = 1e-9,
                 rounds: int = 400) -> np.ndarray:
    points = [x] + [x + step * e for e in np.eye(len(x))]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) < tol * (1 + abs(values[0])):
            break
        centre = np.mean(points[:-1], axis=0)
        trial = 2 * centre - points[-1]
        value = f(trial)
        if value < values[0]:
            far = 3 * centre - 2 * points[-1]
            other = f(far)
            trial, value = (far, other) if other < value else (trial, value)
        elif value >= values[-2]:
            trial = 0.5 * (centre + points[-1])
            value = f(trial)
            if value >= values[-1]:
                points = [points[0]] + [0.5 * (points[0] + p) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
                continue
        points[-1], values[-1] = trial, value
    return points[int(np.argmin(values))]


def fit_gaussian(design: Design, terms: Sequence[str], model_id: str = "model",
                 reml: bool = True) -> Fit:
    """Gaussian model with random intercepts and/or curves.

    One data pass: the criterion depends on the data only through X'WX, X'Wy and y'Wy.
    """
    layout = _layout(design, terms)
    zero = Request(layout.columns, np.zeros(layout.raw.shape[0]))
    sums = evaluate(design, {0: zero}, "gaussian")[0]
    table = absorbed.level_table(design, layout.columns) if design.absorbed else None
    names = [name for name, _ in layout.blocks]
    if design.absorbed and not design.hot:
        names.append(design.absorbed)
    p, n, penalty = layout.n_fixed, design.n_obs, layout.penalty()
    free = n - p if reml else n

    def solve(sd: np.ndarray):
        m = layout.scaled(np.abs(sd[:len(layout.blocks)]))
        matrix, right, value, extra = sums.info, sums.score, sums.value, 0.0
        if design.absorbed:
            big = max(abs(sd[-1]), 1e-6)
            cut = absorbed.eliminate(table, len(right), big)
            matrix, right, value = matrix - cut.outer, right - cut.score, value - cut.gain
            extra = cut.log_det + 2 * cut.count * math.log(big)
        info = m.T @ matrix @ m + np.diag(penalty)
        score = m.T @ right
        theta = np.linalg.lstsq(info, score, rcond=1e-12)[0]
        rss = max(value - theta @ score, 1e-300)
        return info, theta, rss, extra

    def criterion(sd: np.ndarray) -> float:
        info, _, rss, extra = solve(sd)
        inner = info[p:, p:]
        log_u = (np.linalg.slogdet(inner)[1] if len(inner) else 0.0) + extra
        log_all = np.linalg.slogdet(info)[1] + extra
        return ((log_all if reml else log_u)
                + free * (1 + math.log(2 * math.pi * rss / free)) - design.log_constant)

    sd = np.zeros(0)
    if names:
        starts = (0.5,) if design.absorbed else (0.1, 1.0)     # a trial costs a pass if absorbed
        tol = 1e-7 if design.absorbed else 1e-9
        sd = np.abs(min((_nelder_mead(criterion, np.full(len(names), s), tol=tol)
                         for s in starts), key=criterion))
    info, theta, rss, _ = solve(sd)
    residual = math.sqrt(rss / free)
    fit = _finish(design, model_id, tuple(terms), layout, sd[:len(layout.blocks)], theta, info,
                  residual, -0.5 * criterion(sd), p + len(sd) + 1, "gaussian",
                  _row_moments(design))
    if design.absorbed:
        fit.spread[design.absorbed] = float(sd[-1] * residual)
    return fit


# --- results as DataFrames -----------------------------------------------------------


def coefficients(spark: SparkSession, fits: Sequence[Fit], level: float = 0.95) -> DataFrame:
    z = normal_critical(level)
    out = []
    for f in fits:
        for name, b, s in zip(f.names, f.beta, np.sqrt(np.maximum(np.diag(f.cov), 0.0))):
            value = float(b / s) if s > 0 else float("nan")
            out.append((f.model_id, name, float(b), float(s), value, normal_two_sided(value),
                        float(b - z * s), float(b + z * s)))
    return spark.createDataFrame(
        out, "model_id string, term string, estimate double, std_error double, z_value double,"
             " p_value double, lower double, upper double")


def model_table(spark: SparkSession, fits: Sequence[Fit]) -> DataFrame:
    """One row per model: input of the ranking by corrected AIC."""
    return spark.createDataFrame(
        [(f.model_id, " + ".join(f.terms) or "1", float(f.loglik), f.k, f.n) for f in fits],
        "model_id string, terms string, loglik double, k int, n long")


def variance_components(spark: SparkSession, fits: Sequence[Fit]) -> DataFrame:
    """Standard deviation per random factor and both R2 values, per model."""
    out = [(f.model_id, g, float(s), *map(float, f.r2)) for f in fits
           for g, s in (f.spread or {"none": 0.0}).items()]
    return spark.createDataFrame(
        out, "model_id string, grouping string, std_dev double, r2_marginal double,"
             " r2_conditional double")


def random_intercepts(spark: SparkSession, fit: Fit, design: Design, factor: str) -> DataFrame:
    """Conditional modes of one factor, as odds factors too, smallest first."""
    if factor not in fit.effects and fit.absorbed_effects is not None:
        return fit.absorbed_effects.select(
            F.col("h").cast("string").alias("level"), F.col("b").cast("double").alias("intercept"),
            F.exp("b").alias("odds_factor")).orderBy("intercept", "level")
    rows = [(level, float(b), float(math.exp(b))) for level, b in
            zip(design.levels[factor], fit.effects[factor])]
    return spark.createDataFrame(sorted(rows, key=lambda r: r[1]),
                                 "level string, intercept double, odds_factor double")


def curve_table(spark: SparkSession, fit: Fit) -> DataFrame:
    """Centred smooth curves on a grid, with standard errors and effective freedom."""
    out = [(name, float(x), float(v), float(s), fit.edf[name])
           for name, table in fit.curves.items() for x, v, s in table]
    return spark.createDataFrame(out, "curve string, x double, fit double, std_error double,"
                                      " edf double")


def submodels(terms: Sequence[Term]) -> dict[str, list[str]]:
    """All subsets of the terms in which an interaction comes with its main effects."""
    out = {}
    for size in range(len(terms) + 1):
        for chosen in combinations(terms, size):
            names = [t.name for t in chosen]
            if all(t.a.name in names and t.b.name in names for t in chosen
                   if isinstance(t, Interaction)):
                out[" + ".join(names) or "1"] = names
    return out


def dredge(design: Design, terms: Sequence[Term]) -> list[Fit]:
    """Fit every admissible submodel; all of them share each data pass."""
    return list(fit_binomial(design, submodels(terms)).values())


def logistic_bands(df: DataFrame, group: str, x: str, y: str, level: float = 0.95) -> DataFrame:
    """Logistic regression of a 0/1 column per group, with its band at each whole x.

    The groups are fitted together, with an own intercept and slope each.
    """
    from pyspark.sql import functions as F

    from driftline.models.design import Factor, Numeric, build_design
    from driftline.session import cut_lineage
    g, slope = Factor(group), Numeric(x, scale=False)
    terms = [g, slope, Interaction(g, slope)]
    data = cut_lineage(df.groupBy(group, x, F.col(y).alias("_k")).agg(
        F.count(F.lit(1)).alias("_one"))
        .withColumn("_k", F.col("_k") * F.col("_one")))
    edge = data.agg(F.min(x), F.max(x)).first()
    data = data.withColumn(x, F.col(x) - F.lit(edge[0]))
    design = build_design(data, terms, positive="_k", trials="_one")
    fit = fit_binomial(design, {"logistic": [t.name for t in terms]})["logistic"]
    groups = [r[0] for r in data.select(group).distinct().orderBy(group).collect()]
    z, out = normal_critical(level), []
    for name in groups:
        for v in range(int(edge[0]), int(edge[1]) + 1):
            row = np.array([{"(Intercept)": 1.0, f"{group}{name}": 1.0, slope.name: v - edge[0],
                             f"{group}{name}:{slope.name}": v - edge[0]}.get(c, 0.0) for c in fit.names])
            eta, se = float(row @ fit.beta), math.sqrt(max(row @ fit.cov @ row, 0.0))
            out.append((name, v, *[1 / (1 + math.exp(-max(min(e, 700.0), -700.0)))
                                   for e in (eta, eta - z * se, eta + z * se)]))
    return df.sparkSession.createDataFrame(
        out, f"{group} string, {x} int, fit double, lower double, upper double")
