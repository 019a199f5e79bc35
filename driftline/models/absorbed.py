"""A random factor with any number of levels, eliminated level by level on Spark.

Given the other coefficients, the effects of one factor do not interact with each other:
its block of the information matrix is diagonal.  A block of the design holds all rows of its
levels, so each task finds the effects of its levels, takes them out of the joint system, and
only sums of the small remaining system leave the task.  Effects are found anew in every pass; no
table of them is kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from driftline.models.design import Design, Part, blocks, dense_columns
from driftline.session import cut_lineage


@dataclass
class Profile:
    """Sums of one pass at one deviation of the levels, whose effects are at their modes.

    ``info`` and ``score`` are of the small system after the levels; ``value`` has the levels' penalty,
    ``log_det`` is theirs in units of their deviation, and ``slope`` is what the log determinant of all effects
    changes by per coefficient.
    """
    info: np.ndarray
    score: np.ndarray
    value: float
    log_det: float
    slope: np.ndarray


@dataclass
class Eliminated:
    """What the levels of a Gaussian model take out of the small system at one standard deviation."""
    outer: np.ndarray      # sum of c c' / d
    score: np.ndarray      # sum of c q / d
    log_det: float         # sum of log d
    gain: float            # sum of q^2 / d
    count: float


def _parts(design: Design, columns: np.ndarray) -> list[Part]:
    return [design.parts[j] for j in columns] + [
        Part(marks=((place, i),)) for place, count in zip(design.places, design.level_counts) for i in range(count)]


def _logit(fixed: np.ndarray, effect: np.ndarray, a: np.ndarray, n: np.ndarray):
    """Linear predictor, odds, weight, residual and mean share of the rows."""
    eta = np.clip(fixed + effect, -40, 40)
    odds = np.exp(eta)
    mu = odds / (1.0 + odds)
    mean = n * mu
    return eta, odds, mean / (1.0 + odds), a - mean, mu


def _modes(fixed: np.ndarray, a: np.ndarray, n: np.ndarray, first: np.ndarray, of: np.ndarray, sd: float,
           b: np.ndarray) -> np.ndarray:
    """Effects of the levels: Newton's method, kept between the last values of either sign of the score."""
    below, above = np.full(len(b), -np.inf), np.full(len(b), np.inf)
    for _ in range(100):
        _, _, w, r, _ = _logit(fixed, b[of], a, n)
        score = np.add.reduceat(r, first) - b / sd ** 2
        step = score / (np.add.reduceat(w, first) + 1.0 / sd ** 2)
        if np.max(np.abs(step)) < 1e-8:
            return b + step
        below, above = np.where(score > 0, b, below), np.where(score < 0, b, above)
        to = b + np.clip(step, -3.0, 3.0)
        halves = np.isfinite(below) & np.isfinite(above) & ((to <= below) | (to >= above))
        b = np.where(halves, 0.5 * (np.where(halves, below, 0.0) + np.where(halves, above, 0.0)), to)
    return b


#: Rows whose sums are taken at once, up to the end of a level; their columns should fit a core's cache.
PIECE_ROWS = 1 << 11


def _pieces(first: np.ndarray, size: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Rows of whole levels, and where each level begins among them; rows without a level come first."""
    begin = int(first[0]) if len(first) else size
    for lo in range(0, begin, PIECE_ROWS):
        yield slice(lo, min(lo + PIECE_ROWS, begin)), np.zeros(0, int)
    ends, at = np.append(first[1:], size), 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(ends, first[at] + PIECE_ROWS, side="right")))
        yield slice(int(first[at]), int(ends[to - 1])), first[at:to] - first[at]
        at = to


def profile(design: Design, columns: np.ndarray, coef: np.ndarray, sds: Sequence[float],
            cover: np.ndarray | None) -> list[Profile]:
    """One pass over the rows at the given coefficients, for each deviation of the absorbed levels.

    ``cover`` is the covariance of the small system's effects, for the slope; that of the middle deviation
    is returned for all.
    """
    parts = _parts(design, columns)
    k, middle = len(parts), len(sds) // 2
    size = k * k + 2 * k + 2

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(sds), size))
        for numbers, codes, (a_all, n_all, _, _), begins, _ in blocks(batches):
            for rows, first in _pieces(begins, len(a_all)):
                a, n, z = a_all[rows], n_all[rows], dense_columns(parts, numbers[:, rows], codes[:, rows])
                fixed, effect, some = coef @ z, 0.0, len(first) > 0
                of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(a)))) if some else None
                b = np.zeros(len(first))
                for i, (out, sd) in enumerate(zip(total, sds)):
                    if some:
                        b = _modes(fixed, a, n, first, of, sd, b)
                        effect = b[of]
                    eta, odds, w, r, mu = _logit(fixed, effect, a, n)
                    wz = w * z
                    out[:k * k] += (wz @ z.T).ravel()
                    out[k * k:k * k + k] += z @ r
                    out[-2] += a @ eta - n @ np.log1p(odds)
                    if some:
                        d = np.add.reduceat(w, first) + 1.0 / sd ** 2
                        q = np.add.reduceat(r, first) - b / sd ** 2
                        c = np.add.reduceat(wz, first, axis=1)
                        share = c / d
                        out[:k * k] -= (c @ share.T).ravel()
                        out[k * k:k * k + k] -= share @ q
                        out[-2] += 0.5 * np.sum(q * q / d) - 0.5 * np.sum(b * b) / sd ** 2
                        out[-1] += np.sum(np.log(d)) + 2 * len(d) * np.log(sd)
                    if cover is not None and i == middle:
                        apart = z - share[:, of] if some else z
                        lever = np.einsum("ij,ij->j", cover @ apart, apart)
                        if some:
                            lever += (1.0 / d)[of]
                        total[:, k * k + k:k * k + 2 * k] += apart @ (w * (1.0 - 2.0 * mu) * lever)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    flat = _added(design.rows.mapInArrow(partial, "v binary"), len(sds) * size).reshape(len(sds), size)
    return [Profile(f[:k * k].reshape(k, k), f[k * k:k * k + k], float(f[-2]), float(f[-1]),
                    f[k * k + k:k * k + 2 * k]) for f in flat]


def effects(design: Design, columns: np.ndarray, coef: np.ndarray, sd: float) -> DataFrame:
    """Effects of the absorbed levels at these coefficients, as a table ``(h, b)``."""
    parts = _parts(design, columns)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, codes, (a, n, _, _), first, names in blocks(batches):
            if len(first):
                at = int(first[0])
                of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(a))))
                fixed = (coef @ dense_columns(parts, numbers, codes))[at:]
                b = _modes(fixed, a[at:], n[at:], first - at, of, sd, np.zeros(len(first)))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(b)], ["h", "b"])

    return design.rows.mapInArrow(found, "h string, b double")


def _added(sums: DataFrame, size: int) -> np.ndarray:
    """Sum of the tasks' packed numbers."""
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for v in batch.column(0):
                total += np.frombuffer(v.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    total = np.zeros(size)
    for v in sums.repartition(1).mapInArrow(added, "v binary").toArrow().column("v"):
        total += np.frombuffer(v.as_buffer())
    return total


def level_table(design: Design, columns: np.ndarray) -> DataFrame:
    """Per level of a Gaussian model its weight, its sum and its cross products with the small system, packed."""
    parts = _parts(design, columns)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, codes, (a, n, _, _), first, _ in blocks(batches):
            if len(first):
                at = int(first[0])
                wz = (n * dense_columns(parts, numbers, codes)).T[at:]
                v = np.add.reduceat(np.column_stack([n[at:], a[at:], wz]), first - at, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary())], ["v"])

    return cut_lineage(design.rows.mapInArrow(summed, "v binary"))


def eliminate(levels: DataFrame, k: int, sd: float) -> Eliminated:
    """Sum over the levels of what each takes out of a small system of ``k`` coefficients."""
    size = k * k + k + 3

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for packed in batch.column("v"):
                v = np.frombuffer(packed.as_buffer()).reshape(-1, k + 2)
                d, q, c = v[:, 0] + 1.0 / sd ** 2, v[:, 1], v[:, 2:]
                total[:k * k] += (c.T @ (c / d[:, None])).ravel()
                total[k * k:-3] += c.T @ (q / d)
                total[-3:] += [np.sum(np.log(d)), np.sum(q * q / d), len(d)]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    flat = _added(levels.mapInArrow(partial, "v binary"), size)
    return Eliminated(flat[:k * k].reshape(k, k), flat[k * k:-3], *map(float, flat[-3:]))
