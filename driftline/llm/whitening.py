"""Embedding whitening by an incremental eigendecomposition of the covariance.

Entries become integers, x = floor(1024 * c) + 100000, so counts, sums and deviations are exact.

1. Each task keeps a spectrum (count, mean, eigenvalues, eigenvectors of its scatter).  Rows come in
   blocks; a block is centred and reduced by QR to at most d rows of equal scatter, and each of these,
   and the shift between the block's mean and the task's, is a rank-one update: components with no
   share in the update and equal eigenvalues are deflated, the secular equation gives the new
   eigenvalues, and eigenvectors come from the update vector that fits these eigenvalues exactly.
2. Spectra are combined in a tree: the second's scaled eigenvectors, and the shift of the means, are
   successive rank-one updates of the first.
3. Rayleigh-Ritz: the covariance of all rows, centred by the exact mean, is summed over the cluster
   in the basis found; its small eigenproblem turns the basis into eigenvectors to double precision.
   This is repeated with the new basis while the off-diagonal part is above rounding.

Nothing but d x d matrices (d: length of a vector) leaves the tasks.

Defined cases: rows whose vector is null or holds null or non-finite entries are left out, and so are
rows whose vector has not the most frequent length (the greater of equally frequent ones), and empty
vectors; entries from 2**40 on in size are left out as non-finite ones are; a null id is an id;
repeated rows count and are returned each; equal eigenvalues leave the choice of basis open;
components without variance have whitened null and no part in identity_error; a deviation that does
not fit a long is null; an empty table gives no rows; columns beside id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.common import table
from driftline.session import cut_lineage

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Rows of a block.
BLOCK = 4096
#: Spectra that one task combines.
FAN_IN = 8
_EPS = np.finfo(float).eps
_LARGEST = float(1 << 40)


# --- rank-one updates ---------------------------------------------------------------------------

def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z2 / (d - x)) for ascending ``d``: index of the nearest pole, and distance to it.

    Root i lies between d[i] and d[i + 1], the last below d[-1] + rho * sum(z2).  All roots are
    iterated at once by interpolation with the two poles around them, halving where a step leaves the bracket.
    """
    k = d.size
    upper = np.append(np.diff(d), rho * z2.sum())
    gap = d[None, :] - d[:, None]

    def at(delta, eta):
        terms = z2 / (delta - eta[:, None])
        return terms, 1 + rho * terms.sum(1)

    with np.errstate(all="ignore"):
        mid = at(gap, upper / 2)[1]
        right = (mid < 0) & (np.arange(k) < k - 1)      # nearer the pole above
        origin = np.arange(k) + right
        delta = d[None, :] - d[origin][:, None]
        lo = np.where(right, -upper / 2, np.where(mid < 0, upper / 2, 0))
        hi = np.where(right, 0, np.where(mid < 0, upper, upper / 2))
        eta = (lo + hi) / 2
        below = np.tri(k, dtype=bool)                   # poles up to the root's own
        rows, above = np.arange(k), np.minimum(np.arange(k) + 1, k - 1)
        for step in range(120):
            terms, f = at(delta, eta)
            size = 1 + rho * np.abs(terms).sum(1)
            lo, hi = np.where(f < 0, eta, lo), np.where(f < 0, hi, eta)
            done = (np.abs(f) <= 16 * _EPS * size) | (hi - lo <= 2 * _EPS * np.minimum(np.abs(lo), np.abs(hi)))
            if done.all():
                break
            slope = terms * terms / z2
            psi, phi = rho * (slope * below).sum(1), rho * (slope * ~below).sum(1)
            p, q = delta[rows, rows] - eta, delta[rows, above] - eta
            c = f - p * psi - q * phi
            a = (p + q) * f - p * q * (psi + phi)
            b = p * q * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            move = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            move[-1] = p[-1] + psi[-1] * p[-1] ** 2 / (f[-1] - p[-1] * psi[-1])
            new = eta + move
            # zero is a pole: halve towards it by size, so that small distances keep their digits
            half = np.where((lo > 0) & (hi > 4 * lo), np.sqrt(lo * hi),
                            np.where((hi < 0) & (lo < 4 * hi), -np.sqrt(lo * hi), (lo + hi) / 2))
            half = np.where((lo == 0) & (step > 8), hi / 64, np.where((hi == 0) & (step > 8), lo / 64, half))
            eta = np.where(done, eta, np.where((new > lo) & (new < hi) & (step % 8 < 7), new, half))
    return origin, eta


def rank_one(vals: np.ndarray, vecs: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and eigenvectors of vecs diag(vals) vecs' + v v'."""
    z = vecs.T @ v
    rho = float(z @ z)
    if rho == 0 or not np.isfinite(rho):
        return vals, vecs
    z = z / np.sqrt(rho)
    vals, vecs = vals.copy(), vecs.copy()
    tol = 8 * _EPS * max(abs(vals[-1]), rho)
    # equal eigenvalues: turn their vectors so that one of them carries the whole share
    bounds = np.flatnonzero(np.concatenate([[True], np.diff(vals) > tol, [True]]))
    for a, e in zip(bounds[:-1], bounds[1:]):
        if e - a > 1:
            u = z[a:e].copy()
            size = np.sqrt(u @ u)
            sign = 1.0 if u[-1] >= 0 else -1.0
            u[-1] += sign * size
            if size > 0:
                vecs[:, a:e] -= np.outer(vecs[:, a:e] @ u, 2 * u / (u @ u))
                z[a:e] = 0
                z[e - 1] = -sign * size
    active = np.flatnonzero(rho * np.abs(z) > tol)
    d, share = vals[active], z[active]
    origin, eta = secular_roots(d, share * share, rho)
    # d[j] - root[i]; the update vector is rebuilt so that these roots are exact for it
    dist = (d[None, :] - d[origin][:, None]) - eta[:, None]
    gaps = d[None, :] - d[:, None]
    np.fill_diagonal(gaps, 1.0)
    with np.errstate(divide="ignore"):
        fit = np.exp((np.log(np.abs(dist)).sum(0) - np.log(np.abs(gaps)).sum(0)) / 2) * np.sign(share)
        turn = fit[:, None] / dist.T
    bad = ~np.isfinite(turn)
    if bad.any():                                       # a root on its pole: that vector stays
        turn[:, bad.any(0)] = bad[:, bad.any(0)]
    turn /= np.sqrt((turn * turn).sum(0))
    vals[active] = d[origin] + eta
    vecs[:, active] = vecs[:, active] @ turn
    order = np.argsort(vals, kind="stable")
    return vals[order], vecs[:, order]


class Spectrum:
    """Count, mean and eigendecomposition of the scatter of rows."""

    def __init__(self, d: int, n: int = 0, mean=None, vals=None, vecs=None):
        self.n, self.mean = n, np.zeros(d) if mean is None else mean
        self.vals, self.vecs = (np.zeros(d), np.eye(d)) if vals is None else (vals, vecs)

    def _take(self, n: int, mean: np.ndarray, updates: np.ndarray) -> None:
        shift = (mean - self.mean) * np.sqrt(self.n * n / (self.n + n))
        for v in (*updates, shift):
            self.vals, self.vecs = rank_one(self.vals, self.vecs, v)
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n += n

    def add_rows(self, x: np.ndarray) -> None:
        mean = x.mean(0)
        x = x - mean
        self._take(x.shape[0], mean, np.linalg.qr(x, "r") if x.shape[0] > x.shape[1] else x)

    def add(self, other: Spectrum) -> None:
        if other.n:
            self._take(other.n, other.mean, (other.vecs * np.sqrt(np.maximum(other.vals, 0))).T)

    def parts(self) -> list:
        return [self.n, self.mean.tobytes(), self.vals.tobytes(), self.vecs.tobytes()]

    @classmethod
    def of(cls, n: int, mean: bytes, vals: bytes, vecs: bytes) -> Spectrum:
        m = np.frombuffer(mean)
        return cls(m.size, n, m, np.frombuffer(vals), np.frombuffer(vecs).reshape(m.size, m.size))


# --- rows ---------------------------------------------------------------------------------------

def usable(embeddings: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(key, v) of the rows that take part, with the length of their vectors."""
    rows = embeddings.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("v").isNotNull() & F.forall("v", lambda c: F.coalesce(F.abs(c) < _LARGEST, F.lit(False))) & (F.size("v") > 0))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = lengths[0].d if lengths else 0
    return rows.where(F.size("v") == d), d


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer rows of blocks; the vector is the second column."""
    for b in batches:
        for lo in range(0, b.num_rows, BLOCK):
            part = b.slice(lo, BLOCK)
            c = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            yield part.column(0), np.floor(c * SCALE).astype(np.int64) + SHIFT


def _totals(batches, d):
    n, sums = 0, np.zeros(d, np.int64)
    for _, x in _blocks(batches, d):
        n += x.shape[0]
        sums += x.sum(0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, d, dtype=np.int32)), pa.array([n, *sums.tolist()])], ["i", "s"])


_SPECTRUM = "part long, n long, mean binary, vals binary, vecs binary"


def _spectra(batches, d, centre):
    own = Spectrum(d)
    for _, x in _blocks(batches, d):
        own.add_rows((x - centre).astype(float))
    if own.n:
        cols = [[0], *[[v] for v in own.parts()]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["part", "n", "mean", "vals", "vecs"])


def _combine(key, frame):
    frame = frame.sort_values("part")
    merged = None
    for r in frame.itertuples():
        one = Spectrum.of(r.n, r.mean, r.vals, r.vecs)
        if merged is None:
            merged = one
        else:
            merged.add(one)
    return pd.DataFrame([[int(key[0]), *merged.parts()]], columns=["part", "n", "mean", "vals", "vecs"])


def combined(spectra: DataFrame) -> Spectrum | None:
    """One spectrum of the table's: a tree of tasks that combine FAN_IN each."""
    rows = cut_lineage(spectra.withColumn("part", F.monotonically_increasing_id()))
    # one row per task of the first pass: numbered by one small window
    rows = cut_lineage(rows.withColumn("part", F.row_number().over(Window.orderBy("part")).cast("long") - 1))
    while rows.count() > 1:
        rows = cut_lineage(rows.withColumn("up", F.floor(F.col("part") / FAN_IN)).groupBy("up").applyInPandas(_combine, _SPECTRUM))
    last = rows.select("n", "mean", "vals", "vecs").collect()
    return Spectrum.of(*last[0]) if last else None


def _moments(batches, d, n, sums, basis):
    """Sums and products of the rows' coordinates in ``basis``, centred by the exact mean."""
    k = basis.shape[1]
    total = np.zeros((k + 1, k))
    for _, x in _blocks(batches, d):
        y = ((n * x - sums) / n) @ basis
        total[0] += y.sum(0)
        total[1:] += y.T @ y
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["i", "s"])


class Whitening:
    """Exact counts and the components of a fit."""

    def __init__(self, d: int, n: int, sums: np.ndarray, values: np.ndarray, vectors: np.ndarray, trace: float):
        self.d, self.n, self.sums, self.values, self.vectors, self.trace = d, n, sums, values, vectors, trace
        self.identity_error = 0.0

    @property
    def alive(self) -> np.ndarray:
        """Components with variance above rounding."""
        return self.values > 64 * _EPS * max(self.trace, 0.0)

    @property
    def scaled(self) -> np.ndarray:
        return self.vectors / np.sqrt(np.where(self.alive, self.values, 1.0))


def _summed(rows: DataFrame, run, schema: str = "i int, s double") -> dict[int, float]:
    return {r.i: r.s for r in rows.mapInArrow(run, schema).groupBy("i").agg(F.sum("s").alias("s")).collect()}


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """Leading components of ``rows`` (key, v) of length ``d``; None without rows."""
    if d == 0:
        return None
    totals = _summed(rows, lambda b: _totals(b, d), "i int, s long")
    if not totals:
        return None
    n = int(totals[-1])
    sums = np.array([int(totals[i]) for i in range(d)], np.int64)
    centre = np.array([int(totals[i]) // n for i in range(d)], np.int64)
    basis = combined(rows.mapInArrow(lambda b: _spectra(b, d, centre), _SPECTRUM)).vecs[:, ::-1]
    for _ in range(4):
        basis = np.linalg.qr(basis)[0]
        found = _summed(rows, lambda b, q=basis: _moments(b, d, n, sums, q))
        ritz = np.array([found[i] for i in range(d, d + d * d)]).reshape(d, d) / n
        ritz = (ritz + ritz.T) / 2
        values, turn = np.linalg.eigh(ritz)
        values, basis = values[::-1], basis @ turn[:, ::-1]
        if np.abs(ritz - np.diag(np.diag(ritz))).max() <= 1e-12 * max(ritz.trace(), 1e-300):
            break
    k = min(components, d)
    vectors = basis[:, :k] * np.where(basis[np.abs(basis).argmax(0)[:k], np.arange(k)] < 0, -1.0, 1.0)
    out = Whitening(d, n, sums, np.maximum(values[:k], 0), vectors, float(np.trace(ritz)))
    found = _summed(rows, lambda b: _moments(b, d, n, sums, out.scaled))
    whole = np.array([found[i] for i in range(k + k * k)]).reshape(k + 1, k) / n
    error = whole[1:] - np.outer(whole[0], whole[0]) - np.eye(k)
    alive = out.alive
    out.identity_error = float(np.abs(error[np.ix_(alive, alive)]).max()) if alive.any() else 0.0
    return out


_OUT = ("key long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def _deviations(centred: np.ndarray) -> list:
    """Exact sums of squares; null where a long cannot hold one."""
    squares = centred.astype(float) ** 2
    sure = squares.sum(1) < 4e18
    out = np.where(sure[:, None], centred, 0)
    exact = (out * out).sum(1).tolist()
    for i in np.flatnonzero(~sure):
        whole = sum(int(v) ** 2 for v in centred[i])
        exact[i] = whole if whole < 1 << 63 else None
    return exact


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of each row and component."""
    names = [f.split()[0] for f in _OUT.split(", ")]
    schema = pa.schema([("key", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                        *[(name, pa.float64()) for name in names[4:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.values.size
        explained = model.values / model.trace if model.trace > 0 else np.zeros(k)
        for key, x in _blocks(batches, model.d):
            m = x.shape[0]
            centred = model.n * x - model.sums
            white = (centred / model.n) @ model.scaled
            at = np.repeat(np.arange(m), k)
            dead = np.tile(~model.alive, m)
            yield pa.RecordBatch.from_arrays(
                [key.take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, model.n)), pa.array(_deviations(centred), pa.int64()).take(pa.array(at)),
                 pa.array(white.ravel(), mask=dead), pa.array(np.tile(explained, m)),
                 pa.array(np.full(m * k, model.identity_error))], schema=schema)

    return rows.mapInArrow(run, _OUT)


def whitened(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding",
             components: int = COMPONENTS) -> DataFrame:
    """Whitened leading components of all usable rows, fitted to all of them."""
    rows, d = usable(embeddings, key, vector)
    model = fit(rows, d, components)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], _OUT)
    return whiten(rows, model)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened leading components of every embedding."""
    return whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).withColumnRenamed("key", "vec_id")


QUERIES = {"op12_whitening": op12_whitening}
