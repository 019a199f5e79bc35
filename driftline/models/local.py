"""Local regression with its error band, from sums over the cluster.

The smoother is a linear operator on the rows.  At each of G grid points a locally weighted
quadratic is fitted; between grid points the fit is the straight line.  So the operator is L = B K with
B (rows x G) the shares of the two grid points around a row's x, and K (G x rows) the grid
points' weights for the rows.  With A = B'B, C = KK' and D = KB, all G x G,

    tr L = tr D,   delta1 = tr((I - L)(I - L)') = n - 2 tr D + tr AC,
    delta2 = tr(((I - L)(I - L)')^2) = n - 4 tr D + 4 tr AC + 2 tr DD - 4 tr ADC + tr ACAC,

and the residual variance is the weighted sum of squares over delta1, with delta1^2 / delta2 degrees of
freedom.  No matrix with a side of the number of rows is formed, rows meet the grid inside the
tasks, and a task passes on a few vectors per group, which are added up in a tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.models.linear import _design
from driftline.models.special import t_critical
from driftline.session import cut_lineage, drop_tables

#: Bins of a round of the bandwidth search; vectors that one task adds up.
BINS, FAN_IN = 256, 64
#: Groups are panels of a figure.
MOST_GROUPS = 4096

Cells = dict[int, np.ndarray]


def _summed(cells: DataFrame, part: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """Sum over the cells of ``part(group, cells)``, a vector per group; cells are rows (x, n, w, w2, wy, wyy)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Cells = {}
        for b in batches:
            gid = b.column(0).to_numpy()
            table = np.stack([b.column(i).to_numpy().astype(float) for i in range(1, 7)])
            for g in np.unique(gid):
                more = part(int(g), table[:, gid == g])
                held[int(g)] = held[int(g)] + more if int(g) in held else more
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()])],
                                             ["gid", "v"])

    def add(key, table):
        total = sum(np.frombuffer(v.as_py()) for v in table.column("v"))
        return pa.table({"gid": pa.array([key[0].as_py()], pa.int32()), "v": [total.tobytes()]})

    parts = cells.mapInArrow(run, "gid int, v binary").withColumn("task", F.spark_partition_id() % FAN_IN)
    some = parts.groupBy("gid", "task").applyInArrow(add, "gid int, v binary")
    return {r.gid: np.frombuffer(r.v) for r in some.groupBy("gid").applyInArrow(add, "gid int, v binary").collect()}


def _bandwidths(cells: DataFrame, grid: Cells, wanted: dict[int, int]) -> Cells:
    """Distance from each grid point to its ``wanted``-th nearest row, by ever finer bins.

    A bin of one distance ends the search; distances that differ by less than about 1e-9 of the
    first bin's width count as one.
    """
    lo = {g: np.zeros(x.size) for g, x in grid.items()}
    hi = {g: np.full(x.size, np.nextafter(x[-1] - x[0], np.inf)) for g, x in grid.items()}
    below = {g: np.zeros(x.size) for g, x in grid.items()}
    out = {g: np.full(x.size, np.nan) for g, x in grid.items()}
    while any(np.isnan(h).any() for h in out.values()):
        def part(g: int, c: np.ndarray) -> np.ndarray:
            found = np.zeros((grid[g].size, BINS, 4))
            for i in np.flatnonzero(np.isnan(out[g])):
                d = np.abs(c[0] - grid[g][i])
                inside = (d >= lo[g][i]) & (d < hi[g][i])
                d, n = d[inside], c[1][inside]
                edges = np.linspace(lo[g][i], hi[g][i], BINS + 1)
                at = np.searchsorted(edges, d, "right") - 1
                off = d - edges[at]
                for k, weight in enumerate((n, np.ones_like(d), off, off * off)):
                    found[i, :, k] = np.bincount(at, weight, BINS)
            return found.ravel()
        for g, v in _summed(cells, part).items():
            v = v.reshape(grid[g].size, BINS, 4)
            for i in np.flatnonzero(np.isnan(out[g])):
                upto = below[g][i] + np.cumsum(v[i, :, 0])
                at = int(np.searchsorted(upto, wanted[g]))
                _, many, off, square = v[i, at]
                edges = np.linspace(lo[g][i], hi[g][i], BINS + 1)
                if square - off * off / many <= 1e-14 * square or edges[at + 1] <= np.nextafter(edges[at], np.inf):
                    out[g][i] = edges[at] + off / many
                below[g][i] = upto[at] - v[i, at, 0]
                lo[g][i], hi[g][i] = edges[at], edges[at + 1]
    return out


def _kernel(x: np.ndarray, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tricube weights and scaled distances of ``x`` at each grid point; a width of 0 takes ties only."""
    d = x[None, :] - at[:, None]
    wide = np.where(h > 0, h, 1.0)[:, None]
    u = np.where(h[:, None] > 0, d / wide, 0.0)
    near = (np.abs(d) < h[:, None]) | (d == 0)
    return np.where(near, (1 - np.minimum(np.abs(u), 1) ** 3) ** 3, 0.0), u


def _shares(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Share of each grid point in the straight line at ``x``: (G, cells)."""
    step = (at[-1] - at[0]) / (at.size - 1)
    out = np.zeros((at.size, x.size))
    if step == 0:
        out[0] = 1
        return out
    place = np.clip((x - at[0]) / step, 0, at.size - 1)
    i = np.minimum(place.astype(int), at.size - 2)
    out[i, np.arange(x.size)] = 1 - (place - i)
    out[i + 1, np.arange(x.size)] = place - i
    return out


def local_regression(df: DataFrame, y: Column, x: Column, by: Sequence[str] = (), weight: Column | None = None,
                     span: float = 0.75, points: int = 80, level: float = 0.95) -> DataFrame:
    """Locally weighted quadratic regression on an even grid over the x range, with its error band.

    The bandwidth of a grid point is the exact distance to its ``span * n``-th nearest row;
    tricube weights times the case weights give the fit, and where that distance is 0 the fit is
    the weighted mean of the rows tied there.  Result: ``by``, x, fit, std_error, lower, upper, sigma,
    df.  Rows with a missing value or weight 0 drop out.  The band is null where no freedom is left.
    """
    rows = _design(df, by, y, {"x": x}, weight, {})
    cells = cut_lineage(rows.groupBy(*by, "_x0").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_w"), F.sum(F.col("_w") * F.col("_w")).alias("_w2"),
        F.sum(F.col("_w") * F.col("_y")).alias("_wy"), F.sum(F.col("_w") * F.col("_y") * F.col("_y")).alias("_wyy")))
    ranges = cells.groupBy(*by).agg(F.min("_x0").alias("_lo"), F.max("_x0").alias("_hi"), F.sum("_n").alias("_rows"))
    ranges = ranges.where("_rows > 0").limit(MOST_GROUPS + 1).collect()
    if len(ranges) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    schema = T.StructType([cells.schema[b] for b in by] + [
        T.StructField(c, T.DoubleType()) for c in ("x", "fit", "std_error", "lower", "upper", "sigma", "df")])
    spark = df.sparkSession
    if not ranges:
        return spark.createDataFrame([], schema)
    keys = spark.createDataFrame([(i, *[r[b] for b in by]) for i, r in enumerate(ranges)],
                                 T.StructType([T.StructField("gid", T.IntegerType()), *[
                                     T.StructField(f"_k_{b}", cells.schema[b].dataType) for b in by]]))
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_k_{b}"))
    named = cut_lineage(cells.join(F.broadcast(keys), same).select("gid", "_x0", "_n", "_w", "_w2", "_wy", "_wyy"))
    drop_tables(cells)

    grid = {i: np.linspace(r["_lo"], r["_hi"], points) for i, r in enumerate(ranges)}
    n = {i: int(r["_rows"]) for i, r in enumerate(ranges)}
    h = _bandwidths(named, grid, {i: max(1, int(np.floor(n[i] * span + 1e-5))) for i in grid})

    def moments(g: int, c: np.ndarray) -> np.ndarray:
        k, u = _kernel(c[0], grid[g], h[g])
        powers = np.stack([u ** j for j in range(5)])
        return np.concatenate([(powers * k * c[2]).sum(2), (powers[:3] * k * c[4]).sum(2)]).ravel()
    first, fit = {}, {}
    for g, v in _summed(named, moments).items():
        s, t = v.reshape(8, points)[:5], v.reshape(8, points)[5:]
        normal = np.stack([np.stack([s[i + j] for j in range(3)], 1) for i in range(3)], 1)
        first[g] = np.linalg.pinv(normal, rcond=1e-10, hermitian=True)[:, 0]
        fit[g] = np.einsum("gi,ig->g", first[g], t)

    def traces(g: int, c: np.ndarray) -> np.ndarray:
        total = np.zeros(3 * points * points + points + 1)
        for lo in range(0, c.shape[1], 4096):
            x, m, w, w2, wy, wyy = c[:, lo:lo + 4096]
            k, u = _kernel(x, grid[g], h[g])
            each = k * (first[g][:, :1] + first[g][:, 1:2] * u + first[g][:, 2:] * u * u)
            b = _shares(x, grid[g])
            line, mean = fit[g] @ b, wy / w
            total += np.concatenate([((b * m) @ b.T).ravel(), ((each * w2) @ each.T).ravel(), ((each * w) @ b.T).ravel(),
                                     (each * each * w).sum(1), [np.maximum(wyy - wy * mean, 0).sum() + (w * (mean - line) ** 2).sum()]])
        return total
    out = []
    for g, v in _summed(named, traces).items():
        a, c, d = v[:3 * points * points].reshape(3, points, points)
        norms, squares = v[-points - 1:-1], v[-1]
        ac = a @ c
        one = n[g] - 2 * np.trace(d) + np.trace(ac)
        two = (n[g] - 4 * np.trace(d) + 4 * np.trace(ac) + 2 * np.trace(d @ d) - 4 * np.trace(a @ d @ c) + np.trace(ac @ ac))
        free = one > 1e-8 * n[g] and two > 0
        sigma = float(np.sqrt(squares / one)) if free else None
        freedom = float(one * one / two) if free else None
        for i in range(points):
            error = sigma * float(np.sqrt(norms[i])) if free else None
            half = t_critical(level, freedom) * error if free else None
            value = float(fit[g][i])
            out.append((*[ranges[g][b] for b in by], float(grid[g][i]), value, error,
                        value - half if free else None, value + half if free else None, sigma, freedom))
    drop_tables(named)
    return spark.createDataFrame(out, schema)
