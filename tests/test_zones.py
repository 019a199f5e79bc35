"""Zonal statistics against point-in-polygon brute force."""

import numpy as np
import pytest

from driftline.operators import zonal
from driftline.sources.grid import Extent, edges_from_vertices, long_cells


def inside(rings, x, y):
    hits = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                hits += 1
    return hits % 2 == 1


def test_zonal_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    extent = Extent(-20.0, 20.0, -10.0, 10.0, 37, 301)
    values = rng.normal(size=(extent.nrow, extent.ncol))
    wide = spark.createDataFrame(
        [(i, [None if abs(v) < 0.1 else float(v) for v in row]) for i, row in enumerate(values)],
        "r long, v array<double>")
    zones = {}
    for p in range(5):
        parts = []
        for _ in range(3):        # star shapes around nearby centres, so parts overlap
            angle = np.sort(rng.uniform(0, 2 * np.pi, 9))
            reach = rng.uniform(1, 6, 9)
            cx, cy = rng.uniform(-15, 15), rng.uniform(-8, 8)
            parts.append([list(zip((cx + reach * np.cos(angle)).tolist(),
                                   (cy + reach * np.sin(angle)).tolist()))])
        zones[f"P{p}"] = parts
    square = [(-5.0, -5.0), (5.0, -5.0), (5.0, 5.0), (-5.0, 5.0)]
    hole = [(-2.0, -2.0), (-2.0, 2.0), (2.0, 2.0), (2.0, -2.0)]
    zones["HOLE"] = [[square, hole]]
    zones["NONE"] = [[[(100.0, 0.0), (101.0, 0.0), (101.0, 1.0)]]]
    rows = [(code, part, r, s, float(x), float(y)) for code, parts in zones.items()
            for part, rings in enumerate(parts) for r, ring in enumerate(rings)
            for s, (x, y) in enumerate(ring)]
    vertices = spark.createDataFrame(
        rows, "prov_code string, part int, ring int, seq int, lon double, lat double")
    edges = edges_from_vertices(vertices)
    assert edges.count() == len(rows)
    got = {r["prov_code"]: r for r in zonal.zonal_stats(
        long_cells(wide, "r", "v", extent), edges, extent).collect()}
    for code, parts in zones.items():
        found = [(i, j) for i in range(extent.nrow) for j in range(extent.ncol)
                 if any(inside(rings, extent.xmin + (j + .5) * extent.dx,
                               extent.ymax - (i + .5) * extent.dy) for rings in parts)]
        assert got[code]["n_cells"] == len(found), code
        known = [values[i, j] for i, j in found if abs(values[i, j]) >= 0.1]
        if known:
            assert got[code]["mean_value"] == pytest.approx(np.mean(known))
            assert got[code]["min_value"] == min(known)
        else:
            assert got[code]["mean_value"] is None


def test_tall_grid_is_cut_by_columns(spark):
    """Runs depend on the columns a part spans, not on the rows, and merge over the parts."""
    rng = np.random.default_rng(5)
    extent = Extent(-10.0, 10.0, -10.0, 10.0, 640, 8)
    wide = spark.createDataFrame([(i, [float(i * 8 + j) for j in range(8)]) for i in range(640)], "r long, v array<double>")
    parts = []
    for k in range(24):       # corners on edges and centres of columns, level, upright and slanting edges
        x, y = (rng.integers(-8, 4, 2) * 1.25).tolist()
        parts.append([(x, y), (x + 5.0, y), (x + 5.0, y + 2.5), (x + 2.5, y + 2.5), (x + 1.25, y + 6.25), (x, y + 5.0)])
    vertices = spark.createDataFrame(
        [("AB"[p % 2], p, 0, s, float(x), float(y)) for p, ring in enumerate(parts) for s, (x, y) in enumerate(ring)],
        "prov_code string, part int, ring int, seq int, lon double, lat double")
    edges = edges_from_vertices(vertices)
    assert zonal.inside_runs(edges, extent).count() < 2 * 8 * 12
    got = {r["prov_code"]: r for r in zonal.zonal_stats(long_cells(wide, "r", "v", extent), edges, extent).collect()}
    for code in "AB":
        found = [i * 8 + j for i in range(extent.nrow) for j in range(extent.ncol)
                 if any(inside([ring], extent.xmin + (j + .5) * extent.dx, extent.ymax - (i + .5) * extent.dy)
                        for p, ring in enumerate(parts) if "AB"[p % 2] == code)]
        assert got[code]["n_cells"] == len(found)
        assert got[code]["mean_value"] == pytest.approx(np.mean(found))
        assert (got[code]["min_value"], got[code]["max_value"]) == (min(found), max(found))
