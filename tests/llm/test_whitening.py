import math

import numpy as np
import pytest
from pyspark.sql import types as T

from driftline.llm import whitening

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


def plain(rows, k=8):
    """{(id, component): (n, deviation, |whitened|, explained)} with whole integers and a dense solver."""
    kept = [(i, np.float32(v).astype(float)) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([np.floor(1024 * v).astype(int) + 100000 for _, v in kept])
    n, s = len(x), x.sum(0)
    centred = n * x - s
    values, vectors = np.linalg.eigh((centred / n).T @ (centred / n) / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    total = ((centred / n) ** 2).sum() / n
    dev = [sum(int(c) ** 2 for c in row) for row in centred]
    white = np.abs((centred / n) @ vectors) / np.sqrt(np.where(values > 1e-9, values, np.nan))
    return [(kept[r][0], c + 1, n, dev[r], white[r, c], values[c] / total) for r in range(n) for c in range(len(values))]


def rows_of(seed, n, d, scale=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * (1 if scale is None else scale)
    return [(i, v.tolist()) for i, v in enumerate(x)]


def compare(out, want):
    got = sorted(out.collect(), key=lambda r: (r.key is None, r.key, r.component, r.deviation, abs(r.whitened or 0)))
    want = sorted(want, key=lambda r: (r[0] is None, r[0], r[1], r[3], r[4]))
    assert [(r.key, r.component, r.n, r.deviation) for r in got] == [r[:4] for r in want]
    assert np.allclose([abs(r.whitened) if r.whitened is not None else np.nan for r in got], [r[4] for r in want],
                       rtol=1e-7, atol=1e-8, equal_nan=True)
    assert np.allclose([r.explained for r in got], [r[5] for r in want], rtol=1e-9, atol=1e-12)
    assert len({r.identity_error for r in got}) <= 1 and all(r.identity_error < 1e-8 for r in got)


@pytest.mark.parametrize("parts", [1, 5, 23])
def test_equals_a_dense_solver(spark, parts):
    rows = rows_of(1, 700, 12)
    compare(whitening.whitened(frame(spark, rows).repartition(parts)), plain(rows))


def test_small_and_flat_vectors(spark):
    rows = rows_of(2, 40, 3)
    compare(whitening.whitened(frame(spark, rows)), plain(rows))
    flat = [(i, [0.5, v[0], v[0] * 0 + 1.0]) for i, v in rows_of(3, 30, 2)]          # one direction alone
    compare(whitening.whitened(frame(spark, flat)), plain(flat))
    out = whitening.whitened(frame(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.identity_error) for r in out] == [(1, 1, 0, None, 0.0), (2, 1, 0, None, 0.0)]


def test_common_vectors_and_equal_eigenvalues(spark):
    rows = rows_of(4, 60, 6)
    rows += [(100 + i, rows[0][1]) for i in range(400)] + [(7, rows[3][1])]
    compare(whitening.whitened(frame(spark, rows).repartition(9)), plain(rows))
    cross = [(i, [float(v) for v in (np.eye(5) * s)[i % 5]]) for s in (1, -1) for i in range(10)]
    out = whitening.whitened(frame(spark, cross)).toPandas()
    wide = out.pivot_table(index=["key", "deviation"], columns="component", values="whitened", aggfunc="sum")
    assert wide.shape[1] == 5 and out.identity_error.max() < 1e-9


def test_odd_rows_take_no_part(spark):
    good = rows_of(5, 50, 4)
    odd = [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0]), (203, [1.0, float("nan"), 0.0, 0.0]),
           (204, [float("inf"), 0.0, 0.0, 0.0]), (205, [1.0, 2.0]), (206, [1e30, 0.0, 0.0, 0.0])]
    null_id = [(None, good[3][1])]
    df = frame(spark, good + odd + null_id)
    compare(whitening.whitened(df), plain(good + null_id))
    compare(whitening.whitened(df.selectExpr("*", "1 AS key", "2 AS v", "3 AS n", "4 AS component")), plain(good + null_id))
    empty = whitening.whitened(frame(spark, []))
    assert empty.count() == 0 and empty.columns == whitening.whitened(df).columns


@pytest.mark.parametrize("case", range(8))
def test_rank_one_updates(case):
    rng = np.random.default_rng(case)
    d = [1, 2, 5, 16, 16, 33, 8, 8][case]
    x = rng.normal(size=(60, d))
    if case == 4:
        x = np.repeat(x[:3], 20, 0)
    elif case == 6:
        x *= np.logspace(0, -9, d)
    elif case == 7:
        x = rng.integers(0, 2, size=x.shape).astype(float)
    halves = [whitening.Spectrum(d), whitening.Spectrum(d)]
    for i in range(0, 60, 7):
        halves[i % 2].add_rows(x[i:i + 7])
    one = halves[0]
    one.add(halves[1])
    c = x - x.mean(0)
    scale = max(np.abs(c.T @ c).max(), 1e-300)
    assert one.n == 60 and np.allclose(one.mean, x.mean(0))
    assert np.abs(one.vecs * one.vals @ one.vecs.T - c.T @ c).max() < 1e-12 * scale * d
    assert np.abs(one.vecs.T @ one.vecs - np.eye(d)).max() < 1e-12


def test_secular_roots_keep_small_distances():
    d, z2 = np.array([1.0, 1.0 + 1e-9, 2.0]), np.array([0.5, 1e-18, 0.5])
    origin, eta = whitening.secular_roots(d, z2, 1.0)
    for o, e in zip(origin, eta):
        terms = z2 / ((d - d[o]) - e)
        assert abs(1 + terms.sum()) < 1e-10 * (1 + np.abs(terms).sum())


def test_deviations_beyond_a_long():
    big = np.array([[3_000_000_000, 1], [4_000_000_000, 0], [5, 2]])
    assert whitening._deviations(big) == [9 * 10**18 + 1, None, 29]
