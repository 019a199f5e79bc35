"""Quantiles, ranks and curves against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import ranking, reshape, summarise


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v), int(w)) for v, w in zip(rng.normal(size=3000).round(2),
                                                      rng.integers(0, 5, 3000))]
    rows += [(None, float(v), 1) for v in rng.exponential(size=40)]
    rows += [("one", 7.0, 2), ("hot", None, 3)]
    return rows, spark.createDataFrame(rows, "g string, x double, w int")


PROBS = [0.0, 0.025, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("weighted", [False, True])
def test_quantiles(values, weighted):
    rows, df = values
    got = {r["g"]: r["quantiles"] for r in ranking.quantiles(
        df, ["g"], "x", PROBS, "w" if weighted else None).collect()}
    for g in ("hot", None, "one"):
        x = [v for k, v, w in rows if k == g and v is not None
             for _ in range(w if weighted else 1)]
        assert got[g] == pytest.approx(np.quantile(x, PROBS).tolist(), abs=1e-12)


def test_quantiles_without_group(values):
    rows, df = values
    x = [v for _, v, _ in rows if v is not None]
    got = ranking.quantiles(df, [], "x", [0.3]).first()["quantiles"][0]
    assert got == pytest.approx(np.quantile(x, 0.3))


def test_kth_smallest(values):
    rows, df = values
    df = df.filter("x is not null and w > 0").withColumn("k", F.lit(25))
    got = {r["g"]: r["value"] for r in
           ranking.kth_smallest(df, ["g"], "x", "k", "w").collect()}
    for g in ("hot", None):
        x = sorted(v for k, v, w in rows if k == g and v is not None for _ in range(w))
        assert got[g] == x[24]


def test_box_of_weights_equals_box_of_repeats(values):
    _, df = values
    df = df.filter("g is not null")
    a = ranking.box_stats(df, ["g"], "x", weight="w").orderBy("g").collect()
    b = ranking.box_stats(reshape.repeat_rows(df, "w"), ["g"], "x").orderBy("g").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_global_rank_and_positions(values):
    _, df = values
    rows = ranking.global_rank(df.select("x", "w"), ["x", "w"]).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(len(rows)))
    keys = [(r["x"] is not None, r["x"] or 0.0, r["w"]) for r in rows]
    assert keys == sorted(keys)
    pos = ranking.rank_within(df.select("g", "x", "w"), ["g"], ["x", "w"]).collect()
    for g in ("hot", None, "one"):
        mine = sorted(r["position"] for r in pos if r["g"] == g)
        assert mine == list(range(1, len(mine) + 1))


def test_accumulation_is_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(y) if y < 9 else None, f"s{s}" if s else None, int(n) if n else None)
            for y, s, n in zip(rng.integers(0, 10, 200), rng.integers(0, 30, 200),
                               rng.integers(0, 9, 200))]
    df = spark.createDataFrame(rows, "publication_year int, binomial string, N long")
    got = reshape.accumulation(df).collect()
    years = sorted({y for y, _, _ in rows if y is not None}) + [None]
    seen, total = set(), 0
    by_year = {r["publication_year"]: r for r in got}
    for y in years:
        seen |= {s for k, s, _ in rows if k == y}
        total += sum(n or 0 for k, _, n in rows if k == y)
        assert (by_year[y]["cum_species"], by_year[y]["cum_n"]) == (len(seen), total)


def test_histogram_is_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.5, 1.0, 1.5, 2.0, 9.0)], "v double")
    got = {r["bin"]: r["n"] for r in summarise.histogram(df, "v", 1.0, 0.0, 2.0).collect()}
    assert got == {1: 3, 2: 2}


def test_repeat_drops_zero_and_null(spark):
    df = spark.createDataFrame([("a", 2), ("b", 0), ("c", None)], "k string, n long")
    assert [r["k"] for r in reshape.repeat_rows(df, "n").collect()] == ["a", "a"]


def test_to_long_takes_a_column_range(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "id int, a int, b int, c int")
    got = reshape.to_long(df, ["id"], "a", "b", "k", "v").orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "a", 2), (1, "b", 3)]
