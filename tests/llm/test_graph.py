import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import graph
from driftline.session import cut_lineage


def nearest(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    norm = np.sqrt((x * x).sum(1))
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = (x @ x[q]) / (norm * norm[q])
        best = sorted((-round(c, 12), i) for c, i in zip(s.tolist(), ids.tolist()) if i != ids[q])[:k]
        out[int(ids[q])] = best
    return out


def found(spark, rows, shard_points, schema="vec_id long, embedding array<float>, label int"):
    df = spark.createDataFrame([(*r, 0) for r in rows], schema).withColumn("v", F.lit(1)).withColumn("h", F.lit(2))
    usable = cut_lineage(graph.usable(df))
    got = {}
    for r in graph.search(usable, usable.where("vec_id % 50 = 0"), 5, shard_points).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-round(r.score, 12), r.vec_id))
        assert r.rank == len(got[r.query_id])
    return got


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 1500)] + 0.6 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[200:700] = (x[3] + 1e-3 * rng.normal(size=(500, 16))).astype(np.float32)     # a third nearly alike
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want, got = nearest(rows, 5), found(spark, rows, 400)
    hits = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    for q in want:
        assert [s for s, _ in got[q]] == sorted(s for s, _ in got[q])


def test_odd_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (1, [3.0, 0.1])] + [(100 + i, [5.0, 5.0]) for i in range(30)]
    odd = [(2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, None]), (6, [inf, 1.0]), (7, [1.0]), (8, []), (None, [1.0, 1.0]),
           (1, [3.0, 0.1])]
    # a score may differ in its last place from that of another order of summation
    want, got = nearest(rows, 5), found(spark, rows + odd, 4096)
    assert got == want
    assert [i for _, i in got[100]] == [101, 102, 103, 104, 105]


def test_few_and_none(spark):
    assert found(spark, [], 10) == {}
    assert found(spark, [(0, [1.0, 2.0])], 10) == {}
    assert [i for _, i in found(spark, [(0, [1.0, 2.0]), (7, [2.0, 1.0])], 10)[0]] == [7]


@pytest.mark.parametrize("n", [1, 2, 40, 300])
def test_graph_is_bounded_and_reaches_all(n):
    x = graph._unit(np.random.default_rng(n).normal(size=(n, 8)))
    links, start = graph.build(x)
    assert links.shape == (n, graph.DEGREE)
    seen, todo = {start}, [start]
    while todo:
        for k in links[todo.pop()]:
            if k >= 0 and int(k) not in seen:
                seen.add(int(k))
                todo.append(int(k))
    assert len(seen) >= 0.99 * n
    ids, sims = graph.beam_search(x, links, start, x[:5], graph.BEAM)
    assert all(ids[i, 0] == i for i in range(min(5, n)))
