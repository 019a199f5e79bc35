"""Approximate nearest neighbours by cosine: robust-pruned directed graphs, one per shard.

Equal vectors are one point; it keeps the smallest ids that bear it, as many as are asked for.
Points are dealt to shards of bounded size by hash.  In each shard points join the graph in
batches: a greedy beam search from the medoid proposes neighbours, and relaxed distance pruning
keeps a diverse few.  All queries search every shard's graph with a beam, and each query's best of
all shards are merged.  Distances are those of unit vectors in double precision; the score is
computed anew from the original components.

Defined cases: a vector that is null, all zero, or holds null or non-finite components takes no
part, and neither does one of another length than most; a null id neither asks nor answers;
repeated rows count once; fewer candidates than asked for are all returned; ties go to the
smaller id; an empty table gives no rows; only vec_id and embedding are read, other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.llm.common import table
from driftline.session import cut_lineage

#: Points in a shard, out-degree, beam widths of building and searching, pruning slack.
SHARD_POINTS, DEGREE, BUILD_BEAM, BEAM, SLACK, BATCH = 4096, 28, 56, 72, 1.2, 128
#: Query vectors that meet one shard in one task.
QUERY_BLOCK = 4096


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with v as array of doubles, for the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (vectors.select(F.col("vec_id").cast("long"), v.alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(~bad)
            .where(F.exists("v", lambda x: x != 0)).distinct())
    widths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (widths[0]["d"] if widths else 0))


def beam_search(x: np.ndarray, links: np.ndarray, start: int, q: np.ndarray, width: int,
                visited: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities of the ``width`` best points found for each row of ``q``, best first.

    Rows of ``links`` are padded with -1.  Every expanded point is noted in ``visited``.
    """
    m, n = q.shape[0], x.shape[0]
    ids = np.full((m, width), n, np.int64)
    sims = np.full((m, width), -np.inf)
    done = np.ones((m, width), bool)
    ids[:, 0], sims[:, 0], done[:, 0] = start, q @ x[start], False
    rows = np.arange(m)
    while True:
        open_ = np.where(done, -np.inf, sims)
        at = open_.argmax(1)
        live = open_[rows, at] > -np.inf
        if not live.any():
            return ids, sims
        r = rows[live]
        done[r, at[live]] = True
        here = ids[r, at[live]]
        if visited is not None:
            visited.append((r, here, sims[r, at[live]]))
        near = links[here]
        safe = np.where(near < 0, 0, near)
        s = np.einsum("rkd,rd->rk", x[safe], q[r])
        s[near < 0] = -np.inf
        known = (near[:, :, None] == ids[r][:, None, :]).any(2)
        s[known] = -np.inf
        all_ids = np.concatenate([ids[r], np.where(near < 0, n, near)], 1)
        all_sims = np.concatenate([sims[r], s], 1)
        all_done = np.concatenate([done[r], np.zeros(s.shape, bool) | ~np.isfinite(s)], 1)
        top = np.argsort(-all_sims, 1, kind="stable")[:, :width]
        ids[r] = np.take_along_axis(all_ids, top, 1)
        sims[r] = np.take_along_axis(all_sims, top, 1)
        done[r] = np.take_along_axis(all_done, top, 1)


def robust_prune(x: np.ndarray, p: int, pool: np.ndarray, degree: int, slack: float) -> np.ndarray:
    """Nearest first; a kept neighbour removes those to which it is nearer than p by the slack."""
    pool = pool[pool != p]
    if pool.size == 0:
        return pool
    dist = 1 - x[pool] @ x[p]
    order = np.lexsort((pool, dist))
    pool, dist = pool[order], dist[order]
    between = 1 - x[pool] @ x[pool].T
    alive, kept = np.ones(pool.size, bool), []
    for i in range(pool.size):
        if alive[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            alive &= slack * between[i] > dist
    return pool[kept]


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, slack: float = SLACK,
          seed: int = 5) -> tuple[np.ndarray, int]:
    """Directed graph over unit vectors ``x``: out-links (padded with -1) and the entry point."""
    n = x.shape[0]
    links = np.full((n, degree), -1, np.int64)
    fill = np.zeros(n, np.int64)
    start = int((x @ x.mean(0)).argmax())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at = 1
    while at < n:
        batch = order[at:at + min(BATCH, max(1, at))]
        seen: list = []
        beam_search(x, links, start, x[batch], beam, seen)
        r, ids = np.concatenate([s[0] for s in seen]), np.concatenate([s[1] for s in seen])
        by = np.argsort(r, kind="stable")
        pools = np.split(ids[by], np.searchsorted(r[by], np.arange(1, batch.size)))
        mates = np.argsort(-(x[batch] @ x[batch].T), 1)[:, :9]       # points of one batch see each other
        back: dict[int, list[int]] = {}
        for k, p in enumerate(batch):
            mine = robust_prune(x, p, np.unique(np.concatenate([pools[k], batch[mates[k]]])), degree, slack)
            links[p, :mine.size], links[p, mine.size:], fill[p] = mine, -1, mine.size
            for other in mine:
                back.setdefault(int(other), []).append(int(p))
        for p, extra in back.items():
            new = np.setdiff1d(extra, links[p, :fill[p]])
            if fill[p] + new.size <= degree:
                links[p, fill[p]:fill[p] + new.size] = new
                fill[p] += new.size
            else:
                mine = robust_prune(x, p, np.concatenate([links[p, :fill[p]], new]), degree, slack)
                links[p, :mine.size], links[p, mine.size:], fill[p] = mine, -1, mine.size
        at += batch.size
    return links, start


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(flat).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)                          # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def search(vectors: DataFrame, queries: DataFrame, k: int, shard_points: int = SHARD_POINTS,
           beam: int = BEAM) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` found for each row of ``queries`` (both vec_id, v).

    Returns query_id, rank, vec_id, score.  A row is never its own neighbour.
    """
    spark = vectors.sparkSession
    # A hot vector's ids meet in two steps, so that no task holds all of them.
    key = F.xxhash64("v")
    salted = W.partitionBy("h", "v", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    points = (vectors.withColumn("h", key).withColumn("_r", F.row_number().over(salted))
              .where(F.col("_r") <= k + 1).drop("_r"))
    points = (points.withColumn("_r", F.row_number().over(W.partitionBy("h", "v").orderBy("vec_id")))
              .where(F.col("_r") <= k + 1).groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    points = cut_lineage(points)
    n = points.count()
    shards = max(1, -(-n // shard_points))
    asks = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    blocks = max(1, -(-asks.count() // QUERY_BLOCK))
    asks = asks.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    shard = F.pmod(F.shiftright("h", 7), F.lit(shards)).cast("long")

    def indexed(t: pa.Table) -> pa.Table:
        x = _unit(_matrix(t["v"]))
        links, start = build(x)
        out = t.select(["shard", "h", "v", "ids"])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, links.size + 1, links.shape[1], dtype=np.int32)),
                                         pa.array(links.ravel()))
        return out.append_column("links", lists).append_column("entry", pa.array(np.arange(len(t)) == start))

    graph = (points.withColumn("shard", shard).groupBy("shard").applyInArrow(
        indexed, "shard long, h long, v array<double>, ids array<long>, links array<long>, entry boolean"))
    graph = cut_lineage(graph)
    # Every block of queries meets every shard: the stated query set against all rows, in blocks.
    sent = asks.crossJoin(spark.range(shards).select(F.col("id").alias("shard")))

    def searched(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            v = _matrix(right["v"])
            x, links = _unit(v), _matrix(right["links"])
            start = int(np.flatnonzero(right["entry"].to_numpy())[0])
            ids, asked, qv = right["ids"].to_pylist(), left["query_id"].to_pylist(), _matrix(left["q"])
            length = np.sqrt((v * v).sum(1))
            for lo in range(0, len(asked), 256):
                q = qv[lo:lo + 256]
                found, sims = beam_search(x, links, start, _unit(q), beam)
                for row in range(q.shape[0]):
                    got = found[row][np.isfinite(sims[row])]
                    exact = (v[got] @ q[row]) / (length[got] * np.sqrt((q[row] * q[row]).sum()))
                    best = [(-s, i) for s, p in zip(exact.tolist(), got) for i in ids[p] if i != asked[lo + row]]
                    for s, i in sorted(best)[:k]:
                        out["query_id"].append(asked[lo + row])
                        out["vec_id"].append(i)
                        out["score"].append(-s)
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()),
                         "score": pa.array(out["score"], pa.float64())})

    # The graph of a shard is repeated for each block of queries; a block is 8 % of a shard's rows at most
    # of what one task holds.
    copies = graph.crossJoin(spark.range(blocks).select(F.col("id").alias("block")))
    found = (sent.groupBy("shard", "block").cogroup(copies.groupBy("shard", "block"))
             .applyInArrow(searched, "query_id long, vec_id long, score double"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    rows = cut_lineage(usable(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))
    return search(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


QUERIES = {"op9_graph": op9_graph}
