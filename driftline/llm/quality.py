"""Quality classifier: Bradley-Terry utilities learned from preference pairs.

A document's features come from its text alone.  All labelled rows teach: they are dealt to
small blocks, in which each row of label 1 is preferred to each of label 0, and the weights minimise the
logistic loss on feature differences in passes that keep only sums.  A row is accepted from the utility quantile on that the labels' base
rate names, and the score is a logistic curve through that threshold at ``ACCEPT``.

Defined cases: null and empty texts have the features of no text; a null id is scored and never
taught; repeated rows are scored alike; without labels of both kinds every score is 0.5; a score equal to the
threshold is accepted; a very long text is judged whole; an empty table gives no rows; other columns are carried along,
one named like the score is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import byte_chunks, held_out, table, training_rows
from driftline.session import cut_lineage, drop_tables

#: Rows of a label in a block of pairs, Newton steps at most, penalty of the weights, score from which a row is accepted.
DEAL, ROUNDS, RIDGE, ACCEPT = 16, 30, 1e-3, 0.7

# Classes of bytes: letters, digits, spaces, line ends, sentence marks, other marks, non-ASCII.
_KIND = np.full(256, 6, np.uint8)
_KIND[128:] = 5
_KIND[[*range(65, 91), *range(97, 123)]] = 0
_KIND[48:58] = 1
_KIND[[32, 9, 11, 12]] = 2
_KIND[[10, 13]] = 3
_KIND[[ord(c) for c in ".,;:!?'\"-()"]] = 4
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
N_KINDS = 7
#: Share of each pair of kinds (one text unit after another), and ten whole-text measures.
N_FEATURES = N_KINDS * N_KINDS + 10


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features per text; ``offsets`` bound the texts in ``data``."""
    n = offsets.size - 1
    size = np.diff(offsets)
    out = np.zeros((n, N_FEATURES))
    row = np.repeat(np.arange(n), size)
    if data.size:
        kind = _KIND[data].astype(np.int64)
        same = row[1:] == row[:-1]
        pair = (row[:-1] * N_KINDS + kind[:-1]) * N_KINDS + kind[1:]
        grid = np.bincount(pair[same], minlength=n * N_KINDS ** 2).reshape(n, -1)
        out[:, :N_KINDS ** 2] = np.sqrt(grid / np.maximum(size - 1, 1)[:, None])
        space = (kind == 2) | (kind == 3)
        start = ~space
        start[1:] &= space[:-1] | ~same
        words = np.bincount(row[start], minlength=n)
        lines = np.bincount(row[kind == 3], minlength=n) + 1
        upper = np.bincount(row[_UPPER[data]], minlength=n)
        letters = np.bincount(row[kind == 0], minlength=n) + np.bincount(row[kind == 5], minlength=n)
        repeat = np.bincount(row[1:][same & (data[1:] == data[:-1])], minlength=n)
        counts = np.bincount(row * 64 + (data & 63), minlength=n * 64).reshape(n, 64)
        p = counts / np.maximum(size, 1)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            entropy = -np.nansum(np.where(p > 0, p * np.log2(p), 0), axis=1)
        chars = np.maximum(size, 1)
        out[:, N_KINDS ** 2:] = np.stack([
            np.log1p(size), np.log1p(words), letters / np.maximum(words, 1) / 10, np.log1p(lines),
            np.log1p(words / lines), upper / np.maximum(letters, 1), repeat / chars, entropy / 6,
            letters / chars, (size == 0).astype(float)], axis=1)
    else:
        out[:, -1] = 1.0
    return out


def text_features(column: pa.Array) -> np.ndarray:
    parts = [features(data, offs) for _, _, data, offs in byte_chunks(column)]
    return np.concatenate(parts) if parts else np.zeros((0, N_FEATURES))


def fit_pairs(rows: DataFrame) -> dict:
    """Weights, threshold and scale of the score from all ``rows`` (h, y, x).

    Rows are dealt by their hash ``h`` to blocks of about ``DEAL`` rows of the more frequent label and no
    fewer than half as many of the other, which are dealt more than once if they are few.  All pairs of
    a block, a row of label 1 preferred to one of label 0, enter the logistic loss; a row whose
    block holds none of the other label meets that label's mean.  Each Newton step is one
    pass that keeps only sums; as many utilities lie below the threshold as rows have label 0, which is
    found by counts in ever finer bins.
    """
    size = N_FEATURES

    def sums(make: Callable[[np.ndarray, np.ndarray], np.ndarray], length: int, of: DataFrame | None = None) -> np.ndarray:
        """The sum of what ``make`` returns for each batch of rows, or for each block ``of`` some."""
        by_block = of is not None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(length)
            for b in batches:
                if by_block:
                    for k in range(b.num_rows):
                        total += make(*(v.values.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
                                        for v in (b.column(0)[k], b.column(1)[k])))
                elif b.num_rows:
                    total += make(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES),
                                  b.column(1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(length)), pa.array(total)], ["pos", "v"])
        out = np.zeros(length)
        found = (rows.select("x", "y") if of is None else of).mapInArrow(run, "pos long, v double").groupBy("pos").agg(F.sum("v").alias("v")).toArrow()
        out[found["pos"].to_numpy()] = found["v"].to_numpy()
        return out

    first = sums(lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(0)]), 2 + N_FEATURES)
    n, good = first[0], first[1]
    none = {"w": np.zeros(N_FEATURES), "mean": np.zeros(N_FEATURES), "sd": np.ones(N_FEATURES), "cut": 0.0, "scale": 0.0, "shift": 0.0}
    if good == 0 or good == n:
        return none
    mean = first[2:] / n
    sd = np.sqrt(sums(lambda x, y: ((x - mean) ** 2).sum(0), N_FEATURES) / n)
    sd = np.where(sd < 1e-9, 1.0, sd)

    def scaled(x: np.ndarray) -> np.ndarray:
        return np.clip((x - mean) / sd, -8, 8)

    many = max(good, n - good)
    blocks = int(np.ceil(many / DEAL))
    copies = int(np.ceil(blocks * DEAL / 2 / (n - many)))
    deal = F.when(F.col("y") == int(good < n - good), copies - 1).otherwise(0)
    dealt = cut_lineage(rows.withColumn("c", F.explode(F.sequence(F.lit(0), deal)))
                        .groupBy(F.pmod(F.xxhash64("h", "c"), F.lit(blocks)).alias("block"))
                        .agg(F.collect_list(F.when(F.col("y") == 1, F.col("x"))).alias("good"),
                             F.collect_list(F.when(F.col("y") == 0, F.col("x"))).alias("bad")).select("good", "bad"))
    top = sums(lambda x, y: x[y == 1].sum(0), N_FEATURES)
    middle = top / good, (first[2:] - top) / (n - good)

    w = np.zeros(size)
    for _ in range(ROUNDS):
        def newton(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = np.zeros(1 + size + size * size)
            x, y = (scaled(v if len(v) else m[None]) for v, m in zip((x, y), middle))
            part = max(1, 65536 // len(y))
            for at in range(0, len(x), part):
                d = (x[at:at + part, None] - y[None]).reshape(-1, size)
                p = 1 / (1 + np.exp(np.clip(d @ w, -35, 35)))       # chance of the wrong order
                out[0] += len(d)
                out[1:1 + size] += d.T @ p
                out[1 + size:] += ((d * (p * (1 - p))[:, None]).T @ d).ravel()
            return out
        total = sums(newton, 1 + size + size * size, dealt)
        total = total[1:] / total[0]
        step = np.linalg.solve(total[size:].reshape(size, size) + RIDGE * np.eye(size), total[:size] - RIDGE * w)
        w = w + step * min(1.0, 4 / (np.linalg.norm(step) + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    drop_tables(dealt)

    def ranked(label: int | None, rank: float) -> float:
        """The utility of that rank, from 1, among the rows of a label (None: all)."""
        def some(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            u = scaled(x) @ w
            return u if label is None else u[y == label]
        lo, hi = -reach, reach                                      # more than all utilities
        while True:
            grid = np.linspace(lo, hi, 4097)
            below = np.cumsum(sums(lambda x, y: np.histogram(some(x, y), grid)[0] + np.concatenate(
                [[(some(x, y) < lo).sum()], np.zeros(4095)]), 4096))
            at = int(np.searchsorted(below, rank - 0.5))
            lo, hi = grid[at], grid[at + 1]
            if hi - lo < 1e-9 * reach:
                return (lo + hi) / 2

    reach = 8 * np.abs(w).sum() + 1.0
    cut = (ranked(None, n - good) + ranked(None, n - good + 1)) / 2
    spread = ranked(1, np.ceil(good / 2)) - ranked(0, np.ceil((n - good) / 2))
    return none | {"w": w, "mean": mean, "sd": sd, "cut": cut, "scale": float(8 / max(spread, 1e-6)),
                   "shift": float(np.log(ACCEPT / (1 - ACCEPT)))}


def fit(documents: DataFrame, labels: DataFrame) -> dict:
    """Fit on every labelled row outside the held-out fold."""
    rows = training_rows(documents, labels, "quality", held_out(F.col("doc_id"), 4, 2), None)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = text_features(b.column(0))
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([values, b.column(1), b.column(2)], ["x", "y", "h"])

    told = cut_lineage(rows.select("text", "y", F.xxhash64("doc_id", "text").alias("h"))
                       .mapInArrow(emit, "x array<double>, y int, h long"))
    model = fit_pairs(told)
    drop_tables(told)
    return model


def utilities(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["sd"], -8, 8)
    t = (z @ model["w"] - model["cut"]) * model["scale"] + model["shift"]
    return 1 / (1 + np.exp(-np.clip(t, -500, 500)))


def score(documents: DataFrame, model: dict, column: str = "score") -> DataFrame:
    """``documents`` with a quality score from 0 to 1; a column of that name is replaced."""
    shared = documents.sparkSession.sparkContext.broadcast(model)   # a few hundred numbers

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(utilities(shared.value, text_features(pa.array(text, pa.large_string(), from_pandas=True))))

    return documents.withColumn(column, scored(F.coalesce("text", F.lit(""))))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


QUERIES = {"op4_quality": op4_quality}
