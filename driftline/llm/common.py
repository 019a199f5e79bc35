"""Helpers shared by the operators: row keys, Arrow text chunks, vectorised word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.session import ship_package

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """Whether a row's id falls in the held-out fold; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def training_rows(documents: DataFrame, labels: DataFrame, label: str, fold: Column,
                  bound: int | None, seed: int = 7) -> DataFrame:
    """Labelled rows outside ``fold``: all, or at most ``bound`` per class, those of least seeded hash.

    Ids are labelled by their largest label when the table repeats them; null ids and null
    labels teach nothing.  Returns (doc_id, text, y).
    """
    marks = (labels.select("doc_id", F.col(label).cast("int").alias("y")).dropna()
             .groupBy("doc_id").agg(F.max("y").alias("y"))
             .where(~fold & F.col("y").isin(0, 1))
             .withColumn("_h", F.xxhash64("doc_id", F.lit(seed))))
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if bound is None:       # merged at every size, so that the labels never have to fit in a task
        return texts.join(marks.drop("_h").hint("merge"), "doc_id")
    chosen = [marks.where(F.col("y") == y).orderBy("_h", "doc_id").limit(bound) for y in (0, 1)]
    return texts.join(chosen[0].union(chosen[1]).drop("_h"), "doc_id")


# --- Arrow chunks -----------------------------------------------------------------------


def byte_chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``limit`` bytes (one row at least).

    Yields first row, end row, their bytes as one array, and row offsets into it.
    Nulls count as empty.
    """
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type)
                                  or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    width = np.int64 if large else np.int32
    offs = np.frombuffer(bufs[1], width, n + 1 + column.offset)[column.offset:].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


# --- hashes -----------------------------------------------------------------------------

M1, M2, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


def counter(n: int, seed: int) -> np.ndarray:
    """``n`` pseudo-random odd 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * GOLDEN) | np.uint64(1)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE = counter(256, 1)
_BYTE[_SPACE] = 0
_LOWER_BYTE = _BYTE[_FOLD]
_POWER = counter(1 << 12, 2)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each row, A-Z lower-cased, in order.

    Returns the hashes and, per row, the offset of its first word (length rows + 1).
    """
    global _POWER
    n = data.size
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(offsets.size, np.int64)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[(offsets < n)]
    first[inner] = solid[inner]
    starts = np.flatnonzero(first)
    if starts.size == 0:
        return np.zeros(0, np.uint64), np.zeros(offsets.size, np.int64)
    place = np.arange(n, dtype=np.int32)
    place -= np.repeat(starts, np.diff(np.append(starts, n))).astype(np.int32) if starts[0] == 0 else \
        np.concatenate([np.zeros(starts[0], np.int32),
                        np.repeat(starts, np.diff(np.append(starts, n))).astype(np.int32)])
    top = int(place.max()) + 1
    if top > _POWER.size:
        _POWER = counter(1 << (top - 1).bit_length(), 2)
    with np.errstate(over="ignore"):
        values = _LOWER_BYTE[data] * _POWER[place]
        hashes = mix(np.add.reduceat(values, starts))
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    with np.errstate(over="ignore"):
        return mix(a * GOLDEN + mix(b + GOLDEN))
