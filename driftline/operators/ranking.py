"""Exact ranks and quantiles that never gather one group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.session import cut_lineage

_OFFSET_BITS = 33   # layout of monotonically_increasing_id: partition above, row below


def global_rank(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """0-based position of each row in a total order.

    The rows are range partitioned and written once in order; positions follow from the
    partition row counts, so no window ever holds more rows than there are partitions.
    """
    sorted_rows = cut_lineage(df.orderBy(*order).withColumn("_mid",
                                                            F.monotonically_increasing_id()))
    pid = F.shiftright("_mid", _OFFSET_BITS)
    sizes = sorted_rows.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(sizes.select(
        "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    return (sorted_rows.withColumn("_pid", pid).join(offsets, "_pid")
            .withColumn(name, F.col("_off")
                        + F.col("_mid").bitwiseAND((1 << _OFFSET_BITS) - 1))
            .drop("_mid", "_pid", "_off"))


def rank_within(df: DataFrame, by: Sequence[str], order: Sequence[Column | str],
                name: str = "position") -> DataFrame:
    """1-based row number inside each group, from one global order."""
    ranked = global_rank(df, [*by, *order], "_r")
    start = ranked.groupBy(*by).agg(F.min("_r").alias("_r0"))
    return (_null_safe_join(ranked, cut_lineage(start), by)
            .withColumn(name, F.col("_r") - F.col("_r0") + 1).drop("_r", "_r0"))


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                    how: str = "inner") -> DataFrame:
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    out = left.join(right, cond, how)
    return out.drop(*[f"_r_{k}" for k in keys])


def frequencies(df: DataFrame, by: Sequence[str], col: str,
                weight: Column | None = None) -> DataFrame:
    """Distinct values per group with their summed weight and its running total.

    Columns: ``by``, ``_x``, ``_w``, ``_upto`` (weight of all values up to and with this one) and
    ``_n`` (weight of the group).  Null values and weights of 0 drop out.  The source is read
    once; the values are sorted over the whole cluster and totals run inside its partitions.
    """
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    folded = (df.select(*by, F.col(col).alias("_x"), w.alias("_w"))
              .filter(F.col("_x").isNotNull() & (F.col("_w") > 0))
              .groupBy(*by, "_x").agg(F.sum("_w").alias("_w")))
    rows = cut_lineage(folded.orderBy(*by, "_x").withColumn("_mid", F.monotonically_increasing_id()))
    pid = F.shiftright("_mid", _OFFSET_BITS)
    inside = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_pid", pid).withColumn("_run", F.sum("_w").over(inside))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("_pid").agg(F.sum("_w").alias("_p"))         # one row per partition
               .select("_pid", F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_off")))
    rows = cut_lineage(rows.join(cut_lineage(offsets), "_pid").select(
        *by, "_x", "_w", (F.col("_run") + F.col("_off")).alias("_sofar")))
    groups = rows.groupBy(*by).agg(F.min(F.col("_sofar") - F.col("_w")).alias("_g0"),
                                   F.sum("_w").alias("_n"))
    return (_null_safe_join(rows, cut_lineage(groups), by)
            .select(*by, "_x", "_w", (F.col("_sofar") - F.col("_g0")).alias("_upto"), "_n"))


def _at_rank(rank: Column) -> Column:
    """The value at a 0-based rank of its group, as an aggregate over ``frequencies``."""
    own = (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_w"))
    return F.min(F.when(own, F.col("_x")))


def _interpolated(probs: Sequence[float]) -> Column:
    """Array of linear-interpolation quantiles, as an aggregate over ``frequencies``."""
    out = []
    for p in probs:
        h = (F.col("_n") - 1) * F.lit(float(p))
        low = F.floor(h).cast("long")
        lo, hi = _at_rank(low), _at_rank(F.least(low + 1, F.col("_n") - 1))
        share = F.max(h - F.floor(h))
        out.append(lo + share * (hi - lo))
    return F.array(*out)


def quantiles(df: DataFrame, by: Sequence[str], col: str, probs: Sequence[float],
              weight: str | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per group, as an array column ``quantiles``.

    ``weight`` counts a row that many times.  Null values are skipped.
    """
    rows = df.withColumn(col, F.col(col).cast("double"))
    table = frequencies(rows, by, col, None if weight is None else F.col(weight))
    out = table.groupBy(*by).agg(_interpolated(probs).alias("quantiles"))
    return out if by else out.filter(F.element_at("quantiles", 1).isNotNull())


def kth_smallest(df: DataFrame, by: Sequence[str], col: str, k: str, weight: str) -> DataFrame:
    """The ``k``-th smallest value per group, ``k`` being a column constant in the group.

    A row counts ``weight`` times.
    """
    rows = df.withColumn("_k", F.col(k).cast("long"))
    table = frequencies(rows, [*by, "_k"], col, F.col(weight))
    return (table.groupBy(*by, "_k").agg(_at_rank(F.col("_k") - 1).alias("value"))
            .filter(F.col("value").isNotNull()).drop("_k"))


def box_stats(df: DataFrame, by: Sequence[str], col: str,
              weight: str | None = None) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and outlier count per group.

    ``weight`` gives the statistics of rows repeated that many times without
    repeating them.  Everything comes from one frequency table.
    """
    if not by:
        raise ValueError("name at least one grouping column")
    table = cut_lineage(frequencies(df, by, col, None if weight is None else F.col(weight)))
    q = table.groupBy(*by).agg(_interpolated([0.25, 0.5, 0.75]).alias("_q"))
    q = cut_lineage(q.select(*by, *[F.get("_q", F.lit(i)).alias(name)
                                    for i, name in enumerate(("lower", "middle", "upper"))]))
    x, w = F.col("_x"), F.col("_w")
    reach = 1.5 * (F.col("upper") - F.col("lower"))
    inside = (x >= F.col("lower") - reach) & (x <= F.col("upper") + reach)
    return (_null_safe_join(table, q, by).groupBy(*by, "lower", "middle", "upper")
            .agg(F.min(F.when(inside, x)).alias("whisker_low"),
                 F.max(F.when(inside, x)).alias("whisker_high"),
                 F.sum(F.when(inside, 0).otherwise(w)).alias("n_outliers"),
                 F.sum(w).alias("n")))
