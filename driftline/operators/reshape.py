"""Accumulation curves, long form, row expansion, standardising."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import rsem


def accumulation(df: DataFrame, step: str = "publication_year", item: str = "binomial",
                 weight: str = "N") -> DataFrame:
    """Cumulative distinct items and effort over the steps.

    An item counts at its first step, so the distinct count is a running sum of
    newcomers.  The running windows see one row per step.
    """
    cells = df.groupBy(step, item).agg(rsem.sum_skip_null(weight).alias("_n"))
    effort = cells.groupBy(step).agg(F.sum("_n").alias("annual_n"))
    fresh = (cells.groupBy(item).agg(F.min(step).alias("_first"))
             .groupBy("_first").agg(F.count(F.lit(1)).alias("_new")))
    upto = (Window.orderBy(F.asc_nulls_last(step))
            .rowsBetween(Window.unboundedPreceding, 0))
    return (effort.join(fresh, F.col(step).eqNullSafe(F.col("_first")), "left")
            .select(step, "annual_n",
                    F.sum(F.coalesce("_new", F.lit(0))).over(upto).alias("cum_species"),
                    F.sum("annual_n").over(upto).alias("cum_n"))
            .withColumn("cpue", rsem.ratio(F.col("cum_species"), F.col("cum_n"))))


def to_long(df: DataFrame, ids: Sequence[str], first: str, last: str, names_to: str,
            values_to: str) -> DataFrame:
    """Unpivot the columns from ``first`` to ``last`` in table order."""
    a, b = df.columns.index(first), df.columns.index(last)
    return df.unpivot(list(ids), df.columns[a:b + 1], names_to, values_to)


def repeat_rows(df: DataFrame, times: str) -> DataFrame:
    """Each row ``times`` times; null and 0 drop it.

    Prefer the weighted statistics where they exist: this multiplies the data.
    """
    n = F.col(times).cast("int")
    return (df.filter(n > 0).withColumn("_i", F.explode(F.sequence(F.lit(1), n))).drop("_i"))


def standardise(df: DataFrame, *cols: str) -> DataFrame:
    """Add ``z_<col>``: value minus mean over sample deviation, of the whole table.

    The moments are one aggregate row, read back as a scalar subquery.
    """
    stats = df.agg(F.struct(*[s.alias(f"{k}_{c}") for c in cols for k, s in
                              (("m", F.avg(c)), ("s", F.stddev_samp(c)))]).alias("s"))
    box = stats.scalar()
    return df.withColumns({
        f"z_{c}": (F.col(c) - box.getField(f"m_{c}")) / F.nullif(box.getField(f"s_{c}"),
                                                                 F.lit(0.0))
        for c in cols})
