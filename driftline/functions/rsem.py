"""Missing-value rules of the R verbs, as Column expressions.

Spark and R differ in what nulls do to sums, comparisons, distinct counts and
sorting; every summary in the package goes through these helpers.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sum_skip_null(x: ColumnLike) -> Column:
    """Sum that ignores nulls and is 0 for an all-null group."""
    return F.coalesce(F.sum(_c(x)), F.lit(0))


def sum_strict(x: ColumnLike) -> Column:
    """Sum that is null as soon as one input is null."""
    return F.when(F.count(_c(x)) == F.count(F.lit(1)), F.sum(_c(x)))


def ratio(num: Column, den: Column) -> Column:
    """Quotient; null where the divisor is 0 (R gives NaN there)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def frequency(positive: ColumnLike = "NwP", examined: ColumnLike = "N") -> Column:
    """Frequency of occurrence: ratio of sums, nulls skipped."""
    return ratio(sum_skip_null(positive), sum_skip_null(examined))


def frequency_strict(positive: ColumnLike = "NwP", examined: ColumnLike = "N") -> Column:
    """Frequency of occurrence that is null when any input is null."""
    return ratio(sum_strict(positive), sum_strict(examined))


def standard_error(x: ColumnLike) -> Column:
    """Sample standard deviation over the root of the non-null count."""
    return F.stddev_samp(_c(x)) / F.sqrt(F.count(_c(x)).cast("double"))


def weighted_mean(x: ColumnLike, w: ColumnLike, skip_null: bool = False) -> Column:
    """Weighted mean with the rules of R's ``weighted.mean``.

    ``skip_null`` drops rows whose *value* is null.  A null weight on a remaining row
    makes the result null; a row of weight 0 never counts, even if its value is null.
    """
    x, w = _c(x), _c(w)
    kept = x.isNotNull() if skip_null else F.lit(True)
    bad = F.max(F.when(kept & (w.isNull() | ((w != 0) & x.isNull())), 1).otherwise(0))
    used = F.when(kept & (w != 0) & x.isNotNull(), w)
    return F.when(bad == 0, ratio(F.sum(used * x), F.sum(used)))


def n_distinct(x: ColumnLike) -> Column:
    """Distinct count in which null is one more value."""
    return F.count_distinct(_c(x)) + F.max(F.when(_c(x).isNull(), 1).otherwise(0))


def first_by(x: ColumnLike, order: ColumnLike) -> Column:
    """Value of the first row in ``order``, null included."""
    return F.min_by(_c(x), _c(order))


def not_in(x: ColumnLike, values: Iterable) -> Column:
    """``x`` is outside the set; a null ``x`` counts as outside."""
    return ~F.coalesce(_c(x).isin(list(values)), F.lit(False))


def in_or_null(x: ColumnLike, values: Iterable) -> Column:
    """``x`` is in the set or null."""
    return _c(x).isNull() | _c(x).isin(list(values))


def if_else(cond: Column, yes, no) -> Column:
    """Two-way choice that stays null where the condition is null."""
    return F.when(cond, yes).when(~cond, no)


def mapped(x: ColumnLike, table: Mapping[str, str], keep_other: bool = False) -> Column:
    """Look up a fixed recoding table; unmatched values are kept or become null."""
    x = _c(x)
    flat = [F.lit(v) for pair in table.items() for v in pair]
    hit = F.try_element_at(F.create_map(*flat), x)
    return F.coalesce(hit, x) if keep_other else hit


def grouped(x: ColumnLike, groups: Mapping[str, Sequence[str]], keep_other: bool = False) -> Column:
    """Recode by ``{label: [values]}``."""
    return mapped(x, {v: label for label, values in groups.items() for v in values}, keep_other)


def cut(x: ColumnLike, breaks: Sequence[float], labels: Sequence) -> Column:
    """Right-closed classes ``(a, b]``; values outside are null."""
    x = _c(x)
    if len(labels) != len(breaks) - 1:
        raise ValueError("need one label per interval")
    out = None
    for lo, hi, label in zip(breaks[:-1], breaks[1:], labels):
        inside = F.lit(True)
        if lo != float("-inf"):
            inside = inside & (x > F.lit(lo))
        if hi != float("inf"):
            inside = inside & (x <= F.lit(hi))
        inside = inside & x.isNotNull()
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out


def last_match(rules: Sequence[tuple[Column, str]]) -> Column:
    """Successive assignments: the last rule that holds decides."""
    out = None
    for cond, label in reversed(list(rules)):
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def level_index(x: ColumnLike, levels: Sequence[str]) -> Column:
    """1-based position in an explicit level list; unknown values are null."""
    flat = [F.lit(v) for i, level in enumerate(levels, 1) for v in (level, i)]
    return F.try_element_at(F.create_map(*flat), _c(x))


def log_or_null(x: ColumnLike, base10: bool = False) -> Column:
    """Logarithm; null for 0 and below (R gives -Inf / NaN)."""
    x = _c(x).cast("double")
    return F.when(x > 0, F.log10(x) if base10 else F.log(x))


def drop_na(df: DataFrame, *cols: str) -> DataFrame:
    """Complete cases over ``cols`` (all columns when none are named)."""
    return df.dropna(subset=list(cols) or None)
