"""Names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions.rsem import ColumnLike, _c


def genus(binomial: ColumnLike) -> Column:
    return F.get(F.split(_c(binomial), " "), F.lit(0))


def species(binomial: ColumnLike) -> Column:
    """Second word; null for one-word names, later words are dropped."""
    return F.get(F.split(_c(binomial), " "), F.lit(1))


def abbreviate(binomial: ColumnLike) -> Column:
    """"Gadus morhua" -> "G. morhua"; a name without a space gives "G.NA"."""
    b = _c(binomial)
    tail = F.coalesce(F.regexp_substr(b, F.lit(" .*")), F.lit("NA"))
    return F.concat(F.substring(b, 1, 1), F.lit("."), tail)


def sample_label(name: ColumnLike, n: ColumnLike) -> Column:
    """"KURO (n=12)"."""
    return F.concat(_c(name), F.lit(" (n="), _c(n).cast("string"), F.lit(")"))


def clean_tip(label: ColumnLike) -> Column:
    """Underscores to spaces, then the first "Genus species" in the text, else null."""
    spaced = F.replace(_c(label), F.lit("_"), F.lit(" "))
    return F.regexp_substr(spaced, F.lit("[A-Z][a-z]+ [a-z]+"))


def wrap_longitude(lon: ColumnLike, limit: float = 179.0) -> Column:
    """Longitudes above ``limit`` move to the western hemisphere."""
    x = _c(lon)
    return F.when(x > limit, x - 360.0).otherwise(x)
