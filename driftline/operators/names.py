"""Resolve free names against a taxonomy table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.session import cut_lineage


def normal_form(name: Column) -> Column:
    """Lower case, underscores and repeated blanks to one blank."""
    spaced = F.replace(F.lower(name), F.lit("_"), F.lit(" "))
    return F.trim(F.regexp_replace(spaced, " +", " "))


def _shortened(key: Column, edits: int = 1) -> Column:
    """The key itself and every key with up to ``edits`` letters left out."""
    def drops(text: Column) -> Column:
        return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(
            F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))).otherwise(F.array(text))
    forms = F.array(key)
    for _ in range(edits):
        forms = F.array_distinct(F.concat(forms, F.flatten(F.transform(forms, drops))))
    return forms


def resolve_names(queries: DataFrame, taxonomy: DataFrame, name: str = "query",
                  drop_flags: tuple[str, ...] = ("INCERTAE_SEDIS_INHERITED",),
                  edits: int = 1) -> DataFrame:
    """Best taxonomy row of each distinct query: exact, else the nearest within ``edits`` edits.

    ``taxonomy`` has ``label, node, flags``.  Two names within k edits share a form with
    at most k letters left out of each, so near names meet in an equality join on those forms;
    no block of names is ever paired off.  Ties go to the smaller label, then node.
    Unresolved queries and flagged rows are dropped.
    """
    asked = (queries.select(F.col(name).alias("query")).filter(
        F.col("query").isNotNull() & (F.col("query") != "")).distinct()
        .withColumn("key", normal_form(F.col("query"))))
    asked = cut_lineage(asked)
    known = taxonomy.select(normal_form(F.col("label")).alias("known"), "label", "node", "flags")
    exact = (asked.join(known, F.col("key") == F.col("known"))
             .select("query", "label", "node", "flags", F.lit(0).alias("distance")))
    exact = cut_lineage(exact)
    rest = asked.join(exact.select("query").distinct(), "query", "left_anti")
    near = (rest.withColumn("form", F.explode(_shortened(F.col("key"), edits)))
            .join(known.withColumn("form", F.explode(_shortened(F.col("known"), edits))), "form")
            .withColumn("distance", F.levenshtein("key", "known"))
            .filter(F.col("distance") <= edits)
            .select("query", "label", "node", "flags", "distance").distinct())
    best = (exact.unionByName(near).groupBy("query")
            .agg(F.min(F.struct("distance", "label", "node", "flags")).alias("b"))
            .select("query", "b.label", "b.node", "b.flags", "b.distance"))
    return best.filter(~F.coalesce(F.col("flags").isin(*drop_flags), F.lit(False)))
