"""Boosted regression trees with a cross-validated number of trees."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.ranking import quantiles
from driftline.session import cut_lineage


@dataclass
class Boosted:
    prepare: PipelineModel
    model: GBTRegressionModel
    data: DataFrame                # merged rows with label and weight
    numeric: tuple[str, ...]
    flags: tuple[str, ...]         # whether a number is missing, for those that have gaps
    factors: tuple[str, ...]
    cv_error: list[float]          # held-out squared error after each tree

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.flags, *self.factors]


MISSING = "(missing)"


def _fill_missing(rows: DataFrame, numeric: Sequence[str], factors: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Fill gaps of the predictors; returns the names of the flags that mark filled numbers."""
    rows = cut_lineage(rows)
    low = rows.agg(F.count("*").alias("_all"), *[F.min(c).alias(f"_low_{c}") for c in numeric],
                   *[F.count(c).alias(f"_n_{c}") for c in numeric]).first()
    gaps = [c for c in numeric if low[f"_n_{c}"] < low["_all"]]
    fill = {c: float(low[f"_low_{c}"] or 0.0) - 1.0 for c in gaps}
    return (rows.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in gaps})
            .withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in fill.items()})
            .fillna(MISSING, subset=list(factors))), [f"{c}_missing" for c in gaps]


def fit_boosted(df: DataFrame, target: Column, numeric: Sequence[str], factors: Sequence[str],
                weight: Column | None = None, trees: int = 2000, depth: int = 3,
                rate: float = 0.005, bag: float = 0.75, folds: int = 10,
                seed: int = 1) -> Boosted:
    """Squared-error boosting; the tree count is the one with the least held-out error.

    Rows with equal features are merged to their weighted mean, which leaves every split
    criterion as it was.  ``depth`` 3 gives trees of up to seven splits.  Each fold grows all trees
    once and is scored after every tree; folds count by their held-out weight.  A missing number
    gets a value below all others and a flag of its own, a missing factor level a level of its own;
    only rows without target or weight drop out.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.select(*numeric, *[F.col(c).cast("string").alias(c) for c in factors],
                     target.cast("double").alias("_y"), w.alias("_w")).dropna(subset=["_y", "_w"]).filter("_w > 0")
    rows, flags = _fill_missing(rows, numeric, factors)
    given, numeric = tuple(numeric), [*numeric, *flags]
    merged = cut_lineage(rows.groupBy(*numeric, *factors).agg(
        (F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("label"),
        F.sum("_w").alias("weight")))
    prepare = Pipeline(stages=[
        *[StringIndexer(inputCol=c, outputCol=f"{c}_ix", stringOrderType="alphabetAsc")
          for c in factors],
        VectorAssembler(inputCols=[*numeric, *[f"{c}_ix" for c in factors]],
                        outputCol="features")]).fit(merged)
    data = prepare.transform(merged).withColumn(
        "fold", F.pmod(F.xxhash64(*numeric, *factors), F.lit(folds)))
    widest = max([merged.agg(*[F.count_distinct(c) for c in factors]).first()[i]
                  for i in range(len(factors))] or [2])

    def grower(n: int) -> GBTRegressor:
        return GBTRegressor(featuresCol="features", labelCol="label", weightCol="weight",
                            maxIter=n, maxDepth=depth, stepSize=rate, subsamplingRate=bag,
                            maxBins=max(32, widest), seed=seed)

    error = [0.0] * trees
    shares = {r["fold"]: r["w"] for r in data.groupBy("fold").agg(F.sum("weight").alias("w")).collect()}
    for fold in range(folds):
        held = data.filter(F.col("fold") == fold)
        size = shares.get(fold, 0.0)
        if not size or size == sum(shares.values()):
            continue                               # a fold without rows, or with all of them
        model = grower(trees).fit(data.filter(F.col("fold") != fold))
        for i, e in enumerate(model.evaluateEachIteration(held, "squared")):
            error[i] += e * size / sum(shares.values())
    best = error.index(min(error)) + 1
    return Boosted(prepare, grower(best).fit(data), merged, given, tuple(flags), tuple(factors), error)


def cv_table(b: Boosted) -> DataFrame:
    """Held-out error after each tree."""
    return b.data.sparkSession.createDataFrame(
        [(i + 1, float(e)) for i, e in enumerate(b.cv_error)], "n_trees int, cv_error double")


def importance(b: Boosted) -> DataFrame:
    """Relative influence of the features in percent, largest first."""
    total = float(sum(b.model.featureImportances.toArray())) or 1.0
    rows = [(f, 100.0 * float(v) / total)
            for f, v in zip(b.features, b.model.featureImportances.toArray())]
    return b.data.sparkSession.createDataFrame(sorted(rows, key=lambda r: -r[1]),
                                               "feature string, influence double")


def partial_dependence(b: Boosted, feature: str, points: int = 20) -> DataFrame:
    """Mean prediction when one feature is set to each grid value in all rows."""
    if feature in b.numeric:
        probs = [i / (points - 1) for i in range(points)]
        there = F.lit(True) if f"{feature}_missing" not in b.flags else F.col(f"{feature}_missing") == 0
        distinct = b.data.filter(there).select(feature).distinct()
        grid = sorted(set(quantiles(distinct, [], feature, probs).first()[0]))
    else:
        at = b.factors.index(feature)
        grid = list(b.prepare.stages[at].labels)
    values = F.array(*[F.lit(v) for v in grid])
    rows = b.data.withColumn(feature, F.explode(values))
    if f"{feature}_missing" in b.flags:
        rows = rows.withColumn(f"{feature}_missing", F.lit(0.0))
    return (b.model.transform(b.prepare.transform(rows)).groupBy(F.col(feature).alias("value"))
            .agg((F.sum(F.col("weight") * F.col("prediction")) / F.sum("weight"))
                 .alias("prediction")))
