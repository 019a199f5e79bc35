"""Cleaning of the record table and the study cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions import recode, rsem, text


def clean_records(raw: DataFrame, lookup: DataFrame | None = None,
                  drop_sources: Sequence[str] = recode.DUPLICATE_STUDIES) -> DataFrame:
    """Repair, recode and enrich raw records; steps whose inputs are absent are skipped.

    The lookup joins on its small side by measured size (automatic broadcast); the
    record table is not shuffled for it.  Only the three needed lookup columns move.
    """
    df, have = raw, set(raw.columns)
    if "source" in have and drop_sources:
        df = df.filter(~F.col("source").isin(*drop_sources))
    steps = {}
    if {"prop_w_plastic", "N"} <= have:
        steps["WeightedProp"] = F.col("prop_w_plastic") * F.col("N")
    if "habitat" in have:
        steps["Found"] = recode.found("habitat")
    if "prime_forage" in have:
        steps["prime_forage"] = F.nullif("prime_forage", F.lit("not listed"))
    if "ProvCode" in have:
        steps["ProvCode"] = recode.repair_province("ProvCode")
    if "binomial" in have:
        steps["genus"], steps["species"] = text.genus("binomial"), text.species("binomial")
    if "family" in have:
        steps["family"] = recode.repair_family("family")
    if "equipment_used" in have:
        steps["equipment_general"] = recode.gear("equipment_used")
    if "capture_purpose" in have:
        steps["capture_general"] = recode.capture("capture_purpose")
    if "publication_year" in have:
        steps["brk_pt_MD"] = recode.break_point("publication_year")
    df = df.withColumns(steps)
    if lookup is not None and "ProvCode" in have:
        small = lookup.select(F.col("ProvCode").alias("_code"),
                              recode.coast_label("adjacency").alias("adjacency"),
                              "mean_poll_abund")
        # a missing code matches a missing code, as in the scripts' joins
        df = df.join(small, F.col("ProvCode").eqNullSafe(F.col("_code")), "left").drop("_code")
        if "water_type" in have:
            df = df.withColumn("adjacency_water",
                               recode.adjacency_water("water_type", "adjacency"))
    return df


def with_quality(df: DataFrame) -> DataFrame:
    """Add the 0/1 quality flags and ``overall_reliability``."""
    return df.withColumns(recode.quality_flags())


def microplastic_cohort(df: DataFrame, method: str | None = None,
                        exclude_water: str | None = None, years_after: int | None = None,
                        max_depth: float | None = None, min_depth: float | None = None,
                        provinces: Sequence[str] | None = None) -> DataFrame:
    """Records that looked for small particles; the switches narrow the cohort further."""
    df = df.filter(F.col("includes_microplastic") == "Y")
    if method is not None:
        df = df.filter(F.col("method_type") == method)
    if exclude_water is not None:
        df = df.filter(F.col("adjacency_water") != exclude_water)
    if years_after is not None:
        df = df.filter(F.col("publication_year") > years_after)
    if max_depth is not None:
        df = df.filter(F.col("average_depth") < max_depth)
    if min_depth is not None:
        df = df.filter(F.col("average_depth") > min_depth)
    if provinces is not None:
        df = df.filter(F.col("ProvCode").isin(*provinces))
    return df


def map_cohort(df: DataFrame) -> DataFrame:
    """Marine records with a usable province that looked, or may have looked, for particles."""
    return df.filter(F.col("includes_microplastic").isin("Y", "Y?")
                     & (F.col("water_type") == "marine")
                     & F.col("ProvCode").isNotNull() & (F.col("ProvCode") != ""))


#: model -> (columns that must be complete, extra filter)
MODEL_COHORTS = {
    "method": (("N", "NwP", "order", "method_type"), None),
    "full": (("NwP", "N", "prime_forage", "average_depth", "Found",
              "trophic_level_via_fishbase"), "prime_forage != 'Scavenging'"),
    "forage": (("NwP", "N", "prime_forage"), "prime_forage != 'Scavenging'"),
    "depth": (("average_depth", "Found", "NwP", "N"), None),
    "pollution": (("Found", "NwP", "N", "mean_poll_abund"), "adjacency_water != 'estuarine'"),
    "water": (("Found", "adjacency_water", "NwP", "N"), "adjacency_water != 'estuarine'"),
    "trophic": (("NwP", "N", "trophic_level_via_fishbase"), None),
    "year": (("N", "NwP", "publication_year", "order"), "publication_year > 2009"),
    "geo": (("NwP", "N", "adjacency_water", "mean_poll_abund", "order", "source"),
            "method_type != '1'"),
    "particles": (("mean_num_particles_per_indv", "order", "Found", "adjacency_water", "NwP",
                   "N"), "method_type = '3'"),
}


def model_cohort(df: DataFrame, name: str) -> DataFrame:
    """Complete cases of one model."""
    cols, extra = MODEL_COHORTS[name]
    df = rsem.drop_na(df, *cols)
    return df.filter(extra) if extra else df
