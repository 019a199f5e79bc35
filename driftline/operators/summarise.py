"""Grouped summary tables.

All tables are single ``groupBy``/``agg`` plans of sums, counts and distinct counts:
Spark aggregates them on the map side first, so a hot key costs one partial row per
task, and splits distinct counts by value before counting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions import binning, recode, rsem
from driftline.operators import ranking
from driftline.operators.cohort import with_quality
from driftline.session import cut_lineage

PARTICLES = "mean_num_particles_per_indv"


def overall(df: DataFrame) -> DataFrame:
    """One row: frequency, weighted mean particles, its error, median, sample size."""
    main = df.agg(
        rsem.frequency().alias("FO_plastic"),
        rsem.weighted_mean(PARTICLES, "N", skip_null=True).alias("mean_num_plast"),
        rsem.standard_error(PARTICLES).alias("num_plast_SE"),
        rsem.sum_skip_null("N").alias("sample_size"))
    median = ranking.quantiles(df, [], PARTICLES, [0.5])
    return main.withColumn("med_num_plast", median.select(F.get("quantiles", F.lit(0))).scalar())


def by_study(df: DataFrame, faithful: bool = False) -> DataFrame:
    """One row per study; attributes are those of its first record (``row_id`` order).

    ``faithful`` reports polymer confirmation as Method_3, as the published code does.
    """
    df = with_quality(df)
    first = F.struct(
        F.col("poly_conf_YN" if faithful else "meth_3_YN").alias("Method_3"),
        F.col("publication_year").alias("Publication_year"),
        F.col("poly_conf_YN").alias("Polymer_confirmation"),
        F.col("blanks_used_YN").alias("Blanks_used"), F.col("clean_lab_YN").alias("Clean_lab"),
        F.col("min_size_YN").alias("Min_size"),
        F.col("smallest_detection_size_limits_mm").alias("Smallest_detect_size"),
        F.col("method_type").alias("Method_type"))
    out = df.groupBy("source").agg(
        rsem.frequency().alias("Overall_FO"), rsem.sum_strict("N").alias("N"),
        rsem.first_by(first, "row_id").alias("f"))
    return (out.select("source", "Overall_FO", "N", "f.*")
            .withColumn("Min_size", F.coalesce("Min_size", F.lit(0)))
            .withColumn("Overall_reliability", F.col("Polymer_confirmation")
                        + F.col("Blanks_used") + F.col("Clean_lab") + F.col("Min_size")))


def gold_studies(studies: DataFrame, require_min_size: bool = True) -> DataFrame:
    """Studies that meet every quality criterion with the strictest method."""
    keep = ((F.col("Polymer_confirmation") == 1) & (F.col("Blanks_used") == 1)
            & (F.col("Clean_lab") == 1) & (F.col("Method_type") == "3"))
    if require_min_size:
        keep = keep & (F.col("Min_size") == 1)
    return studies.filter(keep)


def species_summary(df: DataFrame, having: Column | None = None, strict: bool = False,
                    wide_status: bool = False, collapse_first: bool = False) -> DataFrame:
    """Mean proportion, sample size and study class per species.

    ``collapse_first`` groups by the collapsed commercial status, so that one species does not
    count once for each finer status.
    """
    if collapse_first:
        df = df.withColumn("commercial", recode.commercial_status("commercial", wide_status))
    size = rsem.sum_strict("N") if strict else rsem.sum_skip_null("N")
    out = (df.filter(rsem.not_in("species", recode.UNNAMED_SPECIES))
           .dropna(subset=["binomial", "family"])
           .groupBy("binomial", "family", "order", "commercial", "iucn_status")
           .agg(F.avg("prop_w_plastic").alias("Sp_mean"), size.alias("Sample_size"),
                rsem.n_distinct("source").alias("num_studies"))
           .withColumn("studies_cat", binning.study_class("num_studies"))
           .withColumn("commercial", recode.commercial_status("commercial", wide_status)))
    if having is not None:
        out = out.filter(having)
    return out.orderBy(F.desc_nulls_last("Sp_mean"), "binomial", "family", "order",
                       "commercial", "iucn_status")


def taxon_rollup(df: DataFrame, rank: str, species_count: bool = True) -> DataFrame:
    """Frequency, effort and commercial share per order or family."""
    aggs = [rsem.frequency().alias("FO_plastic"), F.avg(PARTICLES).alias("mean_num_plast"),
            rsem.sum_skip_null("N").alias("sample_size")]
    if species_count:
        aggs.append(rsem.n_distinct("binomial").alias("num_sp"))
    aggs += [rsem.n_distinct("source").alias("num_studies"),
             F.avg(recode.is_commercial("commercial")).alias("prop_commercial")]
    return (df.groupBy(rank).agg(*aggs).dropna(subset=[rank])
            .withColumn("studies_cat", binning.study_class("num_studies"))
            .withColumn("commercial_cat", binning.commercial_class("prop_commercial"))
            .orderBy(F.desc_nulls_last("FO_plastic"), rank))


def family_focus(df: DataFrame, families: Sequence[str]) -> DataFrame:
    """The chosen families, most affected first."""
    return (df.filter(F.col("family").isin(*families)).groupBy("family")
            .agg(rsem.frequency().alias("FO_plastic"), F.avg(PARTICLES).alias("mean_num_plast"),
                 rsem.sum_skip_null("N").alias("sample_size"),
                 rsem.n_distinct("binomial").alias("num_sp"),
                 rsem.n_distinct("source").alias("num_studies"))
            .orderBy(F.desc_nulls_last("FO_plastic"), "family"))


def threatened_species(df: DataFrame, min_sample: int = 9) -> DataFrame:
    """Threatened species with enough individuals."""
    return (df.filter(F.col("iucn_status").isin(*recode.THREATENED)).groupBy("binomial")
            .agg(rsem.frequency().alias("FO_plastic"),
                 rsem.first_by("iucn_status", "row_id").alias("iucn"),
                 rsem.sum_skip_null("N").alias("Sample_size"))
            .filter(F.col("Sample_size") > min_sample)
            .orderBy(F.desc_nulls_last("FO_plastic"), "binomial"))


VULNERABILITY = "vulnerability_score_via_fishbase_from_cheug_et_al_2005"


def vulnerable_species(df: DataFrame, min_score: float = 50, min_fo: float = 0.25,
                       min_sample: int = 10) -> DataFrame:
    """Vulnerable species with high ingestion; one null count spoils a group's sums."""
    return (df.dropna(subset=[VULNERABILITY])
            .filter(F.col(VULNERABILITY) > min_score)     # a group key: filter before the shuffle
            .groupBy("binomial", "common_name", VULNERABILITY, "iucn_status")
            .agg(rsem.frequency_strict().alias("FO_plastic"),
                 rsem.sum_strict("N").alias("Sample_size"),
                 rsem.n_distinct("source").alias("num_studies"))
            .withColumn("vulnerability_category", binning.vulnerability_class(VULNERABILITY))
            .filter((F.col("FO_plastic") > min_fo) & (F.col("Sample_size") > min_sample))
            .orderBy(F.desc_nulls_last("FO_plastic"), "binomial", "common_name", VULNERABILITY,
                     "iucn_status"))


def concern_species(df: DataFrame, min_fo: float = 0.25, min_sample: int = 10) -> DataFrame:
    """Commercial species with high ingestion."""
    first = F.struct(F.col("commercial").alias("commercial_status"),
                     F.col("aquaculture").alias("AC_status"),
                     F.col("recreational").alias("rec_status"))
    return (df.filter(F.col("commercial").isin(*recode.COMMERCIAL_VALUES))
            .groupBy("common_name", "binomial", "family")
            .agg(rsem.frequency_strict().alias("species_avg"),
                 rsem.weighted_mean(PARTICLES, "N").alias("mean_num_plast"),
                 rsem.sum_strict("N").alias("sample_size"),
                 rsem.n_distinct("source").alias("num_studies"),
                 rsem.first_by(first, "row_id").alias("f"))
            .select("common_name", "binomial", "family", "species_avg", "mean_num_plast",
                    "sample_size", "num_studies", "f.*")
            .filter((F.col("species_avg") > min_fo) & (F.col("sample_size") >= min_sample))
            .orderBy(F.desc_nulls_last("species_avg"), "binomial", "common_name", "family"))


def geographic(df: DataFrame, provinces: Sequence[str] | None = None,
               by_province: bool = True) -> DataFrame:
    """Effort and ingestion of a set of provinces, together or one by one."""
    if provinces is not None:
        df = df.filter(F.col("ProvCode").isin(*provinces))
    return df.groupBy(*(["ProvCode"] if by_province else [])).agg(
        rsem.n_distinct("source").alias("num_studies"),
        rsem.n_distinct("binomial").alias("num_sp"),
        rsem.sum_skip_null("NwP").alias("num_w_plast"),
        rsem.sum_skip_null("N").alias("num_ind_studied"),
        rsem.frequency().alias("prop_by_region"),
        rsem.weighted_mean(PARTICLES, "N").alias("wgt_mean_plast_num"),
        rsem.standard_error(PARTICLES).alias("se_plast_num"))


def province_reliability(df: DataFrame) -> DataFrame:
    """Median over studies of the study's mean reliability, per province."""
    per_study = with_quality(df).groupBy("ProvCode", "source").agg(
        F.avg("overall_reliability").alias("reliability"))
    q = ranking.quantiles(cut_lineage(per_study), ["ProvCode"], "reliability", [0.5])
    return q.select("ProvCode", F.get("quantiles", F.lit(0)).alias("medianreliability"))


def province_summary(df: DataFrame) -> DataFrame:
    """Frequency, individuals, studies, species and normalised ingestion per province."""
    return df.groupBy("ProvCode").agg(
        rsem.frequency().alias("aveplast"), rsem.sum_skip_null("N").alias("numfish"),
        rsem.n_distinct("source").alias("numstudies"),
        rsem.n_distinct("species").alias("numspecies"),
        (rsem.frequency() * rsem.sum_skip_null("N")).alias("normalized"))


def province_bins(summary: DataFrame, faithful: bool = False) -> DataFrame:
    """Attach the map bins and the label to a province summary."""
    from driftline.functions import text
    return summary.withColumns({
        "aveplastbin": binning.fo_bin("aveplast", faithful),
        "numstudiesbin": binning.studies_bin("numstudies"),
        "numfishbin": binning.fish_bin("numfish"),
        "normbin": binning.normalized_bin("normalized"),
        "labels": text.sample_label("ProvCode", "numfish")})


def studies_per_year(df: DataFrame, by: str) -> DataFrame:
    """Number of studies per year and class."""
    return df.groupBy("publication_year", by).agg(rsem.n_distinct("source").alias("n_studies"))


def histogram(df: DataFrame, col: str, width: float, low: float, high: float) -> DataFrame:
    """Counts of right-closed bins; the first bin also holds its left edge."""
    x = F.col(col)
    index = F.greatest(F.ceil((x - low) / width), F.lit(1)).cast("long")
    return (df.filter((x >= low) & (x <= high)).groupBy(index.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")))


def column_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Range, quartiles, mean and missing count of numeric columns, one row per column."""
    long = (df.select(*[F.col(c).cast("double").alias(c) for c in cols])
            .unpivot([], list(cols), "column_name", "value"))
    q = ranking.quantiles(long, ["column_name"], "value", [0.25, 0.5, 0.75])
    stats = long.groupBy("column_name").agg(
        F.min("value").alias("min"), F.avg("value").alias("mean"), F.max("value").alias("max"),
        F.count_if(F.col("value").isNull()).alias("n_null"))
    return stats.join(q, "column_name", "left").select(
        "column_name", "min", F.get("quantiles", F.lit(0)).alias("q1"),
        F.get("quantiles", F.lit(1)).alias("median"), "mean",
        F.get("quantiles", F.lit(2)).alias("q3"), "max", "n_null")
