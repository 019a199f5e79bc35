"""Queries for the grouped summary tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import binning, recode, rsem
from driftline.operators import cohort, ranking, reshape, summarise
from driftline.plans.prep import QUALITY_INPUTS
from driftline.plans.registry import (FO, ROW_ORDER, STRICT_N, STRICT_NWP, SUM_N, _groups,
                                      n_distinct_sql, over_records, query, r, records,
                                      study_class_sql)

P = "mean_num_particles_per_indv"
MICRO = ("source", "includes_microplastic")


def full(spark, sf_dir, *columns, **kw):
    return cohort.microplastic_cohort(records(spark, sf_dir, *MICRO, *columns, **kw))


@query("fo_global", over_records(f"SELECT {r(FO, 'fo')} FROM rec"))
def fo_global(spark, sf_dir):
    return records(spark, sf_dir, "source", "NwP", "N").agg(rsem.frequency().alias("fo"))


@query("se_global", over_records(
    f"SELECT {r('stddev_samp(prop_w_plastic) / sqrt(count(prop_w_plastic))', 'se')} FROM full_"))
def se_global(spark, sf_dir):
    return full(spark, sf_dir, "prop_w_plastic").agg(
        rsem.standard_error("prop_w_plastic").alias("se"))


WMEAN = f"sum({P} * N) / nullif(sum(CASE WHEN {P} IS NOT NULL THEN N END), 0)"
WMEAN_SKIP = (f"CASE WHEN count(*) FILTER (WHERE {P} IS NOT NULL AND N IS NULL) = 0"
              f" THEN {WMEAN} END")
WMEAN_STRICT = (f"CASE WHEN count(*) FILTER (WHERE N IS NULL OR ({P} IS NULL AND N <> 0)) = 0"
                f" THEN {WMEAN} END")
STRICT_FO = f"({STRICT_NWP})::DOUBLE / nullif(({STRICT_N}), 0)::DOUBLE"


@query("wmean_global", over_records(f"""SELECT ProvCode, {r(WMEAN_SKIP, "wmean")}
    FROM full_ GROUP BY ProvCode"""))
def wmean_global(spark, sf_dir):
    return full(spark, sf_dir, "ProvCode", P, "N").groupBy("ProvCode").agg(
        rsem.weighted_mean(P, "N", skip_null=True).alias("wmean"))


@query("wmean_strict", over_records(f"""SELECT binomial, {r(WMEAN_STRICT, "wmean")}
    FROM full_ GROUP BY binomial"""))
def wmean_strict(spark, sf_dir):
    return full(spark, sf_dir, "binomial", P, "N").groupBy("binomial").agg(
        rsem.weighted_mean(P, "N").alias("wmean"))


@query("overall_summary", over_records(f"""SELECT {r(FO, 'FO_plastic')},
    {r(WMEAN_SKIP, 'mean_num_plast')},
    {r(f'stddev_samp({P}) / sqrt(count({P}))', 'num_plast_SE')},
    {r(f'median({P})', 'med_num_plast')}, {SUM_N} AS sample_size FROM full_"""))
def overall_summary(spark, sf_dir):
    return summarise.overall(full(spark, sf_dir, "NwP", "N", P))


@query("n_studies", over_records(f"""SELECT includes_microplastic,
    {n_distinct_sql("source")} AS n_studies, {n_distinct_sql("species")} AS n_species
    FROM rec GROUP BY ALL"""))
def n_studies(spark, sf_dir):
    return records(spark, sf_dir, *MICRO, "binomial").groupBy("includes_microplastic").agg(
        rsem.n_distinct("source").alias("n_studies"),
        rsem.n_distinct("species").alias("n_species"))


STUDY_INPUTS = ("NwP", "N", "publication_year", *QUALITY_INPUTS)
STUDY_SQL = f"""firsts AS (SELECT source, {FO} AS Overall_FO, {STRICT_N} AS N,
    first(meth_3_YN ORDER BY {ROW_ORDER}) AS f_method, first(publication_year ORDER BY {ROW_ORDER})
    AS f_year, first(poly_conf_YN ORDER BY {ROW_ORDER}) AS f_poly,
    first(blanks_used_YN ORDER BY {ROW_ORDER}) AS f_blanks,
    first(clean_lab_YN ORDER BY {ROW_ORDER}) AS f_clean,
    first(min_size_YN ORDER BY {ROW_ORDER}) AS f_size,
    first(smallest_detection_size_limits_mm ORDER BY {ROW_ORDER}) AS f_detect,
    first(method_type ORDER BY {ROW_ORDER}) AS f_type FROM full_ GROUP BY source),
study AS (SELECT source, Overall_FO, N, f_method AS Method_3, f_year AS Publication_year,
    f_poly AS Polymer_confirmation, f_blanks AS Blanks_used, f_clean AS Clean_lab,
    coalesce(f_size, 0) AS Min_size, f_detect AS Smallest_detect_size, f_type AS Method_type,
    f_poly + f_blanks + f_clean + coalesce(f_size, 0) AS Overall_reliability FROM firsts)"""


def study_table(spark, sf_dir):
    return summarise.by_study(full(spark, sf_dir, *STUDY_INPUTS, row_id=True))


def over_studies(body: str) -> str:
    return over_records(f", {STUDY_SQL} {body}")


@query("by_study", over_studies("SELECT * REPLACE (round(Overall_FO, 6) AS Overall_FO) FROM study"))
def by_study(spark, sf_dir):
    return study_table(spark, sf_dir)


GOLD = """Polymer_confirmation = 1 AND Blanks_used = 1 AND Clean_lab = 1 AND Method_type = '3'"""


@query("gold_studies", over_studies(f"""SELECT 'with size' AS rule, count(*) AS n_studies,
    count(*) FILTER (WHERE Overall_FO > 0.25) AS n_high FROM study WHERE {GOLD} AND Min_size = 1
    UNION ALL SELECT 'any size', count(*), count(*) FILTER (WHERE Overall_FO > 0.25) FROM study
    WHERE {GOLD}"""))
def gold_studies(spark, sf_dir):
    studies = study_table(spark, sf_dir)
    high = F.count_if(F.col("Overall_FO") > 0.25)
    parts = [summarise.gold_studies(studies, flag).agg(
        F.lit(label).alias("rule"), F.count(F.lit(1)).alias("n_studies"), high.alias("n_high"))
        for label, flag in (("with size", True), ("any size", False))]
    return parts[0].unionByName(parts[1])


@query("qa_long", over_studies("""SELECT source, Publication_year, Metric_type, Metric_value FROM (
    SELECT source, Publication_year, Polymer_confirmation, Blanks_used, Clean_lab, Min_size
    FROM study WHERE Publication_year > 2009) UNPIVOT INCLUDE NULLS (Metric_value FOR Metric_type
    IN (Polymer_confirmation, Blanks_used, Clean_lab, Min_size))"""))
def qa_long(spark, sf_dir):
    return reshape.to_long(study_table(spark, sf_dir).filter("Publication_year > 2009"),
                           ["source", "Publication_year"], "Polymer_confirmation", "Min_size",
                           "Metric_type", "Metric_value")


COMMERCIAL = "avg(CASE WHEN commercial IN ('commercial', 'highly commercial') THEN 1 ELSE 0 END)"


def _rollup_sql(rank: str, source: str) -> str:
    return over_records(f"""SELECT {rank}, {r(FO, "FO_plastic")}, {r(f"avg({P})",
        "mean_num_plast")}, {SUM_N} AS sample_size, {n_distinct_sql("binomial")} AS num_sp,
        {n_distinct_sql("source")} AS num_studies, {r(COMMERCIAL, "prop_commercial")},
        {study_class_sql("num_studies")} AS studies_cat,
        CASE WHEN prop_commercial <= 0.01 THEN 'None' WHEN prop_commercial <= 0.25 THEN 'Minor'
        ELSE 'Commercial' END AS commercial_cat
        FROM {source} WHERE {rank} IS NOT NULL GROUP BY {rank} ORDER BY FO_plastic DESC""")


ROLLUP_INPUTS = ("NwP", "N", P, "binomial", "commercial")


@query("order_rollup", _rollup_sql('"order"', "full_"))
def order_rollup(spark, sf_dir):
    return summarise.taxon_rollup(full(spark, sf_dir, "order", *ROLLUP_INPUTS), "order")


@query("family_rollup", _rollup_sql("family", "rec"))
def family_rollup(spark, sf_dir):
    return summarise.taxon_rollup(records(spark, sf_dir, "source", "family", *ROLLUP_INPUTS),
                                  "family")


def _species_sql(source: str, status: str, size: str) -> str:
    """Species table over ``source``, grouped by the expression ``status``; nothing is rounded."""
    return f"""species_sum AS (SELECT binomial, family, "order", {status} AS status, iucn_status,
    avg(prop_w_plastic) AS Sp_mean, {size} AS Sample_size,
    {n_distinct_sql("source")} AS num_studies, {study_class_sql("num_studies")} AS studies_cat
    FROM {source} WHERE (species IS NULL OR species NOT IN ('sp.', 'spp.', 'spp'))
    AND binomial IS NOT NULL AND family IS NOT NULL
    GROUP BY binomial, family, "order", {status}, iucn_status)"""


SPECIES_INPUTS = ("binomial", "family", "order", "commercial", "iucn_status", "prop_w_plastic",
                  "N")


@query("species_summary", over_records(f""", {_species_sql("rec", "commercial", SUM_N)}
    SELECT binomial, family, "order", {_groups("status", recode.COMMERCIAL_GROUPS, "status")} AS commercial,
    iucn_status, round(Sp_mean, 6) AS Sp_mean, Sample_size, num_studies, studies_cat FROM species_sum
    WHERE Sample_size > 10 AND Sp_mean < 0.25"""))
def species_summary(spark, sf_dir):
    return summarise.species_summary(
        records(spark, sf_dir, "source", *SPECIES_INPUTS),
        having=(F.col("Sample_size") > 10) & (F.col("Sp_mean") < 0.25))


@query("risk_quadrant", over_records(f""", {_species_sql("full_", _groups("commercial",
    recode.COMMERCIAL_GROUPS_WIDE, "commercial"), STRICT_N)}
    SELECT CASE WHEN Sp_mean >= 0.25 AND Sample_size >= 10 THEN 'high incidence, data rich'
    WHEN Sp_mean >= 0.25 THEN 'high incidence, data poor'
    WHEN Sample_size >= 10 THEN 'low incidence, data rich'
    WHEN Sp_mean IS NOT NULL THEN 'low incidence, data poor' END AS quadrant,
    studies_cat, count(*) AS n_species FROM species_sum
    WHERE status IS NOT NULL AND Sample_size > 0 AND log10(Sample_size) BETWEEN 0 AND 4
    GROUP BY ALL"""))
def risk_quadrant(spark, sf_dir):
    df = summarise.species_summary(full(spark, sf_dir, *SPECIES_INPUTS), strict=True,
                                   wide_status=True, collapse_first=True)
    shown = df.dropna(subset=["commercial"]).filter(
        rsem.log_or_null("Sample_size", base10=True).between(0, 4))
    return shown.groupBy(
        binning.risk_quadrant("Sp_mean", "Sample_size").alias("quadrant"),
        "studies_cat").agg(F.count(F.lit(1)).alias("n_species"))


FAMILIES = ["Carangidae", "Mugilidae", "Pleuronectidae", "Soleidae", "Myctophidae"]


@query("family_focus", over_records(f"""SELECT family, {r(FO, "FO_plastic")},
    {r(f"avg({P})", "mean_num_plast")}, {SUM_N} AS sample_size,
    {n_distinct_sql("binomial")} AS num_sp, {n_distinct_sql("source")} AS num_studies
    FROM full_ WHERE family IN ({", ".join(f"'{f}'" for f in FAMILIES)}) GROUP BY family"""))
def family_focus(spark, sf_dir):
    return summarise.family_focus(
        full(spark, sf_dir, "family", "NwP", "N", P, "binomial"), FAMILIES)


@query("iucn_species", over_records(f"""SELECT binomial, {r(FO, "FO_plastic")},
    first(iucn_status ORDER BY {ROW_ORDER}) AS iucn, {SUM_N} AS Sample_size FROM rec
    WHERE iucn_status IN ('NT', 'VU', 'EN', 'CR') GROUP BY binomial HAVING {SUM_N} > 9"""))
def iucn_species(spark, sf_dir):
    return summarise.threatened_species(
        records(spark, sf_dir, "source", "binomial", "iucn_status", "NwP", "N", row_id=True))


VUL = summarise.VULNERABILITY


@query("vulnerability_table", over_records(f"""SELECT * FROM (SELECT binomial, common_name, {VUL},
    iucn_status, {r(STRICT_FO, "FO_plastic")},
    {STRICT_N} AS Sample_size, {n_distinct_sql("source")} AS num_studies,
    CASE WHEN {VUL} <= 60 THEN 'moderate-high' WHEN {VUL} <= 80 THEN 'high-very high'
    ELSE 'very high' END AS vulnerability_category
    FROM full_ WHERE {VUL} > 50 GROUP BY ALL) WHERE FO_plastic > 0.25 AND Sample_size > 10"""))
def vulnerability_table(spark, sf_dir):
    return summarise.vulnerable_species(
        full(spark, sf_dir, "binomial", "common_name", VUL, "iucn_status", "NwP", "N"))


@query("concern_species", over_records(f"""SELECT * FROM (SELECT common_name, binomial, family,
    {r(STRICT_FO, "species_avg")},
    {r(WMEAN_STRICT, "mean_num_plast")}, {STRICT_N} AS sample_size,
    {n_distinct_sql("source")} AS num_studies,
    first(commercial ORDER BY {ROW_ORDER}) AS commercial_status,
    first(aquaculture ORDER BY {ROW_ORDER}) AS AC_status,
    first(recreational ORDER BY {ROW_ORDER}) AS rec_status
    FROM rec WHERE commercial IN ('commercial', 'highly commercial')
    GROUP BY common_name, binomial, family) WHERE species_avg > 0.25 AND sample_size >= 10"""))
def concern_species(spark, sf_dir):
    return summarise.concern_species(records(
        spark, sf_dir, "source", "common_name", "binomial", "family", "commercial", "aquaculture",
        "recreational", "NwP", "N", P, row_id=True))


@query("geo_summary", over_records(f"""SELECT ProvCode, {n_distinct_sql("source")} AS num_studies,
    {n_distinct_sql("binomial")} AS num_sp,
    CAST(coalesce(sum(NwP), 0) AS BIGINT) AS num_w_plast, {SUM_N} AS num_ind_studied,
    {r(FO, "prop_by_region")},
    {r(WMEAN_STRICT, "wgt_mean_plast_num")}, {r(f"stddev_samp({P}) / sqrt(count({P}))", "se_plast_num")}
    FROM rec WHERE ProvCode IN ('NASE', 'NECS', 'MEDI') GROUP BY ProvCode"""))
def geo_summary(spark, sf_dir):
    return summarise.geographic(
        records(spark, sf_dir, "source", "ProvCode", "binomial", "NwP", "N", P),
        ["NASE", "NECS", "MEDI"])


GEO_SQL = f"""{n_distinct_sql("source")} AS num_studies,
    {n_distinct_sql("binomial")} AS num_sp,
    CAST(coalesce(sum(NwP), 0) AS BIGINT) AS num_w_plast, {SUM_N} AS num_ind_studied,
    {r(FO, "prop_by_region")},
    {r(WMEAN_STRICT, "wgt_mean_plast_num")}, {r(f"stddev_samp({P}) / sqrt(count({P}))", "se_plast_num")}
    FROM rec WHERE ProvCode IN ('NASE', 'NECS', 'MEDI')"""


@query("geo_overall", over_records(f"SELECT {GEO_SQL}"))
def geo_overall(spark, sf_dir):
    """The chosen provinces taken together."""
    return summarise.geographic(
        records(spark, sf_dir, "source", "ProvCode", "binomial", "NwP", "N", P),
        ["NASE", "NECS", "MEDI"], by_province=False)


def _per_year(name: str, by: str, needs: tuple[str, ...], lookup: bool = False) -> None:
    def run(spark, sf_dir):
        df = records(spark, sf_dir, "source", "publication_year", *needs, lookup=lookup)
        return summarise.studies_per_year(df, by)
    query(name, over_records(f"""SELECT publication_year, {by}, {n_distinct_sql("source")}
        AS n_studies FROM rec GROUP BY ALL"""))(run)


_per_year("studies_year_micro", "includes_microplastic", ("includes_microplastic",))
_per_year("studies_year_method", "method_type", ("method_type",))
_per_year("studies_year_region", "adjacency_water", ("ProvCode", "water_type"), lookup=True)

DEPTH_PROBS = [0.025, 0.25, 0.5, 0.75, 0.89, 0.95, 0.99]


@query("depth_quantiles", over_records(" UNION ALL ".join(
    f"SELECT {p}::DOUBLE AS prob, {r(f'quantile_cont(average_depth, {p})', 'depth')} FROM full_"
    for p in DEPTH_PROBS)))
def depth_quantiles(spark, sf_dir):
    q = ranking.quantiles(full(spark, sf_dir, "average_depth"), [], "average_depth", DEPTH_PROBS)
    pairs = F.arrays_zip(F.array(*map(F.lit, DEPTH_PROBS)).alias("prob"),
                         F.col("quantiles").alias("depth"))
    return q.select(F.explode(pairs).alias("p")).select(
        F.col("p.prob").alias("prob"), F.col("p.depth").alias("depth"))


@query("hist_particles", over_records(f"""SELECT CAST(greatest(ceil({P} / 0.001), 1) AS BIGINT)
    AS bin, count(*) AS n FROM full_ WHERE {P} BETWEEN 0 AND 10 GROUP BY ALL"""))
def hist_particles(spark, sf_dir):
    return summarise.histogram(full(spark, sf_dir, P), P, 0.001, 0.0, 10.0)


@query("boxplot_stats", over_records("""SELECT equipment_general, round(q1, 6) AS lower,
    round(q2, 6) AS middle, round(q3, 6) AS upper,
    round(min(p) FILTER (WHERE p >= q1 - 1.5 * (q3 - q1) AND p <= q3 + 1.5 * (q3 - q1)), 6)
    AS whisker_low,
    round(max(p) FILTER (WHERE p >= q1 - 1.5 * (q3 - q1) AND p <= q3 + 1.5 * (q3 - q1)), 6)
    AS whisker_high,
    count(*) FILTER (WHERE p < q1 - 1.5 * (q3 - q1) OR p > q3 + 1.5 * (q3 - q1)) AS n_outliers,
    count(*) AS n FROM (SELECT equipment_general, prop_w_plastic AS p FROM full_
    WHERE prop_w_plastic IS NOT NULL) f JOIN (SELECT equipment_general AS g,
    quantile_cont(prop_w_plastic, 0.25) AS q1, quantile_cont(prop_w_plastic, 0.5) AS q2,
    quantile_cont(prop_w_plastic, 0.75) AS q3 FROM full_ GROUP BY equipment_general) q
    ON equipment_general IS NOT DISTINCT FROM g GROUP BY equipment_general, q1, q2, q3"""))
def boxplot_stats(spark, sf_dir):
    df = full(spark, sf_dir, "equipment_used", "prop_w_plastic")
    return ranking.box_stats(df, ["equipment_general"], "prop_w_plastic")


@query("boxplot_expanded", over_records("""SELECT brk_pt_MD,
    round(quantile_cont(p, 0.25), 6) AS lower, round(quantile_cont(p, 0.5), 6) AS middle,
    round(quantile_cont(p, 0.75), 6) AS upper, count(*) AS n FROM (SELECT brk_pt_MD,
    prop_w_plastic AS p, unnest(range(N)) FROM full_ WHERE prop_w_plastic IS NOT NULL AND N > 0)
    GROUP BY brk_pt_MD"""))
def boxplot_expanded(spark, sf_dir):
    """Statistics of rows repeated N times, from weights."""
    df = full(spark, sf_dir, "publication_year", "prop_w_plastic", "N")
    return ranking.box_stats(df, ["brk_pt_MD"], "prop_w_plastic", weight="N").select(
        "brk_pt_MD", "lower", "middle", "upper", "n")


PROFILED = ["N", "prop_w_plastic", P, "average_depth"]


@query("column_profile", over_records(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, min({c})::DOUBLE AS min, {r(f"quantile_cont({c}, 0.25)", "q1")},
    {r(f"median({c})", "median")}, {r(f"avg({c})", "mean")}, {r(f"quantile_cont({c}, 0.75)", "q3")},
    {r(f"max({c})::DOUBLE", "max")}, count(*) - count({c}) AS n_null FROM full_"""
    for c in PROFILED)))
def column_profile(spark, sf_dir):
    return summarise.column_profile(full(spark, sf_dir, *PROFILED), PROFILED)


def _curve_sql(extra: str) -> str:
    return over_records(f"""SELECT publication_year, annual_n, CAST(cum_species AS BIGINT)
        AS cum_species, CAST(cum_n AS BIGINT) AS cum_n, {r("cum_species / nullif(cum_n, 0)", "cpue")} FROM (
        SELECT y.publication_year, annual_n, sum(annual_n) OVER w AS cum_n,
        (SELECT count(*) FROM (SELECT coalesce(binomial, '?') AS b, min(publication_year) AS f
         FROM full_ WHERE {extra} GROUP BY ALL) WHERE f <= y.publication_year) AS cum_species
        FROM (SELECT publication_year, CAST(coalesce(sum(N), 0) AS BIGINT) AS annual_n FROM full_
        WHERE {extra} GROUP BY ALL) y WINDOW w AS (ORDER BY y.publication_year))""")


@query("accumulation_all", _curve_sql("true"))
def accumulation_all(spark, sf_dir):
    return reshape.accumulation(full(spark, sf_dir, "publication_year", "binomial", "N"))


@query("accumulation_ingest", _curve_sql("prop_w_plastic > 0"))
def accumulation_ingest(spark, sf_dir):
    df = full(spark, sf_dir, "publication_year", "binomial", "N", "prop_w_plastic")
    return reshape.accumulation(df.filter("prop_w_plastic > 0"))


@query("fo_in_year", over_records(f"""SELECT {r("sum(prop_w_plastic * N) / sum(N)", "wmean")}
    FROM full_ WHERE publication_year = 2019 AND N IS NOT NULL AND prop_w_plastic IS NOT NULL"""))
def fo_in_year(spark, sf_dir):
    """Mean frequency of one year, weighted by individuals."""
    df = full(spark, sf_dir, "publication_year", "prop_w_plastic", "N")
    return (df.filter("publication_year = 2019").dropna(subset=["N", "prop_w_plastic"])
            .agg(rsem.weighted_mean("prop_w_plastic", "N").alias("wmean")))
