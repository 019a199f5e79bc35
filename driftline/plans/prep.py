"""Queries for sources, recodings, cohorts and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftline.functions import binning, recode, rsem, text
from driftline.operators import cohort, reshape
from driftline.plans.registry import (ORACLES, _groups, _swap, over_records, query, r, records)
from driftline.session import scratch_dir
from driftline.sources import starschema, tables

COUNT = "count(*) AS n_rows"


def n_rows():
    return F.count(F.lit(1)).alias("n_rows")


def _counts(name: str, sql_cols: str, needs: tuple[str, ...], *exprs, lookup: bool = False) -> None:
    """A recoding query: rows per combination of input and output values.

    Output columns are names, or functions that build the column within a session.
    """
    def run(spark, sf_dir):
        df = records(spark, sf_dir, *needs, lookup=lookup)
        cols = [F.col(e) if isinstance(e, str) else e() for e in exprs]
        return df.groupBy(*cols).agg(n_rows())
    query(name, over_records(f"SELECT {sql_cols}, {COUNT} FROM rec GROUP BY ALL"))(run)


_counts("found_recode", "habitat, Found", ("source", "habitat"), "habitat", "Found")
_counts("gear_recode", "equipment_used, equipment_general", ("source", "equipment_used"),
        "equipment_used", "equipment_general")
_counts("capture_recode", "capture_purpose, capture_general", ("source", "capture_purpose"),
        "capture_purpose", "capture_general")
_counts("na_if", "prime_forage", ("source", "prime_forage"), "prime_forage")
_counts("adjacency_water", "water_type, adjacency, adjacency_water",
        ("source", "ProvCode", "water_type"), "water_type", "adjacency", "adjacency_water",
        lookup=True)
_counts("break_point", "publication_year, brk_pt_MD", ("source", "publication_year"),
        "publication_year", "brk_pt_MD")
_counts("commercial_collapse",
        f"""commercial, {_groups("commercial", recode.COMMERCIAL_GROUPS, "commercial")} AS narrow,
        {_groups("commercial", recode.COMMERCIAL_GROUPS_WIDE, "commercial")} AS wide""",
        ("source", "commercial"), "commercial",
        lambda: recode.commercial_status("commercial").alias("narrow"),
        lambda: recode.commercial_status("commercial", wide=True).alias("wide"))
_counts("level_index",
        """method_type, CAST(CASE method_type WHEN '3' THEN 1 WHEN '1' THEN 2 END AS INT)
        AS level""", ("source", "method_type"), "method_type",
        lambda: rsem.level_index("method_type", ["3", "1"]).alias("level"))
_counts("adjacency_flag",
        f"""ProvCode, CAST(CASE WHEN ProvCode IN ({", ".join(f"'{c}'" for c in
        recode.COASTAL_PROVINCES)}) THEN 1 WHEN ProvCode IS NOT NULL THEN 0 END AS INT) AS
        adjacency""", ("source", "ProvCode"), "ProvCode",
        lambda: recode.coastal_flag("ProvCode").alias("adjacency"))
_counts("binomial_split", "binomial, genus, species", ("source", "binomial"), "binomial",
        "genus", "species")
_counts("binomial_abbrev",
        """binomial, substr(binomial, 1, 1) || '.' || CASE WHEN contains(binomial, ' ')
        THEN substr(binomial, strpos(binomial, ' ')) ELSE 'NA' END AS short""",
        ("source", "binomial"), "binomial", lambda: text.abbreviate("binomial").alias("short"))
_counts("tip_clean",
        """binomial, nullif(regexp_extract(replace(binomial, '_', ' '),
        '[A-Z][a-z]+ [a-z]+'), '') AS tip""", ("source", "binomial"), "binomial",
        lambda: text.clean_tip(F.replace("binomial", F.lit(" "), F.lit("_"))).alias("tip"))
_counts("log_scale", f"""N, {r("CASE WHEN N > 0 THEN log10(N) END", "log10_n")},
        {r("CASE WHEN mean_num_particles_per_indv > 0 THEN ln(mean_num_particles_per_indv) END",
           "ln_particles")}""", ("source", "N", "mean_num_particles_per_indv"), "N",
        lambda: F.round(rsem.log_or_null("N", base10=True), 6).alias("log10_n"),
        lambda: F.round(rsem.log_or_null("mean_num_particles_per_indv"), 6).alias("ln_particles"))
_counts("vulnerability_class",
        """v AS score, CASE WHEN v <= 20 THEN 'low' WHEN v <= 40 THEN 'low-moderate'
        WHEN v <= 60 THEN 'moderate-high' WHEN v <= 80 THEN 'high-very high'
        WHEN v > 80 THEN 'very high' END AS category""",
        ("source", "vulnerability_score_via_fishbase_from_cheug_et_al_2005"),
        lambda: F.col("vulnerability_score_via_fishbase_from_cheug_et_al_2005").alias("score"),
        lambda: binning.vulnerability_class("vulnerability_score_via_fishbase_from_cheug_et_al_2005")
        .alias("category"))
ORACLES["vulnerability_class"] = ORACLES["vulnerability_class"].replace(
    "FROM rec", "FROM (SELECT vulnerability_score_via_fishbase_from_cheug_et_al_2005 AS v"
    " FROM rec)")


@query("prov_repair", over_records(f"""SELECT ProvCode AS raw_code,
    {_swap("ProvCode", recode.PROVINCE_REPAIRS)} AS code, {COUNT} FROM raw GROUP BY ALL"""))
def prov_repair(spark, sf_dir):
    raw = starschema.raw_records(spark, sf_dir, ["ProvCode"])
    return raw.groupBy(F.col("ProvCode").alias("raw_code"),
                       recode.repair_province("ProvCode").alias("code")).agg(n_rows())


@query("family_repair", over_records(f"""SELECT family AS raw_family,
    {_swap("family", recode.FAMILY_REPAIRS)} AS fixed_family, {COUNT} FROM raw GROUP BY ALL"""))
def family_repair(spark, sf_dir):
    raw = starschema.raw_records(spark, sf_dir, ["family"])
    return raw.groupBy(F.col("family").alias("raw_family"),
                       recode.repair_family("family").alias("fixed_family")).agg(n_rows())


@query("weighted_prop", over_records(f"""SELECT ProvCode, {r("sum(WeightedProp)", "weighted")},
    count(WeightedProp) AS n_known FROM rec GROUP BY ProvCode"""))
def weighted_prop(spark, sf_dir):
    df = records(spark, sf_dir, "source", "ProvCode", "prop_w_plastic", "N")
    return df.groupBy("ProvCode").agg(F.sum("WeightedProp").alias("weighted"),
                                      F.count("WeightedProp").alias("n_known"))


QUALITY_INPUTS = ("method_type", "polymer_confirmation", "blanks_used",
                  "clean_lab_procedures_used", "smallest_detection_size_limits_mm")
FLAGS = ["meth_3_YN", "poly_conf_YN", "blanks_used_YN", "clean_lab_YN", "min_size_YN",
         "overall_reliability"]


@query("qa_flags", over_records(f"SELECT {', '.join(FLAGS)}, {COUNT} FROM rec GROUP BY ALL"))
def qa_flags(spark, sf_dir):
    df = cohort.with_quality(records(spark, sf_dir, "source", *QUALITY_INPUTS))
    return df.groupBy(*FLAGS).agg(n_rows())


ROUND_TRIP = ["binomial", "family", "source", "publication_year", "NwP", "N", "prop_w_plastic",
              "mean_num_particles_per_indv", "blanks_used"]


@query("src_records", over_records(f"""SELECT family, blanks_used, {COUNT},
    count(binomial) AS n_named, CAST(sum(N) AS BIGINT) AS n_total, {r("sum(prop_w_plastic)", "s")},
    {r("avg(mean_num_particles_per_indv)", "m")}, count(NwP) AS n_known,
    max(publication_year) AS last_year FROM raw GROUP BY ALL"""))
def src_records(spark, sf_dir):
    """Records out to CSV and back through the reader."""
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    raw = starschema.raw_records(spark, sf_dir, ROUND_TRIP)
    tables.write_table(raw, path)
    back = tables.read_table(spark, path, raw.schema)
    return back.groupBy("family", "blanks_used").agg(
        n_rows(), F.count("binomial").alias("n_named"), F.sum("N").alias("n_total"),
        F.sum("prop_w_plastic").alias("s"), F.avg("mean_num_particles_per_indv").alias("m"),
        F.count("NwP").alias("n_known"), F.max("publication_year").alias("last_year"))


@query("src_blanks", over_records(f"""SELECT 'kept' AS reader, CASE blanks_used WHEN 'no' THEN '' ELSE blanks_used
    END AS blanks_used, {COUNT} FROM raw GROUP BY ALL UNION ALL SELECT 'null', nullif(blanks_used, 'no') AS blanks_used,
    {COUNT} FROM raw GROUP BY ALL"""))
def src_blanks(spark, sf_dir):
    """One CSV with blanks and NA, read with both missing-value conventions."""
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    raw = starschema.raw_records(spark, sf_dir, ["blanks_used", "family"])
    blank = F.when(F.col("blanks_used") == "no", "").otherwise(F.col("blanks_used")).alias("blanks_used")
    tables.write_table(raw.select(blank, "family"), path)
    kept, null = (tables.read_table(spark, path, raw.schema, blank_is_null=b).groupBy("blanks_used").agg(n_rows())
                  for b in (False, True))
    return (kept.withColumn("reader", F.lit("kept")).unionByName(null.withColumn("reader", F.lit("null")))
            .select("reader", "blanks_used", "n_rows"))


@query("src_lookup", over_records(f"""SELECT nullif(ProvCode, '') AS ProvCode, ProvDescr, CAST(adjacency AS INT) AS adjacency,
    {r("mean_poll_abund", "mean_poll_abund")}, CASE WHEN mean_poll_abund > 1000 THEN '>1000' END AS plasticbin
    FROM poll"""))
def src_lookup(spark, sf_dir):
    """The province lookup out to CSV with row names in an unnamed first column, and back; its blanks are nulls."""
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    lookup = starschema.province_lookup(spark, sf_dir).withColumn("plasticbin", F.when(F.col("mean_poll_abund") > 1000, ">1000"))
    named = lookup.select(F.monotonically_increasing_id().alias("row"), *lookup.columns)
    tables.write_table(named.toDF("", *lookup.columns), path)
    return tables.read_lookup(spark, path)


@query("clean_names", over_records(f"""SELECT method_type, CAST(sum(NwP) AS BIGINT) AS nw_p,
    CAST(sum(N) AS BIGINT) AS n, {r("avg(prop_w_plastic)", "prop_w_plastic")},
    {COUNT} FROM raw GROUP BY ALL"""))
def clean_names(spark, sf_dir):
    raw = starschema.raw_records(spark, sf_dir, ["method_type", "NwP", "N", "prop_w_plastic"])
    messy = raw.toDF("Method.type", "NwP", "N", "Prop w plastic")
    return tables.clean_names(messy).groupBy("method_type").agg(
        F.sum("nw_p").alias("nw_p"), F.sum("n").alias("n"),
        F.avg("prop_w_plastic").alias("prop_w_plastic"), n_rows())


@query("join_poll", over_records(f"""SELECT ProvCode, adjacency,
    {r("mean_poll_abund", "mean_poll_abund")}, {COUNT} FROM rec GROUP BY ALL"""))
def join_poll(spark, sf_dir):
    df = records(spark, sf_dir, "source", "ProvCode", lookup=True)
    return df.groupBy("ProvCode", "adjacency", "mean_poll_abund").agg(n_rows())


def _size(df):
    return df.agg(n_rows(), F.sum("N").alias("n_total"))


SIZE_SQL = f"SELECT {COUNT}, CAST(sum(N) AS BIGINT) AS n_total FROM"


@query("cohort_base", over_records(f"{SIZE_SQL} rec"))
def cohort_base(spark, sf_dir):
    return _size(records(spark, sf_dir, "source", "N"))


@query("cohort_micro", over_records(f"{SIZE_SQL} full_"))
def cohort_micro(spark, sf_dir):
    return _size(cohort.microplastic_cohort(
        records(spark, sf_dir, "source", "includes_microplastic", "N")))


@query("cohort_map", over_records(f"""{SIZE_SQL} rec WHERE includes_microplastic IN ('Y', 'Y?')
    AND water_type = 'marine' AND ProvCode <> ''"""))
def cohort_map(spark, sf_dir):
    return _size(cohort.map_cohort(records(spark, sf_dir, "source", "includes_microplastic",
                                           "water_type", "ProvCode", "N")))


@query("cohort_toggle", over_records(f"""{SIZE_SQL} full_ WHERE method_type = '3'
    AND adjacency_water <> 'estuarine' AND publication_year > 2009 AND average_depth < 1500
    AND average_depth > 100 AND ProvCode IN ('MEDI', 'NECS', 'NASE', 'KURO')"""))
def cohort_toggle(spark, sf_dir):
    df = records(spark, sf_dir, "source", "includes_microplastic", "method_type", "water_type",
                 "ProvCode", "publication_year", "average_depth", "N", lookup=True)
    return _size(cohort.microplastic_cohort(
        df, method="3", exclude_water="estuarine", years_after=2009, max_depth=1500,
        min_depth=100, provinces=["MEDI", "NECS", "NASE", "KURO"]))


@query("not_in_keep_null", over_records(f"""{SIZE_SQL} rec
    WHERE species IS NULL OR species NOT IN ('sp.', 'spp.', 'spp')"""))
def not_in_keep_null(spark, sf_dir):
    df = records(spark, sf_dir, "source", "binomial", "N")
    return _size(df.filter(rsem.not_in("species", recode.UNNAMED_SPECIES)))


def _complete_sql() -> str:
    parts = []
    for name, (cols, extra) in cohort.MODEL_COHORTS.items():
        cond = " AND ".join(f"{starschema.quoted(c)} IS NOT NULL" for c in cols)
        parts.append(f"""SELECT '{name}' AS model, count(*) AS n_rows FROM full_
            WHERE {cond}{' AND ' + extra if extra else ''}""")
    return over_records(" UNION ALL ".join(parts))


@query("complete_cases", _complete_sql())
def complete_cases(spark, sf_dir):
    """Cohort size of every model from one scan."""
    df = cohort.microplastic_cohort(records(
        spark, sf_dir, "source", "includes_microplastic", "N", "NwP", "order", "method_type",
        "prime_forage", "average_depth", "habitat", "trophic_level_via_fishbase", "ProvCode",
        "water_type", "publication_year", "mean_num_particles_per_indv", lookup=True))
    counts = []
    for name, (cols, extra) in cohort.MODEL_COHORTS.items():
        cond = F.expr(extra) if extra else F.lit(True)
        for c in cols:
            cond = cond & F.col(c).isNotNull()
        counts.append(F.count_if(cond).alias(name))
    return df.agg(*counts).unpivot([], list(cohort.MODEL_COHORTS), "model", "n_rows")


@query("limit_clip", over_records(f"""SELECT Found, {COUNT} FROM full_
    WHERE average_depth BETWEEN 0 AND 350 AND smallest_detection_size_limits_mm BETWEEN 0 AND 1
    AND N > 0 AND log10(N) BETWEEN 0 AND 4 GROUP BY Found"""))
def limit_clip(spark, sf_dir):
    df = cohort.microplastic_cohort(records(
        spark, sf_dir, "source", "includes_microplastic", "average_depth", "habitat",
        "smallest_detection_size_limits_mm", "N"))
    return (df.filter(F.col("average_depth").between(0, 350)
                      & F.col("smallest_detection_size_limits_mm").between(0, 1)
                      & rsem.log_or_null("N", base10=True).between(0, 4))
            .groupBy("Found").agg(n_rows()))


@query("union_batches", over_records(f"""SELECT batch, count(DISTINCT binomial) AS n_names,
    {COUNT} FROM (SELECT 'named' AS batch, binomial FROM rec WHERE species IS NOT NULL
    UNION ALL SELECT 'other', binomial FROM rec WHERE species IS NULL) GROUP BY batch"""))
def union_batches(spark, sf_dir):
    df = records(spark, sf_dir, "source", "binomial")
    named = df.filter(F.col("species").isNotNull()).select(F.lit("named").alias("batch"),
                                                          "binomial")
    other = df.filter(F.col("species").isNull()).select("binomial", F.lit("other").alias("batch"))
    return named.unionByName(other).groupBy("batch").agg(
        F.count_distinct("binomial").alias("n_names"), n_rows())


@query("scale_depth", over_records(f"""SELECT average_depth,
    {r("(average_depth - (SELECT avg(average_depth) FROM full_)) / (SELECT stddev_samp(average_depth) FROM full_)", "z_average_depth")},
    {COUNT} FROM full_ GROUP BY average_depth"""))
def scale_depth(spark, sf_dir):
    df = cohort.microplastic_cohort(records(spark, sf_dir, "source", "includes_microplastic",
                                            "average_depth"))
    return reshape.standardise(df, "average_depth").groupBy(
        "average_depth", "z_average_depth").agg(n_rows())


@query("expand_rows", over_records(f"""SELECT brk_pt_MD, CAST(sum(N) AS BIGINT) AS n_rows,
    {r("sum(prop_w_plastic * N) / sum(CASE WHEN prop_w_plastic IS NOT NULL THEN N END)", "mean_prop")}
    FROM full_ WHERE N > 0 GROUP BY brk_pt_MD"""))
def expand_rows(spark, sf_dir):
    df = cohort.microplastic_cohort(records(
        spark, sf_dir, "source", "includes_microplastic", "publication_year", "prop_w_plastic",
        "N"))
    return reshape.repeat_rows(df, "N").groupBy("brk_pt_MD").agg(
        n_rows(), F.avg("prop_w_plastic").alias("mean_prop"))


@query("study_backfill", over_records(f"""SELECT d.lang, l.quality, count(*) AS n_rows,
    count(l.doc_id) AS n_matched, count(DISTINCT d.source) AS n_sources
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL"""))
def study_backfill(spark, sf_dir):
    """Left join that leaves most rows unmatched."""
    docs = starschema.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = (starschema.table(spark, sf_dir, "labels")
              .select("doc_id", "quality", F.col("doc_id").alias("hit")))
    return docs.join(labels, "doc_id", "left").groupBy("lang", "quality").agg(
        n_rows(), F.count("hit").alias("n_matched"), F.count_distinct("source").alias("n_sources"))


@query("study_list_records", over_records("""SELECT s.method_type, count(*) AS n_joined,
    count(rec.source) AS n_matched, count(DISTINCT s.source) AS n_studies,
    CAST(sum(rec.N) AS BIGINT) AS n_total
    FROM (SELECT DISTINCT source, method_type FROM rec) s LEFT JOIN rec ON s.source = rec.source
    GROUP BY s.method_type"""))
def study_list_records(spark, sf_dir):
    """The list of studies and methods, joined to the records of each study."""
    df = records(spark, sf_dir, "source", "method_type", "N")
    studies = df.select("source", "method_type").distinct()
    found = df.select(F.col("source").alias("hit"), "N")
    return studies.join(found, F.col("source") == F.col("hit"), "left").groupBy("method_type").agg(
        F.count(F.lit(1)).alias("n_joined"), F.count("hit").alias("n_matched"),
        F.count_distinct("source").alias("n_studies"), F.sum("N").alias("n_total"))
