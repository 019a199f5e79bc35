"""Queries for provinces: summaries, bins, zones and map tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftline.functions import binning, recode, rsem, text
from driftline.operators import cohort, summarise, zonal
from driftline.plans.prep import QUALITY_INPUTS
from driftline.plans.registry import (FO, SUM_N, n_distinct_sql, over_records, query, r, records)
from driftline.plans.summaries import full
from driftline.session import scratch_dir
from driftline.sources import grid, starschema

PROV_INPUTS = ("ProvCode", "NwP", "N", "binomial")
SUMMARY_SQL = f""", prov AS (SELECT ProvCode, {r(FO, "aveplast")}, {SUM_N} AS numfish,
    {n_distinct_sql("source")} AS numstudies, {n_distinct_sql("species")} AS numspecies,
    {r(f"({FO}) * coalesce(sum(N), 0)", "normalized")} FROM full_ GROUP BY ProvCode)"""


def summary(spark, sf_dir):
    return summarise.province_summary(full(spark, sf_dir, *PROV_INPUTS))


@query("prov_summary", over_records(SUMMARY_SQL + " SELECT * FROM prov"))
def prov_summary(spark, sf_dir):
    return summary(spark, sf_dir)


@query("prov_reliability", over_records("""SELECT ProvCode, round(median(rel), 6)
    AS medianreliability FROM (SELECT ProvCode, source, avg(overall_reliability) AS rel FROM full_
    GROUP BY ALL) GROUP BY ProvCode"""))
def prov_reliability(spark, sf_dir):
    return summarise.province_reliability(full(spark, sf_dir, "ProvCode", *QUALITY_INPUTS))


@query("prov_check", over_records(f"""SELECT {n_distinct_sql("source")} AS n_studies,
    {r(FO, "overallprop")}, {r("avg(prop_w_plastic)", "mean_prop")},
    CAST(CASE WHEN count(N) = count(*) THEN sum(N) END AS BIGINT) AS n_strict,
    count(*) AS n_rows, {n_distinct_sql("species")} AS n_species
    FROM full_ WHERE ProvCode = 'KURO'"""))
def prov_check(spark, sf_dir):
    df = full(spark, sf_dir, *PROV_INPUTS, "prop_w_plastic").filter("ProvCode = 'KURO'")
    return df.agg(rsem.n_distinct("source").alias("n_studies"),
                  rsem.frequency().alias("overallprop"), F.avg("prop_w_plastic").alias("mean_prop"),
                  rsem.sum_strict("N").alias("n_strict"), F.count(F.lit(1)).alias("n_rows"),
                  rsem.n_distinct("species").alias("n_species"))


@query("prov_counts", over_records("""SELECT ProvCode, count(*) AS n_rows FROM rec
    WHERE includes_microplastic IN ('Y', 'Y?') AND water_type = 'marine' AND ProvCode <> ''
    GROUP BY ProvCode"""))
def prov_counts(spark, sf_dir):
    df = cohort.map_cohort(records(spark, sf_dir, "source", "includes_microplastic", "water_type",
                                   "ProvCode"))
    return df.groupBy("ProvCode").agg(F.count(F.lit(1)).alias("n_rows"))


@query("prov_range", over_records(f"""SELECT count(*) AS n_rows,
    {n_distinct_sql("ProvCode")} AS n_provinces, min(N) AS low, max(N) AS high FROM rec"""))
def prov_range(spark, sf_dir):
    return records(spark, sf_dir, "source", "ProvCode", "N").agg(
        F.count(F.lit(1)).alias("n_rows"), rsem.n_distinct("ProvCode").alias("n_provinces"),
        F.min("N").alias("low"), F.max("N").alias("high"))


@query("prov_sorted", over_records(SUMMARY_SQL + """ SELECT ProvCode, numfish FROM prov
    ORDER BY numfish, ProvCode"""))
def prov_sorted(spark, sf_dir):
    return summary(spark, sf_dir).select("ProvCode", "numfish").orderBy("numfish", "ProvCode")


@query("top_provinces", over_records(SUMMARY_SQL + """ SELECT ProvCode, numfish FROM prov
    ORDER BY numfish DESC, ProvCode NULLS LAST LIMIT 10"""))
def top_provinces(spark, sf_dir):
    return (summary(spark, sf_dir).select("ProvCode", "numfish")
            .orderBy(F.desc("numfish"), F.asc_nulls_last("ProvCode")).limit(10))


@query("prov_labels", over_records(SUMMARY_SQL + """ SELECT ProvCode,
    ProvCode || ' (n=' || numfish || ')' AS labels FROM prov"""))
def prov_labels(spark, sf_dir):
    return summary(spark, sf_dir).select("ProvCode",
                                         text.sample_label("ProvCode", "numfish").alias("labels"))


def _size_case(x: str, low: str) -> str:
    return f"""CASE WHEN {x} > 1500 THEN '>1500' WHEN {x} > 1000 THEN '1001-1500'
        WHEN {x} > 500 THEN '501-1000' WHEN {x} > 100 AND {x} < 500 THEN '101-500'
        WHEN {x} > 50 AND {x} <= 100 THEN '51-100' WHEN {x} >= 10 AND {x} <= 50 THEN '10-50'
        WHEN {low} THEN '< 10' END"""


FISH_CASE = _size_case("numfish", "numfish > 1 AND numfish < 10")
NORM_CASE = _size_case("normalized", "normalized >= 1 AND normalized < 25")
STUDY_CASE = """CASE WHEN numstudies >= 10 THEN '>10' WHEN numstudies > 5 THEN '6-10'
    WHEN numstudies > 1 THEN '2-5' WHEN numstudies = 1 THEN '1' END"""


def _fo_case(top: str) -> str:
    """Deciles of ``aveplast``; ``top`` is the label of (.99, 1) and of values above 1."""
    arms = " ".join(f"WHEN aveplast <= {k / 10 if k < 10 else 0.99} THEN '{label}'"
                    for k, label in enumerate(
        ["<.10", ".11-.20", ".21-.30", ".31-.40", ".41-.50", ".51-.60", ".61-.70", ".71-.80",
         ".81-.90", ".91-.99"], 1))
    return f"CASE {arms} WHEN aveplast = 1 THEN '1' WHEN aveplast IS NOT NULL THEN {top} END"


# bins are tried on many small groups, so that every class occurs
CELLS_SQL = f""", cell AS (SELECT ProvCode, binomial, family, {FO} AS aveplast,
    {SUM_N} AS numfish, {n_distinct_sql("source")} AS numstudies,
    ({FO}) * coalesce(sum(N), 0) AS normalized FROM full_
    GROUP BY ProvCode, binomial, family)"""


def _bin_query(name: str, sql: str, make) -> None:
    def run(spark, sf_dir):
        df = full(spark, sf_dir, "family", *PROV_INPUTS)
        cells = df.groupBy("ProvCode", "binomial", "family").agg(
            rsem.frequency().alias("aveplast"),
            rsem.sum_skip_null("N").alias("numfish"),
            rsem.n_distinct("source").alias("numstudies"),
            (rsem.frequency() * rsem.sum_skip_null("N")).alias("normalized"))
        return cells.groupBy(make().alias("bin")).agg(
            F.count(F.lit(1)).alias("n_groups"), F.sum("numfish").alias("n_total"))
    query(name, over_records(f"""{CELLS_SQL} SELECT {sql} AS bin, count(*) AS n_groups,
        CAST(sum(numfish) AS BIGINT) AS n_total FROM cell GROUP BY ALL"""))(run)


_bin_query("bin_fo", _fo_case("NULL"), lambda: binning.fo_bin("aveplast"))
_bin_query("bin_fo_faithful", _fo_case("'.11-.20'"),
           lambda: binning.fo_bin("aveplast", faithful=True))
_bin_query("bin_studies", STUDY_CASE, lambda: binning.studies_bin("numstudies"))
_bin_query("bin_fish", FISH_CASE, lambda: binning.fish_bin("numfish"))
_bin_query("bin_norm", NORM_CASE, lambda: binning.normalized_bin("normalized"))

POLL_CASE = """CASE WHEN v >= 1000000 THEN '>10e6' WHEN v >= 100000 THEN '10e6'
    WHEN v >= 10000 THEN '10e4' WHEN v >= 1000 THEN '10e3' WHEN v >= 100 THEN '10e2'
    WHEN v >= 10 THEN '10e1' WHEN v >= 1 THEN '10e0' END"""


@query("bin_pollution", over_records(f"""SELECT {POLL_CASE} AS plasticbin, count(*) AS n_rows
    FROM (SELECT mean_poll_abund * prop_w_plastic AS v FROM rec) GROUP BY ALL"""))
def bin_pollution(spark, sf_dir):
    df = records(spark, sf_dir, "source", "ProvCode", "prop_w_plastic", lookup=True)
    value = F.col("mean_poll_abund") * F.col("prop_w_plastic")
    return df.groupBy(binning.pollution_bin(value).alias("plasticbin")).agg(
        F.count(F.lit(1)).alias("n_rows"))


# --- grid and zones ------------------------------------------------------------------


def over_grid(body: str) -> str:
    return f"{starschema.grid_sql()} {body}"


def edges(spark, sf_dir):
    return grid.edges_from_vertices(starschema.polygon_vertices(spark, sf_dir))


def zones(spark, sf_dir):
    return zonal.zonal_stats(starschema.grid_cells(spark, sf_dir), edges(spark, sf_dir),
                             starschema.grid_extent(spark, sf_dir))


@query("grid_long", over_grid(f"""SELECT row, col, {r("lon", "lon")}, {r("lat", "lat")},
    {r("value", "value")} FROM cells"""))
def grid_long(spark, sf_dir):
    return starschema.grid_cells(spark, sf_dir)


@query("grid_csv", over_grid(f"""SELECT row, CAST((col + 32) % 64 AS INT) AS col,
    {r("-180 + ((col + 32) % 64 + 0.5::DOUBLE) * 354.375::DOUBLE / 64", "lon")},
    {r("(90 - 90 / n) - (row + 0.5::DOUBLE) * ((180 - 180 / n) / n)", "lat")}, {r("value", "value")}
    FROM cells, (SELECT count(*)::DOUBLE AS n FROM embeddings)"""))
def grid_csv(spark, sf_dir):
    """The grid out to CSV with one file per axis, longitudes from 0 to 360 in a header, and back."""
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    cells, extent = starschema.grid_cells(spark, sf_dir), starschema.grid_extent(spark, sf_dir)
    wide = cells.groupBy("row").pivot("col", list(range(extent.ncol))).agg(F.first("value"))
    values, lats, lons = (f"{path}/{part}" for part in ("values", "lats", "lons"))
    (wide.orderBy("row").select(*[F.col(f"`{c}`").alias(f"X{c}") for c in range(extent.ncol)])
     .write.option("header", True).option("nullValue", "NA").csv(values))
    wide.select(extent.lat(F.col("row"))).write.csv(lats)
    spark.range(1).select(*[F.lit(f"X{c * extent.dx}").alias(f"c{c}") for c in range(extent.ncol)]).write.csv(lons)
    return grid.read_grid(spark, values, lats, lons)[0]


@query("lon_wrap", over_records("""SELECT CASE WHEN lon > 179 THEN lon - 360 ELSE lon END AS lon,
    count(*) AS n_rows FROM (SELECT l_partkey % 720 / 2.0::DOUBLE AS lon FROM raw) GROUP BY ALL"""))
def lon_wrap(spark, sf_dir):
    """Half-degree longitudes from 0 to 360 moved to the western hemisphere."""
    lon = F.col("l_partkey") % 720 / 2.0
    return (starschema.table(spark, sf_dir, "lineitem")
            .groupBy(text.wrap_longitude(lon).alias("lon"))
            .agg(F.count(F.lit(1)).alias("n_rows")))


@query("poly_edges", over_grid("SELECT * FROM edges"))
def poly_edges(spark, sf_dir):
    return edges(spark, sf_dir)


@query("zonal_mean", over_grid(
    f"SELECT prov_code, {r('mean_value', 'mean_value')}, n_cells FROM zones"))
def zonal_mean(spark, sf_dir):
    return zones(spark, sf_dir).select("prov_code", "mean_value", "n_cells")


@query("zonal_range", over_grid(f"""SELECT prov_code, {r("min_value", "min_value")},
    {r("max_value", "max_value")} FROM zones"""))
def zonal_range(spark, sf_dir):
    return zones(spark, sf_dir).select("prov_code", "min_value", "max_value")


COAST = ", ".join(f"'{c}'" for c in recode.COASTAL_PROVINCES)
ATTRIBUTES_SQL = f"""attributes AS (SELECT prov_code AS ProvCode,
    CAST(CASE WHEN prov_code IN ({COAST}) THEN 1 ELSE 0 END AS INT) AS adjacency,
    {r("mean_value", "mean_poll_abund")},
    {POLL_CASE.replace("v >=", "mean_value >=")} AS plasticbin FROM zones)"""


def attributes(spark, sf_dir):
    return zonal.province_attributes(zones(spark, sf_dir))


def over_both(body: str) -> str:
    """Records and grid views in one query."""
    return (over_records("").rstrip() + ", " + starschema.grid_sql().removeprefix("WITH ")
            + f", {ATTRIBUTES_SQL} {SUMMARY_SQL} {body}")


@query("prov_attributes", over_grid(f", {ATTRIBUTES_SQL} SELECT * FROM attributes"))
def prov_attributes(spark, sf_dir):
    return attributes(spark, sf_dir)


@query("prov_sampled", over_both("SELECT * FROM attributes JOIN prov USING (ProvCode)"))
def prov_sampled(spark, sf_dir):
    return zonal.sampled_provinces(attributes(spark, sf_dir), summary(spark, sf_dir))


def _level(col: str, levels) -> str:
    arms = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(levels, 1))
    return f"CAST(CASE {col} {arms} END AS INT)"


@query("prov_map_table", over_both(f"""SELECT *,
    {_level("aveplastbin", binning.FO_MAP_LEVELS)} AS aveplast_level,
    {_level("numstudiesbin", binning.STUDY_MAP_LEVELS)} AS numstudies_level,
    {_level("numfishbin", binning.FISH_MAP_LEVELS)} AS numfish_level FROM (
    SELECT *, {_fo_case("NULL")} AS aveplastbin, {STUDY_CASE} AS numstudiesbin,
    {FISH_CASE} AS numfishbin, {NORM_CASE} AS normbin,
    ProvCode || ' (n=' || numfish || ')' AS labels
    FROM attributes LEFT JOIN prov USING (ProvCode))""").replace(
        "ProvCode || ' (n=' || numfish", "ProvCode || ' (n=' || CAST(numfish AS VARCHAR)"))
def prov_map_table(spark, sf_dir):
    bins = summarise.province_bins(summary(spark, sf_dir))
    return zonal.map_table(attributes(spark, sf_dir), bins)
