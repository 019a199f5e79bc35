"""Table of the registered queries and the SQL views their checks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions import recode
from driftline.operators.cohort import clean_records
from driftline.session import ship_package
from driftline.sources import starschema

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; results are rounded to 6 digits so that summation order is moot."""
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            df = fn(spark, sf_dir)
            return df.select(*[
                (F.round(f"`{f.name}`", 6) if isinstance(f.dataType, T.DoubleType)
                 else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields])
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def records(spark: SparkSession, sf_dir: str, *columns: str, row_id: bool = False,
            lookup: bool = False) -> DataFrame:
    """Cleaned records with the columns derived from ``columns``."""
    raw = starschema.raw_records(spark, sf_dir, columns, row_id)
    return clean_records(raw, starschema.province_lookup(spark, sf_dir) if lookup else None)


# --- SQL side ------------------------------------------------------------------------


def r(expr: str, alias: str) -> str:
    return f"round({expr}, 6) AS {alias}"


def _groups(col: str, groups: dict, other: str = "NULL") -> str:
    def texts(values):
        return ", ".join(f"'{v}'" for v in values)
    arms = " ".join(f"WHEN {col} IN ({texts(v)}) THEN '{k}'" for k, v in groups.items())
    return f"CASE {arms} ELSE {other} END"


def _swap(col: str, table: dict) -> str:
    arms = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items())
    return f"CASE {col} {arms} ELSE {col} END"


FO = "coalesce(sum(NwP), 0)::DOUBLE / nullif(coalesce(sum(N), 0), 0)::DOUBLE"
SUM_N = "CAST(coalesce(sum(N), 0) AS BIGINT)"
STRICT_N = "CASE WHEN count(N) = count(*) THEN CAST(sum(N) AS BIGINT) END"
STRICT_NWP = "CASE WHEN count(NwP) = count(*) THEN CAST(sum(NwP) AS BIGINT) END"
ROW_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def n_distinct_sql(col: str) -> str:
    return f"count(DISTINCT {col}) + max(CASE WHEN {col} IS NULL THEN 1 ELSE 0 END)"


def study_class_sql(col: str) -> str:
    return f"CASE WHEN {col} > 3 THEN 3.0 WHEN {col} > 1 THEN 2.0 WHEN {col} > 0 THEN 1.0 END::DOUBLE"


def _flag(bad: str) -> str:
    return f"CASE WHEN {bad} THEN 0 ELSE 1 END"


_POLY = _flag("polymer_confirmation IS NULL OR polymer_confirmation = 'none'")
_BLANK = _flag("blanks_used IS NULL OR blanks_used IN ('no', 'not described')")
_CLEAN = _flag("clean_lab_procedures_used IS NULL"
               " OR clean_lab_procedures_used IN ('no', 'not described')")
_SIZE = _flag("smallest_detection_size_limits_mm IS NULL")
_PROV = _swap("raw.ProvCode", recode.PROVINCE_REPAIRS)

RECORDS_SQL = f"""
WITH raw AS ({starschema.raw_records_sql()}),
poll AS ({starschema.province_lookup_sql()}),
rec AS (SELECT raw.* EXCLUDE (ProvCode, prime_forage, family),
  {_PROV} AS ProvCode,
  CASE WHEN prime_forage <> 'not listed' THEN prime_forage END AS prime_forage,
  {_swap("family", recode.FAMILY_REPAIRS)} AS family,
  prop_w_plastic * N AS WeightedProp,
  {_groups("habitat", recode.HABITAT_GROUPS)} AS Found,
  string_split(binomial, ' ')[1] AS genus, string_split(binomial, ' ')[2] AS species,
  {_groups("equipment_used", recode.GEAR_GROUPS)} AS equipment_general,
  {_groups("capture_purpose", recode.CAPTURE_GROUPS)} AS capture_general,
  CASE WHEN publication_year >= 2017 THEN 'after' WHEN publication_year < 2017 THEN 'before' END
    AS brk_pt_MD,
  CASE poll.adjacency WHEN 1 THEN 'coastal' WHEN 0 THEN 'oceanic' END AS adjacency,
  poll.mean_poll_abund AS mean_poll_abund,
  CASE WHEN water_type IS NULL THEN NULL WHEN water_type = 'estuarine' THEN 'estuarine'
       WHEN poll.adjacency = 1 THEN 'coastal' WHEN poll.adjacency = 0 THEN 'oceanic' END
    AS adjacency_water,
  CASE WHEN method_type = '3' THEN 1 WHEN method_type <> '3' THEN 0 END AS meth_3_YN,
  {_POLY} AS poly_conf_YN, {_BLANK} AS blanks_used_YN, {_CLEAN} AS clean_lab_YN,
  {_SIZE} AS min_size_YN, {_POLY} + {_BLANK} + {_CLEAN} + {_SIZE} AS overall_reliability
  FROM raw LEFT JOIN poll ON {_PROV} IS NOT DISTINCT FROM poll.ProvCode
  WHERE source <> 'Sun et al. 2019'),
full_ AS (SELECT * FROM rec WHERE includes_microplastic = 'Y')
"""


def over_records(body: str) -> str:
    """A check query over ``raw``, ``rec`` (cleaned) and ``full_`` (cohort)."""
    return RECORDS_SQL + body
