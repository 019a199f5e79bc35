"""CSV readers and writers with the two missing-value conventions of the scripts."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: columns of the record table and the province lookup ----------------

RECORD_SCHEMA = T.StructType([
    T.StructField(name, kind()) for name, kind in [
        ("binomial", T.StringType), ("family", T.StringType), ("order", T.StringType),
        ("common_name", T.StringType), ("habitat", T.StringType),
        ("prime_forage", T.StringType), ("water_type", T.StringType),
        ("source", T.StringType), ("publication_year", T.IntegerType),
        ("method_type", T.StringType), ("includes_microplastic", T.StringType),
        ("NwP", T.LongType), ("N", T.LongType), ("prop_w_plastic", T.DoubleType),
        ("mean_num_particles_per_indv", T.DoubleType), ("average_depth", T.DoubleType),
        ("trophic_level_via_fishbase", T.DoubleType),
        ("vulnerability_score_via_fishbase_from_cheug_et_al_2005", T.DoubleType),
        ("iucn_status", T.StringType), ("commercial", T.StringType),
        ("aquaculture", T.StringType), ("recreational", T.StringType),
        ("equipment_used", T.StringType), ("capture_purpose", T.StringType),
        ("polymer_confirmation", T.StringType), ("blanks_used", T.StringType),
        ("clean_lab_procedures_used", T.StringType),
        ("smallest_detection_size_limits_mm", T.DoubleType),
        ("oceanographic_province_from_longhurst_2007", T.StringType),
    ]
])

LOOKUP_SCHEMA = T.StructType([
    T.StructField("_rowname", T.IntegerType()), T.StructField("ProvCode", T.StringType()),
    T.StructField("ProvDescr", T.StringType()), T.StructField("adjacency", T.IntegerType()),
    T.StructField("mean_poll_abund", T.DoubleType()), T.StructField("plasticbin", T.StringType()),
])

# ------------------------------------------------------------------------------------


def snake_case(name: str) -> str:
    """Header text to snake_case: ``NwP`` -> ``nw_p``, punctuation becomes a separator."""
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.strip())
    name = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)
    name = re.sub(r"[^A-Za-z0-9]+", "_", name).strip("_").lower()
    return name if name and not name[0].isdigit() else f"x{name}"


def clean_names(df: DataFrame) -> DataFrame:
    """Rename all columns to snake_case; repeats get ``_2``, ``_3``, ..."""
    seen: dict[str, int] = {}
    names = []
    for name in map(snake_case, df.columns):
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def read_table(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None,
               blank_is_null: bool = True, header: bool = True,
               na: str = "NA") -> DataFrame:
    """Read CSV.  ``blank_is_null=False`` keeps blank strings and nulls only ``na``.

    With a schema the file is read once; without one all columns are strings, so that
    no inference pass runs.
    """
    # Spark turns an unquoted blank into null whatever nullValue says, so the reader
    # that keeps blanks takes a value no file holds and sorts the two cases out after.
    reader = (spark.read.option("header", header).option("escape", '"')
              .option("emptyValue", "").option("nullValue", na if blank_is_null else "\u0001"))
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(path)

    def fix(field: T.StructField):
        x = F.col(f"`{field.name}`")
        if not isinstance(field.dataType, T.StringType):
            return x
        if blank_is_null:
            return F.nullif(x, F.lit("")).alias(field.name)
        return F.nullif(F.coalesce(x, F.lit("")), F.lit(na)).alias(field.name)

    return df.select(*[fix(f) for f in df.schema.fields])


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Record table by header position, renamed to the working names."""
    return (read_table(spark, path, RECORD_SCHEMA)
            .withColumnRenamed("oceanographic_province_from_longhurst_2007", "ProvCode"))


def read_lookup(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Province lookup; the unnamed row-name column is dropped."""
    return read_table(spark, path, LOOKUP_SCHEMA).drop("_rowname")


def write_table(df: DataFrame, path: str, order: Iterable = (), fmt: str = "csv") -> None:
    """Write a result; ``order`` sorts it across files (range partitioned)."""
    order = list(order)
    out = df.orderBy(*order) if order else df
    writer = out.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).option("nullValue", "NA").csv(path)
    else:
        writer.format(fmt).save(path)
