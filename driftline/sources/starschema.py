"""Record, lookup, grid, polygon and taxonomy views over the driver's star schema.

No table of occurrence records is supplied, so each column of the record table is an
expression over lineitem, part, supplier and orders.  A view joins only the tables its
requested columns need.  The same expressions make up the SQL views used for checking.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import recode


def _choose(index: str, values: Sequence[str | None]) -> str:
    """The value at a 0-based index, written for ``for_spark`` or ``for_check``."""
    texts = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"@[{index}]({texts})@"


def for_spark(expr: str) -> str:
    """Lookups become indexes into a constant array, which keeps generated code short."""
    return re.sub(r"@\[(.*?)\]\((.*?)\)@", r"get(array(\2), CAST(\1 AS INT))", expr)


def for_check(expr: str) -> str:
    return re.sub(r"@\[(.*?)\]\((.*?)\)@", r"list_extract([\2], CAST(\1 AS INT) + 1)", expr)


_GEAR_TEXTS = [v for texts in recode.GEAR_GROUPS.values() for v in texts]
_CAPTURE_TEXTS = [v for texts in recode.CAPTURE_GROUPS.values() for v in texts]

#: province code of each nation key; raw spellings, one blank and one missing
_NATION_CODES = [
    "ALSK", "CCAL", "BPRL", "HUMB", "NAST E", "NPSE", "MEDI", "NECS", "KURO", "CHIN", "SUND",
    "INDE", "NASE", "CARB", "GUIN", "BENG", "EAFR", "ARAB", "NPPF", "PSAG", "SATL", "TASM",
    "NEWZ", "", None,
]
_LOOKUP_CODES = [recode.PROVINCE_REPAIRS.get(c, c) for c in _NATION_CODES]
# two spellings repair to codes that other nations supply; a lookup needs unique codes
_LOOKUP_CODES[4], _LOOKUP_CODES[5] = "APLR", "ANTA"

_QTY = "(CAST(l_quantity AS BIGINT) - 1)"
# the odd factor keeps group means away from decimal ties, where rounding would depend on the
# order of summation
_PROP = ("(l_discount * (1 + s_nationkey % 4 + p_size % 5 + length(p_type) % 3)"
         " * 0.8573219847)")
_YEAR = ("CAST(2008 + 2 * (year(l_shipdate) - 1995)"
         " + CASE WHEN month(l_shipdate) > 6 THEN 1 ELSE 0 END AS INT)")
_GENUS = "concat(upper(substring(p_name, 1, 1)), substring(split_part(p_name, ' ', 1), 2, 99))"
_EPITHET = ("concat(split_part(p_name, ' ', 2), "
            + _choose("p_size % 25", [chr(97 + i) for i in range(25)]) + ")")

#: column -> (expression, tables besides lineitem)
RECORD_COLUMNS: dict[str, tuple[str, tuple[str, ...]]] = {
    "binomial": (f"CASE WHEN p_partkey % 23 = 0 THEN NULL"
                 f" WHEN p_partkey % 17 = 0 THEN concat({_GENUS}, ' sp.')"
                 f" WHEN p_partkey % 19 = 0 THEN {_GENUS}"
                 f" WHEN p_partkey % 29 = 0 THEN concat({_GENUS}, ' ', {_EPITHET}, ' minor')"
                 f" ELSE concat({_GENUS}, ' ', {_EPITHET}) END", ("part",)),
    "family": ("CASE p_brand WHEN 'Brand#1' THEN 'Gasterostediae' WHEN 'Brand#2' THEN 'Merluccidae'"
               " WHEN 'Brand#3' THEN 'Carangidae' WHEN 'Brand#4' THEN 'Mugilidae'"
               " WHEN 'Brand#5' THEN 'Soleidae' WHEN 'Brand#6' THEN 'Myctophidae'"
               " WHEN 'Brand#25' THEN NULL ELSE p_brand END", ("part",)),
    "order": ("CASE WHEN p_size = 50 THEN NULL ELSE p_type END", ("part",)),
    "common_name": ("concat(p_brand, ' ', p_name)", ("part",)),
    "habitat": (_choose("(l_orderkey + l_partkey) % 9",
                        [h for g in recode.HABITAT_GROUPS.values() for h in g] + ["unknown"]), ()),
    "prime_forage": ("CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'not listed'"
                     " WHEN '1-URGENT' THEN 'Scavenging' WHEN '2-HIGH' THEN 'Benthic foraging'"
                     " WHEN '3-MEDIUM' THEN 'Pelagic foraging' ELSE 'Planktivory' END",
                     ("orders",)),
    "water_type": ("CASE WHEN p_size = 7 THEN NULL WHEN o_orderstatus = 'P' THEN 'estuarine'"
                   " ELSE 'marine' END", ("part", "orders")),
    "source": ("CASE WHEN s_suppkey % 50 = 3 THEN 'Sun et al. 2019' ELSE s_name END",
               ("supplier",)),
    "publication_year": (_YEAR, ()),
    "method_type": ("CAST(1 + l_linenumber % 3 AS STRING)", ()),
    "includes_microplastic": ("CASE WHEN l_returnflag = 'N' THEN 'N'"
                              " WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'Y?'"
                              " ELSE 'Y' END", ()),
    "NwP": (f"CASE WHEN l_linenumber = 6 AND l_tax = 0.08 AND l_suppkey % 3 = 1 THEN NULL"
            f" ELSE CAST(floor({_QTY} * {_PROP} + 0.5) AS BIGINT) END", ("part", "supplier")),
    "N": (f"CASE WHEN l_linenumber = 7 AND l_tax = 0.0 AND l_suppkey % 4 = 1 THEN NULL"
          f" ELSE {_QTY} END", ()),
    "prop_w_plastic": (f"CASE WHEN l_linenumber = 5 AND l_tax = 0.0 THEN NULL ELSE {_PROP} END",
                       ("part", "supplier")),
    "mean_num_particles_per_indv": ("round(nullif(l_tax, 0.0) * 100)", ()),
    "average_depth": ("CASE WHEN p_size = 17 THEN NULL ELSE CAST(p_size AS DOUBLE) * 30 END", ("part",)),
    "trophic_level_via_fishbase": ("p_retailprice / 300.0", ("part",)),
    "vulnerability_score_via_fishbase_from_cheug_et_al_2005":
        ("CASE WHEN p_size = 29 THEN NULL ELSE CAST(p_size AS DOUBLE) * 2 END", ("part",)),
    "iucn_status": (_choose("l_partkey % 6", ["LC", "NT", "VU", "EN", "CR", None]), ()),
    "commercial": (_choose("l_partkey % 8", [
        "commercial", "highly commercial", "minor commercial", "subsistence",
        "subsistence fisheries", "none", "unknown", None]), ()),
    "aquaculture": (_choose("l_partkey % 3", ["yes", "no", None]), ()),
    "recreational": (_choose("l_partkey % 4", ["yes", "no", "rarely", None]), ()),
    "equipment_used": (_choose("(l_orderkey + l_linenumber) % 33", [*_GEAR_TEXTS, "other", None]),
                       ()),
    "capture_purpose": (_choose("(l_orderkey + l_suppkey) % 16",
                                [*_CAPTURE_TEXTS, "survey", None]), ()),
    "polymer_confirmation": (_choose("(l_suppkey + length(l_returnflag)) % 4",
                                     ["none", "FTIR", None, "Raman"]), ()),
    "blanks_used": ("CASE WHEN l_suppkey % 3 = 0 THEN nullif(l_returnflag, 'A')"
                    " WHEN l_suppkey % 3 = 1 THEN 'no' ELSE 'yes' END", ()),
    "clean_lab_procedures_used": ("CASE WHEN l_linestatus = 'F' AND l_suppkey % 5 = 1"
                                  " THEN 'not described' WHEN l_suppkey % 7 = 2 THEN 'no'"
                                  " ELSE 'yes' END", ()),
    "smallest_detection_size_limits_mm": ("CAST(nullif(p_size, 13) AS DOUBLE) / 50", ("part",)),
    "ProvCode": (_choose("s_nationkey", _NATION_CODES), ("supplier",)),
}
_ROW_ID = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
_JOINS = {
    "part": ("l_partkey", "p_partkey"),
    "supplier": ("l_suppkey", "s_suppkey"),
    "orders": ("l_orderkey", "o_orderkey"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_records(spark: SparkSession, sf_dir: str, columns: Sequence[str],
                row_id: bool = False) -> DataFrame:
    """The record table with the asked columns, before any cleaning.

    ``row_id`` adds the row order as one comparable struct.
    """
    exprs = {c: for_spark(RECORD_COLUMNS[c][0]) for c in columns}
    needed = {t for c in columns for t in RECORD_COLUMNS[c][1]}
    df, early = table(spark, sf_dir, "lineitem"), set()
    for name, (left, right) in _JOINS.items():
        if name in needed:
            side = table(spark, sf_dir, name)
            # a column of one dimension is computed there, once per dimension row
            own = [c for c in columns
                   if set(re.findall(r"\b([lpso])_\w+", exprs[c])) == {right[0]}]
            side = side.select("*", *[F.expr(exprs[c]).alias(c) for c in own])
            df = df.join(side, F.col(left) == F.col(right))
            early.update(own)
    out = [F.col(c) if c in early else F.expr(exprs[c]).alias(c) for c in columns]
    if row_id:
        out.append(F.struct(*_ROW_ID).alias("row_id"))
    return df.select(*out)


def province_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup of adjacency and mean pollution per province, one row per nation."""
    return table(spark, sf_dir, "nation").select(
        F.expr(for_spark(_choose("n_nationkey", _LOOKUP_CODES))).alias("ProvCode"),
        F.concat(F.lit("Province, "), F.col("n_name")).alias("ProvDescr"),
        (F.col("n_nationkey") % 2).alias("adjacency"),
        F.expr("3.0 * pow(10, n_nationkey % 8)").alias("mean_poll_abund"))


def quoted(name: str) -> str:
    return '"order"' if name == "order" else name


def raw_records_sql() -> str:
    """The same record table as one SQL query (all columns and the row order)."""
    cols = ", ".join(f"{for_check(e)} AS {quoted(c)}" for c, (e, _) in RECORD_COLUMNS.items())
    return (f"SELECT {cols}, {', '.join(_ROW_ID)} FROM lineitem"
            " JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"
            " JOIN orders ON l_orderkey = o_orderkey")


def province_lookup_sql() -> str:
    return (f"SELECT {for_check(_choose('n_nationkey', _LOOKUP_CODES))} AS ProvCode,"
            " concat('Province, ', n_name) AS ProvDescr, n_nationkey % 2 AS adjacency,"
            " 3.0 * pow(10, n_nationkey % 8) AS mean_poll_abund FROM nation")


# --- grid and polygons ---------------------------------------------------------------
# The embedding vectors serve as the rows of a grid, and every supplier owns one polygon
# part of its nation's province, placed by its key.

#: (shape, ring, seq, dx, dy): box, concave outline, frame with a hole, diamond
SHAPES = [
    *[(0, 0, i, x, y) for i, (x, y) in enumerate([(0, 0), (20, 0), (20, 12), (0, 12)])],
    *[(1, 0, i, x, y) for i, (x, y) in enumerate(
        [(0, 0), (18, 0), (18, 5), (7, 5), (7, 14), (0, 14)])],
    *[(2, 0, i, x, y) for i, (x, y) in enumerate([(0, 0), (22, 0), (22, 16), (0, 16)])],
    *[(2, 1, i, x, y) for i, (x, y) in enumerate([(6, 5), (6, 11), (14, 11), (14, 5)])],
    *[(3, 0, i, x, y) for i, (x, y) in enumerate([(10, 0), (20, 8), (10, 16), (0, 8)])],
]
_ZONE = f"coalesce({_choose('s_nationkey', _LOOKUP_CODES)}, 'NONE')"
_X = "CAST(-180 + (s_suppkey * 37) % 336 + dx AS DOUBLE)"
_Y = "CAST(-88 + (s_suppkey * 53) % 160 + dy AS DOUBLE)"


def grid_extent(spark: SparkSession, sf_dir: str):
    from driftline.sources.grid import Extent
    return Extent(-180.0, 180.0, -90.0, 90.0, table(spark, sf_dir, "embeddings").count(), 64)


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values rise by powers of ten from north to south; very low vector entries are missing."""
    from driftline.sources.grid import long_cells
    extent = grid_extent(spark, sf_dir)
    size = F.pow(F.lit(10.0), F.floor(F.col("vec_id") * 7 / extent.nrow))
    wide = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(
        "embedding", lambda v: F.when(v.cast("double") >= -0.15, size * (1 + v.cast("double"))))
        .alias("v"))
    return long_cells(wide, "vec_id", "v", extent)


def polygon_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = spark.createDataFrame(SHAPES, "shape int, ring int, seq int, dx int, dy int")
    return (table(spark, sf_dir, "supplier")
            .join(shapes, F.col("s_suppkey") % 4 == F.col("shape"))
            .select(F.expr(for_spark(_ZONE)).alias("prov_code"), F.col("s_suppkey").alias("part"), "ring",
                    "seq", F.expr(_X).alias("lon"), F.expr(_Y).alias("lat")))


def grid_sql() -> str:
    shapes = ", ".join(str(s) for s in SHAPES)
    cell = ("CASE WHEN CAST(v AS DOUBLE) >= -0.15 THEN pow(10, floor(vec_id * 7 / (SELECT count(*)"
            " FROM embeddings))) * (1 + CAST(v AS DOUBLE)) END")
    return f"""WITH cells AS (SELECT vec_id AS row, CAST(i - 1 AS INT) AS col,
      -180 + ((i - 1) + 0.5::DOUBLE) * 5.625::DOUBLE AS lon,
      90 - (vec_id + 0.5::DOUBLE) * (180::DOUBLE / (SELECT count(*) FROM embeddings)) AS lat,
      {cell} AS value FROM (SELECT vec_id, unnest(embedding) AS v,
      unnest(range(1, 65)) AS i FROM embeddings)),
    vertices AS (SELECT {for_check(_ZONE)} AS prov_code, s_suppkey AS part, ring, seq,
      {_X} AS lon, {_Y} AS lat FROM supplier
      JOIN (VALUES {shapes}) s(shape, ring, seq, dx, dy) ON s_suppkey % 4 = shape),
    edges AS (SELECT prov_code, part, ring, seq, lon AS lon1, lat AS lat1,
      coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS lon2,
      coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS lat2 FROM vertices
      WINDOW w AS (PARTITION BY prov_code, part, ring ORDER BY seq
                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    hits AS (SELECT DISTINCT prov_code, row, col, value FROM (
      SELECT prov_code, part, row, col, value FROM cells JOIN edges
      ON (lat1 > lat) <> (lat2 > lat)
      AND lon < lon1 + (lat - lat1) * (lon2 - lon1) / (lat2 - lat1)
      GROUP BY ALL HAVING count(*) % 2 = 1)),
    zones AS (SELECT prov_code, mean_value, min_value, max_value, coalesce(n_cells, 0) AS n_cells
      FROM (SELECT DISTINCT prov_code FROM edges) LEFT JOIN (SELECT prov_code,
      avg(value) AS mean_value, min(value) AS min_value, max(value) AS max_value,
      count(*) AS n_cells FROM hits GROUP BY prov_code) USING (prov_code))"""


# --- taxonomy ------------------------------------------------------------------------
# Parts form five trees: root -> type -> type/brand -> type/brand/name.

_TREE = "concat('T', CAST(p_size % 5 AS STRING))"


def taxonomy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = table(spark, sf_dir, "part").select(
        F.expr(_TREE).alias("tree_id"), "p_type", F.concat_ws("/", "p_type", "p_brand").alias("b"),
        F.concat_ws("/", "p_type", "p_brand", "p_name").alias("t"),
        (F.length("p_brand") / 4.0).alias("bl"), (F.length("p_name") / 8.0).alias("tl")).distinct()

    def node(path):
        return F.concat_ws("/", "tree_id", path)

    def level(key, parent, label, length):
        return F.struct(key.alias("node"), parent.alias("parent"), label.alias("label"),
                        length.cast("double").alias("edge_length"))

    levels = F.array(
        level(F.col("tree_id"), F.lit(None).cast("string"), F.col("tree_id"), F.lit(None)),
        level(node("p_type"), F.col("tree_id"), F.col("p_type"), F.lit(3.0)),
        level(node("b"), node("p_type"), F.col("b"), F.col("bl")),
        level(node("t"), node("b"), F.col("t"), F.col("tl")))
    return leaf.select("tree_id", F.explode(levels).alias("e")).select("tree_id", "e.*").distinct()


def taxonomy_sql() -> str:
    """Views ``leaf`` (one row per tip) and ``edges`` (one row per node)."""
    return f"""WITH leaf AS (SELECT DISTINCT {_TREE} AS tree_id, p_type AS ty, p_brand AS br,
      p_name AS na, {_TREE} || '/' || p_type AS n1, {_TREE} || '/' || p_type || '/' || p_brand
      AS n2, {_TREE} || '/' || p_type || '/' || p_brand || '/' || p_name AS n3,
      length(p_brand) / 4.0::DOUBLE AS bl, length(p_name) / 8.0::DOUBLE AS tl FROM part),
    edges AS (SELECT DISTINCT tree_id, tree_id AS node, NULL::VARCHAR AS parent, tree_id AS label,
      NULL::DOUBLE AS edge_length, 0 AS lev FROM leaf
      UNION SELECT tree_id, n1, tree_id, ty, 3.0, 1 FROM leaf
      UNION SELECT tree_id, n2, n1, ty || '/' || br, bl, 2 FROM leaf
      UNION SELECT tree_id, n3, n2, ty || '/' || br || '/' || na, tl, 3 FROM leaf),
    closure AS (SELECT tree_id, n3 AS tip, unnest([tree_id, n1, n2, n3]) AS node FROM leaf),
    below AS (SELECT tree_id, node, count(*) AS below FROM closure GROUP BY ALL),
    heights AS (SELECT p.tree_id, p.node, sum(coalesce(x.edge_length, 0)) AS root_dist FROM (
      SELECT DISTINCT tree_id, unnest([tree_id, n1, n2, n3]) AS node,
      unnest([[tree_id], [tree_id, n1], [tree_id, n1, n2], [tree_id, n1, n2, n3]]) AS path
      FROM leaf) p JOIN edges x ON p.tree_id = x.tree_id AND list_contains(p.path, x.node)
      GROUP BY p.tree_id, p.node),
    info AS (SELECT tree_id, node, parent, label, lev, coalesce(edge_length, 0) AS edge_length,
      root_dist, max(root_dist) OVER (PARTITION BY tree_id) AS max_height
      FROM edges JOIN (SELECT tree_id, node, root_dist FROM heights) USING (tree_id, node))"""
