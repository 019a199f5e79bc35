"""Gridded values and polygon outlines as long tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions.text import wrap_longitude
from driftline.sources.tables import read_table


@dataclass(frozen=True)
class Extent:
    """Outer edges and shape of a regular grid; row 0 lies at the ``ymax`` edge."""

    xmin: float
    xmax: float
    ymin: float
    ymax: float
    nrow: int
    ncol: int

    @property
    def dx(self) -> float:
        return (self.xmax - self.xmin) / self.ncol

    @property
    def dy(self) -> float:
        return (self.ymax - self.ymin) / self.nrow

    def lon(self, col: Column) -> Column:
        return F.lit(self.xmin) + (col + 0.5) * F.lit(self.dx)

    def lat(self, row: Column) -> Column:
        return F.lit(self.ymax) - (row + 0.5) * F.lit(self.dy)


def long_cells(wide: DataFrame, row: str, values: str, extent: Extent) -> DataFrame:
    """One row per cell from one array per grid row; both indexes start at 0."""
    return (wide.select(F.col(row).cast("long").alias("row"), F.posexplode(values))
            .select("row", F.col("pos").alias("col"),
                    extent.lon(F.col("pos")).alias("lon"),
                    extent.lat(F.col("row")).alias("lat"),
                    F.col("col").cast("double").alias("value")))


def column_order(longitudes: list[float], limit: float = 179.0) -> tuple[list[int], list[float]]:
    """Wrapped longitudes in rising order, and the column each one came from."""
    wrapped = [x - 360.0 if x > limit else x for x in longitudes]
    order = sorted(range(len(wrapped)), key=wrapped.__getitem__)
    return order, [wrapped[i] for i in order]


def read_grid(spark: SparkSession, values: str, latitudes: str, longitudes: str,
              north_first: bool = True) -> tuple[DataFrame, Extent]:
    """Cells and extent of a wide CSV grid with separate axis files.

    ``values`` has a header and one line per latitude; ``latitudes`` has no header;
    ``longitudes`` keeps its values in the header line.  The axis limits are taken as
    the outer edges of the grid.  Lines are numbered in the order of file names and of lines in them.
    """
    header = read_table(spark, longitudes, header=False, na="").first()
    lons = [float(str(v).lstrip("X")) for v in header]
    order, wrapped = column_order(lons)
    lat = read_table(spark, latitudes, header=False).select(F.col("_c0").cast("double").alias("y"))
    low, high, n = lat.agg(F.min("y"), F.max("y"), F.count("y")).first()
    extent = Extent(wrapped[0], wrapped[-1], low, high, n, len(lons))
    wide = read_table(spark, values, header=True, na="NA")
    wide = wide.withColumns({"_file": F.input_file_name(), "_block": F.input_file_block_start(),
                             "_mid": F.monotonically_increasing_id()})
    # Splits in file order; how Spark packs them into tasks does not matter.
    split = ["_file", "_block"]
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    starts = (wide.groupBy(*split).agg(F.count("*").alias("_n"), F.min("_mid").alias("_first"))
              .select(*split, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    wide = wide.join(starts, split)
    line = F.col("_off") + F.col("_mid") - F.col("_first")
    row = line if north_first else F.lit(n - 1) - line
    names = [c for c in wide.columns if c not in ("_file", "_block", "_mid", "_first", "_off")]
    cells = F.array(*[F.col(f"`{names[i]}`").cast("double") for i in order])
    return long_cells(wide.select(row.alias("r"), cells.alias("v")), "r", "v", extent), extent


def edges_from_vertices(vertices: DataFrame) -> DataFrame:
    """Directed edges of closed rings.

    Input ``(prov_code, part, ring, seq, lon, lat)`` with consecutive ``seq`` per ring.
    Neighbours meet in a join on the vertex number, so a long ring is spread over tasks.
    """
    ring = ["prov_code", "part", "ring"]
    start = vertices.select(*ring, "seq", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    end = vertices.select(*ring, (F.col("seq") - 1).alias("seq"), F.col("lon").alias("lon2"),
                          F.col("lat").alias("lat2"))
    point = F.struct("lon", "lat")
    closing = (vertices.groupBy(*ring)
               .agg(F.max("seq").alias("seq"), F.max_by(point, "seq").alias("a"),
                    F.min_by(point, "seq").alias("b"))
               .select(*ring, "seq", F.col("a.lon").alias("lon1"), F.col("a.lat").alias("lat1"),
                       F.col("b.lon").alias("lon2"), F.col("b.lat").alias("lat2")))
    return start.join(end, [*ring, "seq"]).unionByName(closing)


__all__ = ["Extent", "long_cells", "column_order", "read_grid", "edges_from_vertices",
           "wrap_longitude"]
