"""Zonal statistics: which grid cells have their centre inside which polygon.

Polygons are cut into runs of cells along grid lines, columns or rows, whichever are fewer: an edge
meets only the lines of its part, the cells where it turns inside to outside are paired in order, and
the stretches between the two of a pair are inside.  The cost of this step depends on the outlines
and the lines they span, not on the number of cells on a line.  The runs of a province are merged, so
that no more are left than the grid has cells, however many parts there are.  A cell then finds its
runs by an equality join on (line, tile) and one interval test, and is counted at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import binning, recode
from driftline.session import cut_lineage
from driftline.sources.grid import Extent

TILE = 256


def _first(low: Column, high: Column, holds: Callable[[Column], Column], steps: int) -> Column:
    """The first index from ``low`` on that ``holds``, else ``high``; it holds from some index on."""
    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2)
        up = (s["lo"] < s["hi"]) & ~holds(middle)
        return F.struct(F.when(up, middle + 1).otherwise(s["lo"]).alias("lo"),
                        F.when(up | (s["lo"] >= s["hi"]), s["hi"]).otherwise(middle).alias("hi"))

    start = F.struct(low.cast("long").alias("lo"), high.cast("long").alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), start, halve, lambda s: s["lo"])


def by_column(extent: Extent) -> bool:
    """Whether the lines are the columns of the grid."""
    return extent.ncol < extent.nrow


def _turns(edges: DataFrame, extent: Extent) -> DataFrame:
    """``(prov_code, part, line, at)``: from cell ``at`` of the line on, inside and outside swap.

    A centre is inside a part if an odd number of its edges lies to the east.  Both the rows an
    edge spans and the crossing of a row are monotone, also as rounded, so each limit is found by
    halving with the same comparison that would be made for every cell.
    """
    rows, cols = extent.nrow.bit_length(), extent.ncol.bit_length()
    zero, nrow, ncol = F.lit(0), F.lit(extent.nrow), F.lit(extent.ncol)
    spans = (edges.filter(F.col("lat1") != F.col("lat2"))
             .withColumns({"first": _first(zero, nrow, lambda i: extent.lat(i) < F.greatest("lat1", "lat2"), rows),
                           "last": _first(zero, nrow, lambda i: extent.lat(i) < F.least("lat1", "lat2"), rows)})
             .filter(F.col("first") < F.col("last")))

    def crossing(row: Column) -> Column:
        return F.col("lon1") + ((extent.lat(row) - F.col("lat1")) * (F.col("lon2") - F.col("lon1"))
                                / (F.col("lat2") - F.col("lat1")))

    if not by_column(extent):
        return (spans.withColumn("line", F.explode(F.sequence(F.col("first"), F.col("last") - 1)))
                .select("prov_code", "part", "line",
                        _first(zero, ncol, lambda i: extent.lon(i) >= crossing(F.col("line")), cols).alias("at")))
    # west of a part every line meets an even number of its edges; one column more on either side is for rounding
    west = (spans.groupBy("prov_code", "part").agg(F.min(F.least("lon1", "lon2")).alias("west"))
            .select("prov_code", "part", F.greatest(_first(
                zero, ncol, lambda i: extent.lon(i) >= F.col("west"), cols) - 1, zero).alias("low")))
    high = F.least(_first(zero, ncol, lambda i: extent.lon(i) >= F.greatest("lon1", "lon2"), cols), F.lit(extent.ncol - 1))
    lines = (spans.withColumn("high", high).join(west, ["prov_code", "part"]).filter("low <= high")
             .withColumn("line", F.explode(F.sequence("low", "high"))))
    east = (F.col("lon2") > F.col("lon1")) == (F.col("lat2") < F.col("lat1"))     # going south
    lon = extent.lon(F.col("line"))
    bound = _first(F.col("first"), F.col("last"), lambda i: (lon < crossing(i)) == F.col("east"), rows)
    return (lines.withColumn("east", east).withColumn("bound", bound)
            .select("prov_code", "part", "line", F.explode(F.array(
                F.when(F.col("east"), F.col("bound")).otherwise(F.col("first")),
                F.when(F.col("east"), F.col("last")).otherwise(F.col("bound")))).alias("at")))


def inside_runs(edges: DataFrame, extent: Extent) -> DataFrame:
    """Runs ``(prov_code, line, lo, hi)``: the cells lo <= i < hi of a line are inside."""
    order = Window.partitionBy("prov_code", "part", "line").orderBy("at")
    runs = (_turns(edges, extent)
            .withColumn("pair", F.floor((F.row_number().over(order) - 1) / 2))
            .groupBy("prov_code", "part", "line", "pair")
            .agg(F.min("at").alias("lo"), F.max("at").alias("hi")).filter("lo < hi")
            # of runs with one start only the longest counts, whatever part it is of
            .groupBy("prov_code", "line", "lo").agg(F.max("hi").alias("hi")))
    # parts of one province may overlap; their runs are merged so that a cell counts once
    sweep = Window.partitionBy("prov_code", "line").orderBy("lo")
    reach = F.max("hi").over(sweep.rowsBetween(Window.unboundedPreceding, -1))
    start = F.when(F.col("lo") <= reach, 0).otherwise(1)
    return (runs.withColumn("start", start)
            .withColumn("island", F.sum("start").over(
                sweep.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("prov_code", "line", "island")
            .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .select("prov_code", F.col("line").cast("long").alias("line"), "lo", "hi"))


def cells_in_zones(cells: DataFrame, edges: DataFrame, extent: Extent) -> DataFrame:
    """Each cell once per province that contains its centre."""
    line, at = ("col", "row") if by_column(extent) else ("row", "col")
    runs = (inside_runs(edges, extent)
            .withColumn("tile", F.explode(F.sequence(F.floor(F.col("lo") / TILE),
                                                     F.floor((F.col("hi") - 1) / TILE)))))
    runs = cut_lineage(runs)      # the optimizer broadcasts it only if the files are small
    return (cells.withColumns({"line": F.col(line).cast("long"), "tile": F.floor(F.col(at) / TILE)})
            .join(runs, ["line", "tile"])
            .filter((F.col(at) >= F.col("lo")) & (F.col(at) < F.col("hi")))
            .select("prov_code", "row", "col", "lon", "lat", "value"))


def zonal_stats(cells: DataFrame, edges: DataFrame, extent: Extent) -> DataFrame:
    """Mean, range and counts per province; provinces without a cell have nulls.

    Null values are skipped by the statistics but count as cells.
    """
    stats = cells_in_zones(cells, edges, extent).groupBy("prov_code").agg(
        F.avg("value").alias("mean_value"), F.min("value").alias("min_value"),
        F.max("value").alias("max_value"), F.count(F.lit(1)).alias("n_cells"))
    return (edges.select("prov_code").distinct().join(stats, "prov_code", "left")
            .withColumn("n_cells", F.coalesce("n_cells", F.lit(0))))


def province_attributes(stats: DataFrame, value: str = "mean_value") -> DataFrame:
    """The lookup table: coastal flag, mean and pollution bin per province."""
    return stats.select(
        F.col("prov_code").alias("ProvCode"),
        recode.coastal_flag("prov_code").alias("adjacency"),
        F.col(value).alias("mean_poll_abund"),
        binning.pollution_bin(value).alias("plasticbin"))


def sampled_provinces(attributes: DataFrame, summary: DataFrame) -> DataFrame:
    """Provinces with both attributes and records, sorted by code."""
    return attributes.join(summary, "ProvCode").orderBy("ProvCode")


def map_table(provinces: DataFrame, summary: DataFrame) -> DataFrame:
    """All provinces with their summary where there is one, and legend positions."""
    return provinces.join(summary, "ProvCode", "left").withColumns({
        "aveplast_level": binning.map_level("aveplastbin", binning.FO_MAP_LEVELS),
        "numstudies_level": binning.map_level("numstudiesbin", binning.STUDY_MAP_LEVELS),
        "numfish_level": binning.map_level("numfishbin", binning.FISH_MAP_LEVELS)})
