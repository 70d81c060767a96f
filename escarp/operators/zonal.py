"""Footprints and statistics of rasters over them.

A footprint is a set of cells (cliff_id, x, y): area is a count, centroid a mean, buffer a
dilation, overlap an equi-join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from escarp import config
from escarp.functions.geo import METERS_PER_DEGREE
from escarp.functions.stats import percentiles
from escarp.operators.components import connected_components
from escarp.operators.proximity import aggregate_within
from escarp.operators.terrain import TILE_CELLS


@dataclass(frozen=True)
class Georeference:
    """Cell centres: lon = west + x * step, lat = south + y * step."""

    west: float
    south: float
    step: float

    def lat(self, y: Column) -> Column:
        return y * self.step + self.south

    def lon(self, x: Column) -> Column:
        return x * self.step + self.west

    def cells_in(self, degrees: float) -> int:
        """Cells along so many degrees."""
        return max(1, round(degrees / self.step))


def cliff_cells(
    steep: DataFrame,
    value: str = "elevation",
    min_height: float = config.MIN_HEIGHT_M,
    split_cells: int | None = None,
    tile_cells: int = TILE_CELLS,
) -> DataFrame:
    """Cells (cliff_id, x, y, value, height) of steep regions taller than `min_height`.

    Height is that of the whole region. With `split_cells` a region that crosses an edge of the
    rectangles of so many cells a side gives one cliff per connected part in each of them.
    """
    regions = connected_components(steep.select("x", "y", value), tile_cells, split_cells)
    heights = (
        regions.groupBy("component")
        .agg((F.max(value) - F.min(value)).alias("height"))
        .filter(F.col("height") > min_height)
    )
    return regions.join(heights, "component").select(
        F.col("part").alias("cliff_id"), "x", "y", value, "height"
    )


def vectorize(cells: DataFrame) -> DataFrame:
    """One row per cliff: height and pixel count."""
    return cells.groupBy("cliff_id").agg(
        F.max("height").alias("height"), F.count(F.lit(1)).alias("pixel_count")
    )


def cap_per_tile(cliffs: DataFrame, tile: Sequence[str], limit: int = 2000) -> DataFrame:
    """The tallest `limit` cliffs of each tile."""
    order = W.partitionBy(*tile).orderBy(F.col("height").desc(), "cliff_id")
    return (
        cliffs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n")
    )


def dilate(cells: DataFrame, radius_cells: float = 1) -> DataFrame:
    """Footprint cells plus all cells within `radius_cells` of one of them."""
    reach = range(-int(radius_cells), int(radius_cells) + 1)
    disk = [(dx, dy) for dx in reach for dy in reach if dx * dx + dy * dy <= radius_cells**2]
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in disk])
    moved = cells.select("cliff_id", "x", "y", F.explode(offsets).alias("o"))
    return moved.select(
        "cliff_id", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y")
    ).distinct()


def coarsen(footprint: DataFrame, factor: int = 5) -> DataFrame:
    """Light form of a footprint: the coarse cells it touches."""
    return footprint.select(
        "cliff_id",
        F.floor(F.col("x") / factor).alias("cx"),
        F.floor(F.col("y") / factor).alias("cy"),
    ).distinct()


def centroids(footprint: DataFrame, grid: Georeference) -> DataFrame:
    return footprint.groupBy("cliff_id").agg(
        grid.lat(F.avg("y")).alias("latitude"), grid.lon(F.avg("x")).alias("longitude")
    )


def cell_points(footprint: DataFrame, grid: Georeference) -> DataFrame:
    """The cells of each footprint as points: distances to a cliff are to its nearest cell."""
    return footprint.select(
        "cliff_id", grid.lat(F.col("y")).alias("lat"), grid.lon(F.col("x")).alias("lon")
    )


def areas_m2(footprint: DataFrame, grid: Georeference) -> DataFrame:
    """Footprint area: cells shrink east-west with the cosine of latitude."""
    side = grid.step * METERS_PER_DEGREE
    return footprint.groupBy("cliff_id").agg(
        (F.sum(F.cos(F.radians(grid.lat(F.col("y"))))) * side * side).alias("area_m2")
    )


def zonal_rows(footprint: DataFrame, raster: DataFrame) -> DataFrame:
    """Raster values at the cells of each footprint."""
    return footprint.select("cliff_id", "x", "y").join(raster, ["x", "y"])


def zonal_mean(footprint: DataFrame, raster: DataFrame, value: str) -> DataFrame:
    return zonal_rows(footprint, raster).groupBy("cliff_id").agg(F.avg(value).alias(value))


def zonal_percentiles(
    footprint: DataFrame, raster: DataFrame, bands: Sequence[str], percents: Sequence[int]
) -> DataFrame:
    """Columns `<band>_p<percent>` for each footprint, exact; masked values are skipped."""
    rows = zonal_rows(footprint, raster).select(
        "cliff_id", *[F.col(b).cast("double").alias(b) for b in bands]
    )
    return percentile_columns(rows, ["cliff_id"], bands, percents)


def percentile_columns(
    rows: DataFrame, keys: Sequence[str], bands: Sequence[str], percents: Sequence[int]
) -> DataFrame:
    """Exact percentiles of several columns, one pass over a long table, as wide columns."""
    long = rows.unpivot(list(keys), list(bands), "band", "value")
    ranked = percentiles(long, [*keys, "band"], "value", percents)
    columns = [
        F.max(F.when((F.col("band") == b) & (F.col("percent") == float(p)), F.col("value"))).alias(
            f"{b}_p{p}"
        )
        for b in bands
        for p in percents
    ]
    return ranked.groupBy(*keys).agg(*columns)


def class_shares(
    rows: DataFrame,
    keys: Sequence[str],
    code: str,
    classes: Mapping[int, str] = config.LITHOLOGY,
    smoothing: int = 1,
) -> DataFrame:
    """Share of each class among the rows of a zone; the total counts `smoothing` extra."""
    total = F.count(code) + smoothing
    return rows.groupBy(*keys).agg(
        *[(F.count_if(F.col(code) == k) / total).alias(name) for k, name in classes.items()]
    )


def class_shares_within(
    sites: DataFrame,
    cells: DataFrame,
    code: str,
    radius_m: float,
    classes: Mapping[int, str] = config.LITHOLOGY,
    smoothing: int = 1,
) -> DataFrame:
    """The same over a disk around each site."""
    sums = {
        name: ("sum", F.when(F.col(code) == k, 1).otherwise(0)) for k, name in classes.items()
    }
    sums["_total"] = ("sum", F.when(F.col(code).isNotNull(), 1).otherwise(0))
    around = aggregate_within(sites, cells, {"": radius_m}, sums)
    total = F.coalesce("_total", F.lit(0)) + smoothing
    shares = {name: F.coalesce(name, F.lit(0)) / total for name in classes.values()}
    return around.withColumns(shares).drop("_total")


def population_within(
    sites: DataFrame,
    population: DataFrame,
    value: str = "population",
    radii_km: Sequence[float] = config.POPULATION_RADII_KM,
) -> DataFrame:
    """Whole-number population around each site for all radii in one pass."""
    radii = {f"{km:g}km": km * 1000.0 for km in radii_km}
    around = aggregate_within(
        sites, population, radii, {"population_within_": ("sum", F.col(value))}
    )
    names = [f"population_within_{suffix}" for suffix in radii]
    return around.withColumns({n: F.coalesce(n, F.lit(0)).cast("bigint") for n in names})


def road_flags(
    sites: DataFrame, road_points: DataFrame, radii_m: Sequence[float] = config.ROAD_RADII_M
) -> DataFrame:
    """1 where a road point lies within the radius, for all radii in one pass."""
    radii = {f"{m:g}m": float(m) for m in radii_m}
    around = aggregate_within(sites, road_points, radii, {"road_within_": ("max", F.lit(1))})
    names = [f"road_within_{suffix}" for suffix in radii]
    return around.withColumns({n: F.coalesce(n, F.lit(0)) for n in names})


def footprints(
    steep: DataFrame,
    slopes: DataFrame,
    grid: Georeference,
    value: str = "elevation",
    min_height: float = config.MIN_HEIGHT_M,
    split_degrees: float | None = config.DX,
    tile_cells: int = TILE_CELLS,
    buffer_cells: float = 1,
) -> tuple[DataFrame, DataFrame]:
    """Cliff table and its dilated footprint cells.

    Cliffs split at rectangles of `split_degrees` from the corner of the grid, None: not at all.
    Mean elevation is over steep cells only, slope percentiles over the whole footprint.
    """
    split_cells = grid.cells_in(split_degrees) if split_degrees else None
    cells = cliff_cells(steep, value, min_height, split_cells, tile_cells)
    footprint = dilate(cells, buffer_cells)
    cliffs = (
        vectorize(cells)
        .join(centroids(footprint, grid), "cliff_id")
        .join(zonal_mean(footprint, steep.select("x", "y", value), value), "cliff_id", "left")
        .join(
            zonal_percentiles(footprint, slopes, ["slope"], config.SLOPE_PERCENTILES),
            "cliff_id",
            "left",
        )
    )
    return cliffs, footprint
