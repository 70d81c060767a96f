"""Map algebra on cell tables: one row per raster cell (x, y), y growing northwards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from escarp import config

TILE_CELLS = 512


def with_tile(cells: DataFrame, tile_cells: int = TILE_CELLS) -> DataFrame:
    """Square processing tile (tx, ty) of a cell."""
    return cells.withColumns(
        {"tx": F.floor(F.col("x") / tile_cells), "ty": F.floor(F.col("y") / tile_cells)}
    )


def _tile_halo(cells: DataFrame, value: str, tile_cells: int) -> DataFrame:
    """Cells keyed by tile, border cells also in the tiles next to them.

    This costs one shuffle of little more than the table itself, where a self-join or a
    scatter to neighbours would move it several times.
    """
    size = F.lit(tile_cells)
    column, row = F.pmod(F.col("x"), size), F.pmod(F.col("y"), size)
    tx, ty = F.floor(F.col("x") / size), F.floor(F.col("y") / size)

    def seen_by(x: Column, y: Column, when: Column, own: bool) -> Column:
        seen = F.struct(x.alias("tx"), y.alias("ty"), F.lit(own).alias("own"))
        return F.when(when, seen)

    homes = F.array(
        seen_by(tx, ty, F.lit(True), True),
        seen_by(tx - 1, ty, column == 0, False),
        seen_by(tx + 1, ty, column == tile_cells - 1, False),
        seen_by(tx, ty - 1, row == 0, False),
        seen_by(tx, ty + 1, row == tile_cells - 1, False),
    )
    spread = cells.select(
        "x", "y", value, F.explode(F.filter(homes, lambda h: h.isNotNull())).alias("_home")
    ).select("x", "y", value, "_home.*")
    return spread.repartition("tx", "ty")


def gradient(
    cells: DataFrame, value: str = "elevation", cell_m: float = 10, tile_cells: int = TILE_CELLS
) -> DataFrame:
    """Central differences `dzdx`, `dzdy`; NULL where one of the four neighbours is missing."""

    def change(along: str, across: str) -> Column:
        line = W.partitionBy("tx", "ty", across).orderBy(along)
        before, after = F.lag(value).over(line), F.lead(value).over(line)
        adjacent = (F.lag(along).over(line) == F.col(along) - 1) & (
            F.lead(along).over(line) == F.col(along) + 1
        )
        return F.when(adjacent, (after - before) / (2.0 * cell_m))

    sides = _tile_halo(cells, value, tile_cells)
    both = sides.withColumn("dzdx", change("x", "y")).withColumn("dzdy", change("y", "x"))
    missing = F.col("dzdx").isNull() | F.col("dzdy").isNull()
    return both.filter("own").select(
        "x",
        "y",
        value,
        F.when(~missing, F.col("dzdx")).alias("dzdx"),
        F.when(~missing, F.col("dzdy")).alias("dzdy"),
    )


def slope_degrees() -> Column:
    dx, dy = F.col("dzdx"), F.col("dzdy")
    return F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))


def aspect_degrees() -> Column:
    """Compass direction the ground falls to, 0 = north, 90 = east; 0 where flat."""
    east, north = -F.col("dzdx"), -F.col("dzdy")
    turn = F.degrees(F.atan2(east, north))
    flat = (east == 0) & (north == 0)
    return F.when(flat, 0.0).otherwise(F.when(turn < 0, turn + 360).otherwise(turn))


def terrain(
    cells: DataFrame, value: str = "elevation", cell_m: float = 10, tile_cells: int = TILE_CELLS
) -> DataFrame:
    """Cells with slope and aspect in degrees."""
    return gradient(cells, value, cell_m, tile_cells).select(
        "x", "y", value, slope_degrees().alias("slope"), aspect_degrees().alias("aspect")
    )


def mask(value: Column, keep: Column) -> Column:
    """The value where `keep` holds, masked (NULL) elsewhere."""
    return F.when(keep, value)


def steep_cells(
    cells: DataFrame, steep_degrees: float = config.STEEP_DEGREES, value: str = "elevation"
) -> DataFrame:
    """Cells steeper than the threshold, with whole-number elevation."""
    return cells.filter(F.col("slope") > steep_degrees).withColumn(
        value, F.col(value).cast("int")
    )


def stack(*rasters: DataFrame) -> DataFrame:
    """Bands of several cell tables side by side, where all have the cell."""
    result = rasters[0]
    for raster in rasters[1:]:
        result = result.join(raster, ["x", "y"])
    return result


def with_band_ratios(
    cells: DataFrame, ratios: Mapping[str, Sequence[str]] = config.BAND_RATIOS
) -> DataFrame:
    """Quotient bands; masked where the divisor is zero."""
    return cells.withColumns(
        {
            name: F.try_divide(F.col(top).cast("double"), F.col(bottom).cast("double"))
            for name, (top, bottom) in ratios.items()
        }
    )


def tile_grid(
    spark,
    xmin: float = config.XMIN,
    xmax: float = config.XMAX,
    dx: float = config.DX,
    ymin: float = config.YMIN,
    ymax: float = config.YMAX,
    dy: float = config.DY,
) -> DataFrame:
    """Rectangles from inclusive sequences of corners: the last one passes the maximum."""
    n_columns = int((xmax - xmin) / dx + 1e-9) + 1
    n_rows = int((ymax - ymin) / dy + 1e-9) + 1
    at = F.col("id")
    column, row = F.floor(at / n_rows), F.pmod(at, F.lit(n_rows))
    return spark.range(n_columns * n_rows).select(
        column.alias("tile_x"),
        row.alias("tile_y"),
        (column * dx + xmin).alias("west"),
        (row * dy + ymin).alias("south"),
        ((column + 1) * dx + xmin).alias("east"),
        ((row + 1) * dy + ymin).alias("north"),
    )


def tile_of(
    lat: Column,
    lon: Column,
    xmin: float = config.XMIN,
    dx: float = config.DX,
    ymin: float = config.YMIN,
    dy: float = config.DY,
) -> dict[str, Column]:
    """Grid position of the rectangle that holds a coordinate, in the grid of `tile_grid`."""
    return {"tile_x": F.floor((lon - xmin) / dx), "tile_y": F.floor((lat - ymin) / dy)}


def tiles_touching(tiles: DataFrame, region_points: DataFrame, **grid: float) -> DataFrame:
    """Rectangles that hold some point of a region; `grid` is that of `tile_grid` (xmin, dx, ymin, dy)."""
    occupied = region_points.select(
        *[c.alias(n) for n, c in tile_of(F.col("lat"), F.col("lon"), **grid).items()]
    ).distinct()
    return tiles.join(occupied, ["tile_x", "tile_y"], "left_semi")
