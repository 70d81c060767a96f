"""Stacks of dated scenes over the raster grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from escarp.session import materialize, scratch_dir

#: Pairs of a footprint and a scene that are compared in one tile; a tile of more is cut into parts.
LEAF_PAIRS = 1 << 14

_BOX, _TILE = ["xmin", "xmax", "ymin", "ymax"], ["_tx", "_ty"]


def between_dates(
    scenes: DataFrame, start: str, end: str | None = None, time: str = "time_start"
) -> DataFrame:
    """Scenes from `start` up to, not including, `end`; open-ended without `end`."""
    kind = scenes.schema[time].dataType
    kept = scenes.filter(F.col(time) >= F.lit(start).cast(kind))
    return kept if end is None else kept.filter(F.col(time) < F.lit(end).cast(kind))


def newest_first(scenes: DataFrame, time: str = "time_start") -> DataFrame:
    return scenes.orderBy(F.col(time).desc(), "scene_id")


def _covered_tiles(boxes: DataFrame, size: int) -> DataFrame:
    """One row per tile a box touches, closed at both ends."""

    def span(low: str, high: str) -> Column:
        return F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size))

    return boxes.withColumn("_tx", F.explode(span("xmin", "xmax"))).withColumn(
        "_ty", F.explode(span("ymin", "ymax"))
    )


def _parts(rows: DataFrame, size: int, step: int) -> DataFrame:
    """Rows in tiles of `size` dealt to the step x step parts of the tile that their box touches."""

    def span(low: str, high: str, at: str) -> Column:
        first = F.col(at) * step
        return F.sequence(
            F.greatest(F.floor(F.col(low) * step / size), first),
            F.least(F.floor(F.col(high) * step / size), first + (step - 1)),
        )

    across = rows.withColumn("_tx", F.explode(span("xmin", "xmax", "_tx")))
    return across.withColumn("_ty", F.explode(span("ymin", "ymax", "_ty")))


def _covers(boxes: DataFrame, size: int) -> Column:
    """Whether a box covers its tile whole; whole cells end one before the next tile."""
    cells = all(isinstance(boxes.schema[c].dataType, T.IntegralType) for c in _BOX)
    reach = size - 1 if cells else size
    low_x, low_y = F.col("_tx") * size, F.col("_ty") * size
    return (
        (F.col("xmin") <= low_x)
        & (F.col("xmax") >= low_x + reach)
        & (F.col("ymin") <= low_y)
        & (F.col("ymax") >= low_y + reach)
    )


def recent_scenes(
    footprints: DataFrame, scenes: DataFrame, k: int = 3, tile_cells: int = 64, leaf_pairs: int = LEAF_PAIRS
) -> DataFrame:
    """The k newest scenes whose bounds meet each footprint's bounds.

    Both tables carry xmin, xmax, ymin, ymax in cells. They meet by tile. In a tile, a scene
    that covers the tile whole meets every footprint there, so anything older than the k-th
    newest such scene cannot be among the newest k and is left out. A footprint that covers the
    tile whole meets every scene there and takes the k newest. The other footprints of a tile are
    compared with its scenes one by one where these are few pairs; any other tile is cut into
    parts, where the same holds.
    """
    path = scratch_dir(scenes.sparkSession)
    # copies meet once; how many there are of each is put back at the end
    feet = footprints.groupBy("cliff_id", *_BOX).agg(F.count(F.lit(1)).alias("_feet"))
    dated = scenes.groupBy("scene_id", "time_start", *_BOX).agg(F.count(F.lit(1)).alias("_copies"))
    asked = materialize(_covered_tiles(feet, tile_cells), f"{path}/asked{tile_cells}")
    tiles = _covered_tiles(dated, tile_cells)
    found, size = [], tile_cells
    while True:
        useful = materialize(_useful(tiles, asked, k, size), f"{path}/useful{size}")
        partial = asked.filter(~_covers(asked, size))
        pairs_of = useful.groupBy(*_TILE).agg(F.count(F.lit(1)).alias("_n")).join(
            partial.groupBy(*_TILE).agg(F.count(F.lit(1)).alias("_m")), _TILE
        )
        small = F.lit(size == 1) | (F.col("_n") * F.col("_m") <= leaf_pairs)
        nodes = materialize(pairs_of.select(*_TILE, small.alias("_small")), f"{path}/nodes{size}")
        found += [
            _found(pairs, tile_cells // size)
            for pairs in (_of_whole(useful, asked, k, size), _of_few(useful, partial, nodes, k))
        ]
        crowded = nodes.filter("NOT _small").select(*_TILE)
        if crowded.isEmpty():
            break
        step = next(s for s in (4, *range(2, size + 1)) if size % s == 0)
        tiles = _parts(useful.join(crowded, _TILE, "left_semi"), size, step)
        asked = _parts(partial.join(crowded, _TILE, "left_semi"), size, step)
        size //= step
        asked = materialize(asked, f"{path}/asked{size}")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    # newest k per first tile, copies counted: the result of a footprint is among those of its tiles
    newest = W.partitionBy("cliff_id", *_TILE).orderBy(F.col("time_start").desc(), "scene_id")
    newer = F.coalesce(F.sum("_rows").over(newest.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = (
        pairs.distinct()
        .withColumn("_rows", F.col("_feet") * F.col("_copies"))
        .withColumn("_newer", newer)
        .filter(F.col("_newer") < k)
        .groupBy("cliff_id", "scene_id")
        .agg(F.max("time_start").alias("time_start"))
    )
    return newest_per_group(kept, "cliff_id", k)


def _useful(tiles: DataFrame, asked: DataFrame, k: int, size: int) -> DataFrame:
    """Scenes of asked tiles that are not older than the k-th newest that covers the tile whole."""
    newest = W.partitionBy(*_TILE).orderBy(F.col("time_start").desc(), "scene_id")
    tiles = tiles.join(asked.select(*_TILE).distinct(), _TILE, "left_semi")
    floor = (
        tiles.filter(_covers(tiles, size))
        .withColumn("_n", F.row_number().over(newest))
        .filter(F.col("_n") <= k)
        .filter(F.col("_n") == k)
        .select(*_TILE, F.col("time_start").alias("_floor"), F.col("scene_id").alias("_last"))
    )
    as_new = (F.col("time_start") > F.col("_floor")) | (
        (F.col("time_start") == F.col("_floor")) & (F.col("scene_id").isNull() | (F.col("scene_id") <= F.col("_last")))
    )
    unknown = F.col("_floor").isNull() | F.col("_last").isNull()
    return tiles.join(floor, _TILE, "left").filter(unknown | as_new).drop("_floor", "_last")


def _of_whole(useful: DataFrame, asked: DataFrame, k: int, size: int) -> DataFrame:
    """Footprints that cover their tile whole, with the k newest scenes there."""
    newest = W.partitionBy(*_TILE).orderBy(F.col("time_start").desc(), "scene_id")
    top = useful.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= k).drop("_n")
    return top.join(_renamed(asked.filter(_covers(asked, size))), _TILE)


def _of_few(useful: DataFrame, partial: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The k newest scenes that meet each other footprint, in the tiles of few pairs."""
    small = nodes.filter("_small").select(*_TILE)
    meets = (
        (F.col("xmin") <= F.col("_fxmax"))
        & (F.col("xmax") >= F.col("_fxmin"))
        & (F.col("ymin") <= F.col("_fymax"))
        & (F.col("ymax") >= F.col("_fymin"))
    )
    per_tile = W.partitionBy("cliff_id", *[f"_f{c}" for c in _BOX], *_TILE).orderBy(
        F.col("time_start").desc(), "scene_id"
    )
    return (
        useful.join(small, _TILE, "left_semi")
        .join(_renamed(partial), _TILE)
        .filter(meets)
        .withColumn("_n", F.row_number().over(per_tile))
        .filter(F.col("_n") <= k)
        .drop("_n")
    )


def _renamed(asked: DataFrame) -> DataFrame:
    return asked.withColumnsRenamed({c: f"_f{c}" for c in _BOX})


def _found(pairs: DataFrame, parts: int) -> DataFrame:
    """Pairs with the tile of the first size that their part lies in."""
    return pairs.withColumns({c: F.floor(F.col(c) / parts) for c in _TILE})


def newest_per_group(rows: DataFrame, group: str, k: int = 3) -> DataFrame:
    """Top k by time in each group; k rows per group and task are left before the shuffle."""
    order = W.partitionBy(group).orderBy(F.col("time_start").desc(), "scene_id")
    return rows.withColumn("recency", F.row_number().over(order)).filter(F.col("recency") <= k)


def cloud_reduced_composite(
    pixels: DataFrame,
    bands: Sequence[str],
    cells: Sequence[str] = ("x", "y"),
    cloud: str = "cloud",
    cloud_range: float = 10,
    percent: float = 50,
) -> DataFrame:
    """Per cell and band, the percentile over the least cloudy scenes.

    A scene counts where its cloud score is at most the cell's lowest score + `cloud_range`.
    """
    cells = list(cells)
    # a group is the scenes of one cell, bounded by the data model: one exchange is enough
    clearest = F.min(cloud).over(W.partitionBy(*cells))
    clear = pixels.withColumn("_clear", clearest).filter(F.col(cloud) <= F.col("_clear") + cloud_range)
    usable = {b: F.nanvl(F.col(b).cast("double"), F.lit(None).cast("double")) for b in bands}
    return clear.groupBy(*cells).agg(
        *[F.percentile(value, percent / 100).alias(b) for b, value in usable.items()]
    )


def mosaic(
    pixels: DataFrame,
    bands: Sequence[str],
    cells: Sequence[str] = ("x", "y"),
    order: Sequence[str] = ("time_start", "scene_id"),
) -> DataFrame:
    """Last scene on top; a masked pixel (first band NULL) lets the one below through."""
    seen = pixels.filter(F.col(bands[0]).isNotNull())
    top = seen.groupBy(*cells).agg(
        F.max_by(F.struct(*bands), F.struct(*order)).alias("_top")
    )
    return top.select(*cells, *[F.col(f"_top.{b}").alias(b) for b in bands])


def brightest(
    pixels: DataFrame, bands: Sequence[str], cells: Sequence[str] = ("x", "y")
) -> DataFrame:
    """Per cell and band the maximum over all scenes."""
    return pixels.groupBy(*cells).agg(*[F.max(b).alias(b) for b in bands])


def spectral_gradient(bands: Sequence[Column]) -> Column:
    """Root mean square of the differences between neighbouring bands."""
    steps = [later - earlier for earlier, later in zip(bands, bands[1:])]
    total = steps[0] * steps[0]
    for step in steps[1:]:
        total = total + step * step
    return F.sqrt(total / len(steps))
