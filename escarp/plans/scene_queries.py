"""Scene stacks: filters, top-k, composites, band arithmetic, zonal bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from escarp import config
from escarp.operators import patches, scenes, terrain, zonal
from escarp.plans.registry import query
from escarp.sources import views

_BANDS = ("B2", "B4", "B5", "B6", "B7")

_BOXES = """footprints AS (
  SELECT s_suppkey AS cliff_id, (s_suppkey * 53) % 400 AS xmin, (s_suppkey * 53) % 400 + 30 AS xmax,
         (s_suppkey * 71) % 400 AS ymin, (s_suppkey * 71) % 400 + 20 AS ymax FROM supplier),
scenes AS (
  SELECT event_id AS scene_id, ts AS time_start, (event_id * 97) % 400 AS xmin,
         (event_id * 97) % 400 + event_id % 200 AS xmax, (event_id * 89) % 400 AS ymin,
         (event_id * 89) % 400 + event_id % 150 AS ymax FROM events)"""


def _footprint_boxes(spark, sf_dir):
    key = F.col("s_suppkey")
    x, y = F.pmod(key * 53, F.lit(400)), F.pmod(key * 71, F.lit(400))
    return views.table(spark, sf_dir, "supplier").select(
        key.alias("cliff_id"),
        x.alias("xmin"),
        (x + 30).alias("xmax"),
        y.alias("ymin"),
        (y + 20).alias("ymax"),
    )


def _scene_boxes(spark, sf_dir):
    key = F.col("event_id")
    x, y = F.pmod(key * 97, F.lit(400)), F.pmod(key * 89, F.lit(400))
    return views.table(spark, sf_dir, "events").select(
        key.alias("scene_id"),
        F.col("ts").alias("time_start"),
        x.alias("xmin"),
        (x + F.pmod(key, F.lit(200))).alias("xmax"),
        y.alias("ymin"),
        (y + F.pmod(key, F.lit(150))).alias("ymax"),
    )


@query(
    f"""WITH {_BOXES} SELECT cliff_id, scene_id,
row_number() OVER (PARTITION BY cliff_id ORDER BY time_start DESC, scene_id) AS recency
FROM footprints f, scenes s WHERE s.xmin <= f.xmax AND s.xmax >= f.xmin AND s.ymin <= f.ymax
  AND s.ymax >= f.ymin
QUALIFY recency <= 3"""
)
def recent_scenes_per_footprint(spark, sf_dir):
    """Bounds join and the three newest scenes of each footprint."""
    newest = scenes.recent_scenes(_footprint_boxes(spark, sf_dir), _scene_boxes(spark, sf_dir))
    return newest.select("cliff_id", "scene_id", "recency")


@query(
    f"""WITH {views.SCENES} SELECT event_id, scene_id FROM pixels
WHERE time_start >= TIMESTAMP '2024-01-10' AND time_start < TIMESTAMP '2024-01-20'"""
)
def scenes_between_dates(spark, sf_dir):
    pixels = views.scene_pixels(spark, sf_dir)
    return scenes.between_dates(pixels, "2024-01-10", "2024-01-20").select("event_id", "scene_id")


@query(
    f"""WITH {views.SCENES} SELECT scene_id, count(*) AS n FROM pixels
WHERE time_start >= TIMESTAMP '2024-01-17' GROUP BY scene_id"""
)
def scenes_since_date(spark, sf_dir):
    """Date filter with one bound: open-ended."""
    since = scenes.between_dates(views.scene_pixels(spark, sf_dir), "2024-01-17")
    return since.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {views.SCENES} SELECT event_id,
row_number() OVER (ORDER BY time_start DESC, scene_id) AS position FROM pixels
QUALIFY position <= 100"""
)
def newest_scenes(spark, sf_dir):
    """Reverse chronological order, first hundred."""
    newest = scenes.newest_first(views.scene_pixels(spark, sf_dir)).limit(100)
    ranked = F.row_number().over(
        scenes.W.orderBy(F.col("time_start").desc(), "scene_id")  # over the hundred rows left
    )
    return newest.withColumn("position", ranked).select("event_id", "position")


@query(
    f"""WITH {views.SCENES} SELECT event_id, {", ".join(
        f"{top} / CAST(nullif({bottom}, 0) AS DOUBLE) AS {name}"
        for name, (top, bottom) in config.BAND_RATIOS.items())} FROM pixels"""
)
def band_ratios(spark, sf_dir):
    ratios = terrain.with_band_ratios(views.scene_pixels(spark, sf_dir))
    return ratios.select("event_id", *config.BAND_RATIOS)


@query(
    f"""WITH {views.SCENES},
clear AS (SELECT *, min(cloud) OVER (PARTITION BY x, y) AS lowest FROM pixels)
SELECT x, y, {", ".join(f"round(quantile_cont(CAST({b} AS DOUBLE), 0.5), 6) AS {b}" for b in _BANDS)}
FROM clear WHERE cloud <= lowest + 10 GROUP BY x, y"""
)
def cloud_reduced_composite(spark, sf_dir):
    composite = scenes.cloud_reduced_composite(views.scene_pixels(spark, sf_dir), _BANDS)
    return composite.select("x", "y", *[F.round(b, 6).alias(b) for b in _BANDS])


@query(
    f"""WITH {views.SCENES} SELECT x, y, arg_max(B4, time_start) AS B4, arg_max(B2, time_start) AS B2
FROM pixels GROUP BY x, y"""
)
def latest_mosaic(spark, sf_dir):
    return scenes.mosaic(views.scene_pixels(spark, sf_dir), ["B4", "B2"])


@query(
    f"""WITH {views.SCENES} SELECT x, y, {", ".join(f"max({b}) AS {b}" for b in _BANDS)}
FROM pixels GROUP BY x, y"""
)
def brightest_pixels(spark, sf_dir):
    return scenes.brightest(views.scene_pixels(spark, sf_dir), _BANDS)


@query(
    f"""WITH {views.SCENES} SELECT event_id, round(sqrt((power(B4 - B2, 2) + power(B5 - B4, 2)
 + power(B6 - B5, 2) + power(B7 - B6, 2)) / 4), 6) AS S FROM pixels"""
)
def spectral_gradients(spark, sf_dir):
    gradient = scenes.spectral_gradient([F.col(b).cast("double") for b in _BANDS])
    return views.scene_pixels(spark, sf_dir).select("event_id", F.round(gradient, 6).alias("S"))


_ALL_BANDS = [*config.BANDS, *config.BAND_RATIOS]


@query(
    f"""WITH {views.SCENES},
ratios AS (SELECT *, {", ".join(
        f"{top} / CAST(nullif({bottom}, 0) AS DOUBLE) AS {name}"
        for name, (top, bottom) in config.BAND_RATIOS.items())} FROM pixels)
SELECT scene_id, {", ".join(
        f"round(quantile_cont(CAST({b} AS DOUBLE), {p / 100}), 6) AS {b}_p{p}"
        for b in _ALL_BANDS for p in config.BAND_PERCENTILES)} FROM ratios GROUP BY scene_id"""
)
def zonal_band_percentiles(spark, sf_dir):
    """Eight bands, five percentiles: forty columns."""
    rows = terrain.with_band_ratios(views.scene_pixels(spark, sf_dir))
    doubles = rows.select("scene_id", *[F.col(b).cast("double").alias(b) for b in _ALL_BANDS])
    wide = zonal.percentile_columns(doubles, ["scene_id"], _ALL_BANDS, config.BAND_PERCENTILES)
    return wide.select(
        "scene_id", *[F.round(c, 6).alias(c) for c in wide.columns if c != "scene_id"]
    )


@query(
    f"""WITH {views.CELLS}, {views.SCENES}
SELECT x, y, elevation, B4 FROM cells JOIN (
  SELECT x, y, max(B4) AS B4 FROM pixels GROUP BY x, y) USING (x, y)"""
)
def stacked_bands(spark, sf_dir):
    """Rasters of two sources side by side on the grid."""
    red = scenes.brightest(views.scene_pixels(spark, sf_dir), ["B4"])
    return terrain.stack(views.cells(spark, sf_dir), red).select("x", "y", "elevation", "B4")


_BOX_CELLS = """boxcells AS (SELECT DISTINCT x, y FROM (
  SELECT unnest(range((s_suppkey * 53) % 60, (s_suppkey * 53) % 60 + 4)) AS x, (s_suppkey * 71) % 90 AS y
  FROM supplier))"""


@query(
    f"""WITH {views.CELLS}, {_BOX_CELLS}
SELECT x, y, elevation FROM cells SEMI JOIN boxcells USING (x, y)"""
)
def clipped_raster(spark, sf_dir):
    key = F.col("s_suppkey")
    x = F.pmod(key * 53, F.lit(60))
    footprint = views.table(spark, sf_dir, "supplier").select(
        F.explode(F.sequence(x, x + 3)).alias("x"), F.pmod(key * 71, F.lit(90)).alias("y")
    )
    return patches.clip(views.cells(spark, sf_dir), footprint)
