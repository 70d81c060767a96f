"""Terrain, connected regions, footprints and zonal statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from escarp import config
from escarp.operators import components, terrain, zonal
from escarp.plans.registry import query
from escarp.sources import views
from escarp.sources.views import CELL_M, GRID, VIEW_TILE_CELLS

_PERCENTS = config.SLOPE_PERCENTILES

TERRAIN = f"""{views.CELLS},
near AS (
  SELECT x, y, elevation,
    CASE WHEN lag(x) OVER w = x - 1 AND lead(x) OVER w = x + 1
      THEN (lead(elevation) OVER w - lag(elevation) OVER w) / (2.0 * {CELL_M}) END AS gx,
    CASE WHEN lag(y) OVER v = y - 1 AND lead(y) OVER v = y + 1
      THEN (lead(elevation) OVER v - lag(elevation) OVER v) / (2.0 * {CELL_M}) END AS gy
  FROM cells WINDOW w AS (PARTITION BY y ORDER BY x), v AS (PARTITION BY x ORDER BY y)),
terrain AS (
  SELECT x, y, elevation, gx, gy, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope,
    CASE WHEN gx IS NULL OR gy IS NULL THEN NULL WHEN gx = 0 AND gy = 0 THEN 0.0
      ELSE degrees(atan2(-gx, -gy)) + CASE WHEN atan2(-gx, -gy) < 0 THEN 360 ELSE 0 END END AS aspect
  FROM near)"""

# cells steeper than 70 degrees, then the set of cells each one can reach
_STEEP = "steep AS (SELECT * FROM terrain WHERE slope > 70)"


def reach_sql(name: str, source: str, extra: str = "TRUE") -> str:
    """Recursive CTE: smallest reachable cell of each cell over 8-neighbour contacts."""
    return f"""{name}_links AS (
  SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_
  FROM {source} a, (SELECT unnest([-1, 0, 1]) AS dx) o1, (SELECT unnest([-1, 0, 1]) AS dy) o2,
       {source} b
  WHERE b.x = a.x + dx AND b.y = a.y + dy AND {extra}),
{name}_reach AS (
  SELECT x AS ax, y AS ay, x AS bx, y AS by_ FROM {source}
  UNION
  SELECT r.ax, r.ay, l.bx, l.by_ FROM {name}_reach r JOIN {name}_links l
    ON r.bx = l.ax AND r.by_ = l.ay),
{name} AS (
  SELECT ax AS x, ay AS y, min(by_ * 1000000 + bx) AS id FROM {name}_reach GROUP BY 1, 2)"""


_T = VIEW_TILE_CELLS
_SAME_TILE = f"a.x // {_T} = b.x // {_T} AND a.y // {_T} = b.y // {_T}"

FOOTPRINTS = f"""{TERRAIN}, {_STEEP},
{reach_sql("region", "steep")},
{reach_sql("part", "steep", _SAME_TILE)},
tall AS (
  SELECT id AS region_id, max(elevation) - min(elevation) AS height
  FROM region JOIN steep USING (x, y) GROUP BY 1 HAVING max(elevation) - min(elevation) > 50),
members AS (
  SELECT part.id AS cliff, x, y, elevation, height, region_id
  FROM part JOIN region USING (x, y) JOIN tall ON region.id = region_id JOIN steep USING (x, y)),
footprint AS (
  SELECT DISTINCT cliff, x + dx AS x, y + dy AS y FROM members,
    (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS o(dx, dy))"""


def _terrain(spark, sf_dir):
    return terrain.gradient(views.cells(spark, sf_dir), cell_m=CELL_M, tile_cells=_T).select(
        "x",
        "y",
        "elevation",
        terrain.slope_degrees().alias("slope"),
        terrain.aspect_degrees().alias("aspect"),
    )


def _cliff_cells(spark, sf_dir, split=True):
    steep = terrain.steep_cells(_terrain(spark, sf_dir))
    return zonal.cliff_cells(steep, split_cells=_T if split else None, tile_cells=_T)


def _named(cells, names="cliff_id"):
    """Footprints under a name that does not depend on the labelling: their smallest cell."""
    smallest = cells.groupBy("cliff_id").agg(
        F.min(F.col("y") * 1000000 + F.col("x")).alias("cliff")
    )
    return cells.join(smallest, "cliff_id").drop("cliff_id").withColumnRenamed("cliff", names)


@query(
    f"""WITH {TERRAIN} SELECT x, y, elevation, round(slope, 6) AS slope, round(aspect, 6) AS aspect
FROM terrain"""
)
def slope_and_aspect(spark, sf_dir):
    return _terrain(spark, sf_dir).withColumns(
        {c: F.round(c, 6) for c in ("slope", "aspect")}
    )


@query(
    f"""WITH {TERRAIN} SELECT x, y, CAST(coalesce(slope > 70, false) AS BOOLEAN) AS is_steep,
CASE WHEN slope > 70 THEN elevation END AS elevation FROM terrain"""
)
def masked_elevation(spark, sf_dir):
    """Threshold and mask: elevation where steep, NULL elsewhere."""
    steep = F.col("slope") > config.STEEP_DEGREES
    return _terrain(spark, sf_dir).select(
        "x",
        "y",
        F.coalesce(steep, F.lit(False)).alias("is_steep"),
        terrain.mask(F.col("elevation"), steep).alias("elevation"),
    )


@query(
    f"""WITH RECURSIVE {TERRAIN}, {_STEEP}, {reach_sql("region", "steep")}
SELECT id, count(*) AS n_cells, min(elevation) AS elevation_min, max(elevation) AS elevation_max
FROM region JOIN steep USING (x, y) GROUP BY id"""
)
def connected_regions(spark, sf_dir):
    """Smallest and largest elevation of every connected steep region."""
    steep = terrain.steep_cells(_terrain(spark, sf_dir)).select("x", "y", "elevation")
    return (
        components.connected_components(steep, _T)
        .groupBy("component")
        .agg(
            F.min(F.col("y") * 1000000 + F.col("x")).alias("id"),
            F.count(F.lit(1)).alias("n_cells"),
            F.min("elevation").alias("elevation_min"),
            F.max("elevation").alias("elevation_max"),
        )
        .drop("component")
    )


@query(
    f"""WITH RECURSIVE {FOOTPRINTS} SELECT region_id, max(height) AS height, count(*) AS pixel_count
FROM members GROUP BY region_id"""
)
def whole_cliffs(spark, sf_dir):
    """Tall regions as whole cliffs."""
    cells = _named(_cliff_cells(spark, sf_dir, split=False), "region_id")
    return cells.groupBy("region_id").agg(
        F.max("height").alias("height"), F.count(F.lit(1)).alias("pixel_count")
    )


@query(
    f"""WITH RECURSIVE {FOOTPRINTS} SELECT cliff, max(height) AS height, count(*) AS pixel_count
FROM members GROUP BY cliff"""
)
def cliffs_by_tile(spark, sf_dir):
    """One cliff per connected part in each tile."""
    cells = _named(_cliff_cells(spark, sf_dir))
    return zonal.vectorize(cells).withColumnRenamed("cliff_id", "cliff")


@query(f"WITH RECURSIVE {FOOTPRINTS} SELECT cliff, x, y FROM footprint")
def dilated_footprints(spark, sf_dir):
    cells = _named(_cliff_cells(spark, sf_dir))
    return zonal.dilate(cells).withColumnRenamed("cliff_id", "cliff")


@query(
    f"""WITH RECURSIVE {FOOTPRINTS}
SELECT DISTINCT cliff, CAST(floor(x / 5) AS BIGINT) AS cx, CAST(floor(y / 5) AS BIGINT) AS cy
FROM footprint"""
)
def coarse_footprints(spark, sf_dir):
    cells = _named(_cliff_cells(spark, sf_dir))
    return zonal.coarsen(zonal.dilate(cells)).withColumnRenamed("cliff_id", "cliff")


@query(
    f"""WITH RECURSIVE {FOOTPRINTS} SELECT cliff, round(31 + avg(y) * 0.0001, 6) AS latitude,
round(-125 + avg(x) * 0.0001, 6) AS longitude,
round(sum(cos(radians(31 + y * 0.0001))) * power(0.0001 * 6371008.8 * pi() / 180, 2), 3) AS area_m2
FROM footprint GROUP BY cliff"""
)
def footprint_centroids_and_areas(spark, sf_dir):
    footprint = zonal.dilate(_named(_cliff_cells(spark, sf_dir)))
    return (
        zonal.centroids(footprint, GRID)
        .join(zonal.areas_m2(footprint, GRID), "cliff_id")
        .select(
            F.col("cliff_id").alias("cliff"),
            F.round("latitude", 6).alias("latitude"),
            F.round("longitude", 6).alias("longitude"),
            F.round("area_m2", 3).alias("area_m2"),
        )
    )


_SLOPES = ", ".join(
    f"round(quantile_cont(slope, {p / 100}), 6) AS slope_p{p}" for p in _PERCENTS
)


@query(
    f"""WITH RECURSIVE {FOOTPRINTS},
base AS (SELECT cliff, max(height) AS height, count(*) AS pixel_count FROM members GROUP BY 1),
place AS (SELECT cliff, round(31 + avg(y) * 0.0001, 6) AS latitude,
  round(-125 + avg(x) * 0.0001, 6) AS longitude FROM footprint GROUP BY 1),
mean AS (SELECT cliff, round(avg(s.elevation), 6) AS elevation
  FROM footprint JOIN steep s USING (x, y) GROUP BY 1),
slopes AS (SELECT cliff, {_SLOPES} FROM footprint JOIN terrain USING (x, y) GROUP BY 1)
SELECT * FROM base JOIN place USING (cliff) LEFT JOIN mean USING (cliff) LEFT JOIN slopes USING (cliff)"""
)
def cliff_footprints(spark, sf_dir):
    """The footprint table: height, pixels, centroid, mean elevation, slope percentiles."""
    ground = _terrain(spark, sf_dir)
    cliffs, footprint = zonal.footprints(
        terrain.steep_cells(ground),
        ground.select("x", "y", "slope"),
        GRID,
        split_degrees=_T * GRID.step,
        tile_cells=_T,
    )
    # a part is named by its smallest cell
    x, y = components.cell_of(F.col("cliff_id"))
    numbers = [c for c in cliffs.columns if c not in ("cliff_id", "height", "pixel_count")]
    return cliffs.select(
        (y * 1000000 + x).alias("cliff"),
        "height",
        "pixel_count",
        *[F.round(c, 6).alias(c) for c in numbers],
    )


@query(
    f"""WITH RECURSIVE {FOOTPRINTS},
base AS (SELECT cliff, max(height) AS height, min(x // {_T}) AS tx, min(y // {_T}) AS ty
  FROM members GROUP BY 1)
SELECT cliff, height, tx, ty FROM base
QUALIFY row_number() OVER (PARTITION BY tx, ty ORDER BY height DESC, cliff) <= 3"""
)
def tallest_cliffs_per_tile(spark, sf_dir):
    """The cap on cliffs per tile, here three."""
    cells = terrain.with_tile(_named(_cliff_cells(spark, sf_dir)), _T)
    cliffs = cells.groupBy("cliff_id").agg(
        F.max("height").alias("height"), F.min("tx").alias("tx"), F.min("ty").alias("ty")
    )
    return zonal.cap_per_tile(cliffs, ["tx", "ty"], 3).withColumnRenamed("cliff_id", "cliff")


@query(
    """SELECT tx AS tile_x, ty AS tile_y, -125 + tx / 4 AS west, 31 + ty / 4 AS south,
-125 + (tx + 1) / 4 AS east, 31 + (ty + 1) / 4 AS north
FROM (SELECT unnest(range(93)) AS tx) a, (SELECT unnest(range(73)) AS ty) b
WHERE EXISTS (SELECT 1 FROM (
  SELECT (310000 + (c_custkey * 104729) % 180000) // 2500 - 124 AS cy,
         ((c_custkey * 7919) % 230000) // 2500 AS cx
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE r_name = 'AMERICA') p WHERE p.cx = tx AND p.cy = ty)"""
)
def tiles_of_country(spark, sf_dir):
    """The tile grid, kept where it meets the country."""
    nation = views.table(spark, sf_dir, "nation").join(
        views.table(spark, sf_dir, "region").filter("r_name = 'AMERICA'"),
        F.col("n_regionkey") == F.col("r_regionkey"),
    )
    inside = views.areas(spark, sf_dir).join(
        nation.select(F.col("n_nationkey").alias("nation")), "nation", "left_semi"
    )
    # a hair of a degree keeps points on a tile edge on the side whole numbers put them
    points = inside.select((F.col("lat") + 1e-7).alias("lat"), (F.col("lon") + 1e-7).alias("lon"))
    return terrain.tiles_touching(terrain.tile_grid(spark), points)


@query(
    f"""WITH {TERRAIN} SELECT y // 7 AS zone, {_SLOPES} FROM terrain WHERE slope IS NOT NULL
GROUP BY 1"""
)
def zonal_slope_percentiles(spark, sf_dir):
    rows = _terrain(spark, sf_dir).select(F.floor(F.col("y") / 7).alias("zone"), "slope")
    wide = zonal.percentile_columns(rows, ["zone"], ["slope"], _PERCENTS)
    return wide.select("zone", *[F.round(f"slope_p{p}", 6).alias(f"slope_p{p}") for p in _PERCENTS])


_SHARES = ", ".join(
    f"round(count(*) FILTER (p_size = {k}) / (count(p_size) + 1), 6) AS {name}"
    for k, name in config.LITHOLOGY.items()
)


@query(f"SELECT p_brand, {_SHARES} FROM part GROUP BY p_brand")
def lithology_shares(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    shares = zonal.class_shares(part, ["p_brand"], "p_size")
    return shares.withColumns({n: F.round(n, 6) for n in config.LITHOLOGY.values()})


_D = """2 * 6371008.8 * asin(least(1.0, sqrt(power(sin(radians(p.lat - s.lat) / 2), 2)
  + cos(radians(s.lat)) * cos(radians(p.lat)) * power(sin(radians(p.lon - s.lon) / 2), 2))))"""
_DISK_SHARES = ", ".join(
    f"round(count(*) FILTER (p_size = {k}) / (count(p_size) + 1), 6) AS {name}"
    for k, name in config.LITHOLOGY.items()
)


@query(
    f"""WITH {views.SITES}, {views.ROADS},
lith AS (SELECT roads.*, p_size FROM roads JOIN part ON road_id = p_partkey)
SELECT cliff_id, {_DISK_SHARES} FROM sites s LEFT JOIN lith p ON {_D} <= 200000 GROUP BY cliff_id"""
)
def lithology_around_cliffs(spark, sf_dir):
    """Class shares over a disk around each cliff."""
    codes = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("road_id"), "p_size")
    cells = views.roads(spark, sf_dir).join(codes, "road_id")
    around = zonal.class_shares_within(views.sites(spark, sf_dir), cells, "p_size", 200_000)
    return around.select(
        "cliff_id", *[F.round(n, 6).alias(n) for n in config.LITHOLOGY.values()]
    )
