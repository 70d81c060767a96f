"""Distance joins, joining areas to cliffs, explorer views."""

from __future__ import annotations

from pyspark.sql import functions as F

from escarp.operators import features, zonal
from escarp.operators.proximity import nearest_within
from escarp.plans.registry import distance_sql, query
from escarp.sources import views

# the test points lie far apart, so radii are scaled up until matches exist
MATCH_M, NEAR_M, PROBE_M = 40_000, 80_000, 50_000

SITE_AREA_M = distance_sql("s.lat", "s.lon", "a.lat", "a.lon")

_IN_EXTENT = "lon BETWEEN -125 AND -102 AND lat BETWEEN 31 AND 49"

_MATCHED = f"""pairs AS (
  SELECT a.ord, a.name, a.n_rock, a.n_views, s.cliff_id, min({SITE_AREA_M}) AS d
  FROM areas a, site_cells s WHERE a.n_rock > 0 AND a.{_IN_EXTENT.replace(" lat", " a.lat")}
  GROUP BY ALL),
matched AS (
  SELECT * FROM pairs WHERE d <= {MATCH_M}
  QUALIFY row_number() OVER (PARTITION BY ord ORDER BY d, cliff_id) = 1),
labels AS (
  SELECT cliff_id, CAST(sum(n_rock) AS BIGINT) AS n_rock, CAST(sum(n_views) AS BIGINT) AS n_views,
         string_agg(name, ' - ' ORDER BY ord DESC) || ' - ' AS name
  FROM matched GROUP BY cliff_id),
vicinity AS (
  SELECT cliff_id, CAST(sum(n_rock) AS BIGINT) AS vicinity_n_rock,
         CAST(sum(n_views) AS BIGINT) AS vicinity_n_views, count(*) AS vicinity_n_areas
  FROM pairs WHERE d <= {NEAR_M} GROUP BY cliff_id)"""

_WITH = f"WITH {views.AREAS}, {views.SITES}, {views.SITE_CELLS}, {_MATCHED}"


@query(
    f"""WITH {views.AREAS}
SELECT ord, name, lat, lon, n_rock, n_views FROM areas WHERE n_rock > 0 AND {_IN_EXTENT}"""
)
def climbing_areas(spark, sf_dir):
    kept = features.climbing_areas(views.areas(spark, sf_dir))
    return kept.select("ord", "name", "lat", "lon", "n_rock", "n_views")


def _wall(spark, sf_dir):
    return views.site_cells(spark, sf_dir).select("cliff_id", "lat", "lon")


@query(
    f"""{_WITH} SELECT ord, name, cliff_id, round(d, 3) AS distance_m FROM matched"""
)
def nearest_cliff_per_area(spark, sf_dir):
    areas = features.climbing_areas(views.areas(spark, sf_dir))
    matched = nearest_within(areas, _wall(spark, sf_dir), "cliff_id", MATCH_M, "cliff_id")
    return matched.select(
        "ord", "name", "cliff_id", F.round("distance_m", 3).alias("distance_m")
    )


@query(f"""{_WITH} SELECT * FROM labels""")
def matched_area_labels(spark, sf_dir):
    areas = features.climbing_areas(views.areas(spark, sf_dir))
    matched = nearest_within(areas, _wall(spark, sf_dir), "cliff_id", MATCH_M, "cliff_id")
    return features.summarize_matches(matched)


@query(
    f"""{_WITH} SELECT s.cliff_id, coalesce(n_rock, 0) AS n_rock, coalesce(n_views, 0) AS n_views,
coalesce(name, '') AS name FROM sites s LEFT JOIN labels USING (cliff_id)"""
)
def cliffs_with_area_labels(spark, sf_dir):
    areas = features.climbing_areas(views.areas(spark, sf_dir))
    sites = views.sites(spark, sf_dir)
    joined = features.attach_areas(sites, areas, MATCH_M, _wall(spark, sf_dir))
    return joined.select("cliff_id", "n_rock", "n_views", "name")


@query(
    f"""{_WITH} SELECT cliff_id, coalesce(vicinity_n_rock, 0) AS vicinity_n_rock,
coalesce(vicinity_n_views, 0) AS vicinity_n_views, coalesce(vicinity_n_areas, 0) AS vicinity_n_areas
FROM sites LEFT JOIN vicinity USING (cliff_id)"""
)
def cliffs_with_vicinity(spark, sf_dir):
    areas = features.climbing_areas(views.areas(spark, sf_dir))
    sites = views.sites(spark, sf_dir)
    joined = features.attach_vicinity(sites, areas, NEAR_M, _wall(spark, sf_dir))
    return joined.select("cliff_id", "vicinity_n_rock", "vicinity_n_views", "vicinity_n_areas")


@query(
    f"""{_WITH} SELECT s.cliff_id, coalesce(n_rock, 0) AS n_rock, coalesce(n_views, 0) AS n_views,
coalesce(name, '') AS name, coalesce(vicinity_n_rock, 0) AS vicinity_n_rock,
coalesce(vicinity_n_views, 0) AS vicinity_n_views, coalesce(vicinity_n_areas, 0) AS vicinity_n_areas,
round(CASE WHEN l.cliff_id IS NULL THEN 0.0
  ELSE greatest(0.0, least(1.0, log2(1000 + n_rock + n_views) / 10 - 1)) END, 6) AS mp_score
FROM sites s LEFT JOIN labels l ON s.cliff_id = l.cliff_id
LEFT JOIN vicinity v ON s.cliff_id = v.cliff_id"""
)
def scored_cliffs(spark, sf_dir):
    """Nearest join, labels, vicinity and score: the joined site table."""
    areas = features.climbing_areas(views.areas(spark, sf_dir))
    wall = _wall(spark, sf_dir)
    joined = features.attach_areas(views.sites(spark, sf_dir), areas, MATCH_M, wall)
    joined = features.attach_vicinity(joined, areas, NEAR_M, wall)
    raw = F.when(F.col("name") != "", F.col("n_rock") + F.col("n_views") + 1000).otherwise(0)
    return joined.select(
        "cliff_id",
        "n_rock",
        "n_views",
        "name",
        "vicinity_n_rock",
        "vicinity_n_views",
        "vicinity_n_areas",
        F.round(features.log_score(raw), 6).alias("mp_score"),
    )


@query(
    f"""WITH {views.SITES}, {views.POPULATION}
SELECT cliff_id,
  CAST(coalesce(sum(CASE WHEN d <= 30000 THEN population END), 0) AS BIGINT) AS population_within_30km,
  CAST(coalesce(sum(CASE WHEN d <= 60000 THEN population END), 0) AS BIGINT) AS population_within_60km,
  CAST(coalesce(sum(CASE WHEN d <= 100000 THEN population END), 0) AS BIGINT) AS population_within_100km
FROM (SELECT cliff_id, population, {SITE_AREA_M} AS d FROM sites s, population a)
GROUP BY cliff_id"""
)
def population_around_cliffs(spark, sf_dir):
    around = zonal.population_within(views.sites(spark, sf_dir), views.population(spark, sf_dir))
    return around.select("cliff_id", *[c for c in around.columns if c.startswith("population_")])


_ROAD_RADII = (5_000, 10_000, 15_000, 20_000)


@query(
    f"""WITH {views.SITES}, {views.ROADS}
SELECT cliff_id, {", ".join(
    f"CAST(min(d) <= {r} AS INTEGER) AS road_within_{r}m" for r in _ROAD_RADII)}
FROM (SELECT cliff_id, {SITE_AREA_M} AS d FROM sites s, roads a) GROUP BY cliff_id"""
)
def roads_near_cliffs(spark, sf_dir):
    around = zonal.road_flags(views.sites(spark, sf_dir), views.roads(spark, sf_dir), _ROAD_RADII)
    return around.select("cliff_id", *[c for c in around.columns if c.startswith("road_")])


@query(
    f"""WITH {views.AREAS}, {views.SITE_CELLS}, {views.ROADS},
near AS (SELECT s.road_id, a.* FROM roads s, areas a WHERE {SITE_AREA_M} <= {PROBE_M}),
tall AS (SELECT s.road_id, max(a.height) AS h FROM roads s, site_cells a
  WHERE {SITE_AREA_M} <= {PROBE_M} GROUP BY 1),
agg AS (SELECT road_id, CAST(sum(n_rock) AS BIGINT) AS n_routes,
  arg_min(name, (-n_views, ord)) AS top_area FROM near GROUP BY 1)
SELECT road_id, coalesce(n_routes, 0) AS n_routes,
  CASE WHEN h IS NULL THEN 'No cliffs found!' ELSE h || 'm' END AS tallest_cliff,
  coalesce(top_area, 'No MP area found!') AS top_area
FROM roads LEFT JOIN agg USING (road_id) LEFT JOIN tall USING (road_id)"""
)
def vicinity_of_probes(spark, sf_dir):
    summary = features.vicinity_summary(
        views.roads(spark, sf_dir), views.areas(spark, sf_dir), views.site_cells(spark, sf_dir), PROBE_M
    )
    return summary.select("road_id", "n_routes", "tallest_cliff", "top_area")


@query(
    f"""WITH {views.AREAS}, {views.SITE_CELLS} SELECT DISTINCT s.cliff_id FROM site_cells s, areas a
WHERE {SITE_AREA_M} <= 20000"""
)
def cliffs_intersecting_disks(spark, sf_dir):
    """Cliffs with a cell in the disk around some area."""
    near = nearest_within(_wall(spark, sf_dir), views.areas(spark, sf_dir), "ord", 20_000, "ord")
    return near.select("cliff_id").distinct()


@query(
    f"""WITH {views.AREAS} SELECT ord, round(sqrt((2000 * n_rock + n_views) / 2000), 6) AS size
FROM areas"""
)
def marker_sizes(spark, sf_dir):
    return views.areas(spark, sf_dir).select(
        "ord", F.round(features.marker_size(), 6).alias("size")
    )


@query(
    f"""WITH {views.SITES} SELECT cliff_id,
[{", ".join(f"'{c}'" for c in features.PALETTE)}][least(height // 40, 39) + 1] AS color FROM sites"""
)
def height_colors(spark, sf_dir):
    return views.sites(spark, sf_dir).select(
        "cliff_id", features.height_color(F.col("height")).alias("color")
    )


# fixed values: the box of the area check
_YOSEMITE = (-119.7, 37.0, -119.5, 38.0)


@query(
    f"""WITH {views.AREAS} SELECT count(*) AS n FROM areas
WHERE lon BETWEEN -119.7 AND -119.5 AND lat BETWEEN 37.0 AND 38.0"""
)
def areas_in_box(spark, sf_dir):
    boxed = features.in_box(views.areas(spark, sf_dir), *_YOSEMITE)
    return boxed.agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {views.AREAS}
SELECT nation, CAST(sum(n_rock) AS BIGINT) AS n_rock, count(*) AS n_areas, max(n_views) AS max_views,
arg_min(name, (-n_views, ord)) AS most_viewed FROM areas GROUP BY nation"""
)
def area_summary_by_nation(spark, sf_dir):
    """Sum, size, maximum, and the first name after sorting by views."""
    return (
        views.areas(spark, sf_dir)
        .groupBy("nation")
        .agg(
            F.sum("n_rock").alias("n_rock"),
            F.count(F.lit(1)).alias("n_areas"),
            F.max("n_views").alias("max_views"),
            F.max_by("name", F.struct("n_views", -F.col("ord"))).alias("most_viewed"),
        )
    )


@query(
    f"""WITH {views.AREAS} SELECT ord, name, n_views FROM areas ORDER BY n_views DESC, ord LIMIT 50"""
)
def most_viewed_areas(spark, sf_dir):
    top = views.areas(spark, sf_dir).orderBy(F.col("n_views").desc(), "ord").limit(50)
    return top.select("ord", "name", "n_views")
