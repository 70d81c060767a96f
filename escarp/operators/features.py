"""Joining areas to cliffs, cleaning, scoring, and the explorer views."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escarp import config
from escarp.operators.proximity import aggregate_in_zones, aggregate_within, nearest_within

# fixed values: older column names and the ones used here
ALIASES = {
    "num_views": "n_views",
    "num_rock_routes": "n_rock",
    "vicinity_num_views": "vicinity_n_views",
    "vicinity_num_rock_routes": "vicinity_n_rock",
    "vicinity_mp_areas": "vicinity_n_areas",
    "custom_index": "cliff_id",
}

# fixed values: columns that are no features once accessibility is known
NOT_FEATURES = (
    "road_within_500m",
    "road_within_1000m",
    "road_within_1500m",
    "road_within_2000m",
    "population_within_30km",
    "population_within_60km",
    "population_within_100km",
    "n_views",
    "vicinity_n_rock",
    "vicinity_n_views",
    "system:index",
    "cliff_id",
    "vicinity_n_areas",
)

# fixed values: colours of the height buckets, 40 m each
PALETTE = (
    "FFFF00", "FFF000", "FFE000", "FFD000", "FFC000", "FFB000", "FFA000", "FF9000",
    "FF8000", "FF7000", "FF6000", "FF5000", "FF4000", "FF3000", "FF2000", "FF1000",
    "FF0000", "FF0010", "FF0020", "FF0030", "FF0040", "FF0050", "FF0060", "FF0070",
    "FF0080", "FF0090", "FF00A0", "FF00B0", "FF00C0", "FF00D0", "FF00D0", "FF00F0",
    "FF00FF", "FF00FF", "FF00FF", "FF00FF", "FF00FF", "FF00FF", "FF00FF", "FF00FF",
)


def in_box(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    return df.filter(F.col("lon").between(west, east) & F.col("lat").between(south, north))


def climbing_areas(areas: DataFrame) -> DataFrame:
    """Areas in the working extent that have rock routes."""
    boxed = in_box(areas, config.XMIN, config.YMIN, config.XMAX, config.YMAX)
    return boxed.filter(F.col("n_rock") > 0)


def summarize_matches(matched: DataFrame) -> DataFrame:
    """Per cliff: summed routes and views, names joined newest first with ' - ' after each.

    Newest is the largest `ord`, a number or a path in the tree. The text of one cliff is one
    value, so its names do meet; numbers combine before.
    """
    return (
        matched.groupBy("cliff_id")
        .agg(
            F.sum("n_rock").alias("n_rock"),
            F.sum("n_views").alias("n_views"),
            F.sort_array(F.collect_list(F.struct("ord", "name")), asc=False).alias("_n"),
        )
        .withColumn(
            "name", F.concat(F.array_join(F.transform("_n", lambda n: n["name"]), " - "), F.lit(" - "))
        )
        .drop("_n")
    )


def attach_areas(
    cliffs: DataFrame,
    areas: DataFrame,
    radius_m: float = config.MATCH_RADIUS_M,
    footprint: DataFrame | None = None,
) -> DataFrame:
    """Each area goes to the cliff with the closest cell; cliffs without one get 0, 0 and ''.

    `footprint` has a row (cliff_id, lat, lon) per cell; without it a cliff is its own point.
    """
    points = cliffs if footprint is None else footprint
    matched = nearest_within(
        areas, points.select("lat", "lon", "cliff_id"), "cliff_id", radius_m, "cliff_id"
    )
    return cliffs.join(summarize_matches(matched), "cliff_id", "left").withColumns(
        {
            "n_rock": F.coalesce("n_rock", F.lit(0)),
            "n_views": F.coalesce("n_views", F.lit(0)),
            "name": F.coalesce("name", F.lit("")),
        }
    )


def attach_vicinity(
    cliffs: DataFrame,
    areas: DataFrame,
    radius_m: float = config.VICINITY_RADIUS_M,
    footprint: DataFrame | None = None,
) -> DataFrame:
    """Routes, views and number of all areas around each cliff; 0 when there are none.

    With `footprint` (cliff_id, lat, lon per cell) an area is near if some cell is, and counts once.
    """
    names = ["vicinity_n_rock", "vicinity_n_views", "vicinity_n_areas"]
    values = [F.col("n_rock"), F.col("n_views"), F.lit(1)]
    aggs = {n: ("sum", v) for n, v in zip(names, values, strict=True)}
    if footprint is None:
        around = aggregate_within(cliffs, areas, {"": radius_m}, aggs)
    else:
        near = aggregate_in_zones(footprint, "cliff_id", areas, radius_m, aggs)
        around = cliffs.join(near, "cliff_id", "left")
    return around.withColumns({n: F.coalesce(n, F.lit(0)) for n in names})


def canonical_names(df: DataFrame, aliases: Mapping[str, str] = ALIASES) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in aliases.items() if k in df.columns})


def raw_score(cliffs: DataFrame, matches: DataFrame) -> DataFrame:
    """1000 + routes + views of the matched areas, 0 without any (`mp_score`, `n_views`).

    A matched area whose counts are NULL is a match with 0 routes and views.
    """
    found = matches.groupBy("cliff_id").agg(
        F.sum("n_views").alias("_views"),
        F.sum("n_rock").alias("_rock"),
        F.count(F.lit(1)).alias("_matches"),
    )
    matched = F.col("_matches").isNotNull()
    views, rock = F.coalesce("_views", F.lit(0)), F.coalesce("_rock", F.lit(0))
    return (
        cliffs.join(found, "cliff_id", "left")
        .withColumn("n_views", views)
        .withColumn("mp_score", F.when(matched, views + rock + 1000).otherwise(0))
        .drop("_views", "_rock", "_matches")
    )


def log_score(raw: Column) -> Column:
    """0 below 1000, else log2 / 10 - 1 kept within 0 and 1; NULL and NaN give NULL."""
    value = raw.cast("double")
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log2(value) / 10 - 1))
    return F.when(value < 1000, 0.0).when(value.isNotNull() & ~F.isnan(value), scaled)


def plausible_shape() -> Column:
    """False for holes and spikes of the elevation data."""
    return (F.col("height") < F.col("pixel_count") * 2.5 + 100) & (F.col("pixel_count") > 10)


def positive_bands(bands=("B2", "B4", "B5", "B6", "B7"), suffix: str = "_p20") -> Column:
    """True where all are > 0; NaN counts as missing, not as large."""
    result = F.lit(True)
    for band in bands:
        value = F.col(band + suffix).cast("double")
        result &= F.coalesce((value > 0) & ~F.isnan(value), F.lit(False))
    return result


def present(column: str) -> Column:
    value = F.col(column).cast("double")
    return value.isNotNull() & ~F.isnan(value)


def scaled_shape(cliffs: DataFrame) -> DataFrame:
    """Pixels per metre of height, and height in kilometres, both from the old height."""
    height = F.col("height")
    return cliffs.withColumns(
        {"pixel_count": F.col("pixel_count") / height, "height": height / 1000}
    )


def is_accessible() -> Column:
    """Explored by climbers, or near a road and enough people; a missing value is no."""

    def above(name: str, limit: int) -> Column:
        return F.coalesce(F.col(name) > limit, F.lit(False))

    def road(metres: int) -> Column:
        return F.coalesce(F.col(f"road_within_{metres}m") == 1, F.lit(False))

    return (
        above("n_views", 1000)
        | above("vicinity_n_views", 5000)
        | (road(500) & above("population_within_30km", 10_000))
        | (road(1000) & above("population_within_60km", 100_000))
        | (road(1500) & above("population_within_100km", 1_000_000))
        | (road(2000) & above("population_within_100km", 2_000_000))
    )


def model_table(cliffs: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """Clean, scale, label and project joined cliffs for modelling.

    Needs `mp_score` raw; `required` lists further columns that must be present.
    """
    kept = plausible_shape() & positive_bands()
    for column in required:
        kept &= present(column)
    clean = cliffs.filter(kept).withColumn("mp_score", log_score(F.col("mp_score")))
    return scaled_shape(clean).withColumn("is_accessible", is_accessible()).drop(*NOT_FEATURES)


def unseen(df: DataFrame) -> DataFrame:
    return df.filter(F.col("mp_score") == 0)


def marker_size() -> Column:
    """Area of the pin grows with routes and views."""
    return F.sqrt((F.col("n_rock") * 2000 + F.col("n_views")) / 2000)


def height_color(height: Column) -> Column:
    """Colour of the 40 m bucket; the last one for anything taller."""
    index = F.least(F.floor(height / 40), F.lit(len(PALETTE) - 1))
    return F.element_at(F.array(*[F.lit(c) for c in PALETTE]), (index + 1).cast("int"))


def vicinity_summary(
    probes: DataFrame,
    areas: DataFrame,
    cliffs: DataFrame,
    radius_m: float = config.PROBE_RADIUS_M,
) -> DataFrame:
    """Around each probe point: routes, the tallest cliff, the most viewed area.

    `cliffs` has `height` on its rows, one per cliff or one per cell of its footprint.
    """
    from_areas = {
        "n_routes": ("sum", F.col("n_rock")),
        "_top": ("max", F.struct("n_views", (-F.col("ord")).alias("o"), "name")),
    }
    around = aggregate_within(probes, areas, {"": radius_m}, from_areas)
    around = aggregate_within(
        around, cliffs, {"": radius_m}, {"_tallest": ("max", F.col("height"))}
    )
    tallest = F.concat(F.col("_tallest").cast("string"), F.lit("m"))
    return around.select(
        *probes.columns,
        F.coalesce("n_routes", F.lit(0)).alias("n_routes"),
        F.when(F.coalesce("_tallest", F.lit(0)) == 0, "No cliffs found!")
        .otherwise(tallest)
        .alias("tallest_cliff"),
        F.coalesce("_top.name", F.lit("No MP area found!")).alias("top_area"),
    )
