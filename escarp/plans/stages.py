"""The staged build of the site table; each stage is a written table, done ones are skipped."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from escarp import config
from escarp.operators import features, model, terrain, tree, zonal
from escarp.sources import tables


@dataclass(frozen=True)
class Stage:
    """A table `name`, made by `build` from the tables before it."""

    name: str
    build: Callable[[Callable[[str], DataFrame]], DataFrame]
    partition_by: tuple[str, ...] = ()


def is_done(spark: SparkSession, path: str) -> bool:
    """True once the table has been committed."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return marker.getFileSystem(conf).exists(marker)


def run_stages(spark: SparkSession, stages: list[Stage], folder: str) -> list[str]:
    """Build every stage whose table is missing, in order; gives the names of those built.

    A stage that broke off left no marker and is written anew.
    """

    def read(name: str) -> DataFrame:
        return tables.read_table(spark, f"{folder}/{name}")

    built = []
    for stage in stages:
        path = f"{folder}/{stage.name}"
        if not is_done(spark, path):
            tables.write_table(stage.build(read), path, stage.partition_by, "overwrite")
            built.append(stage.name)
    return built


#: Models that are searched, and how many settings of each.
SEARCHED = {"linear": 1, "ridge": 200, "lasso": 200, "knn": 20, "tree": 50, "forest": 20, "gbt": 20}


@dataclass(frozen=True)
class Inputs:
    """Source tables of the build."""

    elevation: DataFrame  # x, y, elevation
    bands: DataFrame  # x, y, B2 ... B7: a cloud-reduced composite
    lithology: DataFrame  # x, y, code
    population: DataFrame  # lat, lon, population
    roads: DataFrame  # lat, lon
    areas: DataFrame  # rows of a flattened tree
    grid: zonal.Georeference
    models: Mapping[str, int] = field(default_factory=lambda: dict(SEARCHED))  # settings to try
    cell_m: float = 10
    tile_cells: int = terrain.TILE_CELLS


def site_stages(inputs: Inputs) -> list[Stage]:
    """areas -> ground -> footprints -> cliffs -> cliff features -> joined -> model table -> settings ->
    ranked. Models are fitted on accessible cliffs; `ranked` has the best unseen ones by the sum of all
    predictions."""

    def areas(read):
        rows = tree.areas_by_coordinate(inputs.areas, with_path=True)
        return rows.withColumnsRenamed({"latitude": "lat", "longitude": "lon", "path": "ord"})

    def ground(read):
        return terrain.gradient(inputs.elevation, "elevation", inputs.cell_m, inputs.tile_cells).select(
            "x", "y", "elevation", terrain.slope_degrees().alias("slope")
        )

    def cliff_cells(read):
        steep = terrain.steep_cells(read("ground"))
        split_cells = inputs.grid.cells_in(config.DX)
        return zonal.cliff_cells(steep, split_cells=split_cells, tile_cells=inputs.tile_cells)

    def footprints(read):
        return zonal.dilate(read("cliff_cells"))

    def cliffs(read):
        steep = terrain.steep_cells(read("ground")).select("x", "y", "elevation")
        slopes = read("ground").select("x", "y", "slope")
        footprint = read("footprints")
        slope_columns = zonal.zonal_percentiles(
            footprint, slopes, ["slope"], config.SLOPE_PERCENTILES
        )
        return (
            zonal.vectorize(read("cliff_cells"))
            .join(zonal.centroids(footprint, inputs.grid), "cliff_id")
            .join(zonal.zonal_mean(footprint, steep, "elevation"), "cliff_id", "left")
            .join(slope_columns, "cliff_id", "left")
        )

    def cliff_data(read):
        footprint = read("footprints")
        bands = terrain.with_band_ratios(inputs.bands)
        names = [*config.BANDS, *config.BAND_RATIOS]
        spectra = zonal.zonal_percentiles(footprint, bands, names, config.BAND_PERCENTILES)
        rocks = zonal.class_shares(
            zonal.zonal_rows(footprint, inputs.lithology), ["cliff_id"], "code"
        )
        located = read("cliffs").withColumnsRenamed({"latitude": "lat", "longitude": "lon"})
        people = zonal.population_within(located, inputs.population)
        return (
            zonal.road_flags(people, inputs.roads)
            .join(spectra, "cliff_id", "left")
            .join(rocks, "cliff_id", "left")
        )

    def joined(read):
        near = features.climbing_areas(read("areas"))
        cells = zonal.cell_points(read("footprints"), inputs.grid)
        labelled = features.attach_areas(read("cliff_data"), near, footprint=cells)
        return features.attach_vicinity(labelled, near, footprint=cells)

    def modelled(read):
        # an area gives its cliff a name, and the name a separator, also where it has no name itself
        seen = F.col("name") != ""
        raw = F.when(seen, F.col("n_rock") + F.col("n_views") + 1000).otherwise(0)
        kept = read("joined").withColumn("site_id", F.col("cliff_id"))
        return features.model_table(kept.withColumn("mp_score", raw))

    def trained(table):
        return table.filter("is_accessible"), model.feature_columns(table)

    def settings(read):
        train, inputs_of_model = trained(read("model_table"))
        return model.search_all(train, inputs_of_model, "mp_score", "site_id", inputs.models)

    def ranked(read):
        table = read("model_table")
        train, inputs_of_model = trained(table)
        scored, names = model.predict_with(
            read("settings"), train, table, inputs_of_model, "mp_score", "site_id"
        )
        return model.rank_unseen(scored, names, "site_id")

    return [
        Stage("areas", areas),
        Stage("ground", ground),
        Stage("cliff_cells", cliff_cells),
        Stage("footprints", footprints),
        Stage("cliffs", cliffs),
        Stage("cliff_data", cliff_data),
        Stage("joined", joined),
        Stage("model_table", modelled),
        Stage("settings", settings),
        Stage("ranked", ranked),
    ]
