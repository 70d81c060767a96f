"""The staged build from elevation to model table, on views of the smallest tables."""

from pyspark.sql import functions as F

from escarp.operators import linear, tree
from escarp.plans.stages import Inputs, run_stages, site_stages
from escarp.session import scratch_dir
from escarp.sources import views

SF_DIR = "/root/testdata/sf0.001"


def test_build_and_resume(spark):
    cells = views.cells(spark, SF_DIR)
    grid = views.GRID
    key = F.col("x") * 31 + F.col("y") * 17
    bands = cells.select(
        "x", "y", *[((key * m) % 90 + 10).alias(b) for b, m in {"B2": 3, "B4": 5, "B5": 7, "B6": 11, "B7": 13}.items()]
    )
    points = cells.select(grid.lat(F.col("y")).alias("lat"), grid.lon(F.col("x")).alias("lon"), "elevation")
    nodes = points.filter(F.col("elevation") % 20 == 0).select(
        F.concat_ws("_", "lat", "lon").alias("node_id"), "lat", "lon", "elevation"
    )
    crag = nodes.select(
        "node_id", F.lit("root").alias("parent_id"), F.col("elevation").alias("ordinal"),
        F.concat(F.lit("crag "), "node_id").alias("name"), F.lit(None).cast("string").alias("url"),
        F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("long"),
        F.concat_ws(",", "lat", "lon").alias("gps2"), F.lit(400).cast("long").alias("views"),
        F.lit(None).cast("array<string>").alias("types"),
    )
    missing = F.lit(None).cast("double")
    routes = crag.select(
        F.concat(F.lit("r"), "node_id").alias("node_id"), F.col("node_id").alias("parent_id"), "ordinal", "name",
        "url", missing.alias("lat"), missing.alias("long"), F.lit(None).cast("string").alias("gps2"), "views",
        F.array(F.lit("trad")).alias("types"),
    )
    inputs = Inputs(
        elevation=cells,
        bands=bands,
        lithology=cells.select("x", "y", (F.col("elevation") % 20).alias("code")),
        population=points.withColumnRenamed("elevation", "population"),
        roads=points.filter(F.col("elevation") % 50 == 0).drop("elevation"),
        areas=tree.flatten_adjacency(crag.unionByName(routes)),
        grid=grid,
        cell_m=views.CELL_M,
        tile_cells=10,
    )
    folder = scratch_dir(spark)
    stages = site_stages(inputs)[:-2]
    assert run_stages(spark, stages[:5], folder) == [s.name for s in stages[:5]]
    assert run_stages(spark, stages, folder) == [s.name for s in stages[5:]]
    assert run_stages(spark, stages, folder) == []
    joined = spark.read.parquet(f"{folder}/joined")
    assert joined.count() == spark.read.parquet(f"{folder}/cliffs").count() > 0
    assert joined.filter("n_rock > 0").count() > 0
    assert joined.filter("vicinity_n_areas < 1 and n_rock > 0").count() == 0
    total = points.agg(F.sum("elevation")).first()[0]
    assert joined.filter(F.col("population_within_100km") != total).count() == 0
    table = spark.read.parquet(f"{folder}/model_table")
    assert "is_accessible" in table.columns and "road_within_500m" not in table.columns
    for column in ("slope_p10", "B42_p50", "geology_alluvium", "elevation"):
        assert column in table.columns


def test_search_and_ranking(spark):
    """The last two stages, on a model table with accessible and unseen sites."""
    rows = spark.range(300).selectExpr(
        "id AS site_id", "0.01 + id % 17 * 0.01 AS height", "id % 13 * 1.0D AS slope_p10", "id % 7 * 0.5D AS B42_p50",
        "id % 3 = 0 AS is_accessible",
        "IF(id % 5 = 0, 0D, id % 17 * 0.02 + id % 13 * 0.01) AS mp_score",
    )
    folder = scratch_dir(spark)
    rows.write.parquet(f"{folder}/model_table")
    names = {"linear": 1, "ridge": 8, "lasso": 3, "tree": 2}
    inputs = Inputs(*[rows] * 6, grid=views.GRID, models=names)
    assert run_stages(spark, site_stages(inputs)[-2:], folder) == ["settings", "ranked"]
    assert {r["model"] for r in spark.read.parquet(f"{folder}/settings").collect()} == set(names)
    ranked = spark.read.parquet(f"{folder}/ranked").orderBy(F.col("summary_score").desc(), "site_id").collect()
    assert len(ranked) == 50 and all(r["site_id"] % 5 == 0 for r in ranked)
    for r in ranked:
        assert abs(sum(r[f"{n}_score"] for n in names) - r["summary_score"]) < 1e-9
    weights = linear.fit("linear", rows.filter("is_accessible"), ["height", "slope_p10", "B42_p50"], "mp_score")
    best = rows.filter("mp_score = 0").select("site_id", weights.column(["height", "slope_p10", "B42_p50"]).alias("w"))
    best = {r["site_id"]: r["w"] for r in best.collect()}
    assert all(abs(best[r["site_id"]] - r["linear_score"]) < 1e-9 for r in ranked)
