"""Scores, cleaning, patches, models on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from escarp.operators import features, model, patches, scenes, terrain, zonal
from escarp.session import scratch_dir
from escarp.sources import tables


def test_names_of_two_areas_on_one_cliff(spark):
    cliffs = spark.createDataFrame(
        [("c1", 40.0, -110.0), ("c2", 41.0, -110.0)], "cliff_id string, lat double, lon double"
    )
    areas = spark.createDataFrame(
        [(1, "A", 40.0005, -110.0, 2, 10), (2, "B", 40.001, -110.0, 3, 20), (3, "far", 45.0, -110.0, 9, 9)],
        "ord long, name string, lat double, lon double, n_rock long, n_views long",
    )
    got = {r["cliff_id"]: (r["n_rock"], r["n_views"], r["name"]) for r in features.attach_areas(cliffs, areas).collect()}
    assert got == {"c1": (5, 30, "B - A - "), "c2": (0, 0, "")}


def test_log_score(spark):
    raw = spark.createDataFrame([(0,), (999,), (1000,), (4096,), (2**20,), (2**21,)], "s long")
    got = [r[0] for r in raw.select(features.log_score(F.col("s"))).collect()]
    assert got == pytest.approx([0, 0, 0, 0.2, 1, 1])


def test_missing_bands_do_not_pass(spark):
    bands = ["B2_p20", "B4_p20", "B5_p20", "B6_p20", "B7_p20"]
    rows = [(1.0,) * 5, (float("nan"), 1.0, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0), (0.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, ", ".join(f"{b} double" for b in bands))
    assert [r[0] for r in df.select(features.positive_bands()).collect()] == [True, False, False, False]


def test_accessible_with_missing_population(spark):
    names = ["n_views", "vicinity_n_views", "road_within_500m", "road_within_1000m", "road_within_1500m",
             "road_within_2000m", "population_within_30km", "population_within_60km", "population_within_100km"]
    rows = [
        (1001, 0, 0, 0, 0, 0, None, None, None),
        (0, 5001, 0, 0, 0, 0, None, None, None),
        (0, 0, 1, 1, 1, 1, None, None, None),
        (0, 0, 1, 0, 0, 0, 10_001, 0, 0),
        (0, 0, 0, 1, 0, 0, 10_001, 100_001, 0),
        (0, 0, 0, 0, 1, 0, 0, 0, 1_000_001),
        (0, 0, 0, 0, 0, 1, 0, 0, 1_000_001),
        (1000, 5000, 1, 1, 1, 1, 10_000, 100_000, 1_000_000),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    got = [r[0] for r in df.select(features.is_accessible()).collect()]
    assert got == [True, True, False, True, True, True, False, False]


def test_colors_stop_at_the_last(spark):
    heights = spark.createDataFrame([(0,), (39,), (40,), (1599,), (99999,)], "h long")
    got = [r[0] for r in heights.select(features.height_color(F.col("h"))).collect()]
    assert got == ["FFFF00", "FFFF00", "FFF000", "FF00FF", "FF00FF"] and len(features.PALETTE) == 40


def test_class_shares_count_one_extra(spark):
    codes = spark.createDataFrame([("z", 1), ("z", 1), ("z", 3), ("z", 7), ("z", None)], "zone string, code int")
    row = zonal.class_shares(codes, ["zone"], "code").first()
    assert (row["geology_carbonate"], row["geology_non_carbonate"], row["geology_alluvium"]) == (0.4, 0.2, 0.0)


@pytest.mark.parametrize("size", [4, 5])
def test_neighborhood_rows_run_from_north_to_south(spark, size):
    cells = spark.range(400).select((F.col("id") % 20).alias("x"), F.floor(F.col("id") / 20).alias("y"))
    cells = cells.withColumn("v", F.col("y") * 100 + F.col("x"))
    centers = spark.createDataFrame([(10, 10), (0, 10)], "x long, y long")
    rows = patches.neighborhoods(centers, cells, ["v"], size).collect()
    assert len(rows) == 1  # the other one reaches over the border
    half = size // 2
    want = [[(10 + half - i) * 100 + 10 - half + j for j in range(size)] for i in range(size)]
    assert rows[0]["v"] == want


def test_no_scene_means_no_sample(spark):
    df = spark.createDataFrame([(1000.0, 3), (1000.0, 0), (1.0, 3)], "a double, n int")
    sizes = df.select(patches.sample_size_by_area(F.col("a"), F.col("n"), 0.003)).collect()
    assert [r[0] for r in sizes] == [1, 0, 1]


@pytest.mark.parametrize("n", [0, 1, 7, 100, 101, 250])
def test_shard_bounds(spark, n):
    rows = {r["id"]: r["shard"] for r in patches.with_shard(spark.range(n), "id", [], 10).collect()}
    for i in range(10):
        bounds = range(int(n / 10 * i), int(n / 10 * (i + 1)))
        assert [k for k in sorted(rows) if rows[k] == i] == list(bounds)


def test_shards_are_written_in_runs(spark):
    path = scratch_dir(spark)
    rows = spark.range(1000).withColumn("v", F.col("id") * 2)
    tables.write_shards(rows, path, "id", [], 4, ["v"], rows_per_file=50)
    back = tables.read_shards(spark, f"{path}/shard=*", "v long")
    assert back.count() == 1000 and back.agg(F.sum("v")).first()[0] == 999 * 1000
    assert spark.read.parquet(path).groupBy("shard").count().filter("count = 250").count() == 4


def test_stripes(spark):
    df = spark.createDataFrame(
        [(37.505, -119.5), (37.515, -119.5), (37.905, -119.5), (37.915, -119.5), (37.925, -119.5), (37.505, -118.0), (37.49, -119.5)],
        "lat double, lon double",
    )
    got = [r[0] for r in df.select(patches.stripe(F.col("lat"), F.col("lon"))).collect()]
    assert got == ["train", "eval", "train", "eval", None, None, None]


def test_recent_scenes_against_brute_force(spark):
    rng = np.random.default_rng(0)
    boxes = [(i, int(x), int(x + w), int(y), int(y + h)) for i, (x, y, w, h) in
             enumerate(rng.integers([0, 0, 0, 0], [60, 60, 120, 120], (60, 4)))]
    feet = [(f"f{i}", b[1], b[1] + 9, b[3], b[3] + 9) for i, b in enumerate(boxes[:25])]
    scene_df = spark.createDataFrame(
        [(i, f"2020-01-{1 + (i * 7) % 28:02d}", *b) for i, *b in boxes],
        "scene_id long, day string, xmin int, xmax int, ymin int, ymax int",
    ).withColumn("time_start", F.col("day").cast("timestamp"))
    feet_df = spark.createDataFrame(feet, "cliff_id string, xmin int, xmax int, ymin int, ymax int")
    got = {}
    for r in scenes.recent_scenes(feet_df, scene_df.drop("day"), 3, 8).collect():
        got.setdefault(r["cliff_id"], []).append((r["recency"], r["scene_id"]))
    for name, x0, x1, y0, y1 in feet:
        meets = [(-((i * 7) % 28), i) for i, a, b, c, d in boxes if a <= x1 and b >= x0 and c <= y1 and d >= y0]
        assert [s for _, s in sorted(got.get(name, []))] == [i for _, i in sorted(meets)[:3]]


def test_oversampling_keeps_rows_together(spark):
    rows = spark.range(200).select("id", (F.when(F.col("id") < 150, 0.05).otherwise(F.col("id") / 1000)).alias("y"))
    out = model.oversample(rows, "y", "id", block=7)
    sizes = {r["class"]: r["count"] for r in out.groupBy("class").count().collect()}
    assert set(sizes.values()) == {150}
    assert out.select("id", "y").exceptAll(rows.crossJoin(spark.range(200).select(F.lit(1).alias("z"))).select("id", "y")).count() == 0
    assert out.filter("copy = 0").count() == 200


@pytest.mark.parametrize("block", [7, 1000])
def test_knn_against_brute_force(spark, block):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(60, 3)).round(1)
    y = rng.integers(0, 5, 60)
    df = spark.createDataFrame([(i, *map(float, d), float(t)) for i, (d, t) in enumerate(zip(data, y))], "id long, a double, b double, c double, y double")
    got = {r["id"]: r["prediction"] for r in model.knn_predict(df.filter("id < 40"), df, ["a", "b", "c"], "y", "id", 5, 1.5, block).collect()}
    for i in range(60):
        near = sorted((float((np.abs(data[j] - data[i]) ** 1.5).sum()), float(y[j])) for j in range(40))[:5]
        assert got[i] == pytest.approx(np.mean([t for _, t in near]))


def test_settings_are_drawn_once_each():
    drawn = model.random_settings("forest", 20, seed=1)
    assert len({str(d) for d in drawn}) == 20
    assert model.random_settings("linear", 5) == [{}]
    assert len(model.random_settings("ridge", 100)) == 8


def test_knn_and_tree_search(spark):
    rows = spark.range(80).select(
        "id", (F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 10 * 2.0).alias("y")
    )
    for name, n in (("knn", 1), ("tree", 2)):
        best = model.search_settings(name, rows, ["a"], "y", "id", n, n_folds=2)
        assert best.count() == n and best.first()["r2"] <= 1.0


def test_saved_settings_keep_history(spark):
    path = scratch_dir(spark)
    best = spark.createDataFrame([("ridge", {"alpha": "1"})], "model string, params map<string,string>")
    tables.save_settings(best, path, 1)
    newer = spark.createDataFrame([("ridge", {"alpha": "5"})], "model string, params map<string,string>")
    tables.save_settings(newer, path, 2)
    history = tables.read_table(spark, path)
    assert history.count() == 2
    assert model.best_settings(history).first()["params"] == {"alpha": "5"}


def test_unknown_models_are_refused(spark):
    with pytest.raises(ValueError):
        model.regressor("neural", spark.range(1), ["a"], "y")
    with pytest.raises(ValueError):
        model.feature_importance("linear", None, [], spark)


def test_composite_ignores_cloudy_scenes(spark):
    rows = [(1, 0, 0, 0, 10), (2, 0, 0, 9, 20), (3, 0, 0, 50, 999), (4, 1, 0, 70, 5)]
    df = spark.createDataFrame(rows, "scene_id int, x int, y int, cloud int, B2 int")
    got = {(r["x"], r["y"]): r["B2"] for r in scenes.cloud_reduced_composite(df, ["B2"]).collect()}
    assert got == {(0, 0): 15.0, (1, 0): 5.0}




def test_missing_scores_stay_missing(spark):
    rows = [(1, 999.0), (2, 1000.0), (3, 2.0**20), (4, None), (5, float("nan"))]
    frame = spark.createDataFrame(rows, "id int, raw double")
    got = {r.id: r.s for r in frame.select("id", features.log_score(F.col("raw")).alias("s")).collect()}
    assert got[1] == got[2] == 0.0 and got[3] == 1.0
    assert got[4] is None and got[5] is None


def test_match_without_counts_is_a_match(spark):
    cliffs = spark.createDataFrame([(1,), (2,)], "cliff_id int")
    matches = spark.createDataFrame([(1, None, None)], "cliff_id int, n_views long, n_rock long")
    got = {r.cliff_id: (r.mp_score, r.n_views) for r in features.raw_score(cliffs, matches).collect()}
    assert got == {1: (1000, 0), 2: (0, 0)}


def test_other_grids_find_their_tiles(spark):
    grid = {"xmin": 0.0, "dx": 2.0, "ymin": 10.0, "dy": 3.0}
    tiles = terrain.tile_grid(spark, xmax=4.0, ymax=16.0, **grid)
    points = spark.createDataFrame([(11.0, 1.0), (17.5, 5.0)], "lat double, lon double")
    own = points.select(*[c.alias(n) for n, c in terrain.tile_of(F.col("lat"), F.col("lon"), **grid).items()])
    assert tiles.count() == 9
    assert tiles.join(own, ["tile_x", "tile_y"], "left_semi").count() == 2
    assert sorted((r.tile_x, r.tile_y) for r in terrain.tiles_touching(tiles, points, **grid).collect()) == [(0, 0), (2, 2)]


def test_stage_columns_that_are_no_features(spark):
    frame = spark.createDataFrame(
        [(1, 2.0, 3.0, "n", 5, 6.0, 7.0, True)],
        "site_id int, lat double, lon double, name string, n_rock int, height double, mp_score double, is_accessible boolean",
    )
    assert model.feature_columns(frame) == ["height"]


@pytest.mark.parametrize("leaf_pairs", [1, 40, 1 << 14])
def test_recent_scenes_of_crowded_tiles(spark, leaf_pairs):
    """Tiles that no scene covers, equal times, copies of an id with other boxes: cut as far as needed."""
    rng = np.random.default_rng(1)
    boxes = [(i, int(x), int(x + w), int(y), int(y + h)) for i, (x, y, w, h) in
             enumerate(rng.integers([0, 0, 0, 0], [90, 90, 40, 40], (300, 4)))]
    feet = [(i, int(x), int(x + w), int(y), int(y + h)) for i, (x, y, w, h) in
            enumerate(rng.integers([0, 0, 0, 0], [90, 90, 45, 12], (80, 4)))]
    scene_df = spark.createDataFrame(
        [(i, i % 29, *b) for i, *b in boxes], "scene_id long, time_start int, xmin int, xmax int, ymin int, ymax int"
    )
    feet_df = spark.createDataFrame(feet, "cliff_id int, xmin int, xmax int, ymin int, ymax int")
    got = {}
    for r in scenes.recent_scenes(feet_df, scene_df, 3, 32, leaf_pairs).collect():
        got.setdefault(r["cliff_id"], []).append((r["recency"], r["scene_id"]))
    for i, x0, x1, y0, y1 in feet:
        meets = [(-(j % 29), j) for j, a, b, c, d in boxes if a <= x1 and b >= x0 and c <= y1 and d >= y0]
        assert [s for _, s in sorted(got.get(i, []))] == [j for _, j in sorted(meets)[:3]]


def test_few_pairs_of_scenes_and_footprints_meet(spark):
    """All scenes in one corner of a tile, the footprints in another: no join of all with all."""
    far = spark.range(3000).selectExpr("id AS scene_id", "id AS time_start", "0 AS xmin", "9 AS xmax", "id % 9 AS ymin", "9 AS ymax")
    feet = spark.range(2000).selectExpr("id AS cliff_id", "40 AS xmin", "47 AS xmax", "id % 40 AS ymin", "45 AS ymax")
    plan_rows = []
    real = scenes._of_few

    def counted(useful, partial, nodes, k):
        small = nodes.filter("_small").select("_tx", "_ty")
        plan_rows.append(useful.join(small, ["_tx", "_ty"]).join(scenes._renamed(partial), ["_tx", "_ty"]).count())
        return real(useful, partial, nodes, k)

    scenes._of_few = counted
    try:
        assert scenes.recent_scenes(feet, far).count() == 0
    finally:
        scenes._of_few = real
    assert sum(plan_rows) < 0.01 * 3000 * 2000
