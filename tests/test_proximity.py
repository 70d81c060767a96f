"""Distance joins against brute force, also with crowded cells and odd places."""

import math
import random

import pytest
from pyspark.sql import functions as F

from escarp.operators.proximity import (
    aggregate_in_zones,
    aggregate_within,
    densify_segments,
    nearest_within,
    zones_within,
)

R = 6371008.8


def metres(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = (
        math.sin((lb - la) / 2) ** 2
        + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    )
    return 2 * R * math.asin(min(1.0, math.sqrt(h)))


def around(rng, n, lat, lon, spread):
    return [(lat + rng.uniform(-spread, spread), lon + rng.uniform(-spread, spread)) for _ in range(n)]


def frame(spark, points, id_name):
    rows = [(i, float(p[0]), float((p[1] + 180) % 360 - 180), i % 5) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, f"{id_name} long, lat double, lon double, w long")


def scene(name):
    rng = random.Random(name)
    if name == "spread":
        return around(rng, 80, 40, -110, 0.03), around(rng, 80, 40, -110, 0.03)
    if name == "crowded":  # most of both sides within a few metres, copies included
        core = around(rng, 60, 40, -110, 0.00005)
        left = core + core[:20] + around(rng, 20, 40, -110, 0.02)
        right = around(rng, 90, 40, -110, 0.0001) + core[:30] + around(rng, 20, 40, -110, 0.02)
        return left, right
    if name == "north":
        return around(rng, 60, 78, 20, 0.05), around(rng, 60, 78, 20, 0.05)
    if name == "date_line":
        return around(rng, 60, 10, 180, 0.02), around(rng, 60, 10, 180, 0.02)
    if name == "pole":
        return around(rng, 20, 89.998, 0, 0.0015) + [(89.9995, 170)], [(89.9995, -10), (89.999, 90)]
    if name == "equator":
        return around(rng, 60, 0, 0, 0.02), around(rng, 60, 0, 0, 0.02)
    raise KeyError(name)


def everything():
    """All scenes at once; they lie far apart from each other."""
    names = ["spread", "north", "date_line", "pole", "equator", "crowded"]
    parts = [scene(n) for n in names]
    # the first and the last scene share a place
    parts[0] = tuple([(lat + 3, lon) for lat, lon in side] for side in parts[0])
    return [p for part in parts for p in part[0]], [p for part in parts for p in part[1]]


@pytest.mark.parametrize("leaf_pairs", [6, 1 << 16])
def test_nearest(spark, leaf_pairs):
    left, right = everything()
    got = nearest_within(
        frame(spark, left, "a"), frame(spark, right, "b"), "b", 800, "b", "d", leaf_pairs
    )
    got = {r["a"]: r["d"] for r in got.collect()}
    want = {}
    for i, p in enumerate(left):
        best = min(metres(p, q) for q in right)
        if best <= 800:
            want[i] = best
    assert set(got) == set(want)
    for i in want:
        assert got[i] == pytest.approx(want[i], abs=1e-3)


@pytest.mark.parametrize("leaf_pairs", [6, 1 << 16])
def test_aggregates(spark, leaf_pairs):
    left, right = everything()
    got = aggregate_within(
        frame(spark, left, "a").drop("w"),
        frame(spark, right, "b"),
        {"_300": 300.0, "_800": 800.0},
        {"w": ("sum", F.col("w")), "n": ("sum", F.lit(1)), "top": ("max", F.col("b"))},
        leaf_pairs,
    ).collect()
    assert len(got) == len(left)
    for row in got:
        p = left[row["a"]]
        for r in (300, 800):
            near = [i for i, q in enumerate(right) if metres(p, q) <= r]
            assert row[f"n_{r}"] == (len(near) or None)
            assert row[f"w_{r}"] == (sum(i % 5 for i in near) if near else None)
            assert row[f"top_{r}"] == (max(near) if near else None)


@pytest.mark.parametrize("leaf_pairs", [6, 1 << 16])
def test_zones(spark, leaf_pairs):
    left, right = everything()
    cells = frame(spark, right, "b").withColumn("zone", F.when(F.col("b") != 3, F.col("b") % 7))
    got = zones_within(frame(spark, left, "a"), cells, "zone", 800, "d", leaf_pairs).collect()
    want = {}
    for i, p in enumerate(left):
        for j, q in enumerate(right):
            if j != 3 and metres(p, q) <= 800:
                want[i, j % 7] = min(want.get((i, j % 7), 800.0), metres(p, q))
    assert {(r["a"], r["zone"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        assert r["d"] == pytest.approx(want[r["a"], r["zone"]], abs=1e-3)


def test_a_dense_footprint_is_not_joined_point_by_point(spark):
    """A square of 250,000 cells of one footprint and 2,500 points: few pairs of points are left."""
    from escarp.functions.geo import CellGrid
    from escarp.operators import proximity

    cells = spark.range(250_000).selectExpr("0 AS zone", "40 + id % 500 * 1e-5 AS lat", "-110 + id div 500 * 1e-5 AS lon")
    sites = spark.range(2_500).selectExpr("id AS a", "40 + id % 50 * 1e-4 + 3e-6 AS lat", "-110 + id div 50 * 1e-4 AS lon")
    grid = CellGrid(800.0)
    one = proximity._Side(proximity._keyed(sites.select("lat", "lon"), grid), grid, {}, (), proximity.scratch_dir(spark) + "/l")
    two = proximity._Side(proximity._keyed(cells, grid), grid, {}, ["zone"], proximity.scratch_dir(spark) + "/r")
    walk = proximity._Walk(one, two, [800.0], True, proximity.NEAREST_LEAF_PAIRS, proximity.scratch_dir(spark))
    leaves = 0
    for ll, rl, pairs in walk.small:
        sizes = one.cells(ll).select("_cy", "_cx", "_n").join(
            pairs.select(F.col("_ly").alias("_cy"), F.col("_lx").alias("_cx"), "_ry", "_rx"), ["_cy", "_cx"])
        many = two.cells(rl).select(F.col("_cy").alias("_ry"), F.col("_cx").alias("_rx"), F.col("_n").alias("_m"))
        row = sizes.join(many, ["_ry", "_rx"]).agg(F.sum(F.col("_n") * F.col("_m")).alias("s"), F.max(F.col("_n") * F.col("_m")).alias("m")).first()
        leaves += row["s"]
        assert row["m"] <= proximity.NEAREST_LEAF_PAIRS
    assert leaves < 0.1 * 250_000 * 2_500
    near = zones_within(sites, cells, "zone", 800, "d")
    assert near.count() == 2_500 and near.agg(F.max("d")).first()[0] < 1.0


def test_tie_goes_to_smallest_id(spark):
    left = spark.createDataFrame([(1, 40.0, -110.0)], "a long, lat double, lon double")
    right = spark.createDataFrame(
        [(7, 40.001, -110.0), (5, 40.001, -110.0), (9, 40.001, -110.0)],
        "b long, lat double, lon double",
    )
    assert nearest_within(left, right, "b", 300, "b").first()["b"] == 5


def test_points_without_coordinate_match_nothing(spark):
    left = spark.createDataFrame([(1, None, None), (2, 40.0, -110.0)], "a long, lat double, lon double")
    right = left.select(F.col("a").alias("b"), "lat", "lon")
    got = aggregate_within(left, right, {"": 100.0}, {"n": ("sum", F.lit(1))})
    assert {r["a"]: r["n"] for r in got.collect()} == {1: None, 2: 1}


def test_densified_line(spark):
    line = spark.createDataFrame([(1, 40.0, -110.0, 40.0, -109.99)], "id long, lat1 double, lon1 double, lat2 double, lon2 double")
    points = sorted((r["lon"] for r in densify_segments(line, 100).collect()))
    assert points[0] == -110.0 and points[-1] == pytest.approx(-109.99)
    assert max(metres((40, a), (40, b)) for a, b in zip(points, points[1:])) <= 100


def test_a_wall_longer_than_the_radius_counts_each_area_once(spark):
    from escarp.operators.features import attach_areas, attach_vicinity

    cells = [(1, 40.0, -110.0 + 0.0005 * i) for i in range(60)] + [(2, 40.01, -110.0)]
    wall = spark.createDataFrame(cells, "cliff_id long, lat double, lon double")
    cliffs = spark.createDataFrame([(1, 40.0, -109.985), (2, 40.01, -110.0), (3, 50.0, 5.0)], "cliff_id long, lat double, lon double")
    areas = [(1, "end", 40.0, -109.9705, 3, 10), (2, "start", 40.0, -110.001, 1, 5), (2, "start", 40.0, -110.001, 1, 5), (4, "far", 41.0, -110.0, 9, 9), (5, "lost", None, -110.0, 9, 9)]
    areas = spark.createDataFrame(areas, "ord long, name string, lat double, lon double, n_rock long, n_views long")
    got = attach_vicinity(attach_areas(cliffs, areas, 300, wall), areas, 300, wall)
    got = {r["cliff_id"]: (r["n_rock"], r["n_views"], r["name"], r["vicinity_n_areas"], r["vicinity_n_rock"]) for r in got.collect()}
    assert got == {1: (5, 20, "start - start - end - ", 3, 5), 2: (0, 0, "", 0, 0), 3: (0, 0, "", 0, 0)}


@pytest.mark.parametrize("leaf_pairs", [6, 1 << 16])
def test_sums_in_zones(spark, leaf_pairs):
    """Each point counts once for a zone, also where several of its cells are near."""
    left, right = everything()
    cells = frame(spark, right, "b").withColumn("zone", F.when(F.col("b") != 3, F.col("b") % 7))
    aggs = {"w": ("sum", F.col("w")), "n": ("sum", F.lit(1)), "top": ("max", F.col("a"))}
    got = aggregate_in_zones(cells, "zone", frame(spark, left, "a"), 800, aggs, leaf_pairs).collect()
    want = {}
    for i, p in enumerate(left):
        for zone in {j % 7 for j, q in enumerate(right) if j != 3 and metres(p, q) <= 800}:
            want.setdefault(zone, []).append(i)
    assert {r["zone"]: (r["n"], r["w"], r["top"]) for r in got} == {
        z: (len(near), sum(i % 5 for i in near), max(near)) for z, near in want.items()
    }


def test_no_row_for_each_point_near_a_zone(spark):
    """Nearly all points lie deep within the radius of all zones: few are compared one by one."""
    from escarp.operators import proximity

    sites = spark.range(200).selectExpr("id AS zone", "40 + id * 1e-5 AS lat", "-110.0D AS lon")
    areas = spark.range(10_000).selectExpr("40 + (id % 100) * 6e-5 AS lat", "-110 + id div 100 * 6e-5 AS lon")
    compared = []
    real = proximity._near_zones

    def counted(*args):
        found = real(*args)
        compared.append(found.count())
        return found

    proximity._near_zones = counted
    try:
        got = aggregate_in_zones(sites, "zone", areas, 3000.0, {"n": ("sum", F.lit(1))})
        assert {r["n"] for r in got.collect()} == {10_000} and got.count() == 200
    finally:
        proximity._near_zones = real
    assert sum(compared) < 0.1 * 200 * 10_000


def test_the_largest_of_structs_sorts_no_pairs(spark):
    """The largest text or struct around each point: pairs are folded by a hash table, not sorted."""
    left, right = scene("crowded")
    probes, areas = frame(spark, left, "a"), frame(spark, right, "b")
    top = F.struct("w", (-F.col("b")).alias("o"), F.concat(F.lit("n"), F.col("b")).alias("name"))
    name = F.when(F.col("w") > 1, F.concat(F.lit("n"), F.col("b")))
    around = aggregate_within(probes, areas, {"_1": 300.0, "_2": 800.0}, {"top": ("max", top), "first": ("min", name)})
    rows = around.collect()
    plan = around._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert len(rows) == len(left)
    for row in rows:
        for suffix, r in (("_1", 300), ("_2", 800)):
            near = [i for i, q in enumerate(right) if metres(left[row["a"]], q) <= r]
            best = max(((i % 5, -i, f"n{i}") for i in near), default=None)
            assert (tuple(row["top" + suffix]) if row["top" + suffix] else None) == best
            assert row["first" + suffix] == min((f"n{i}" for i in near if i % 5 > 1), default=None)
