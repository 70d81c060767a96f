"""Connected regions: labels must not depend on tiles, and odd shapes must hold together."""

import random

import pytest
from pyspark.sql import functions as F

from escarp.operators import terrain, zonal
from escarp.operators.components import connected_components, connected_nodes


def regions_of(cells):
    """Brute-force 8-neighbour regions as a set of frozensets."""
    left, found = set(cells), set()
    while left:
        todo, region = [left.pop()], set()
        while todo:
            x, y = todo.pop()
            region.add((x, y))
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    near = (x + dx, y + dy)
                    if near in left:
                        left.remove(near)
                        todo.append(near)
        found.add(frozenset(region))
    return found


def labelled(spark, cells, tile, column="component"):
    df = spark.createDataFrame([(x, y) for x, y in cells], "x int, y int")
    groups = {}
    for r in connected_components(df, tile).collect():
        groups.setdefault(r[column], set()).add((r["x"], r["y"]))
    return {frozenset(g) for g in groups.values()}


def spiral(n):
    cells, x, y, dx, dy, step = [], 0, 0, 1, 0, n
    seen = set()
    while step > 0:
        for _ in range(step):
            if (x, y) not in seen:
                seen.add((x, y))
                cells.append((x, y))
            x, y = x + dx, y + dy
        dx, dy = -dy, dx
        step -= 1 if dx == 0 else 2
    return cells


SHAPES = {
    "diagonal": [(0, 0), (1, 1), (3, 3), (4, 2)],
    "over_edge": [(3, 1), (4, 1), (9, 9)],
    "over_corner": [(3, 3), (4, 4), (3, 8), (4, 7)],
    "negative": [(-1, -1), (0, 0), (-5, -5)],
    "spiral": spiral(24),
    "row": [(x, 0) for x in range(100)],
    "single": [(5, 5)],
}


@pytest.mark.parametrize("tile", [1, 4, 64])
def test_shapes(spark, tile):
    """All shapes on one raster, each far from the others."""
    cells = [
        (x + 1000 * n, y) for n, shape in enumerate(sorted(SHAPES)) for x, y in SHAPES[shape]
    ]
    assert labelled(spark, cells, tile) == regions_of(cells)


@pytest.mark.parametrize("tile", [3, 50])
def test_random_field(spark, tile):
    rng = random.Random(tile)
    cells = [(x, y) for x in range(40) for y in range(40) if rng.random() < 0.42]
    assert labelled(spark, cells, tile) == regions_of(cells)


def test_star_and_path_of_nodes(spark):
    edges = [("hub", f"leaf{i}") for i in range(200)] + [(f"p{i}", f"p{i + 1}") for i in range(60)]
    got = connected_nodes(spark.createDataFrame(edges, "a string, b string")).collect()
    names = {}
    for r in got:
        names.setdefault(r["component"], set()).add(r["node"])
    assert sorted(len(n) for n in names.values()) == [61, 201]


def test_height_must_exceed_threshold(spark):
    steep = spark.createDataFrame(
        [(0, 0, 100), (1, 0, 150), (5, 5, 100), (6, 6, 151)], "x int, y int, elevation int"
    )
    cliffs = zonal.cliff_cells(steep, min_height=50)
    assert {(r["x"], r["y"]) for r in cliffs.collect()} == {(5, 5), (6, 6)}


@pytest.mark.parametrize("tile", [2, 3, 4, 512])
def test_cliff_splits_at_rectangles_whatever_the_tile_and_keeps_the_whole_height(spark, tile):
    steep = spark.createDataFrame(
        [(x, 0, 100 * x) for x in range(6)], "x int, y int, elevation int"
    )
    split = zonal.cliff_cells(steep, split_cells=4, tile_cells=tile)
    parts = zonal.vectorize(split).collect()
    assert sorted((r["cliff_id"], r["height"], r["pixel_count"]) for r in parts) == [
        (0, 500, 4),
        (4, 500, 2),
    ]
    whole = zonal.vectorize(zonal.cliff_cells(steep, tile_cells=tile)).collect()
    assert [(r["cliff_id"], r["height"], r["pixel_count"]) for r in whole] == [(0, 500, 6)]


@pytest.mark.parametrize("tile", [3, 5, 64])
def test_parts_of_a_rectangle_join_only_inside_it(spark, tile):
    # a U: its arms lie in the lower rectangle, their bridge in the upper one
    cells = [(x, y) for x in (1, 4) for y in range(6, 8)] + [(x, 8) for x in range(1, 5)]
    steep = spark.createDataFrame([(x, y, 30 * y) for x, y in cells], "x int, y int, elevation int")
    got = zonal.cliff_cells(steep, split_cells=8, tile_cells=tile).collect()
    parts = {}
    for r in got:
        parts.setdefault(r["cliff_id"], set()).add((r["x"], r["y"]))
    arms = [{(1, 6), (1, 7)}, {(4, 6), (4, 7)}]
    assert sorted(parts.values(), key=min) == sorted([*arms, {(x, 8) for x in range(1, 5)}], key=min)
    assert {r["height"] for r in got} == {60}


def test_dilation_holds_the_footprint_and_joins_diagonals(spark):
    cells = spark.createDataFrame([("c", 0, 0), ("c", 1, 1)], "cliff_id string, x int, y int")
    got = {(r["x"], r["y"]) for r in zonal.dilate(cells, 1).collect()}
    assert {(0, 0), (1, 1), (0, 1), (1, 0)} <= got and len(got) == 8


@pytest.mark.parametrize("tile", [2, 3, 100])
def test_slope_does_not_depend_on_tiles(spark, tile):
    rng = random.Random(0)
    z = {(x, y): rng.randrange(100) for x in range(7) for y in range(6) if (x, y) != (3, 3)}
    cells = spark.createDataFrame([(x, y, v) for (x, y), v in z.items()], "x int, y int, elevation int")
    got = {(r["x"], r["y"]): (r["dzdx"], r["dzdy"]) for r in terrain.gradient(cells, tile_cells=tile).collect()}
    assert set(got) == set(z)
    for x, y in z:
        sides = [z.get(k) for k in ((x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1))]
        if None in sides:
            assert got[(x, y)] == (None, None)
        else:
            assert got[(x, y)] == ((sides[1] - sides[0]) / 20, (sides[3] - sides[2]) / 20)


def test_aspect_points_downhill(spark):
    ground = spark.createDataFrame(
        [(0.0, -1.0), (-1.0, 0.0), (0.0, 1.0), (1.0, 0.0), (0.0, 0.0)], "dzdx double, dzdy double"
    )
    got = [r[0] for r in ground.select(F.round(terrain.aspect_degrees(), 6)).collect()]
    assert got == [0.0, 90.0, 180.0, 270.0, 0.0]


def test_tile_grid_counts_the_passing_rows(spark):
    grid = terrain.tile_grid(spark)
    assert grid.count() == 93 * 73
    assert grid.agg(F.max("east"), F.max("north")).first() == (-101.75, 49.25)
