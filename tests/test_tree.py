"""Tree flattening on small hand-made trees."""

import json
import random

import pytest
from pyspark.sql import functions as F

from escarp.operators import tree
from escarp.sources import tables


def area(name, children, lat=None, lon=None, views=0, gps2=None):
    node = {"name": name, "url": f"u/{name}", "totalViews": views, "children": children}
    if lat is not None:
        node |= {"lat": lat, "long": lon, "gps2": gps2 or f"{lat},{lon}"}
    return node


def route(name, types, views=1):
    return {"name": name, "url": f"u/{name}", "totalViews": views, "types": types}


ROOTS = [
    area(
        " North \nsubtitle",
        [
            area("Inherits", [route("r1", ["trad"]), route("r2", ["alpine", "snow"], 5)], views=3),
            area("Own", [route("r3", []), route("r4", ["boulder", "ice"])], 41.0, -110.5, 2),
        ],
        40.0,
        -110.0,
        10,
        "40.0004,-110.0004",
    ),
    area("Same place as Own", [route("r5", ["sport"])], 41.0, -110.5),
    area("Empty", [], 42.0, -111.0, 7),
]


@pytest.mark.parametrize("one_list", [False, True])
def test_nested_tree(spark, tmp_path, one_list):
    path = tmp_path / "tree.json"
    text = json.dumps(ROOTS, indent=1) if one_list else "\n".join(json.dumps(r) for r in ROOTS)
    path.write_text(text)
    rows = tree.flatten_nested(tables.read_area_tree(spark, str(path), one_list)).cache()
    assert rows.count() == 11
    got = {
        (r["latitude"], r["longitude"]): (r["name"], r["n_boulder"], r["n_winter"], r["n_rock"], r["n_views"])
        for r in tree.areas_by_coordinate(rows).collect()
    }
    assert got == {
        (40.0004, -110.0004): ("North", 0, 1, 1, 10 + 3 + 2 + 10),
        (41.0, -110.5): ("Own", 1, 0, 2, 2 + 2 + 2 + 2),
    }
    once = tree.areas_by_coordinate(rows, double_count_leaf_views=False)
    assert once.filter("latitude = 41.0").first()["n_views"] == 2 + 3


def bad_roots(spark):
    nodes = [
        ("a", "root", 0, "A", "u/a", 40.0, -110.0, "40.0,-110.0", 0, None),
        ("b", "a", 0, "B", "u/b", 41.0, -111.0, "41.002,-111.0", 0, None),
        ("c", "b", 0, "C", "u/c", None, None, None, 1, ["trad"]),
    ]
    schema = (
        "node_id string, parent_id string, ordinal long, name string, url string, lat double, "
        "long double, gps2 string, views long, types array<string>"
    )
    return spark.createDataFrame(nodes, schema)


def test_bad_coordinate_fails(spark):
    with pytest.raises(Exception, match="coordinates disagree: u/b"):
        tree.flatten_adjacency(bad_roots(spark)).collect()


def test_bad_coordinate_in_quarantine(spark):
    rows = tree.flatten_adjacency(bad_roots(spark), on_bad="quarantine").cache()
    assert [r["name"] for r in rows.filter("bad_coordinate").collect()] == ["B"]
    assert rows.filter("name = 'C'").first()["key_lat"] == 40.0


@pytest.mark.parametrize("gps2", [None, "", "41.0", "north,west"])
def test_coordinate_without_precise_text_is_bad(spark, gps2):
    nodes = bad_roots(spark).withColumn("gps2", F.when(F.col("node_id") == "b", F.lit(gps2)).otherwise(F.col("gps2")))
    with pytest.raises(Exception, match="no precise coordinate: u/b"):
        tree.flatten_adjacency(nodes).collect()
    rows = tree.flatten_adjacency(nodes, on_bad="quarantine").cache()
    assert [r["name"] for r in rows.filter("bad_coordinate").collect()] == ["B"]
    found = tree.areas_by_coordinate(rows, with_path=True).collect()
    assert [(r["name"], r["n_rock"], r["path"]) for r in found] == [("A", 1, [0])]


NODE_SCHEMA = (
    "node_id string, parent_id string, ordinal long, name string, url string, lat double, "
    "long double, gps2 string, views long, types array<string>"
)


def test_deep_trees_cycles_and_orphans(spark, monkeypatch):
    rng = random.Random(5)
    nodes, parents = {}, ["root"]
    for i in range(64):  # a chain of depth 64
        nodes[f"c{i}"] = [f"c{i - 1}" if i else "root", 0, None]
        parents.append(f"c{i}")
    for i in range(150):
        nodes[f"a{i}"] = [rng.choice(parents), i + 1, None]
        parents.append(f"a{i}")
    for i in range(300):
        nodes[f"r{i}"] = [rng.choice(parents[1:]), 1000 + i, ["trad"]]
    nodes |= {"x": ["y", 0, None], "y": ["x", 0, None], "under_x": ["x", 1, ["trad"]]}
    nodes |= {"lost": ["nowhere", 0, None], "under_lost": ["lost", 0, None], "under_route": ["r0", 0, None]}
    nodes["loop"] = ["loop", 0, None]
    at = {n: (round(40 + i / 100, 2), -110.0) for i, n in enumerate(nodes) if n.startswith(("c", "a")) and rng.random() < 0.3}
    data = [
        (n, up, place, n, f"u/{n}", *(at[n] if n in at else (None, None)), f"{at[n][0]},{at[n][1]}" if n in at else None, 1, kinds)
        for n, (up, place, kinds) in nodes.items()
    ]
    want = {}
    for n in nodes:
        path, key, here, seen = [], None, n, set()
        while here in nodes and here not in seen and (here == n or nodes[here][2] is None):
            seen.add(here)
            path.insert(0, nodes[here][1])
            key = key or at.get(here)
            here = nodes[here][0]
        if here == "root":
            want[n] = (path, *(key or (tree.ROOT_LAT, tree.ROOT_LON)))
    written = []
    write = tree.materialize
    monkeypatch.setattr(tree, "materialize", lambda df, path: written.append(path) or write(df, path))
    frame = spark.createDataFrame(data, NODE_SCHEMA)
    rows = tree.flatten_adjacency(frame).collect()
    assert {r["name"]: (r["path"], r["key_lat"], r["key_lon"]) for r in rows if r["path"]} == want
    assert len(rows) == len(want) + 1 and len(want) == 64 + 150 + 300
    assert len(written) <= 10  # the first stretches, eight joins at most, the rows
    assert tree.flatten_adjacency(frame.limit(0)).count() == 1


@pytest.mark.parametrize("split", ["134217728", "700"])
def test_reading_order_for_any_split_size(spark, tmp_path, split):
    for part in range(4):
        lines = [json.dumps({"name": f"{part}-{i}", "children": []}) for i in range(50 + 40 * part)]
        lines.insert(7, "")
        (tmp_path / f"part{part}.json").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        roots = tables.read_area_tree(spark, str(tmp_path))
        names = roots.select("ordinal", F.try_variant_get("node", "$.name", "string").alias("name"))
        got = sorted(tuple(r) for r in names.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [f"{part}-{i}" for part in range(4) for i in range(50 + 40 * part)]
    assert got == list(enumerate(want))


def test_clean_name(spark):
    names = [" a b ", "x\r\ny", " pad ", "", "one\x0btwo", "q r"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(tree.clean_name(F.col("n")))
    want = [(n.splitlines() or [""])[0].strip() for n in names]
    assert [r[0] for r in got.collect()] == want


def test_random_branches_end_at_leaves(spark):
    nodes = bad_roots(spark)
    walks = tree.random_branches(nodes, 5).collect()
    assert sorted((r["draw"], r["depth"], r["node_id"]) for r in walks) == [
        (d, i + 1, n) for d in range(5) for i, n in enumerate("abc")
    ]
