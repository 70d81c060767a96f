"""Area trees: flatten nested or parent-pointer trees to rows and aggregate them by coordinate.

A node is an area (has `children`) or a route (has `types`). Nodes without an own coordinate
use the one of the nearest ancestor that has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escarp import config
from escarp.functions.stats import mix, with_ordinal
from escarp.session import materialize, scratch_dir

# fixed values: the virtual root above all root areas
ROOT_NAME, ROOT_LAT, ROOT_LON = "All", 39.0, -98.0
ROOT_ID = "root"

COORDINATE_TOLERANCE = 1e-3

# fixed values: what counts as a line break, and as space at either end of a name
LINE_BREAKS = "\\n\\r\\x0B\\f\\x1C\\x1D\\x1E\\x85\\u2028\\u2029"
SPACES = "[\\s\\x1C-\\x1F]+"

NODE_FIELDS = ("name", "url", "lat", "long", "gps2", "views", "types")


def clean_name(name: Column) -> Column:
    """First line, without white space at its ends."""
    first_line = F.regexp_extract(name, f"^[^{LINE_BREAKS}]*", 0)
    return F.regexp_replace(first_line, f"(?U)^{SPACES}|{SPACES}$", "")


def route_type(types: Column) -> Column:
    """boulder, else winter (mixed, ice, snow), else rock; an empty list is rock."""
    winter = F.array(*[F.lit(t) for t in config.WINTER_TYPES])
    return (
        F.when(F.array_contains(types, "boulder"), "boulder")
        .when(F.arrays_overlap(types, winter), "winter")
        .when(types.isNotNull(), "rock")
    )


def precise_coordinate(gps2: Column) -> tuple[Column, Column]:
    """(lat, lon) of the high-precision text 'lat,lon'; NULL where it cannot be read."""
    parts = F.split(gps2, ",")
    return (
        F.trim(F.try_element_at(parts, F.lit(1))).try_cast("double"),
        F.trim(F.try_element_at(parts, F.lit(2))).try_cast("double"),
    )


def coordinates_disagree(lat: Column, lon: Column, gps2: Column) -> Column:
    """True where the rounded and the precise coordinate are too far apart."""
    lat2, lon2 = precise_coordinate(gps2)
    limit = COORDINATE_TOLERANCE
    return (F.abs(lat - lat2) > limit) | (F.abs(lon - lon2) > limit)


def _with_key(level: DataFrame, on_bad: str) -> DataFrame:
    """Own coordinate if the node has one, else the parent's (`up_lat`, `up_lon`).

    An own coordinate is bad if its precise text is missing, unreadable or disagrees.
    """
    if on_bad not in ("fail", "quarantine"):
        raise ValueError(f"unknown mode {on_bad!r}")
    own = F.col("lat").isNotNull()
    disagree = coordinates_disagree(F.col("lat"), F.col("long"), F.col("gps2"))
    bad = own & F.coalesce(disagree, F.lit(True))
    lat2, lon2 = precise_coordinate(F.col("gps2"))
    if on_bad == "fail":
        fault = F.when(disagree, "coordinates disagree: ").otherwise("no precise coordinate: ")
        message = F.concat(fault, F.coalesce("url", F.lit("?")))
        lat2 = F.when(bad, F.raise_error(message).cast("double")).otherwise(lat2)
    else:
        own &= ~bad
    return level.withColumns(
        {
            "bad_coordinate": bad,
            "key_lat": F.when(own, lat2).otherwise(F.col("up_lat")),
            "key_lon": F.when(own, lon2).otherwise(F.col("up_lon")),
        }
    )


def flatten_nested(roots: DataFrame, on_bad: str = "fail") -> DataFrame:
    """Rows of a nested tree, level by level.

    `roots` has `ordinal` and `node` VARIANT, one row per root area. A level is spread over the
    cluster by path before it is written, so one large root area does not stay in one task.
    """
    scratch = scratch_dir(roots.sparkSession)

    def fields(frontier: DataFrame) -> DataFrame:
        node = F.col("node")
        return frontier.select(
            "path",
            "up_lat",
            "up_lon",
            F.try_variant_get(node, "$.name", "string").alias("name"),
            F.try_variant_get(node, "$.url", "string").alias("url"),
            F.try_variant_get(node, "$.lat", "double").alias("lat"),
            F.try_variant_get(node, "$.long", "double").alias("long"),
            F.try_variant_get(node, "$.gps2", "string").alias("gps2"),
            F.coalesce(F.try_variant_get(node, "$.totalViews", "bigint"), F.lit(0)).alias("views"),
            F.try_variant_get(node, "$.types", "array<string>").alias("types"),
            F.try_variant_get(node, "$.children", "array<variant>").alias("children"),
        )

    frontier = roots.select(
        F.array(F.col("ordinal").cast("bigint")).alias("path"),
        F.lit(ROOT_LAT).alias("up_lat"),
        F.lit(ROOT_LON).alias("up_lon"),
        "node",
    )
    rows = virtual_root(roots)
    depth = 0
    while True:
        spread = frontier.repartition(F.xxhash64("path"))
        level = materialize(_with_key(fields(spread), on_bad), f"{scratch}/depth{depth}")
        rows = rows.unionByName(_tree_rows(level))
        parents = level.filter(F.size("children") > 0)
        if parents.isEmpty():
            return rows
        child = F.posexplode("children").alias("pos", "node")
        frontier = parents.select(
            "path", F.col("key_lat").alias("up_lat"), F.col("key_lon").alias("up_lon"), child
        ).select(
            F.concat("path", F.array(F.col("pos").cast("bigint"))).alias("path"),
            "up_lat",
            "up_lon",
            "node",
        )
        depth += 1


def _area_paths(nodes: DataFrame, on_bad: str) -> DataFrame:
    """(parent_id, up_path, up_lat, up_lon) of every area below the root, by path doubling.

    Each area knows a stretch of its path: up to the ancestor `up`, with the nearest own coordinate on
    it. A round puts the ancestor's stretch before the own one, which doubles it, so that a tree of depth
    d takes about log2(d) joins. While areas below the root are left, each round finishes some of them; a
    round that finishes none leaves cycles only. Routes, the most of a tree, take no part.
    """
    scratch = scratch_dir(nodes.sparkSession)
    lat2, lon2 = precise_coordinate(F.col("gps2"))
    own = F.col("lat").isNotNull()
    if on_bad == "quarantine":
        own &= F.coalesce(~coordinates_disagree(F.col("lat"), F.col("long"), F.col("gps2")), F.lit(False))
    start = nodes.filter(F.col("types").isNull()).select(
        "node_id",
        F.col("parent_id").alias("up"),
        F.array(F.col("ordinal").cast("bigint")).alias("path"),
        F.when(own, F.struct(lat2.alias("lat"), lon2.alias("lon"))).alias("key"),
    )
    known = materialize(start, f"{scratch}/stretch0")
    at_root = F.col("up") == ROOT_ID
    done, active = known.filter(at_root), known.filter(~at_root)
    depth = 0
    while True:
        depth += 1
        ahead = done.unionByName(active).select(
            F.col("node_id").alias("up"),
            F.col("up").alias("next_up"),
            F.col("path").alias("path_before"),
            F.col("key").alias("key_before"),
        )
        doubled = active.join(ahead, "up").select(
            "node_id",
            F.col("next_up").alias("up"),
            F.concat("path_before", "path").alias("path"),
            F.coalesce("key", "key_before").alias("key"),
        )
        doubled = materialize(doubled, f"{scratch}/stretch{depth}")
        finished, active = doubled.filter(at_root), doubled.filter(~at_root)
        if finished.isEmpty():
            break
        done = done.unionByName(finished)
    root = F.struct(F.lit(ROOT_LAT).alias("lat"), F.lit(ROOT_LON).alias("lon"))
    areas = done.select("node_id", "path", F.coalesce("key", root).alias("key"))
    top = nodes.sparkSession.range(1).select(
        F.lit(ROOT_ID).alias("node_id"), F.array().cast("array<bigint>").alias("path"), root.alias("key")
    )
    return areas.unionByName(top).select(
        F.col("node_id").alias("parent_id"),
        F.col("path").alias("up_path"),
        F.col("key.lat").alias("up_lat"),
        F.col("key.lon").alias("up_lon"),
    )


def flatten_adjacency(nodes: DataFrame, on_bad: str = "fail") -> DataFrame:
    """The same rows from parent-pointer nodes.

    `nodes` has `node_id`, `parent_id`, `ordinal` among siblings and the node fields; root areas
    have the parent `ROOT_ID`. Nodes that no chain of areas ties to the root are left out.
    """
    joined = nodes.join(_area_paths(nodes, on_bad), "parent_id").withColumn(
        "path", F.concat("up_path", F.array(F.col("ordinal").cast("bigint")))
    )
    rows = _tree_rows(_with_key(joined.drop("up_path"), on_bad))
    rows = materialize(rows, f"{scratch_dir(nodes.sparkSession)}/nodes")
    return virtual_root(nodes).unionByName(rows)


def _tree_rows(level: DataFrame) -> DataFrame:
    return level.select("path", *NODE_FIELDS, "key_lat", "key_lon", "bad_coordinate")


def virtual_root(like: DataFrame) -> DataFrame:
    """The one row above all root areas."""
    return like.sparkSession.range(1).select(
        F.array().cast("array<bigint>").alias("path"),
        F.lit(ROOT_NAME).alias("name"),
        F.lit(None).cast("string").alias("url"),
        F.lit(ROOT_LAT).alias("lat"),
        F.lit(ROOT_LON).alias("long"),
        F.lit(f"{ROOT_LAT},{ROOT_LON}").alias("gps2"),
        F.lit(0).cast("bigint").alias("views"),
        F.lit(None).cast("array<string>").alias("types"),
        F.lit(ROOT_LAT).alias("key_lat"),
        F.lit(ROOT_LON).alias("key_lon"),
        F.lit(False).alias("bad_coordinate"),
    )


def areas_by_coordinate(
    rows: DataFrame, double_count_leaf_views: bool = True, with_path: bool = False
) -> DataFrame:
    """One area per coordinate that has routes: counts by type, views, topmost name.

    `with_path` adds the `path` of the node that gives the name, which orders areas by position.
    The name is the first in depth-first order: paths compare like that order, prefix first. A
    node that inherits its coordinate comes after the one it has it from, so only nodes with an
    own one are looked at for names; the many routes meet in the plain sums alone.
    """
    kind = route_type(F.col("types"))
    weight = F.when(F.col("types").isNotNull() & F.lit(double_count_leaf_views), 2).otherwise(1)
    counts = (
        rows.groupBy("key_lat", "key_lon")
        .agg(
            F.count_if(kind == "boulder").alias("n_boulder"),
            F.count_if(kind == "winter").alias("n_winter"),
            F.count_if(kind == "rock").alias("n_rock"),
            F.sum(F.col("views") * weight).alias("n_views"),
        )
        .filter(F.col("n_boulder") + F.col("n_winter") + F.col("n_rock") > 0)
    )
    names = (
        rows.filter(F.col("lat").isNotNull() & ~F.col("bad_coordinate"))
        .groupBy("key_lat", "key_lon")
        .agg(
            F.min_by(clean_name(F.col("name")), F.col("path")).alias("name"),
            F.min("path").alias("path"),
        )
    )
    found = counts.join(names if with_path else names.drop("path"), ["key_lat", "key_lon"])
    return found.withColumnsRenamed({"key_lat": "latitude", "key_lon": "longitude"})


def random_branches(nodes: DataFrame, n_draws: int, seed: int = 0) -> DataFrame:
    """Random walks from the virtual root to a leaf, a uniform child at each step.

    Rows (draw, depth, node_id). Children get a dense position once, so that a step is one
    equi-join of the few walks with the children.
    """
    sized = nodes.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n_children"))
    placed = with_ordinal(
        nodes.select("node_id", "parent_id", "ordinal"), ["parent_id"], "ordinal", ["node_id"], "at"
    )
    scratch = scratch_dir(nodes.sparkSession)
    children = materialize(
        placed.join(sized, "parent_id").select("parent_id", "node_id", "at", "n_children"),
        f"{scratch}/children",
    )
    counts = children.filter(F.col("at") == 0).select("parent_id", "n_children")
    walks = nodes.sparkSession.range(n_draws).select(
        F.col("id").alias("draw"), F.lit(ROOT_ID).alias("node_id")
    )
    steps = None
    depth = 0
    while True:
        turn = mix(F.lit(seed), F.col("draw"), F.lit(depth))
        chosen = (
            walks.withColumnRenamed("node_id", "parent_id")
            .join(counts, "parent_id")
            .withColumn("at", F.pmod(turn, F.col("n_children")))
            .drop("n_children")
        )
        walks = materialize(
            chosen.join(children.drop("n_children"), ["parent_id", "at"]).select("draw", "node_id"),
            f"{scratch}/step{depth}",
        )
        if walks.isEmpty():
            return steps
        depth += 1
        step = walks.withColumn("depth", F.lit(depth))
        steps = step if steps is None else steps.unionByName(step)
