"""The engine's inputs as views on the shared test tables (whole tables, integer arithmetic).

Each Spark view has a twin in SQL, used by the comparison queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from escarp.operators.tree import ROOT_ID
from escarp.operators.zonal import Georeference

GRID = Georeference(west=-125.0, south=31.0, step=0.0001)
GRID_COLUMNS = 100
VIEW_TILE_CELLS = 25
CELL_M = 700


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _div(a: Column, b: int) -> Column:
    """Whole-number division of non-negative integers."""
    return F.floor(a / b).cast("bigint")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation cells from orders, 100 to a row."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return orders.select(
        F.pmod(key, F.lit(GRID_COLUMNS)).alias("x"),
        _div(key, GRID_COLUMNS).alias("y"),
        _div(F.floor("o_totalprice"), 100).cast("int").alias("elevation"),
    )


CELLS = """cells AS (
  SELECT o_orderkey % 100 AS x, o_orderkey // 100 AS y,
         CAST(CAST(floor(o_totalprice) AS BIGINT) // 100 AS INTEGER) AS elevation
  FROM orders)"""


def _place(key: Column, lon_step: int, lat_step: int) -> dict[str, Column]:
    return {
        "lat": (F.pmod(key * lat_step, F.lit(180000)) + 310000) / 10000.0,
        "lon": (F.pmod(key * lon_step, F.lit(230000)) - 1250000) / 10000.0,
    }


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Climbing areas from customers; views from their orders."""
    views = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.sum(_div(F.floor("o_totalprice"), 1000)).alias("v"))
    )
    key = F.col("c_custkey")
    place = _place(key, 7919, 104729)
    return (
        table(spark, sf_dir, "customer")
        .join(views, "c_custkey", "left")
        .select(
            key.alias("ord"),
            F.col("c_name").alias("name"),
            F.col("c_nationkey").alias("nation"),
            place["lat"].alias("lat"),
            place["lon"].alias("lon"),
            F.pmod(key, F.lit(7)).alias("n_rock"),
            F.coalesce("v", F.lit(0)).alias("n_views"),
        )
    )


AREAS = """areas AS (
  SELECT c_custkey AS ord, c_name AS name, c_nationkey AS nation,
         (310000 + (c_custkey * 104729) % 180000) / 10000.0 AS lat,
         (-1250000 + (c_custkey * 7919) % 230000) / 10000.0 AS lon,
         c_custkey % 7 AS n_rock, coalesce(v, 0) AS n_views
  FROM customer LEFT JOIN (
    SELECT o_custkey, CAST(sum(CAST(floor(o_totalprice) AS BIGINT) // 1000) AS BIGINT) AS v
    FROM orders GROUP BY 1) t ON c_custkey = o_custkey)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cliff sites from suppliers."""
    key = F.col("s_suppkey")
    place = _place(key, 15485, 32453)
    return table(spark, sf_dir, "supplier").select(
        key.alias("cliff_id"),
        place["lat"].alias("lat"),
        place["lon"].alias("lon"),
        (F.pmod(key * 37, F.lit(900)) + 20).alias("height"),
        (F.pmod(key * 11, F.lit(400)) + 1).alias("pixel_count"),
        "s_acctbal",
    )


SITES = """sites AS (
  SELECT s_suppkey AS cliff_id,
         (310000 + (s_suppkey * 32453) % 180000) / 10000.0 AS lat,
         (-1250000 + (s_suppkey * 15485) % 230000) / 10000.0 AS lon,
         20 + (s_suppkey * 37) % 900 AS height, 1 + (s_suppkey * 11) % 400 AS pixel_count,
         s_acctbal
  FROM supplier)"""


def site_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints of the sites: walls of 1 to 5 cells that run north-east, longer than the radii."""
    key = F.col("s_suppkey")
    i = F.col("i")
    return (
        table(spark, sf_dir, "supplier")
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.pmod(key, F.lit(5)))))
        .select(
            key.alias("cliff_id"),
            ((F.pmod(key * 32453, F.lit(180000)) + 310000 + i * 700) / 10000.0).alias("lat"),
            ((F.pmod(key * 15485, F.lit(230000)) - 1250000 + i * 2300) / 10000.0).alias("lon"),
            (F.pmod(key * 37, F.lit(900)) + 20).alias("height"),
        )
    )


SITE_CELLS = """site_cells AS (
  SELECT s_suppkey AS cliff_id,
         (310000 + (s_suppkey * 32453) % 180000 + i * 700) / 10000.0 AS lat,
         (-1250000 + (s_suppkey * 15485) % 230000 + i * 2300) / 10000.0 AS lon,
         20 + (s_suppkey * 37) % 900 AS height
  FROM (SELECT s_suppkey, unnest(range(0, s_suppkey % 5 + 1)) AS i FROM supplier) t)"""


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Road points from parts."""
    key = F.col("p_partkey")
    place = _place(key, 6151, 24593)
    return table(spark, sf_dir, "part").select(
        key.alias("road_id"), place["lat"].alias("lat"), place["lon"].alias("lon")
    )


ROADS = """roads AS (
  SELECT p_partkey AS road_id,
         (310000 + (p_partkey * 24593) % 180000) / 10000.0 AS lat,
         (-1250000 + (p_partkey * 6151) % 230000) / 10000.0 AS lon
  FROM part)"""


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population points: sold quantity per part."""
    sold = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("road_id"))
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("population"))
    )
    return roads(spark, sf_dir).join(sold, "road_id")


POPULATION = (
    ROADS
    + """,
population AS (
  SELECT road_id, lat, lon, population FROM roads JOIN (
    SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS population
    FROM lineitem GROUP BY 1) ON road_id = l_partkey)"""
)


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area tree region -> nation -> customer -> order; every third customer inherits."""

    def node(df, node_id, parent, ordinal, name, own, views, types):
        lat, lon = own if own else (F.lit(None).cast("double"), F.lit(None).cast("double"))
        return df.select(
            node_id.alias("node_id"),
            parent.alias("parent_id"),
            F.col(ordinal).cast("bigint").alias("ordinal"),
            name.alias("name"),
            F.lit(None).cast("string").alias("url"),
            F.round(lat, 3).alias("lat"),
            F.round(lon, 3).alias("long"),
            F.concat_ws(",", lat.cast("string"), lon.cast("string")).alias("gps2"),
            F.coalesce(views, F.lit(0)).cast("bigint").alias("views"),
            types.alias("types"),
        )

    def own(key: str, inherits: Column | None = None) -> tuple[Column, Column]:
        place = _place(F.col(key).cast("bigint"), 7919, 104729)
        if inherits is None:
            return place["lat"], place["lon"]
        return F.when(~inherits, place["lat"]), F.when(~inherits, place["lon"])

    def name_of(prefix: str, key: str) -> Column:
        return F.concat(F.lit(prefix), F.col(key))

    no_types = F.lit(None).cast("array<string>")
    zero = F.lit(0)
    priority = F.substring("o_orderpriority", 1, 1)
    kind = (
        F.when(priority == "1", "boulder")
        .when(priority == "2", "ice")
        .when(priority == "3", "mixed")
        .otherwise("trad")
    )
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders")
    parts = [
        node(region, name_of("r", "r_regionkey"), F.lit(ROOT_ID), "r_regionkey",
             F.col("r_name"), own("r_regionkey"), zero, no_types),
        node(nation, name_of("n", "n_nationkey"), name_of("r", "n_regionkey"), "n_nationkey",
             F.concat(F.lit("  "), F.col("n_name"), F.lit("\nsecond line")),
             own("n_nationkey"), zero, no_types),
        node(customer, name_of("c", "c_custkey"), name_of("n", "c_nationkey"), "c_custkey",
             F.col("c_name"), own("c_custkey", F.col("c_custkey") % 3 == 0),
             F.floor(F.abs("c_acctbal")), no_types),
        node(orders, name_of("o", "o_orderkey"), name_of("c", "o_custkey"), "o_orderkey",
             name_of("route ", "o_orderkey"), None,
             _div(F.floor("o_totalprice"), 1000), F.array(kind)),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


TREE = """place AS (
  SELECT k, (310000 + (k * 104729) % 180000) / 10000.0 AS lat,
         (-1250000 + (k * 7919) % 230000) / 10000.0 AS lon
  FROM (SELECT c_custkey AS k FROM customer UNION SELECT r_regionkey FROM region
        UNION SELECT n_nationkey FROM nation)),
nodes AS (
  SELECT 'r' || r_regionkey AS node_id, 'root' AS parent_id, CAST(r_regionkey AS BIGINT) AS ordinal,
         r_name AS name, lat, lon, CAST(0 AS BIGINT) AS views, NULL AS kind,
         [CAST(r_regionkey AS BIGINT)] AS path
  FROM region JOIN place ON k = r_regionkey
  UNION ALL
  SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, n_name, lat, lon, 0, NULL,
         [CAST(n_regionkey AS BIGINT), n_nationkey]
  FROM nation JOIN place ON k = n_nationkey
  UNION ALL
  SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey, c_name,
         CASE WHEN c_custkey % 3 = 0 THEN n.lat ELSE p.lat END,
         CASE WHEN c_custkey % 3 = 0 THEN n.lon ELSE p.lon END,
         CAST(floor(abs(c_acctbal)) AS BIGINT), NULL,
         [CAST(n_regionkey AS BIGINT), n_nationkey, c_custkey]
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN place p ON p.k = c_custkey
       JOIN place n ON n.k = n_nationkey
  UNION ALL
  SELECT 'o' || o_orderkey, 'c' || o_custkey, o_orderkey, 'route ' || o_orderkey,
         CASE WHEN c_custkey % 3 = 0 THEN n.lat ELSE p.lat END,
         CASE WHEN c_custkey % 3 = 0 THEN n.lon ELSE p.lon END,
         CAST(floor(o_totalprice) AS BIGINT) // 1000,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'boulder' WHEN '2' THEN 'winter'
              WHEN '3' THEN 'winter' ELSE 'rock' END,
         [CAST(n_regionkey AS BIGINT), n_nationkey, c_custkey, o_orderkey]
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN place p ON p.k = c_custkey JOIN place n ON n.k = n_nationkey)"""


def scene_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene pixels from events: 400 cells, four bands, a cloud score."""
    events = table(spark, sf_dir, "events")
    key, cents = F.col("event_id"), F.round(F.col("value") * 100).cast("bigint")
    cell = F.pmod(key, F.lit(400))
    return events.select(
        F.col("user_id").alias("scene_id"),
        key,
        F.col("ts").alias("time_start"),
        F.pmod(cell, F.lit(20)).alias("x"),
        _div(cell, 20).alias("y"),
        cents.alias("B2"),
        (F.pmod(cents * 7, F.lit(1009)) + 1).alias("B4"),
        F.pmod(cents * 13, F.lit(997)).alias("B5"),
        (F.pmod(cents * 29, F.lit(1013)) + 5).alias("B6"),
        F.pmod(cents * 31, F.lit(991)).alias("B7"),
        F.pmod(cents, F.lit(100)).alias("cloud"),
    )


SCENES = """pixels AS (
  SELECT scene_id, event_id, time_start, (event_id % 400) % 20 AS x, (event_id % 400) // 20 AS y,
         cents AS B2, (cents * 7) % 1009 + 1 AS B4, (cents * 13) % 997 AS B5,
         (cents * 29) % 1013 + 5 AS B6, (cents * 31) % 991 AS B7, cents % 100 AS cloud
  FROM (SELECT user_id AS scene_id, event_id, ts AS time_start,
               CAST(round(value * 100) AS BIGINT) AS cents FROM events))"""


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 patches from embeddings: (vec_id, label, flat)."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").alias("flat")
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric rows for models: line items with their order and part."""
    items = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"
    )
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_size", "p_retailprice"
    )
    return items.join(orders, "l_orderkey").join(part, "l_partkey")
