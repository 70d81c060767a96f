"""Area trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from escarp.operators import tree
from escarp.plans.registry import mix_sql, query
from escarp.sources import views
from escarp.sources.views import table

_BY_KEY = """
SELECT lat AS latitude, lon AS longitude, arg_min(trim(name), path) AS name,
  count(*) FILTER (kind = 'boulder') AS n_boulder, count(*) FILTER (kind = 'winter') AS n_winter,
  count(*) FILTER (kind = 'rock') AS n_rock,
  CAST(sum(views * CASE WHEN kind IS NULL THEN 1 ELSE 2 END) AS BIGINT) AS n_views
FROM nodes GROUP BY lat, lon HAVING count(kind) > 0"""


@query(
    f"""WITH {views.TREE}
SELECT array_to_string(path, '/') AS path, trim(name) AS name, lat, lon, views FROM nodes
UNION ALL SELECT '', 'All', 39.0, -98.0, 0"""
)
def flattened_tree(spark, sf_dir):
    rows = tree.flatten_adjacency(views.tree_nodes(spark, sf_dir))
    return rows.select(
        F.array_join(F.col("path").cast("array<string>"), "/").alias("path"),
        tree.clean_name(F.col("name")).alias("name"),
        F.col("key_lat").alias("lat"),
        F.col("key_lon").alias("lon"),
        "views",
    )


@query(f"WITH {views.TREE} {_BY_KEY}")
def areas_by_coordinate(spark, sf_dir):
    return tree.areas_by_coordinate(tree.flatten_adjacency(views.tree_nodes(spark, sf_dir)))


@query(
    f"""WITH {views.TREE} SELECT count(*) FILTER (kind = 'boulder') AS n_boulder,
count(*) FILTER (kind = 'winter') AS n_winter, count(*) FILTER (kind = 'rock') AS n_rock FROM nodes"""
)
def route_type_counts(spark, sf_dir):
    kind = tree.route_type(F.col("types"))
    return views.tree_nodes(spark, sf_dir).agg(
        *[F.count_if(kind == k).alias(f"n_{k}") for k in ("boulder", "winter", "rock")]
    )


def _nested_roots(spark, sf_dir):
    """One nested area per order: a crag with own coordinate, inside it a wall without."""
    key = F.col("o_orderkey")
    place = views._place(key, 7919, 104729)
    views_of = F.floor(F.col("o_totalprice") / 1000).cast("bigint")

    def route(name, kind):
        return F.struct(
            F.lit(name).alias("name"), F.lit(1).alias("totalViews"), F.array(F.lit(kind)).alias("types")
        )

    wall = F.struct(
        F.concat(F.lit("wall "), key).alias("name"),
        F.lit(2).alias("totalViews"),
        F.array(route("a", "trad"), route("b", "ice"), route("c", "boulder")).alias("children"),
    )
    crag = F.struct(
        F.concat(F.lit(" crag "), key, F.lit("\nmore")).alias("name"),
        place["lat"].alias("lat"),
        place["lon"].alias("long"),
        F.concat_ws(",", place["lat"].cast("string"), place["lon"].cast("string")).alias("gps2"),
        views_of.alias("totalViews"),
        F.array(wall).alias("children"),
    )
    node = F.parse_json(F.to_json(crag))
    return table(spark, sf_dir, "orders").select(key.alias("ordinal"), node.alias("node"))


@query(
    """WITH crags AS (
  SELECT o_orderkey AS k, (310000 + (o_orderkey * 104729) % 180000) / 10000.0 AS latitude,
         (-1250000 + (o_orderkey * 7919) % 230000) / 10000.0 AS longitude,
         CAST(floor(o_totalprice / 1000) AS BIGINT) AS v FROM orders)
SELECT latitude, longitude, arg_min('crag ' || k, k) AS name, count(*) AS n_boulder,
  count(*) AS n_winter, count(*) AS n_rock, CAST(sum(v + 2 + 3 * 2) AS BIGINT) AS n_views
FROM crags GROUP BY latitude, longitude"""
)
def areas_of_nested_trees(spark, sf_dir):
    return tree.areas_by_coordinate(tree.flatten_nested(_nested_roots(spark, sf_dir)))


_DRAWS = 100
_WALK = "\nUNION ALL ".join(
    f"""SELECT draw, CAST({d} AS INTEGER) AS depth, node_id FROM w{d}""" for d in range(1, 5)
)


def _step_sql(depth: int) -> str:
    before = "draws" if depth == 1 else f"w{depth - 1}"
    return f"""w{depth} AS (SELECT p.draw, c.node_id FROM {before} p JOIN placed c
  ON c.parent_id = p.node_id AND c.at = {mix_sql("0", "p.draw", str(depth - 1))} % c.n)"""


@query(
    f"""WITH {views.TREE},
placed AS (SELECT node_id, parent_id,
  row_number() OVER (PARTITION BY parent_id ORDER BY ordinal, node_id) - 1 AS at,
  count(*) OVER (PARTITION BY parent_id) AS n FROM nodes),
draws AS (SELECT unnest(range({_DRAWS})) AS draw, 'root' AS node_id),
{", ".join(_step_sql(d) for d in range(1, 5))}
{_WALK}"""
)
def random_branches(spark, sf_dir):
    return tree.random_branches(views.tree_nodes(spark, sf_dir), _DRAWS).select(
        "draw", "depth", "node_id"
    )


@query(
    """SELECT o_orderkey, CAST(abs(3 * (o_orderkey % 7)) > 10 AS BOOLEAN) AS disagree FROM orders"""
)
def coordinate_check(spark, sf_dir):
    """Precise coordinates off by 0 to 1.8e-3 degrees against a tolerance of 1e-3."""
    key = F.col("o_orderkey")
    off = F.pmod(key, F.lit(7)) * 3 / 10000
    lat, lon = F.lit(37.5), F.lit(-119.5) + F.pmod(key, F.lit(10))
    gps2 = F.concat_ws(",", lat.cast("string"), (lon + off).cast("string"))
    disagree = tree.coordinates_disagree(lat, lon, gps2)
    return table(spark, sf_dir, "orders").select("o_orderkey", disagree.alias("disagree"))
