"""Sampling, patches, batches and shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from escarp.operators import patches, scenes
from escarp.plans.registry import mix_sql, query
from escarp.session import scratch_dir
from escarp.sources import tables, views

_DRAW = mix_sql("0", "x", "y")


@query(
    f"""WITH {views.CELLS},
sized AS (SELECT *, y // 10 AS zone, CAST(ceil(count(*) OVER (PARTITION BY y // 10) * 0.05) AS BIGINT) AS n
  FROM cells)
SELECT zone, x, y FROM sized
QUALIFY row_number() OVER (PARTITION BY zone ORDER BY {_DRAW}, x, y) <= n"""
)
def sampled_pixels(spark, sf_dir):
    """A share of the pixels of each zone, at least one."""
    zoned = views.cells(spark, sf_dir).withColumn("zone", F.floor(F.col("y") / 10))
    sizes = zoned.groupBy("zone").agg(F.ceil(F.count(F.lit(1)) * 0.05).alias("n"))
    sampled = patches.sample_pixels(zoned.join(sizes, "zone"), ["zone"], "n")
    return sampled.select("zone", "x", "y")


@query(
    f"""WITH {views.SITES}
SELECT cliff_id, CASE WHEN cliff_id % 4 = 0 THEN 0
    ELSE CAST(ceil(pixel_count * 100.0 * 0.003 / (cliff_id % 4)) AS BIGINT) END AS by_area,
  CAST(ceil(pixel_count / height * (height / 1000) * 0.1 * 1000) AS BIGINT) AS by_cliff FROM sites"""
)
def sample_sizes(spark, sf_dir):
    sites = views.sites(spark, sf_dir)
    height = F.col("height")
    return sites.select(
        "cliff_id",
        patches.sample_size_by_area(
            F.col("pixel_count") * 100.0, F.pmod("cliff_id", F.lit(4)), 0.003
        ).alias("by_area"),
        patches.sample_size_by_cliff(F.col("pixel_count") / height, height / 1000).alias("by_cliff"),
    )


def _turn_sql(turn: int) -> str:
    """One round of the permutation: the halves change places, a mix of one is added to the other."""
    added = f"(l + {mix_sql(str(turn), 'shard', 'r')}) % half"
    return f"turn{turn + 1} AS (SELECT shard, i, half, n, r AS l, {added} AS r FROM turn{turn})"


@query(
    f"""WITH {views.CELLS},
ranked AS (SELECT x, y, row_number() OVER (ORDER BY y, x) - 1 AS place FROM cells),
sizes AS (SELECT count(*) AS n, CAST(power(2, (length(bin(count(*) - 1)) + 1) // 2) AS BIGINT) AS half FROM cells),
tries AS (SELECT unnest(range(half * half)) AS i, half, n FROM sizes),
turn0 AS (SELECT CAST(shard AS BIGINT) AS shard, i, half, n, i // half AS l, i % half AS r
  FROM tries, (SELECT unnest(range(200)) AS shard) WHERE i < 50 * half * half // n * 3 + 1000),
{", ".join(_turn_sql(t) for t in range(4))},
drawn AS (SELECT shard, l * half + r AS place FROM turn4 WHERE l * half + r < n
  QUALIFY row_number() OVER (PARTITION BY shard ORDER BY i) <= 50)
SELECT CAST(shard AS INTEGER) AS shard, x, y FROM drawn JOIN ranked USING (place)"""
)
def shard_samples(spark, sf_dir):
    """200 samples of fixed size, one per shard, each by a permutation of the cells."""
    return patches.sample_shards(views.cells(spark, sf_dir), 200, 50).select("shard", "x", "y")


_RATED = """rated AS (
  SELECT s_suppkey AS cliff_id, 0.05 AS height, CAST(4 + s_suppkey % 9 AS DOUBLE) AS pixel_count,
    (s_suppkey % 4) / 4 AS mp_score FROM supplier),
footprint AS (
  SELECT s_suppkey AS cliff_id, (s_suppkey * 53) % 90 + dx AS x, (s_suppkey * 71) % 90 + dy AS y
  FROM supplier, (SELECT unnest(range(9)) AS dx) a, (SELECT unnest(range(9)) AS dy) b)"""


def _rated(spark, sf_dir):
    key = F.col("s_suppkey")
    return views.table(spark, sf_dir, "supplier").select(
        key.alias("cliff_id"),
        F.lit(0.05).alias("height"),
        (F.pmod(key, F.lit(9)) + 4).cast("double").alias("pixel_count"),
        (F.pmod(key, F.lit(4)) / 4).alias("mp_score"),
    )


def _square_footprints(spark, sf_dir, side=9):
    key, steps = F.col("s_suppkey"), F.sequence(F.lit(0), F.lit(side - 1))
    spread = views.table(spark, sf_dir, "supplier").select(key, F.explode(steps).alias("dx"))
    return spread.withColumn("dy", F.explode(steps)).select(
        key.alias("cliff_id"),
        (F.pmod(key * 53, F.lit(90)) + F.col("dx")).alias("x"),
        (F.pmod(key * 71, F.lit(90)) + F.col("dy")).alias("y"),
    )


@query(
    f"""WITH {_RATED}
SELECT cliff_id, x, y, mp_score, pixel_count FROM rated JOIN footprint USING (cliff_id)
WHERE mp_score > 0
QUALIFY row_number() OVER (PARTITION BY cliff_id ORDER BY {_DRAW}, x, y)
  <= ceil(pixel_count * 0.05 * 0.1 * 1000)"""
)
def sampled_pixels_of_rated_cliffs(spark, sf_dir):
    """Only cliffs with a score; each sample carries the scalars of its cliff."""
    sampled = patches.sample_cliff_pixels(
        _rated(spark, sf_dir), _square_footprints(spark, sf_dir), ["mp_score", "pixel_count"]
    )
    return sampled.select("cliff_id", "x", "y", "mp_score", "pixel_count")


@query(
    f"""WITH {views.SCENES},
pairs AS (
  SELECT s_suppkey AS cliff_id, (s_suppkey + i) % 3 AS scene_id
  FROM supplier, (SELECT unnest(range(2)) AS i) t),
small AS (
  SELECT s_suppkey AS cliff_id, (s_suppkey * 53) % 12 + dx AS x, (s_suppkey * 71) % 12 + dy AS y
  FROM supplier, (SELECT unnest(range(9)) AS dx) a, (SELECT unnest(range(9)) AS dy) b),
centers AS (
  SELECT cliff_id, scene_id, x AS cx, y AS cy FROM small JOIN pairs USING (cliff_id)
  QUALIFY row_number() OVER (PARTITION BY cliff_id, scene_id
    ORDER BY {mix_sql("0", "scene_id", "x", "y")}, scene_id, x, y)
    <= ceil((1000 + 7 * cliff_id) * 0.003 / 2)),
image AS (
  SELECT (event_id // 400) % 3 AS scene_id, x, y, max(B4) AS B4 FROM pixels GROUP BY 1, 2, 3)
SELECT cliff_id, c.scene_id, cx AS center_x, cy AS center_y, CAST(sum(B4) AS DOUBLE) AS total
FROM centers c JOIN image i ON i.scene_id = c.scene_id AND x BETWEEN cx - 1 AND cx + 1
  AND y BETWEEN cy - 1 AND cy + 1
GROUP BY ALL HAVING count(*) = 9"""
)
def scene_patches(spark, sf_dir):
    """3 x 3 patches around sampled pixels, from each recent scene of a cliff."""
    key, steps = F.col("s_suppkey"), F.sequence(F.lit(0), F.lit(8))
    supplier = views.table(spark, sf_dir, "supplier")
    pairs = supplier.select(
        key.alias("cliff_id"), F.explode(F.array(key % 3, (key + 1) % 3)).alias("scene_id")
    )
    cliffs = supplier.select(key.alias("cliff_id"), (key * 7 + 1000.0).alias("area_m2"))
    spread = supplier.select(key, F.explode(steps).alias("dx")).withColumn("dy", F.explode(steps))
    footprint = spread.select(
        key.alias("cliff_id"),
        (F.pmod(key * 53, F.lit(12)) + F.col("dx")).alias("x"),
        (F.pmod(key * 71, F.lit(12)) + F.col("dy")).alias("y"),
    )
    pixels = views.scene_pixels(spark, sf_dir).withColumn(
        "scene_id", F.floor(F.col("event_id") / 400) % 3
    )
    image = scenes.brightest(pixels, ["B4"], ["scene_id", "x", "y"])
    sampled = patches.sample_scene_patches(cliffs, footprint, pairs, image, ["B4"], size=3)
    band = F.transform("B4", lambda row: F.transform(row, lambda v: v.cast("double")))
    return sampled.select(
        "cliff_id", "scene_id", "center_x", "center_y", patches.grid_sum(band).alias("total")
    )


_SIZE = 15


@query(
    f"""WITH {views.CELLS},
centers AS (SELECT x AS cx, y AS cy FROM cells
  QUALIFY row_number() OVER (PARTITION BY y // 10 ORDER BY {_DRAW}, x, y) <= 5),
patch AS (SELECT cx, cy, cy + 7 - y AS i, x - cx + 7 AS j, elevation,
    count(*) OVER (PARTITION BY cx, cy) AS n
  FROM centers JOIN cells ON x BETWEEN cx - 7 AND cx + 7 AND y BETWEEN cy - 7 AND cy + 7)
SELECT cx AS center_x, cy AS center_y, i, j, CAST(elevation AS DOUBLE) AS elevation
FROM patch WHERE n = {_SIZE * _SIZE}"""
)
def neighborhood_patches(spark, sf_dir):
    """15 x 15 arrays around sampled pixels, one row per element."""
    cells = views.cells(spark, sf_dir)
    zoned = cells.withColumn("zone", F.floor(F.col("y") / 10))
    centers = patches.sample_pixels(zoned, ["zone"], 5).select("x", "y")
    grids = patches.neighborhoods(centers, cells, ["elevation"], _SIZE)
    return (
        grids.select("center_x", "center_y", F.posexplode("elevation").alias("i", "row"))
        .select("center_x", "center_y", F.col("i").cast("bigint").alias("i"), F.posexplode("row").alias("j", "v"))
        .select(
            "center_x", "center_y", "i", F.col("j").cast("bigint").alias("j"),
            F.col("v").cast("double").alias("elevation"),
        )
    )


_FLAT = """flat AS (
  SELECT vec_id, label, unnest(range(64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"""


def _grid(column="flat"):
    return patches.to_grid(F.col(column), 8)


@query(f"WITH {_FLAT} SELECT vec_id, k // 8 AS i, k % 8 AS j, round(v / 256, 9) AS v FROM flat")
def scaled_patches(spark, sf_dir):
    scaled = views.patches(spark, sf_dir).select(
        "vec_id", patches.scale_pixels(_grid()).alias("grid")
    )
    rows = scaled.select("vec_id", F.posexplode("grid").alias("i", "row"))
    return rows.select(
        "vec_id", F.col("i").cast("bigint").alias("i"), F.posexplode("row").alias("j", "v")
    ).select("vec_id", "i", F.col("j").cast("bigint").alias("j"), F.round("v", 9).alias("v"))


@query(
    f"""WITH {_FLAT}
SELECT vec_id, k // 8 AS i, k % 8 AS j, c AS channel, round(v * (c + 1), 6) AS v
FROM flat, (SELECT unnest(range(3)) AS c) t"""
)
def stacked_patches(spark, sf_dir):
    """Channel first to channel last: three bands per patch."""

    def times(factor):
        return F.transform(
            _grid(), lambda row: F.transform(row, lambda v: v.cast("double") * factor)
        )

    named = views.patches(spark, sf_dir).select(
        "vec_id", *[times(n + 1).alias(f"band{n}") for n in range(3)]
    )
    stacked = named.select(
        "vec_id", patches.stack_bands([F.col(f"band{n}") for n in range(3)]).alias("grid")
    )
    rows = stacked.select("vec_id", F.posexplode("grid").alias("i", "row"))
    pixels = rows.select("vec_id", "i", F.posexplode("row").alias("j", "pixel"))
    values = pixels.select("vec_id", "i", "j", F.posexplode("pixel").alias("channel", "v"))
    return values.select(
        "vec_id",
        *[F.col(c).cast("bigint").alias(c) for c in ("i", "j", "channel")],
        F.round("v", 6).alias("v"),
    )


@query(
    f"""WITH {_FLAT} SELECT vec_id, round(sum(v), 5) AS total, round(sum(v) / 64, 6) AS mean
FROM flat GROUP BY vec_id"""
)
def patch_sums(spark, sf_dir):
    grid = F.transform(_grid(), lambda row: F.transform(row, lambda v: v.cast("double")))
    return views.patches(spark, sf_dir).select(
        "vec_id",
        F.round(patches.grid_sum(grid), 5).alias("total"),
        F.round(patches.grid_mean(grid), 6).alias("mean"),
    )


@query(
    """SELECT p_partkey, round((p_partkey % 900) / 10.0 / 90, 6) AS slope_target,
round(cos((p_partkey * 7 % 3600) / 10.0 / 360 * 2 * CAST(3.14159 AS DOUBLE)), 6) AS cos_aspect,
round(sin((p_partkey * 7 % 3600) / 10.0 / 360 * 2 * CAST(3.14159 AS DOUBLE)), 6) AS sin_aspect FROM part"""
)
def terrain_targets(spark, sf_dir):
    key = F.col("p_partkey")
    targets = patches.terrain_targets(
        F.pmod(key, F.lit(900)) / 10.0, F.pmod(key * 7, F.lit(3600)) / 10.0
    )
    return views.table(spark, sf_dir, "part").select(
        key, *[F.round(c, 6).alias(n) for n, c in targets.items()]
    )


@query(
    """SELECT vec_id, round(embedding[1], 6) AS R, round(embedding[4], 6) AS N, label AS target
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings)"""
)
def patch_inputs_and_target(spark, sf_dir):
    """Only band columns reach the inputs; the id is kept here to line rows up."""
    vectors = views.patches(spark, sf_dir)
    bands = {b: F.element_at("flat", n + 1).cast("double") for n, b in enumerate("RGBN")}
    named = vectors.withColumns(bands).withColumnRenamed("label", "mp_score")
    split = patches.split_inputs(named.withColumn("R", F.struct("vec_id", "R")))
    return split.select(
        "inputs.R.vec_id",
        F.round("inputs.R.R", 6).alias("R"),
        F.round("inputs.N", 6).alias("N"),
        "target",
    )


@query(
    f"""WITH epochs AS (SELECT CAST(unnest(range(3)) AS INTEGER) AS epoch)
SELECT epoch, position // 16 AS batch, position, vec_id FROM (
  SELECT epoch, vec_id, row_number() OVER (
    PARTITION BY epoch ORDER BY {mix_sql("0", "epoch", "vec_id")}, vec_id) - 1 AS position
  FROM embeddings, epochs)"""
)
def shuffled_batches(spark, sf_dir):
    rows = views.patches(spark, sf_dir).select("vec_id")
    return patches.batches(rows, ["vec_id"], 16, 3).select("epoch", "batch", "position", "vec_id")


@query(
    """SELECT o_orderkey, CASE WHEN lon10 BETWEEN -1197 AND -1191 AND band BETWEEN 0 AND 41
  THEN CASE band % 2 WHEN 0 THEN 'train' ELSE 'eval' END END AS stripe
FROM (SELECT o_orderkey, -1200 + o_orderkey % 12 AS lon10,
  CAST(floor((o_orderkey * 37 % 600 - 50) / 10) AS BIGINT) AS band FROM orders)"""
)
def train_and_eval_stripes(spark, sf_dir):
    key = F.col("o_orderkey")
    lat = F.lit(37.5) + (F.pmod(key * 37, F.lit(600)) - 50) / 1000
    lon = (F.pmod(key, F.lit(12)) - 1200) / 10
    return views.table(spark, sf_dir, "orders").select(
        key, patches.stripe(lat, lon).alias("stripe")
    )


@query(
    """WITH p AS (SELECT label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT label, round(avg((abs(e[1]-e[4]) + abs(e[2]-e[5]) + abs(e[3]-e[6])) / 3), 6) AS mae,
round(avg((power(e[1]-e[4], 2) + power(e[2]-e[5], 2) + power(e[3]-e[6], 2)) / 3), 6) AS mse,
round(avg(abs(e[1]-e[4])), 6) AS slope_error,
round(avg(acos(greatest(-1.0, least(1.0, e[2]*e[5] + e[3]*e[6])))), 6) AS aspect_error
FROM p GROUP BY label"""
)
def prediction_errors(spark, sf_dir):
    vectors = views.patches(spark, sf_dir)
    names = ["t0", "t1", "t2", "p0", "p1", "p2"]
    frame = vectors.select(
        "label", *[F.element_at("flat", n + 1).cast("double").alias(c) for n, c in enumerate(names)]
    )
    errors = patches.terrain_errors(frame, ["label"])
    return errors.select("label", *[F.round(c, 6).alias(c) for c in errors.columns[1:]])


@query(
    """SELECT o_orderkey, o_orderkey AS ordinal,
CAST(((o_orderkey + 1) * 100 - 1) // (SELECT count(*) FROM orders) AS INTEGER) AS shard FROM orders"""
)
def shards_by_ordinal(spark, sf_dir):
    """Sequential ids and 100 contiguous slices."""
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey")
    return patches.with_shard(orders, "o_orderkey", [])


@query(
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders
QUALIFY ordinal >= 500 AND ordinal < 900"""
)
def slice_of_rows(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey")
    placed = patches.with_ordinal(orders, [], "o_orderkey", [])
    return patches.slice_by_ordinal(placed, 500, 900)


@query("""SELECT vec_id, label FROM embeddings""")
def sharded_patch_files(spark, sf_dir):
    """Patches written as 100 shards with chosen columns, then read back by pattern."""
    path = scratch_dir(spark)
    tables.write_shards(
        views.patches(spark, sf_dir), path, "vec_id", [], 100, ["vec_id", "label", "flat"]
    )
    schema = "vec_id bigint, label int, flat array<float>"
    return tables.read_shards(spark, f"{path}/shard=*", schema).select("vec_id", "label")


@query(
    """SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer"""
)
def csv_round_trip(spark, sf_dir):
    """Written as CSV with a header, read back with an explicit schema."""
    path = scratch_dir(spark)
    rows = views.table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal"
    )
    tables.write_csv(rows, path)
    return tables.read_csv(spark, path, rows.schema)


@query(
    """SELECT s_suppkey, [s_suppkey % 3, s_suppkey % 3, s_suppkey % 3][j] AS repeated,
s_suppkey % 5 + (j - 1) * 2 AS stepped FROM supplier, (SELECT unnest([1, 2, 3]) AS j) t"""
)
def repeated_and_stepped_lists(spark, sf_dir):
    """List repeat and list sequence, flattened to rows."""
    key = F.col("s_suppkey")
    lists = views.table(spark, sf_dir, "supplier").select(
        key,
        F.array_repeat(F.pmod(key, F.lit(3)), 3).alias("r"),
        F.sequence(
            F.pmod(key, F.lit(5)), F.pmod(key, F.lit(5)) + 4, F.lit(2).cast("bigint")
        ).alias("s"),
    )
    pairs = lists.select("s_suppkey", F.explode(F.arrays_zip("r", "s")).alias("p"))
    return pairs.select("s_suppkey", F.col("p.r").alias("repeated"), F.col("p.s").alias("stepped"))
