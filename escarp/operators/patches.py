"""Image patches: sampling, neighbourhoods, scaling, stripes, batches, shards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escarp import config
from escarp.functions.stats import mix, sample_per_group, with_ordinal
from escarp.session import materialize, scratch_dir


def sample_size_by_area(area_m2: Column, n_scenes: Column, share: float) -> Column:
    """At least one sample per footprint and scene; none where there is no scene."""
    return F.coalesce(
        F.ceil(F.try_divide(area_m2 * share, n_scenes.cast("double"))), F.lit(0).cast("bigint")
    )


def sample_size_by_cliff(pixel_ratio: Column, height_km: Column, factor: float = 0.1) -> Column:
    """Samples from pixel_count / height and height / 1000, i.e. a share of the pixels."""
    return F.ceil(pixel_ratio * height_km * factor * 1000)


def clip(cells: DataFrame, footprint: DataFrame) -> DataFrame:
    return cells.join(footprint.select("x", "y"), ["x", "y"], "left_semi")


def sample_pixels(
    cells: DataFrame, groups: Sequence[str], size: str | int, seed: Column | int = 0, spread: bool = False
) -> DataFrame:
    """Exactly min(size, cells) random cells of each group; `spread` is for many small groups."""
    return sample_per_group(cells, groups, size, ["x", "y"], seed, spread=spread)


def sample_cliff_pixels(
    cliffs: DataFrame, footprint: DataFrame, scalars: Sequence[str], seed: int = 0
) -> DataFrame:
    """Pixels of the cliffs with a score, a share of each one's size, with the cliff's scalars."""
    sized = cliffs.filter(F.col("mp_score") > 0).select(
        "cliff_id",
        *[c for c in scalars if c != "cliff_id"],
        sample_size_by_cliff(F.col("pixel_count"), F.col("height")).alias("n_samples"),
    )
    pixels = footprint.join(sized, "cliff_id")
    return sample_pixels(pixels, ["cliff_id"], "n_samples", seed, spread=True).drop("n_samples")


def sample_scene_patches(
    cliffs: DataFrame,
    footprint: DataFrame,
    cliff_scenes: DataFrame,
    scene_cells: DataFrame,
    bands: Sequence[str],
    share: float = config.SAMPLE_FRACTION,
    size: int = config.PATCH_PIXELS,
    seed: int = 0,
) -> DataFrame:
    """Patches around random footprint pixels, from each of a cliff's recent scenes.

    `cliffs` has area_m2, `cliff_scenes` pairs (cliff_id, scene_id). Every scene of a cliff gives
    the same number of samples, at least one.
    """
    counts = cliff_scenes.groupBy("cliff_id").agg(F.count(F.lit(1)).alias("_scenes"))
    sized = cliffs.join(counts, "cliff_id").select(
        "cliff_id", sample_size_by_area(F.col("area_m2"), F.col("_scenes"), share).alias("_n")
    )
    asked = cliff_scenes.select("cliff_id", "scene_id").join(sized, "cliff_id")
    pixels = footprint.select("cliff_id", "x", "y").join(asked, "cliff_id")
    centers = sample_per_group(
        pixels, ["cliff_id", "scene_id"], "_n", ["scene_id", "x", "y"], seed, spread=True
    ).drop("_n")
    return neighborhoods(centers, scene_cells, bands, size, ["scene_id"])


def sample_shards(cells: DataFrame, n_shards: int, size: int) -> DataFrame:
    """Exactly min(size, cells) random cells per shard, independent of the other shards.

    Cells are numbered by (y, x). A shard goes through its own permutation of the numbers 0, 1, 2 and so on
    of the next power of four, leaves out those with no cell, and takes the first `size`. Only the drawn
    numbers are made, a row each, and meet the cells once. `cells` has one row per (x, y).
    """
    spark = cells.sparkSession
    path = scratch_dir(spark)
    ranked = materialize(with_ordinal(cells, [], "y", ["x"], "_at"), f"{path}/ranked")
    n = ranked.count()
    half = 2 ** permutation_bits(n)
    size, tried = min(size, n), 0
    # on average n of half * half numbers have a cell; the few shards that come out short go on
    steps = min(half * half, size * half * half // max(n, 1) * 5 // 4 + 64)
    shards, drawn = spark.range(n_shards).select(F.col("id").cast("int").alias("shard")), []
    while size and tried < half * half:
        tries = F.explode(F.sequence(F.lit(tried), F.lit(min(tried + steps, half * half) - 1)))
        asked = permuted(shards.repartition("shard").withColumn("_i", tries), "shard", "_i", half, "_at")
        # written before the filter, which would otherwise be pushed through the rounds as one expression
        drawn.append(materialize(asked, f"{path}/drawn{len(drawn)}").filter(F.col("_at") < n))
        tried += steps
        found = reduce(DataFrame.unionByName, drawn).groupBy("shard").agg(F.count(F.lit(1)).alias("_n"))
        short = materialize(
            spark.range(n_shards).select(F.col("id").cast("int").alias("shard")).join(found, "shard", "left")
            .filter(F.coalesce("_n", F.lit(0)) < size).select("shard"),
            f"{path}/short{len(drawn)}",
        )
        if short.isEmpty():
            break
        shards = short
    if not drawn:
        return cells.withColumn("shard", F.lit(0)).limit(0)
    in_order = with_ordinal(reduce(DataFrame.unionByName, drawn), ["shard"], "_i", [], "_place")
    taken = in_order.filter(F.col("_place") < size).select("shard", "_at")
    return ranked.join(taken, "_at").select(*cells.columns, "shard")


def permutation_bits(n: int) -> int:
    """Bits of each half of the numbers that `permuted` permutes: the least b with 4 ** b >= n."""
    return ((max(n, 1) - 1).bit_length() + 1) // 2


def permuted(df: DataFrame, seed: str, number: str, half: int, out: str, rounds: int = 4) -> DataFrame:
    """`out` is the place of `number` in a permutation of 0 .. half * half - 1 that depends on `seed`.

    Each round exchanges the halves of the number and adds a mix of one to the other, which can be
    undone, so no two numbers get one place. A round is a projection of its own: as one expression
    the halves would be written out many times.
    """
    state = df.withColumns({"_left": F.floor(F.col(number) / half), "_right": F.pmod(F.col(number), F.lit(half))})
    for turn in range(rounds):
        added = F.pmod(F.col("_left") + mix(turn, F.col(seed), F.col("_right")), F.lit(half))
        state = state.select(*df.columns, F.col("_right").alias("_left"), added.alias("_right"))
    return state.withColumn(out, F.col("_left") * half + F.col("_right")).drop("_left", "_right")


def neighborhoods(
    centers: DataFrame,
    cells: DataFrame,
    bands: Sequence[str],
    size: int = config.PATCH_PIXELS,
    on: Sequence[str] = (),
) -> DataFrame:
    """A size x size array per band around each centre, northern row first.

    `on` names further columns both tables share, such as the scene.

    Each centre asks for its size * size cells, so only sampled centres are spread. Patches
    with a missing cell or a masked value are dropped.
    """
    keys = [c for c in centers.columns if c not in ("x", "y")]
    half, steps = size // 2, F.sequence(F.lit(0), F.lit(size - 1))
    asked = (
        centers.select(*keys, F.col("x").alias("center_x"), F.col("y").alias("center_y"))
        .withColumn("i", F.explode(steps))
        .withColumn("j", F.explode(steps))
        .withColumn("x", F.col("center_x") - half + F.col("j"))
        .withColumn("y", F.col("center_y") + half - F.col("i"))
    )
    whole = F.lit(True)
    for band in bands:
        whole &= F.col(band).isNotNull()
    found = asked.join(cells.select(*on, "x", "y", *bands).filter(whole), [*on, "x", "y"])
    patch = found.groupBy(*keys, "center_x", "center_y").agg(
        F.array_sort(F.collect_list(F.struct("i", "j", *bands))).alias("_p")
    )
    full = patch.filter(F.size("_p") == size * size)

    def grid(band: str) -> Column:
        flat = F.transform("_p", lambda p: p[band].cast("float"))
        return F.transform(steps, lambda i: F.slice(flat, i * size + 1, size))

    return full.select(*keys, "center_x", "center_y", *[grid(b).alias(b) for b in bands])


def to_grid(flat: Column, size: int) -> Column:
    """Cut a flat array into rows."""
    rows = F.sequence(F.lit(0), F.lit(size - 1))
    return F.transform(rows, lambda i: F.slice(flat, i * size + 1, size))


def scale_pixels(grid: Column, divisor: float = 256.0) -> Column:
    return F.transform(grid, lambda row: F.transform(row, lambda v: v / divisor))


def stack_bands(bands: Sequence[Column]) -> Column:
    """Band grids to one grid of pixel vectors (channel first to channel last)."""
    stacked = F.transform(bands[0], lambda row: F.transform(row, lambda v: F.array(v)))
    for band in bands[1:]:
        stacked = F.zip_with(
            stacked,
            band,
            lambda pixels, row: F.zip_with(pixels, row, lambda p, v: F.concat(p, F.array(v))),
        )
    return stacked


def grid_sum(grid: Column) -> Column:
    return F.aggregate(F.flatten(grid), F.lit(0.0), lambda acc, v: acc + v)


def grid_mean(grid: Column) -> Column:
    return F.try_divide(grid_sum(grid), F.size(F.flatten(grid)).cast("double"))


def terrain_targets(slope: Column, aspect: Column, pi: float = 3.14159) -> dict[str, Column]:
    """Slope as a share of vertical, aspect as a unit vector; pi in six digits, as the targets define it."""
    turn = aspect / 360 * 2 * pi
    return {
        "slope_target": slope / 90,
        "cos_aspect": F.cos(turn),
        "sin_aspect": F.sin(turn),
    }


def split_inputs(
    patches: DataFrame, bands: Sequence[str] = ("R", "G", "B", "N"), target: str = "mp_score"
) -> DataFrame:
    """Band columns as inputs and one target; every other column stays behind."""
    return patches.select(F.struct(*bands).alias("inputs"), F.col(target).alias("target"))


def batches(
    rows: DataFrame, identity: Sequence[str], batch_size: int, epochs: int = 1, seed: int = 0
) -> DataFrame:
    """Each epoch a new order of all rows, cut into batches: (epoch, batch, position)."""
    repeated = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    keyed = repeated.withColumn(
        "_draw", mix(F.lit(seed), F.col("epoch"), *[F.col(c) for c in identity])
    )
    placed = with_ordinal(keyed, ["epoch"], "_draw", identity, "position")
    return placed.drop("_draw").withColumn("batch", F.floor(F.col("position") / batch_size))


# fixed values: the region cut into training and evaluation stripes
STRIPES = {"xmin": -119.7, "xmax": -119.1, "ymin": 37.5, "ymax": 37.9, "step": 0.01}


def stripe(lat: Column, lon: Column, box: Mapping[str, float] = STRIPES) -> Column:
    """'train' or 'eval' by alternating bands of latitude, NULL outside the region."""
    starts = int(round((box["ymax"] - box["ymin"]) / (2 * box["step"]))) + 1
    band = F.floor(F.round((lat - box["ymin"]) / box["step"], 6))
    inside = (lon >= box["xmin"]) & (lon <= box["xmax"]) & band.between(0, 2 * starts - 1)
    return F.when(inside, F.when(F.pmod(band, F.lit(2)) == 0, "train").otherwise("eval"))


def terrain_errors(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean errors of (slope, cos, sin) predictions; true columns t0..t2, predicted p0..p2."""
    dot = F.col("t1") * F.col("p1") + F.col("t2") * F.col("p2")
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))
    gaps = [F.col(f"t{i}") - F.col(f"p{i}") for i in range(3)]
    return predictions.groupBy(*keys).agg(
        F.avg((F.abs(gaps[0]) + F.abs(gaps[1]) + F.abs(gaps[2])) / 3).alias("mae"),
        F.avg((gaps[0] ** 2 + gaps[1] ** 2 + gaps[2] ** 2) / 3).alias("mse"),
        F.avg(F.abs(gaps[0])).alias("slope_error"),
        F.avg(angle).alias("aspect_error"),
    )


def with_shard(
    rows: DataFrame,
    key: str,
    ties: Sequence[str],
    n_shards: int = config.N_SHARDS,
) -> DataFrame:
    """Contiguous slices of nearly equal size in key order: shard i holds the ordinals in
    [int(step * i), int(step * (i + 1))) with step = rows / n_shards."""
    placed = with_ordinal(rows, [], key, ties)
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    shard = F.floor(((F.col("ordinal") + 1) * n_shards - 1) / F.col("_total"))
    return (
        placed.join(F.broadcast(total))  # one row
        .withColumn("shard", shard.cast("int"))
        .drop("_total")
    )


def slice_by_ordinal(placed: DataFrame, start: int, stop: int) -> DataFrame:
    return placed.filter((F.col("ordinal") >= start) & (F.col("ordinal") < stop))
