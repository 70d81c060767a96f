"""Exact ranks, percentiles and samples that never put a whole group into one task.

A plain `row_number` or `percentile` sends each group to one task. Here rows are dealt out by ranges
of (group, key), whose borders Spark measures on the rows themselves: however unevenly groups and keys
are spread, ranges are of nearly equal size. A row's rank is its place in its range plus the rows of its
group in earlier ranges, of which there is one count for each range and group. Samples cut groups into
bins of a pseudo-random draw, which is even by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from escarp.session import materialize, scratch_dir

N_BINS = 4096
PRIME = 2147483647


def mix(seed: Column | int, *parts: Column) -> Column:
    """Pseudo-random integer in [0, PRIME) from integers, in plain BIGINT arithmetic.

    The same on every engine and for every partitioning, and safe from overflow.
    """
    h = F.pmod(seed if isinstance(seed, Column) else F.lit(seed).cast("bigint"), F.lit(PRIME))
    for part in parts:
        h = (h * 48271 + F.pmod(part.cast("bigint"), F.lit(PRIME)) + 11) % PRIME
    # the fifth power is a permutation modulo this prime; scrambling once keeps the tree small
    square = (h * h) % PRIME
    return ((square * square) % PRIME * h % PRIME).cast("bigint")


def wide_mix(seed: int, *parts: Column) -> Column:
    """Pseudo-random integer in [0, PRIME * PRIME), which is 62 bits: two draws of `mix`."""
    return mix(seed, *parts) * PRIME + mix(seed + 1, *parts)


def _running(groups: Sequence[str], weight: str) -> Column:
    window = W.partitionBy(*groups).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(weight).over(window), F.lit(0))


def _group(groups: Sequence[str]) -> Column:
    """The group as one value; inside a struct NULL equals NULL."""
    return F.struct(F.lit(0).alias("all"), *[F.col(g) for g in groups])


def _ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with `_group`, sorted by it and `order` in ranges of nearly equal size, written once.

    `_bin` is the number of the range, `_row_at` grows with the row's place in it by one.
    """
    keys = ["_group", *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = placed.withColumn("_row_at", F.monotonically_increasing_id())
    placed = materialize(placed, f"{scratch_dir(df.sparkSession)}/ranges")
    return placed.withColumn("_bin", F.shiftright("_row_at", 33))


def with_ordinal(
    df: DataFrame, groups: Sequence[str], key: str, ties: Sequence[str], out: str = "ordinal"
) -> DataFrame:
    """0-based position of each row in its group, ordered by (key, ties).

    Any key that can be sorted will do. Ties should tell the rows of one key apart: rows that agree in
    both stay in one range and get their places in any order. A NULL group is a group like any other.
    """
    grouped = df.withColumn("_group", _group(groups))
    placed = _ranged(grouped, list(dict.fromkeys([key, *ties])))
    spans = placed.groupBy("_group", "_bin").agg(F.min("_row_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    spans = spans.select("_group", "_bin", (_running(["_group"], "_n") - F.col("_low")).alias("_shift"))
    return (
        placed.join(spans, ["_group", "_bin"])
        .withColumn(out, F.col("_row_at") + F.col("_shift"))
        .drop("_group", "_bin", "_row_at", "_shift")
    )


def sample_per_group(
    df: DataFrame,
    groups: Sequence[str],
    size: str | int,
    identity: Sequence[str],
    seed: Column | int = 0,
    n_bins: int = N_BINS,
    spread: bool = False,
) -> DataFrame:
    """Exactly min(size, rows) random rows of each group.

    `size` is a number or the name of a column constant within the group. Rows are taken in
    order of `mix(seed, identity)`, so the same rows come back on every run. Bin counts tell
    which bins of a group are needed; rows meet them by group and bin, so a hot group is spread
    over its bins, and rows of other bins are dropped. NULL groups are groups like any other.

    Each task counts its own rows first, which leaves few counts where groups are large. Where they are
    small it would hold a count for nearly each of its rows, however many an earlier step has made in it:
    with `spread`, rows are dealt out by group and bin before they are counted, once for all steps.
    """
    limit = F.col(size) if isinstance(size, str) else F.lit(size)
    keyed = df.withColumn("_draw", mix(seed, *[F.col(c) for c in identity])).withColumns(
        {"_bin": F.floor(F.col("_draw") * n_bins / PRIME), "_group": _group(groups)}
    )
    if spread:
        keyed = keyed.repartition("_group", "_bin")
    needed = (
        keyed.groupBy("_group", "_bin")
        .agg(F.count(F.lit(1)).alias("_n"), F.max(limit).alias("_limit"))
        .withColumn("_left", F.col("_limit") - _running(["_group"], "_n"))
        .filter("_left > 0")
        .select("_group", "_bin", "_left")
    )
    within = W.partitionBy("_group", "_bin").orderBy("_draw", *identity)
    return (
        keyed.join(needed, ["_group", "_bin"])
        .withColumn("_place", F.row_number().over(within))
        .filter("_place <= _left")
        .drop("_draw", "_bin", "_group", "_left", "_place")
    )


def percentiles(
    df: DataFrame, groups: Sequence[str], value: str, percents: Sequence[float]
) -> DataFrame:
    """Exact interpolated percentiles as rows (groups, percent, value); NULL and NaN skipped.

    Equal values of a group are counted first, so a frequent value is one row with a weight. A NULL
    group is a group like any other.
    """
    number = F.col(value).cast("double")
    usable = number.isNotNull() & ~F.isnan(number)
    counted = df.filter(usable).groupBy(_group(groups).alias("_group"), number.alias("_v"))
    placed = _ranged(counted.agg(F.count(F.lit(1)).alias("_w")), ["_v"])
    totals = F.sum("_n").over(W.partitionBy("_group"))
    bins = (
        placed.groupBy("_group", "_bin")
        .agg(F.sum("_w").alias("_n"))
        .withColumns({"_offset": _running(["_group"], "_n"), "_total": totals})
    )
    targets = F.explode(F.array(*[F.lit(float(p)) for p in percents]))
    wanted = (
        bins.withColumn("percent", targets)
        .withColumn("_position", F.col("percent") / 100 * (F.col("_total") - 1))
        .withColumn("_rank", F.explode(F.array(F.floor("_position"), F.ceil("_position"))))
        .filter(
            (F.col("_rank") >= F.col("_offset"))
            & (F.col("_rank") < F.col("_offset") + F.col("_n"))
        )
        .groupBy("_group", "_bin", "_offset")
        .agg(F.collect_set(F.struct("percent", "_position", "_rank")).alias("_ranks"))
    )
    through = W.partitionBy("_group", "_bin").orderBy("_v")
    hits = (
        placed.join(wanted, ["_group", "_bin"])
        .withColumn("_end", F.col("_offset") + F.sum("_w").over(through))
        .withColumn(
            "_hit",
            F.explode(
                F.filter(
                    "_ranks",
                    lambda t: (t["_rank"] < F.col("_end"))
                    & (t["_rank"] >= F.col("_end") - F.col("_w")),
                )
            ),
        )
        .select("_group", "_v", "_hit.*")
    )
    share = F.max(F.col("_position") - F.floor("_position"))
    low, high = F.min("_v"), F.max("_v")
    found = hits.groupBy("_group", "percent").agg((low + (high - low) * share).alias(value))
    return found.select(*[F.col("_group")[g].alias(g) for g in groups], "percent", value)
