"""Ranks, samples and percentiles against plain Python, with hot groups and few bins."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from escarp.functions import stats
from escarp.operators import patches


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [("hot", i, rng.choice([0.0, rng.uniform(-5, 5)]), rng.randrange(1000)) for i in range(600)]
    data += [("a", 1000 + i, rng.gauss(0, 1), i) for i in range(30)] + [("one", 5000, 2.5, 1)]
    data += [("hot", 9000, None, 3), ("hot", 9001, float("nan"), 3)]
    return spark.createDataFrame(data, "g string, id long, v double, k long").cache()


@pytest.fixture(params=[1, 7, 64])
def ranges(spark, request):
    """Ranges as they are cut on a cluster: many small ones, which AQE does not merge."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    for name, value in zip(names, (str(request.param), "false")):
        spark.conf.set(name, value)
    yield request.param
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def test_percentiles(rows, ranges):
    got = stats.percentiles(rows, ["g"], "v", [0, 10, 37.5, 50, 90, 100]).collect()
    values = {}
    for r in rows.collect():
        if r["v"] is not None and not np.isnan(r["v"]):
            values.setdefault(r["g"], []).append(r["v"])
    assert len(got) == 6 * len(values)
    for r in got:
        assert r["v"] == pytest.approx(np.percentile(values[r["g"]], r["percent"]), abs=1e-12)


def test_ordinal(rows, ranges):
    got = stats.with_ordinal(rows, ["g"], "k", ["id"]).collect()
    assert len(got) == rows.count()
    by_group = {}
    for r in got:
        by_group.setdefault(r["g"], []).append((r["k"], r["id"], r["ordinal"]))
    for members in by_group.values():
        assert [m[2] for m in sorted(members)] == list(range(len(members)))


def test_ranges_follow_the_rows(spark, ranges):
    """One far outlier, ids with gaps and a frequent key: no range is far above the mean."""
    rows = spark.range(60_000).selectExpr("IF(id = 7, 1e18, IF(id % 3 = 0, 5, id * id)) AS k", "id")
    grouped = rows.withColumn("_group", stats._group([]))
    sizes = [r["count"] for r in stats._ranged(grouped, ["k", "id"]).groupBy("_bin").count().collect()]
    assert len(sizes) >= 0.9 * ranges and max(sizes) <= 3 * 60_000 / len(sizes)


def test_null_groups_stay(spark, ranges):
    rows = spark.range(10).selectExpr("id", "IF(id < 4, NULL, 'a') AS g", "id * 1.0D AS v")
    got = {(r["g"], r["id"]): r["ordinal"] for r in stats.with_ordinal(rows, ["g"], "id", []).collect()}
    assert got == {(None if i < 4 else "a", i): i if i < 4 else i - 4 for i in range(10)}
    middle = {r["g"]: r["v"] for r in stats.percentiles(rows, ["g"], "v", [50]).collect()}
    assert middle == {None: 1.5, "a": 6.5}


def test_ordinal_without_groups(spark):
    got = stats.with_ordinal(spark.range(100).repartition(7), [], "id", []).collect()
    assert all(r["id"] == r["ordinal"] for r in got)


@pytest.mark.parametrize("n_bins", [1, 64, 4096])
def test_sample_is_exact_and_repeatable(rows, n_bins):
    sized = rows.withColumn("n", F.when(F.col("g") == "hot", 50).otherwise(40))
    first = stats.sample_per_group(sized, ["g"], "n", ["id"], 3, n_bins)
    again = stats.sample_per_group(sized.repartition(13), ["g"], "n", ["id"], 3, n_bins)
    ids = sorted(r["id"] for r in first.collect())
    assert ids == sorted(r["id"] for r in again.collect())
    counts = {r["g"]: r["count"] for r in first.groupBy("g").count().collect()}
    assert counts == {"hot": 50, "a": 30, "one": 1}


def test_mix_is_even(spark):
    draws = spark.range(100_000).select((stats.mix(5, F.col("id")) * 10 / stats.PRIME).cast("int").alias("b"))
    counts = [r["count"] for r in draws.groupBy("b").count().collect()]
    assert len(counts) == 10 and min(counts) > 9_000 and max(counts) < 11_000


def test_scratch_lies_in_the_configured_folder(spark):
    from escarp.session import scratch_dir

    assert scratch_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir") + "/")


def test_sample_keeps_null_groups(spark):
    rows = spark.range(500).selectExpr("id", "IF(id % 2 = 0, NULL, 'odd') AS g")
    got = stats.sample_per_group(rows, ["g"], 20, ["id"], 1)
    assert {r["g"]: r["count"] for r in got.groupBy("g").count().collect()} == {None: 20, "odd": 20}
    assert stats.sample_per_group(rows, [], 30, ["id"], 1).count() == 30


def test_small_groups_are_dealt_out_before_they_are_counted(spark):
    """A task that made many rows of small groups must not hold a count for nearly each of them."""
    cells = F.explode(F.sequence(F.lit(0), F.lit(80)))
    rows = spark.range(60).coalesce(1).select(F.col("id").alias("g"), cells.alias("x"), F.lit(7).alias("y"))
    rows = rows.withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    args = (["g"], 9, ["x", "y"], 2)
    dealt, plain = stats.sample_per_group(rows, *args, spread=True), stats.sample_per_group(rows, *args)
    assert {tuple(r) for r in dealt.collect()} == {tuple(r) for r in plain.collect()}
    assert dealt.count() == 60 * 9
    cliffs = spark.range(60).select(F.col("id").alias("cliff_id"), F.lit(900.0).alias("area_m2"))
    seen = cliffs.select("cliff_id", F.lit(1).alias("scene_id"))
    image = spark.range(90).select(F.lit(1).alias("scene_id"), F.col("id").alias("x"), F.lit(7).alias("y"), F.col("id").alias("B4"))
    footprint = rows.withColumnRenamed("g", "cliff_id")
    sampled = patches.sample_scene_patches(cliffs, footprint, seen, image, ["B4"], share=0.01, size=1)
    rated = cliffs.select("cliff_id", F.lit(1).alias("mp_score"), F.lit(9.0).alias("pixel_count"), F.lit(0.05).alias("height"))
    for df in (sampled, patches.sample_cliff_pixels(rated, footprint, ["mp_score"])):
        plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
        counted = max(i for i, line in enumerate(plan) if re.search(r"HashAggregate\(keys=\[_group#\d+, _bin#", line))
        below = next(line for line in plan[counted:] if "Exchange" in line)
        assert re.search(r"hashpartitioning\(_group#\d+, _bin#\d+L, \d+\), REPARTITION_BY_COL", below)
    assert sampled.count() == 59 * 9  # no cliff without an id
