"""Samples of shards by permutations."""

import pytest
from pyspark.sql import functions as F

from escarp.operators.patches import permutation_bits, permuted, sample_shards


@pytest.mark.parametrize("half", [1, 2, 16])
def test_permutation_hits_every_number_once(spark, half):
    numbers = spark.range(half * half).withColumn("seed", F.explode(F.array(F.lit(0), F.lit(3))))
    got = permuted(numbers, "seed", "id", half, "place")
    places = got.groupBy("seed").agg(F.array_sort(F.collect_list("place")).alias("p")).collect()
    assert all(r["p"] == list(range(half * half)) for r in places)
    assert len(places) == 2


def test_permutation_bits():
    for n in (1, 2, 4, 5, 16, 17, 64, 65, 1000):
        bits = permutation_bits(n)
        assert 4**bits >= n and (bits == 0 or 4 ** (bits - 1) < n)


@pytest.mark.parametrize("size", [0, 7, 60, 100])
def test_shards_hold_exactly_the_asked_number_of_different_cells(spark, size):
    cells = spark.range(70).select((F.col("id") % 10).alias("x"), F.floor(F.col("id") / 10).alias("y"))
    rows = [tuple(r) for r in sample_shards(cells, 9, size).select("shard", "x", "y").collect()]
    assert len(set(rows)) == len(rows) == 9 * min(size, 70)
    assert {r[0] for r in rows} == (set(range(9)) if size else set())


def test_samples_are_even_and_differ_between_shards(spark):
    cells = spark.range(100).select((F.col("id") % 10).alias("x"), F.floor(F.col("id") / 10).alias("y"))
    drawn = sample_shards(cells, 400, 20)
    hits = [r["count"] for r in drawn.groupBy("x", "y").count().collect()]
    assert len(hits) == 100 and min(hits) > 40 and max(hits) < 125  # 80 each on average
    sets = drawn.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("s"))
    assert sets.select("s").distinct().count() == 400
    assert sample_shards(cells.limit(0), 4, 20).count() == 0
