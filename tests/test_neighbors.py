"""Exact nearest neighbours against brute force, and how little is compared."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from escarp.operators.neighbors import blocks_to_compare, choose_pivots, knn_predict
from escarp.session import materialize, scratch_dir

NAMES = ["a", "b", "c"]


def frame(spark, data, y):
    rows = [(i, *map(float, d), float(t)) for i, (d, t) in enumerate(zip(data, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double")


def brute(data, y, train, k, p):
    expected = {}
    for i, one in enumerate(data):
        far = [float((np.abs(data[j] - one) ** p).sum()) for j in train]
        near = sorted((np.inf if np.isnan(d) else d, float(y[j])) for d, j in zip(far, train))[:k]
        expected[i] = float(np.mean([t for _, t in near])) if near else None
    return expected


def predicted(df, n_train, k, p, block):
    got = knn_predict(df.filter(F.col("id") < n_train), df, NAMES, "y", "id", k, p, block)
    return {r["id"]: r["prediction"] for r in got.collect()}


@pytest.mark.parametrize(("p", "block"), [(1, 16), (2, 16), (2.5, 50), (0.5, 40)])
def test_clusters_copies_and_outliers(spark, p, block):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(6, 3)) * 20
    data = np.vstack([middle[rng.integers(0, 6, 200)] + rng.normal(size=(200, 3)), np.full((60, 3), 1.0)])
    data = data[rng.permutation(260)].round(1)
    data[7] = 1e6
    y = rng.integers(0, 9, 260)
    got = predicted(frame(spark, data, y), 180, 5, p, block)
    assert got == pytest.approx(brute(data, y, range(180), 5, p))


def test_odd_vectors_and_few_training_rows(spark):
    data = np.array([[0, 0, 0], [1, 0, 0], [np.nan, 0, 0], [np.inf, 1, 1], [5, 5, 5], [0, 0, 1]], dtype=float)
    y = np.array([1, 2, 3, 4, 5, 6])
    df = frame(spark, data, y)
    assert predicted(df, 6, 8, 2, 2) == pytest.approx({i: 3.5 for i in range(6)})  # all of them are near
    got = predicted(df, 5, 2, 2, 2)
    assert got[0] == 1.5 and got[5] == 1.5 and got[4] == pytest.approx(3.5)
    assert got[2] == 1.5  # everything is infinitely far: the smaller targets
    nulls = df.withColumn("a", F.when(F.col("id") != 2, F.col("a")))
    assert predicted(nulls, 5, 2, 2, 2) == got
    assert set(predicted(df, 0, 3, 2, 4).values()) == {None}
    assert predicted(df.limit(0), 3, 3, 2, 4) == {}


def test_clustered_rows_meet_few_blocks(spark):
    rng = np.random.default_rng(9)
    data = (rng.normal(size=(40, 3)) * 50)[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 3))
    df = frame(spark, data, rng.integers(0, 9, 4000))
    placed, asked, pairs, _ = blocks_to_compare(df, df, NAMES, "y", "id", 8, 2.0, 100)
    training = placed.filter("_asks = 0").groupBy(F.col("_at").alias("_other")).agg(F.count("*").alias("n"))
    asking = asked.groupBy("_at").agg(F.count("*").alias("m"))
    home = asking.join(training, asking["_at"] == training["_other"]).agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    other = pairs.join(training, "_other").join(asking, "_at").agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    assert (home + (other or 0)) / 4000**2 < 0.2
    assert placed.groupBy("_at").count().agg(F.max("count")).first()[0] <= 100


def test_pivots_of_equal_points():
    assert len(choose_pivots(np.ones((50, 2)), 8)) == 1


@pytest.mark.parametrize("p", [0.5, 1.5, 3])
def test_groups_of_blocks_meet_without_clusters(spark, p):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(400, 3))
    data[:40] = data[40]  # copies: equal distances, told apart by their targets
    data[50:60] *= 1e6
    data[60:80] = data[60] + rng.normal(size=(20, 3)) * 1e-9
    data[81, 0], data[82, 1] = np.nan, np.inf
    data = data[rng.permutation(400)]
    y = rng.integers(0, 50, 400)
    df = frame(spark, data, y)
    got = knn_predict(df.filter(F.col("id") < 350), df, NAMES, "y", "id", 5, p, block=32, group=128)
    with np.errstate(invalid="ignore"):
        assert {r["id"]: r["prediction"] for r in got.collect()} == pytest.approx(brute(data, y, range(350), 5, p))


def test_rows_are_sent_once_for_each_group(spark):
    """Without clusters all blocks meet; a row goes to every group of blocks, not to every block."""
    rng = np.random.default_rng(4)
    df = frame(spark, rng.normal(size=(1200, 3)), rng.integers(0, 9, 1200))
    names = [f"{c} * 0 + rand({i})" for i, c in enumerate(NAMES * 8)]
    wide = materialize(df.select("id", "y", *[F.expr(e).alias(f"f{i}") for i, e in enumerate(names)]), scratch_dir(spark))
    columns = [c for c in wide.columns if c.startswith("f")]
    placed, asked, pairs, _ = blocks_to_compare(wide, wide, columns, "y", "id", 8, 1.5, 50, group=800)
    assert pairs.count() > 40 * 39 / 2
    sent = pairs.select("_at", "_group", "_other_group").distinct().join(asked, ["_at", "_group"]).count()
    assert sent <= 1200 * 3
    assert placed.groupBy("_group").count().agg(F.max("count")).first()[0] <= 850
    assert asked.count() == 1200
