"""Linear models from moments against plain matrices, fold by fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from escarp.operators import linear, model


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 4)) * [1, 10, 0.1, 3] + [1000, -5, 0, 2]
    x[:, 3] = x[:, 0] * 0.5 + 0.1 * x[:, 3]  # nearly collinear
    y = x @ [0.5, -0.2, 3, 0.1] + rng.standard_normal(400)
    data = [(i, *map(float, row), float(v)) for i, (row, v) in enumerate(zip(x, y))]
    data += [(400, None, 1.0, 1.0, 1.0, 1.0), (401, 1.0, 1.0, 1.0, 1.0, None)]
    return spark.createDataFrame(data, "id long, a double, b double, c double, d double, y double").repartition(5)


FEATURES = ["a", "b", "c", "d"]


def matrices(rows):
    kept = sorted(r for r in map(tuple, rows.collect()) if None not in r)
    table = np.array(kept, float)
    return table[:, 0].astype(int), table[:, 1:5], table[:, 5]


def plain(name, x, y, alpha):
    mx, my = x.mean(axis=0), y.mean()
    x, y = x - mx, y - my
    if name == "lasso":
        w = np.zeros(x.shape[1])
        for _ in range(100_000):
            before = w.copy()
            for k in range(len(w)):
                rest = x[:, k] @ (y - x @ w + x[:, k] * w[k]) / len(y)
                w[k] = np.sign(rest) * max(abs(rest) - alpha, 0) / (x[:, k] @ x[:, k] / len(y))
            if np.abs(w - before).max() < 1e-13:
                break
    else:
        w = np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ y)
    return w, my - w @ mx


@pytest.mark.parametrize(("name", "alpha"), [("linear", 0.0), ("ridge", 0.1), ("ridge", 50.0), ("lasso", 0.01), ("lasso", 10.0)])
def test_weights(rows, name, alpha):
    _, x, y = matrices(rows)
    got = linear.fit(name, rows, FEATURES, "y", None if name == "linear" else alpha)
    w, b = plain(name, x, y, alpha)
    assert got.weights == pytest.approx(w, rel=1e-5, abs=1e-7)
    assert got.intercept == pytest.approx(b, rel=1e-5, abs=1e-4)
    sums = rows.dropna().agg(F.sum(got.column(FEATURES)).alias("s")).first()["s"]
    assert sums == pytest.approx((x @ w + b).sum(), rel=1e-9)


def test_search_holds_out_each_fold(spark, rows):
    ids, x, y = matrices(rows)
    fold = {r["id"]: r["f"] for r in rows.select("id", F.pmod(model.mix(F.lit(0), F.col("id")), F.lit(5)).alias("f")).collect()}
    fold = np.array([fold[i] for i in ids])
    got = {r["params"]["alpha"]: r["r2"] for r in model.search_settings("ridge", rows, FEATURES, "y", "id", 8).collect()}
    for alpha, value in got.items():
        want = []
        for f in range(5):
            w, b = plain("ridge", x[fold != f], y[fold != f], float(alpha))
            held = y[fold == f]
            want.append(1 - ((held - x[fold == f] @ w - b) ** 2).sum() / ((held - held.mean()) ** 2).sum())
        assert value == pytest.approx(np.mean(want), rel=1e-8)
    assert len(got) == 8


def test_search_reads_the_table_once(spark, rows):
    reads = spark.sparkContext.accumulator(0)
    counted = rows.rdd.map(lambda r: (reads.add(1), r)[1]).toDF(rows.schema)
    model.search_settings("lasso", counted, FEATURES, "y", "id", 10)
    assert reads.value == rows.count()


def test_settings_are_typed_again():
    for name in model.GRIDS:
        setting = model.random_settings(name, 1)[0]
        assert model.typed_settings(name, {k: str(v) for k, v in setting.items()}) == setting


def test_errors(spark, rows):
    with pytest.raises(ValueError, match="no model"):
        model.regressor("other", rows, FEATURES, "y")
    with pytest.raises(ValueError, match="no rows"):
        linear.fit("linear", rows.limit(0), FEATURES, "y")
