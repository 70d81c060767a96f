"""Regression on cliff tables with Spark ML, plus sampling and ranking."""

from __future__ import annotations

import itertools
import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from escarp.functions.stats import PRIME, mix, wide_mix, with_ordinal
from escarp.operators import linear
from escarp.operators.neighbors import knn_predict
from escarp.session import materialize, scratch_dir

TREE_MODELS = ("tree", "forest", "gbt")
MODELS = ("linear", "ridge", "lasso", "knn", *TREE_MODELS)
# fixed values: columns that say where a site is or what is to be predicted, old and new names
NOT_INPUTS = (
    *("latitude", "longitude", "lat", "lon", "name", "site_id", "cliff_id", ".geo"),
    *("is_accessible", "n_rock", "mp_score"),
)

# fixed values: search grids, in the names of Spark ML parameters
GRIDS: dict[str, dict[str, list]] = {
    "linear": {},
    "ridge": {"alpha": [0.1, 1, 2, 5, 10, 20, 50, 100]},
    "lasso": {"alpha": [0.0001, 0.0002, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.1, 1, 10]},
    "knn": {"k": [8, 16, 32, 64, 128], "p": [1, 1.5, 2, 2.5]},
    "tree": {
        "minInfoGain": [0, 0.005, 0.01, 0.02, 0.05, 0.1],
        "maxDepth": [3, 4, 5, 6, 7, 30],
        "minInstancesPerNode": [1, 2, 3, 4],
    },
    "forest": {
        "featureSubsetStrategy": ["all", "sqrt"],
        "maxDepth": [4, 5, 6, 7, 8, 9, 10, 30],
        "minInstancesPerNode": [1, 2, 3, 4, 5],
        "bootstrap": [True, False],
    },
    "gbt": {
        "maxDepth": [3, 4, 5, 6, 7, 8, 9, 30],
        "minInstancesPerNode": [1, 2, 4, 6, 8, 10],
        "stepSize": [0.01, 0.03, 0.05, 0.1, 0.2],
        "subsamplingRate": [0.7, 0.75, 0.8, 0.85, 0.9],
        "featureSubsetStrategy": ["0.7", "0.75", "0.8", "0.85", "0.9"],
    },
}


def feature_columns(df: DataFrame, drop: Sequence[str] = NOT_INPUTS) -> list[str]:
    """Numeric columns that are neither identity nor target."""
    numeric = (T.NumericType, T.BooleanType)
    return [f.name for f in df.schema.fields if f.name not in drop and isinstance(f.dataType, numeric)]


def with_split(
    rows: DataFrame, identity: Sequence[str], train_share: float = 0.9, seed: int = 0
) -> DataFrame:
    """Adds `is_train`: a coin per row that falls the same way on every run."""
    draw = mix(seed, *[F.col(c) for c in identity])
    return rows.withColumn("is_train", draw < int(train_share * PRIME))


def score_class(y: Column) -> Column:
    return F.ceil(y * 10).cast("int")


def oversample(
    rows: DataFrame, target: str, identity: str, seed: int = 0, block: int = 10_000
) -> DataFrame:
    """Every class of `ceil(10 y)` filled up with repeats to the size of the largest one.

    All rows stay, features and target together; `copy` is 0 for an original and the number of
    the draw for a repeat. Draws are made in blocks, so no task makes all draws of a class.
    """
    classed = rows.withColumn("class", score_class(F.col(target)))
    sizes = classed.groupBy("class").agg(F.count(F.lit(1)).alias("_n"))
    largest = sizes.agg(F.max("_n").alias("_largest"))
    short = sizes.join(F.broadcast(largest)).filter("_n < _largest")  # one row
    blocks = short.withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_largest") - F.col("_n") - 1) / block)))
    ).repartition("class", "_block")
    first = F.col("_block") * block + 1
    last = F.least(first + block - 1, F.col("_largest") - F.col("_n"))
    draws = blocks.withColumn("copy", F.explode(F.sequence(first, last))).select(
        "class",
        "copy",
        F.pmod(wide_mix(seed, F.col("class"), F.col("copy")), F.col("_n")).alias("_at"),
    )
    placed = with_ordinal(classed, ["class"], identity, [], "_at")
    repeats = placed.join(draws, ["class", "_at"]).drop("_at")
    originals = classed.withColumn("copy", F.lit(0).cast("bigint"))
    return originals.unionByName(repeats)


def _population(train: DataFrame, target: str) -> tuple[int, float]:
    row = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(target).alias("s")).first()
    return row["n"], row["s"] or 1.0


def regressor(name: str, train: DataFrame, features: Sequence[str], target: str, **params):
    """An unfitted model over named columns.

    Linear models take `alpha` as the usual penalty weight: ridge minimises RSS + alpha |w|^2,
    lasso RSS / 2n + alpha |w|. Spark divides the ridge term by the rows and by the spread of
    the target, which is undone here.
    """
    params = dict(params)
    if name in ("linear", "ridge", "lasso"):
        alpha = float(params.pop("alpha", 0.0 if name == "linear" else 1.0))
        if name == "ridge":
            n, spread = _population(train, target)
            alpha = alpha * spread / n
        model = LinearRegression(
            regParam=alpha,
            elasticNetParam=1.0 if name == "lasso" else 0.0,
            standardization=False,
            **params,
        )
    elif name == "tree":
        model = DecisionTreeRegressor(seed=0, **params)
    elif name == "forest":
        model = RandomForestRegressor(seed=0, **{"numTrees": 100, **params})
    elif name == "gbt":
        model = GBTRegressor(seed=0, **params)
    else:
        raise ValueError(f"there is no model {name!r}; choose one of {', '.join(MODELS)}")
    model.setFeaturesCol("_features").setLabelCol(target).setPredictionCol("prediction")
    assembler = VectorAssembler(
        inputCols=list(features), outputCol="_features", handleInvalid="error"
    )
    return Pipeline(stages=[assembler, model])


def fit(name: str, train: DataFrame, features: Sequence[str], target: str, **params):
    return regressor(name, train, features, target, **params).fit(train)


def predict(model, rows: DataFrame, out: str = "prediction") -> DataFrame:
    scored = model.transform(rows).drop("_features")
    return scored.withColumnRenamed("prediction", out)


def r2(scored: DataFrame, target: str, prediction: str = "prediction") -> Column:
    """Coefficient of determination as one aggregate."""
    residual = F.sum((F.col(target) - F.col(prediction)) ** 2)
    return 1 - residual / (F.var_pop(target) * F.count(target))


def evaluate(scored: DataFrame, target: str, by: str = "is_train") -> DataFrame:
    """R2 for the rows the model was trained on and for the others."""
    return scored.groupBy(by).agg(r2(scored, target).alias("r2"))


def feature_importance(name: str, model, features: Sequence[str], spark) -> DataFrame:
    """Rows (feature, importance) of a tree model."""
    if name not in TREE_MODELS:
        raise ValueError(f"{name} models weigh no features; tree models do")
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(w)) for f, w in zip(features, weights)]
    return spark.createDataFrame(rows, "feature string, importance double")


def random_settings(name: str, n: int, seed: int = 0) -> list[dict]:
    """n different settings drawn uniformly from the grid of a model (all if there are fewer)."""
    grid = GRIDS[name]
    everything = [
        dict(zip(grid, values)) for values in itertools.product(*grid.values())
    ]
    return random.Random(seed).sample(everything, min(n, len(everything)))


def search_settings(
    name: str,
    train: DataFrame,
    features: Sequence[str],
    target: str,
    identity: str,
    n_iter: int,
    n_folds: int = 5,
    seed: int = 0,
    parallelism: int = 2,
) -> DataFrame:
    """Mean cross-validated R2 of random settings: rows (model, params, r2), best first.

    The fold of a row follows from its identity alone. Everything that depends on the training
    rows, the scale of a penalty too, is taken from the rows of the fold at hand. Linear models are
    solved from the moments of the folds, so all their settings cost one pass over the table.
    """
    spark = train.sparkSession
    settings = random_settings(name, n_iter, seed)
    fold = F.pmod(mix(F.lit(seed), F.col(identity)), F.lit(n_folds)).alias("_fold")
    if name in linear.LINEAR_MODELS:
        folds = linear.moments(train, features, target, fold)
        return _history(spark, name, settings, linear.cross_validated(name, folds, settings))
    columns = dict.fromkeys((identity, target, *features))
    folded = materialize(train.select(*columns, fold), f"{scratch_dir(spark)}/folds")

    def score(setting: dict) -> float:
        return _cross_validated(name, folded, features, target, identity, n_folds, setting)

    with ThreadPoolExecutor(parallelism) as pool:  # the fits themselves run on the cluster
        scores = list(pool.map(score, settings))
    return _history(spark, name, settings, scores)


def _history(spark, name: str, settings: Sequence[Mapping], scores: Sequence[float]) -> DataFrame:
    rows = [
        (name, {k: str(v) for k, v in setting.items()}, score)
        for setting, score in zip(settings, scores, strict=True)
    ]
    result = spark.createDataFrame(rows, "model string, params map<string,string>, r2 double")
    return result.orderBy(F.col("r2").desc())


def _cross_validated(name, folded, features, target, identity, n_folds, setting) -> float:
    scores = []
    for fold in range(n_folds):
        held_out = folded.filter(F.col("_fold") == fold)
        rest = folded.filter(F.col("_fold") != fold)
        if name == "knn":
            scored = knn_predict(rest, held_out, features, target, identity, **setting)
        else:
            scored = predict(fit(name, rest, features, target, **setting), held_out)
        scores.append(scored.agg(r2(scored, target).alias("r2")).first()["r2"])
    return float(np.mean(scores))


def compare_settings(
    name: str, rows: DataFrame, features: Sequence[str], target: str, tuned: Mapping
) -> DataFrame:
    """R2 on training and held-out rows with tuned and with default settings."""
    parts = []
    for variant, params in (("tuned", dict(tuned)), ("default", {})):
        model = fit(name, rows.filter("is_train"), features, target, **params)
        scored = evaluate(predict(model, rows), target)
        parts.append(
            scored.groupBy().agg(
                F.lit(variant).alias("variant"),
                F.max(F.when(F.col("is_train"), F.col("r2"))).alias("r2_train"),
                F.max(F.when(~F.col("is_train"), F.col("r2"))).alias("r2_test"),
            )
        )
    return parts[0].unionByName(parts[1])


def search_all(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    identity: str,
    models: Mapping[str, int],
    n_folds: int = 5,
    seed: int = 0,
) -> DataFrame:
    """The best setting of each of several models, and its score: rows (model, params, r2).

    `models` has the number of random settings to try for each model.
    """
    found = None
    for name, n_iter in models.items():
        tried = search_settings(name, train, features, target, identity, n_iter, n_folds, seed).limit(1)
        found = tried if found is None else found.unionByName(tried)
    return found


def typed_settings(name: str, params: Mapping[str, str]) -> dict:
    """Saved settings, which are texts, as the values of the model's grid."""
    grid = GRIDS[name]
    return {key: next(v for v in grid[key] if str(v) == text) for key, text in params.items()}


def predict_with(
    settings: DataFrame, train: DataFrame, rows: DataFrame, features: Sequence[str], target: str, identity: str
) -> tuple[DataFrame, list[str]]:
    """The rows with a column `<model>_score` for each saved setting, and the names of those columns."""
    names = []
    for saved in sorted(settings.collect(), key=lambda r: MODELS.index(r["model"])):  # one row a model
        name, out = saved["model"], f"{saved['model']}_score"
        params = typed_settings(name, saved["params"])
        if name in linear.LINEAR_MODELS:
            rows = rows.withColumn(out, linear.fit(name, train, features, target, **params).column(features))
        elif name == "knn":
            rows = knn_predict(train, rows, features, target, identity, **params, out=out)
        else:
            rows = predict(fit(name, train, features, target, **params), rows, out)
        names.append(out)
    return rows, names


def best_settings(history: DataFrame) -> DataFrame:
    """The latest saved setting of each model; older runs stay in the table."""
    return history.groupBy("model").agg(
        F.max("run_id").alias("run_id"), F.max_by("params", "run_id").alias("params")
    )


def rank_unseen(
    scored: DataFrame, summands: Sequence[str], identity: str, limit: int = 50
) -> DataFrame:
    """Cliffs without a score of their own, best summed prediction first, height in metres."""
    total = F.lit(0.0)
    for column in summands:
        total = total + F.col(column)
    return (
        scored.filter(F.col("mp_score") == 0)
        .withColumn("summary_score", total)
        .withColumn("height", F.col("height") * 1000)
        .orderBy(F.col("summary_score").desc(), identity)
        .limit(limit)
    )
