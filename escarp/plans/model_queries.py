"""Cleaning, scoring, regression and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from escarp.operators import features, model
from escarp.plans.registry import mix_sql, query
from escarp.session import materialize, scratch_dir
from escarp.sources import tables, views

# cliffs made from parts: every column the cleaning rules look at, with NULL, NaN and bad values
_CLIFFS = """cliffs AS (
  SELECT p_partkey AS cliff_id, 20 + (p_partkey * 37) % 900 AS height,
    1 + (p_partkey * 11) % 400 AS pixel_count,
    CASE WHEN p_partkey % 97 = 0 THEN CAST('NaN' AS DOUBLE) WHEN p_partkey % 89 = 0 THEN NULL
      ELSE ((p_partkey * 13) % 101 - 3) / 100 END AS B2_p20,
    ((p_partkey * 17) % 103 - 2) / 100 AS B4_p20, 0.5 AS B5_p20, 0.25 AS B6_p20, 0.125 AS B7_p20,
    CASE WHEN p_partkey % 53 = 0 THEN NULL ELSE (p_partkey % 7) / 8 END AS R_p10,
    p_partkey % 2 AS road_within_500m, (p_partkey % 3 > 0)::INT AS road_within_1000m,
    (p_partkey % 5 > 0)::INT AS road_within_1500m, (p_partkey % 7 > 0)::INT AS road_within_2000m,
    CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE (p_partkey * 31) % 20000 END AS population_within_30km,
    (p_partkey * 131) % 200000 AS population_within_60km,
    (p_partkey * 1013) % 3000000 AS population_within_100km,
    (p_partkey * 7) % 6000 AS vicinity_n_views, p_partkey % 4 AS vicinity_n_rock,
    p_partkey % 3 AS vicinity_n_areas
  FROM part),
matches AS (
  SELECT (c_custkey * 3) % 5000 AS cliff_id, c_custkey % 7 AS n_rock, (c_custkey * 19) % 1500 AS n_views
  FROM customer),
found AS (SELECT cliff_id, sum(n_rock) AS r, sum(n_views) AS v FROM matches GROUP BY cliff_id),
scored AS (
  SELECT cliffs.*, CAST(coalesce(v, 0) AS BIGINT) AS n_views,
    CAST(CASE WHEN v IS NULL THEN 0 ELSE 1000 + r + v END AS BIGINT) AS raw_score
  FROM cliffs LEFT JOIN found USING (cliff_id))"""

_LOG = """CASE WHEN {raw} < 1000 THEN 0.0
  ELSE greatest(0.0, least(1.0, log2({raw}) / 10 - 1)) END"""

_ACCESSIBLE = """coalesce(n_views > 1000, false) OR coalesce(vicinity_n_views > 5000, false)
  OR coalesce(road_within_500m = 1 AND population_within_30km > 10000, false)
  OR coalesce(road_within_1000m = 1 AND population_within_60km > 100000, false)
  OR coalesce(road_within_1500m = 1 AND population_within_100km > 1000000, false)
  OR coalesce(road_within_2000m = 1 AND population_within_100km > 2000000, false)"""


def _cliffs(spark, sf_dir):
    """The same in Spark, under the older column names that cleaning also accepts."""
    k = F.col("p_partkey")

    def mod(factor: int, size: int):
        return F.pmod(k * factor, F.lit(size))

    def flag(n: int):
        return (F.pmod(k, F.lit(n)) > 0).cast("int")

    every = {
        "height": mod(37, 900) + 20,
        "pixel_count": mod(11, 400) + 1,
        "B2_p20": F.when(mod(1, 97) == 0, F.lit(float("nan")))
        .when(mod(1, 89) == 0, F.lit(None))
        .otherwise((mod(13, 101) - 3) / 100),
        "B4_p20": (mod(17, 103) - 2) / 100,
        "B5_p20": F.lit(0.5),
        "B6_p20": F.lit(0.25),
        "B7_p20": F.lit(0.125),
        "R_p10": F.when(mod(1, 53) != 0, mod(1, 7) / 8),
        "road_within_500m": mod(1, 2),
        "road_within_1000m": flag(3),
        "road_within_1500m": flag(5),
        "road_within_2000m": flag(7),
        "population_within_30km": F.when(mod(1, 41) != 0, mod(31, 20000)),
        "population_within_60km": mod(131, 200000),
        "population_within_100km": mod(1013, 3000000),
        "vicinity_num_views": mod(7, 6000),
        "vicinity_num_rock_routes": mod(1, 4),
        "vicinity_mp_areas": mod(1, 3),
    }
    return views.table(spark, sf_dir, "part").select(
        k.alias("custom_index"), *[c.alias(n) for n, c in every.items()]
    )


def _matches(spark, sf_dir):
    k = F.col("c_custkey")
    return views.table(spark, sf_dir, "customer").select(
        F.pmod(k * 3, F.lit(5000)).alias("custom_index"),
        F.pmod(k, F.lit(7)).alias("num_rock_routes"),
        F.pmod(k * 19, F.lit(1500)).alias("num_views"),
    )


def _scored(spark, sf_dir):
    cliffs = features.canonical_names(_cliffs(spark, sf_dir))
    return features.raw_score(cliffs, features.canonical_names(_matches(spark, sf_dir)))


@query(f"WITH {_CLIFFS} SELECT cliff_id, n_views, raw_score AS mp_score FROM scored")
def raw_scores(spark, sf_dir):
    """Keyed lookup of matched areas and the raw score, from tables with older column names."""
    return _scored(spark, sf_dir).select("cliff_id", "n_views", "mp_score")


@query(
    f"""SELECT o_orderkey, round({_LOG.format(raw="raw")}, 9) AS score
FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 4000 AS raw FROM orders)"""
)
def log_scores(spark, sf_dir):
    raw = F.pmod(F.floor("o_totalprice"), F.lit(4000))
    return views.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.round(features.log_score(raw), 9).alias("score")
    )


_KEPT = """height < 2.5 * pixel_count + 100 AND pixel_count > 10
  AND B2_p20 > 0 AND NOT isnan(B2_p20) AND B4_p20 > 0 AND B5_p20 > 0 AND B6_p20 > 0
  AND B7_p20 > 0 AND R_p10 IS NOT NULL"""


@query(
    f"""WITH {_CLIFFS} SELECT pixel_count / height AS pixel_count, height / 1000 AS height,
  B2_p20, B4_p20, CAST(B5_p20 AS DOUBLE) AS B5_p20, CAST(B6_p20 AS DOUBLE) AS B6_p20,
  CAST(B7_p20 AS DOUBLE) AS B7_p20, R_p10,
  round({_LOG.format(raw="raw_score")}, 9) AS mp_score, {_ACCESSIBLE} AS is_accessible
FROM scored WHERE {_KEPT}"""
)
def model_table(spark, sf_dir):
    """Cleaned, scaled and labelled cliffs without the columns that are no features."""
    table = features.model_table(_scored(spark, sf_dir), required=("R_p10",))
    return table.withColumn("mp_score", F.round("mp_score", 9))


@query(
    f"""WITH {_CLIFFS} SELECT cliff_id, {_ACCESSIBLE} AS is_accessible FROM scored WHERE raw_score = 0"""
)
def accessible_unseen_cliffs(spark, sf_dir):
    """Accessibility of the cliffs no area belongs to."""
    rest = features.unseen(_scored(spark, sf_dir))
    return rest.select("cliff_id", features.is_accessible().alias("is_accessible"))


_ITEM = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_SPLIT = f"{mix_sql('0', *_ITEM)} < {int(0.9 * 2147483647)}"


@query(
    f"""SELECT {", ".join(_ITEM)}, {_SPLIT} AS is_train FROM lineitem"""
)
def train_and_test_rows(spark, sf_dir):
    items = views.table(spark, sf_dir, "lineitem").select(*_ITEM)
    return model.with_split(items, _ITEM)


@query(
    f"""WITH classed AS (
  SELECT o_orderkey, CAST(ceil(o_totalprice / 1000000 * 10) AS INTEGER) AS class FROM orders),
placed AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY o_orderkey) - 1 AS at,
  count(*) OVER (PARTITION BY class) AS n FROM classed),
sizes AS (SELECT class, max(n) AS n FROM placed GROUP BY class),
draws AS (SELECT class, n, unnest(range(1, (SELECT max(n) FROM sizes) - n + 1)) AS copy FROM sizes)
SELECT o_orderkey, class, CAST(0 AS BIGINT) AS copy FROM classed
UNION ALL
SELECT p.o_orderkey, d.class, d.copy FROM draws d JOIN placed p
  ON p.class = d.class AND p.at =
    ({mix_sql("0", "d.class", "d.copy")} * 2147483647 + {mix_sql("1", "d.class", "d.copy")}) % d.n"""
)
def balanced_classes(spark, sf_dir):
    """Rows of small classes repeated until all classes are as large as the largest."""
    rows = views.table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 1000000).alias("y")
    )
    return model.oversample(rows, "y", "o_orderkey").select("o_orderkey", "class", "copy")


def _sales(spark, sf_dir):
    rows = views.sales(spark, sf_dir).select(
        *_ITEM,
        "l_quantity",
        "l_discount",
        "l_tax",
        "l_extendedprice",
        "o_totalprice",
        F.col("p_size").cast("double").alias("p_size"),
        "p_retailprice",
    )
    return model.with_split(rows, _ITEM)


_INPUTS = ["l_quantity", "l_discount", "l_tax", "o_totalprice", "p_size", "p_retailprice"]

_MOMENTS = f"""moments AS (
  SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my,
    covar_pop(l_extendedprice, l_quantity) AS c, var_pop(l_quantity) AS v
  FROM lineitem WHERE {_SPLIT})"""


def _line_sql(weight: str) -> str:
    return f"""WITH {_MOMENTS}
SELECT {", ".join(_ITEM)}, round(my + ({weight}) * (l_quantity - mx), 2) AS prediction
FROM lineitem, moments"""


def _line(spark, sf_dir, name, **params):
    """Fitted on the training rows, scored on every row."""
    rows = model.with_split(
        views.table(spark, sf_dir, "lineitem").select(*_ITEM, "l_quantity", "l_extendedprice"),
        _ITEM,
    )
    fitted = model.fit(name, rows.filter("is_train"), ["l_quantity"], "l_extendedprice", **params)
    return model.predict(fitted, rows).select(*_ITEM, F.round("prediction", 2).alias("prediction"))


@query(_line_sql("c / v"))
def linear_regression(spark, sf_dir):
    return _line(spark, sf_dir, "linear")


@query(_line_sql("c * n / (v * n + 50000)"))
def ridge_regression(spark, sf_dir):
    return _line(spark, sf_dir, "ridge", alpha=50000)


@query(_line_sql("sign(c) * greatest(abs(c) - 1000, 0) / v"))
def lasso_regression(spark, sf_dir):
    return _line(spark, sf_dir, "lasso", alpha=1000, tol=1e-12)


@query(
    f"""WITH {_MOMENTS},
scored AS (SELECT {_SPLIT} AS is_train, l_extendedprice AS y,
  my + c / v * (l_quantity - mx) AS p FROM lineitem, moments)
SELECT is_train, round(1 - sum(power(y - p, 2)) / (var_pop(y) * count(*)), 6) AS r2
FROM scored GROUP BY is_train"""
)
def r2_of_training_and_test_rows(spark, sf_dir):
    rows = model.with_split(
        views.table(spark, sf_dir, "lineitem").select(*_ITEM, "l_quantity", "l_extendedprice"),
        _ITEM,
    )
    fitted = model.fit("linear", rows.filter("is_train"), ["l_quantity"], "l_extendedprice")
    scores = model.evaluate(model.predict(fitted, rows), "l_extendedprice")
    return scores.select("is_train", F.round("r2", 6).alias("r2"))


_KNN_SPLIT = f"{mix_sql('0', 'vec_id')} < {int(0.9 * 2147483647)}"


@query(
    f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, {_KNN_SPLIT} AS is_train
  FROM embeddings),
pairs AS (SELECT q.vec_id, t.label, list_sum(list_transform(list_zip(q.e, t.e),
    lambda z: power(abs(z[1] - z[2]), 1.5))) AS d FROM v q, v t WHERE t.is_train)
SELECT vec_id, round(avg(label), 6) AS prediction FROM (SELECT * FROM pairs
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, label) <= 8) GROUP BY vec_id"""
)
def nearest_neighbor_regression(spark, sf_dir):
    """Exact 8 nearest neighbours under the Minkowski distance with p = 1.5."""
    vectors = views.patches(spark, sf_dir)
    names = [f"e{i}" for i in range(64)]
    rows = model.with_split(
        vectors.select(
            "vec_id", "label", *[F.element_at("flat", i + 1).alias(n) for i, n in enumerate(names)]
        ),
        ["vec_id"],
    )
    scored = model.knn_predict(rows.filter("is_train"), rows, names, "label", "vec_id", 8, 1.5)
    return scored.select("vec_id", F.round("prediction", 6).alias("prediction"))


@query()
def tree_feature_importance(spark, sf_dir):
    rows = _sales(spark, sf_dir).filter("is_train")
    fitted = model.fit("tree", rows, _INPUTS, "l_extendedprice", maxDepth=5)
    return model.feature_importance("tree", fitted, _INPUTS, spark)


@query()
def ranked_unseen_sales(spark, sf_dir):
    """Forest and boosted trees trained on some rows, their sum ranks the rows with no score."""
    rows = _sales(spark, sf_dir).withColumns(
        {
            "mp_score": F.when(F.col("l_discount") > 0.05, F.col("l_tax")).otherwise(0.0),
            "height": F.col("l_quantity") / 1000,
            "item": F.concat_ws("-", *_ITEM),
        }
    )
    inputs = ["l_quantity", "o_totalprice", "p_size", "p_retailprice"]
    used = ["item", "height", "mp_score", "is_train", "l_extendedprice", *inputs]
    rows = materialize(rows.select(*dict.fromkeys(used)), scratch_dir(spark))  # joined once for all passes
    train = rows.filter("is_train")
    forest = model.fit("forest", train, inputs, "l_extendedprice", numTrees=10, maxDepth=5)
    boosted = model.fit("gbt", train, inputs, "l_extendedprice", maxIter=5, maxDepth=4)
    scored = model.predict(boosted, model.predict(forest, rows, "forest_score"), "gbt_score")
    ranked = model.rank_unseen(scored, ["forest_score", "gbt_score"], "item")
    return ranked.select("item", "height", "forest_score", "gbt_score", "summary_score")


@query(
    """SELECT o_orderkey, o_custkey % 900 / CAST(1000 AS DOUBLE) * 1000 AS height,
round(o_totalprice + o_custkey, 2) AS summary_score
FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_totalprice + o_custkey DESC, o_orderkey LIMIT 50"""
)
def ranked_unseen_orders(spark, sf_dir):
    """The ranking itself: summed scores, unseen rows only, top 50, height in metres."""
    rows = views.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_orderstatus") == "F").cast("double").alias("mp_score"),
        (F.pmod("o_custkey", F.lit(900)) / 1000).alias("height"),
        F.col("o_totalprice").alias("forest_score"),
        F.col("o_custkey").cast("double").alias("gbt_score"),
    )
    ranked = model.rank_unseen(rows, ["forest_score", "gbt_score"], "o_orderkey")
    return ranked.select(
        "o_orderkey", "height", F.round("summary_score", 2).alias("summary_score")
    )


@query()
def searched_settings(spark, sf_dir):
    """Cross-validated random search, best setting first."""
    rows = _sales(spark, sf_dir).filter("is_train")
    return model.search_settings("ridge", rows, _INPUTS, "l_extendedprice", "l_orderkey", 3)


_FOLD = f"{mix_sql('0', 'l_orderkey')} % 5"
_ALPHAS = [setting["alpha"] for setting in model.random_settings("ridge", 8)]


@query(
    f"""WITH items AS (SELECT l_quantity AS x, l_extendedprice AS y, {_FOLD} AS fold FROM lineitem),
folds AS (SELECT unnest(range(5)) AS held),
moments AS (SELECT held, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(y, x) AS c,
    var_pop(x) AS v FROM folds JOIN items ON fold <> held GROUP BY held),
alphas AS (SELECT unnest({_ALPHAS}::DOUBLE[]) AS alpha),
scored AS (SELECT alpha, held, y, my + c * n / (v * n + alpha) * (x - mx) AS p
  FROM moments JOIN items ON fold = held, alphas),
errors AS (SELECT alpha, held, 1 - sum(power(y - p, 2)) / (var_pop(y) * count(*)) AS r2
  FROM scored GROUP BY alpha, held)
SELECT alpha, round(avg(r2), 9) AS r2 FROM errors GROUP BY alpha"""
)
def cross_validated_ridge(spark, sf_dir):
    """All penalties of the grid on one feature; folds and penalty scale follow from the rows."""
    items = views.table(spark, sf_dir, "lineitem")
    found = model.search_settings("ridge", items, ["l_quantity"], "l_extendedprice", "l_orderkey", 8)
    alpha = F.col("params")["alpha"].cast("double").alias("alpha")
    return found.select(alpha, F.round("r2", 9).alias("r2"))


_LASSOS = [setting["alpha"] for setting in model.random_settings("lasso", 10)]
_MOMENTS = f"""items AS (SELECT l_quantity AS x, l_extendedprice AS y, {_FOLD} AS fold FROM lineitem),
folds AS (SELECT unnest(range(5)) AS held),
moments AS (SELECT held, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(y, x) AS c,
    var_pop(x) AS v FROM folds JOIN items ON fold <> held GROUP BY held),
settings AS (SELECT 'linear' AS model, CAST(0 AS DOUBLE) AS alpha
    UNION ALL SELECT 'ridge', unnest({[float(a) for a in _ALPHAS]})
    UNION ALL SELECT 'lasso', unnest({[float(a) for a in _LASSOS]})),
models AS (SELECT held, model, alpha, mx, my, CASE model WHEN 'ridge' THEN c / (v + alpha / n)
    ELSE sign(c) * greatest(abs(c) - alpha, 0) / v END AS w FROM moments, settings),
scores AS (SELECT model, alpha, held, 1 - sum(power(y - my - w * (x - mx), 2)) / (var_pop(y) * count(*)) AS r2
    FROM models JOIN items ON fold = held GROUP BY model, alpha, held),
means AS (SELECT model, alpha, avg(r2) AS r2 FROM scores GROUP BY model, alpha)"""


@query(
    f"""WITH {_MOMENTS} SELECT model, nullif(alpha, 0) AS alpha, round(r2, 9) AS r2 FROM means"""
)
def searched_linear_models(spark, sf_dir):
    """Every setting of all linear models over five folds, from one pass over the table."""
    items = views.table(spark, sf_dir, "lineitem")
    found = None
    for name in ("linear", "ridge", "lasso"):
        tried = model.search_settings(name, items, ["l_quantity"], "l_extendedprice", "l_orderkey", 10)
        found = tried if found is None else found.unionByName(tried)
    alpha = F.try_element_at("params", F.lit("alpha")).cast("double").alias("alpha")
    return found.select("model", alpha, F.round("r2", 9).alias("r2"))


@query(
    f"""WITH {_MOMENTS}, best AS (SELECT arg_max(model, r2) AS model, arg_max(alpha, r2) AS alpha
    FROM means WHERE model <> 'linear' GROUP BY model),
known AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(y, x) AS c, var_pop(x) AS v FROM items),
fitted AS (SELECT my, mx, max(CASE WHEN model = 'ridge' THEN c / (v + alpha / n) END) AS a,
    max(CASE WHEN model = 'lasso' THEN sign(c) * greatest(abs(c) - alpha, 0) / v END) AS b
    FROM known, best GROUP BY my, mx)
SELECT l_orderkey, l_linenumber, round(my + a * (l_quantity - mx), 4) AS ridge_score,
    round(my + b * (l_quantity - mx), 4) AS lasso_score FROM lineitem, fitted"""
)
def scored_by_saved_settings(spark, sf_dir):
    """Best settings of two searches, saved, read back, fitted on all rows and applied."""
    items = views.table(spark, sf_dir, "lineitem")
    inputs = ["l_quantity"]
    path = scratch_dir(spark)
    best = model.search_all(items, inputs, "l_extendedprice", "l_orderkey", {"ridge": 8, "lasso": 10})
    tables.save_settings(best, path, 1)
    saved = model.best_settings(tables.read_table(spark, path))
    scored, names = model.predict_with(saved, items, items, inputs, "l_extendedprice", "l_orderkey")
    return scored.select("l_orderkey", "l_linenumber", *[F.round(n, 4).alias(n) for n in names])


@query()
def tuned_and_default_scores(spark, sf_dir):
    used = dict.fromkeys([*_INPUTS, "l_extendedprice", "is_train"])
    rows = materialize(_sales(spark, sf_dir).select(*used), scratch_dir(spark))  # joined once for all passes
    tuned = {"maxDepth": 7, "minInstancesPerNode": 4}
    return model.compare_settings("tree", rows, _INPUTS, "l_extendedprice", tuned)


@query(
    """SELECT n_name AS model, max(s_suppkey) AS run_id, arg_max(s_name, s_suppkey) AS params
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"""
)
def latest_settings(spark, sf_dir):
    """Settings saved by many runs, appended; the latest of each model is read back."""
    supplier = views.table(spark, sf_dir, "supplier")
    nation = views.table(spark, sf_dir, "nation")
    history = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("model"),
        F.col("s_suppkey").alias("run_id"),
        F.col("s_name").alias("params"),
    )
    path = scratch_dir(spark)
    tables.write_table(history, path)
    return model.best_settings(tables.read_table(spark, path))
