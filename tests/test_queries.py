"""Every registered query against its SQL on the smallest tables."""

import check_oracles
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return check_oracles.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, name):
    rows, problems, _, _ = check_oracles.compare(spark, db, name, SF_DIR)
    assert problems == []


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_desert_box_is_empty(spark):
    from escarp.operators.features import in_box

    areas = spark.createDataFrame([(37.5, -119.6, "a"), (37.5, -118.0, "b")], "lat double, lon double, name string")
    assert in_box(areas, -119.7, 37.0, -119.5, 38.0).count() == 1
    assert in_box(areas, -116.7, 37.0, -116.5, 38.0).count() == 0


def test_tree_queries_join_their_rows_once(spark, tmp_path, monkeypatch):
    """What is fitted and scored is a written table, so no pass runs the join again."""
    from escarp.plans import model_queries

    ids = spark.range(40)
    ids.selectExpr("id AS o_orderkey", "id * 3.0D AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    ids.selectExpr("id AS p_partkey", "id AS p_size", "id * 2.0D AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    ids.selectExpr(
        "id AS l_orderkey", "id AS l_partkey", "id % 5 AS l_suppkey", "1 AS l_linenumber", "id * 1.0D AS l_quantity",
        "id * 7.0D AS l_extendedprice", "0.1D AS l_discount", "0.02D AS l_tax",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    fitted = []

    def compare(name, rows, *more):
        fitted.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return rows

    monkeypatch.setattr(model_queries.model, "compare_settings", compare)
    model_queries.tuned_and_default_scores(spark, str(tmp_path))
    assert fitted and "Join" not in fitted[0]
