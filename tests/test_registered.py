"""Every registered query at the smallest scale, next to its SQL where it has one."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import registered.oracle
import registered.queries

SMALL = "/root/testdata/sf0.001"
# the training-data operators have tests of their own
QUERIES, SQL = registered.queries.QUERIES, registered.oracle.ORACLE
MODEL_ONLY = {
    "rf_predictions", "gbt_predictions", "feature_importance", "boosting_logloss", "notebook_classifier_job",
    "model_comparison_job", "three_model_comparison_job", "hybrid_evaluation_job", "boosted_predictions", "boosting_gains",
}
# best paths over all ways to write a row: held against all paths of short rows in test_casing_paths.py
PATHS_ONLY = {"truecase_context"}


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for file in Path(SMALL).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def in_name_order(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


def test_only_models_and_paths_have_no_sql():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert set(QUERIES) - set(SQL) == MODEL_ONLY | PATHS_ONLY and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, database, name):
    result = QUERIES[name](spark, SMALL)
    answer = database.execute(SQL[name])
    columns = [column[0] for column in answer.description]
    assert sorted(result.columns) == sorted(columns)
    rows = in_name_order([tuple(row) for row in result.collect()], result.columns)
    assert rows == in_name_order(answer.fetchall(), columns) and rows
    # nothing may pair every row with every row
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["rf_predictions", "gbt_predictions", "boosted_predictions"])
def test_models_predict_every_listing(spark, name):
    rows = QUERIES[name](spark, SMALL).collect()
    assert len(rows) == len({r["product_id"] for r in rows}) == 200
    assert all(0 <= r["probability"] <= 1 and r["prediction"] in (0, 1) for r in rows)


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["tn"] + row["fp"] + row["fn"] + row["tp"] == 87
