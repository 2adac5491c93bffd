"""Queries next to their SQL, and what holds for all of them."""

from pathlib import Path

import duckdb
import pytest
from test_llm_common import SMALL

import __spark_entry__ as entry
from shelfsift.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_like_sql(spark, name):
    database = duckdb.connect()
    for file in Path(SMALL).glob("*.parquet"):
        database.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    answer = database.execute(ORACLE[name])
    columns = [c[0] for c in answer.description]
    result = QUERIES[name](spark, SMALL)
    assert sorted(result.columns) == sorted(columns)
    mine = sorted(map(repr, (tuple(r) for r in result.select(*columns).collect())))
    assert mine == sorted(map(repr, answer.fetchall())) and mine


def test_every_operator_is_registered_once():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and set(QUERIES) | {"pipeline"} <= set(entry.queries())
