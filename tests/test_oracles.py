"""Every registered query against its SQL oracle on the smallest data."""

import duckdb
import pytest
from conftest import TABLES

from __spark_entry__ import entry
from gridspark.plans import load_queries
from gridspark.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
load_queries()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    spark_types = {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema.fields}
    assert spark_types == {c[0]: str(c[1]) for c in cur.description}
    text = lambda row, names: tuple(repr(row[names.index(c)]) for c in order)
    expected = sorted(text(row, columns) for row in cur.fetchall())
    assert sorted(text(tuple(row), df.columns) for row in df.collect()) == expected
