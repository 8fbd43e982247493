"""Registered queries of the package against their SQL."""

import glob
import os

import duckdb
import pytest

from terracell.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    result = QUERIES[name](spark, SMALL)
    wanted = duck.sql(ORACLES[name])
    assert {c: TYPES[t] for c, t in result.dtypes} == dict(zip(wanted.columns, map(str, wanted.types)))
    columns = sorted(result.columns)
    got = sorted(map(tuple, result.select(*columns).toPandas().values.tolist()), key=str)
    assert got == sorted(map(tuple, wanted.df()[columns].values.tolist()), key=str)
    assert got


def test_one_query_per_operator():
    numbers = sorted(int(name.split("_")[0][2:]) for name in QUERIES)
    assert numbers == list(range(1, 14))
