"""Every registered query against its SQL: same columns, types and rows."""

import glob
import os

import duckdb
import pytest

import checks

from .conftest import SMALL

TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}

#: the small tables hold nothing this query could find
MAY_BE_EMPTY = {"missing_tiles", "tile_render_query", "process_inputs", "process_inputs_by_layer", "scene_search"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def ordered(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), na_position="first", ignore_index=True)


@pytest.mark.parametrize("name", sorted(checks.QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    result = checks.QUERIES[name](spark, SMALL)
    rel = duck.sql(checks.ORACLES[name])
    types = dict(zip(rel.columns, map(str, rel.types)))
    assert {c: TYPES[t] for c, t in result.dtypes} == types
    got, wanted = ordered(result.toPandas()), ordered(rel.df())
    assert len(got) == len(wanted)
    assert len(got) or name in MAY_BE_EMPTY
    for c in got.columns:
        same = (got[c] == wanted[c]) | (got[c].isna() & wanted[c].isna())
        assert same.all(), (c, got[c][~same].head().tolist(), wanted[c][~same].head().tolist())


def test_every_query_has_an_oracle():
    assert set(checks.QUERIES) == set(checks.ORACLES)
