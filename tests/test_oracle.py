"""Every library query against its SQL on DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from lodestone import queries as library

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(v):
    if hasattr(v, "__len__") and not isinstance(v, (str, bytes)):
        return repr([_cell(x) for x in v])
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) or v is pd.NaT:
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_" or type(v).__name__ == "bool":
        return str(bool(v))
    try:
        return f"{float(v):.9g}" if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def rows(frame: pd.DataFrame) -> list:
    names = sorted(frame.columns)
    return sorted(tuple(map(_cell, r)) for r in frame[names].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(library.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    ours, theirs = library.QUERIES[name](spark, SF).toPandas(), duck.execute(library.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_every_query_has_sql():
    assert set(library.QUERIES) == set(library.ORACLE_SQL)
