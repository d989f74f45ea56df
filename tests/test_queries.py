"""The engine's queries against their SQL in DuckDB, on the smallest test tables."""

import glob
import os

import pytest

from tileforge import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def plain(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    number = lambda x: round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted((tuple(number(x) for x in row) for row in frame.where(frame.notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_its_sql(spark, duck, name):
    assert plain(queries.queries()[name](spark, SF).toPandas()) == plain(duck.execute(queries.oracle_sql()[name]).df())
