"""Every registered query against its SQL in DuckDB, over the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from workload.oracle import ORACLE as SQL
from workload.queries import QUERIES


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path("/root/testdata/sf0.001").glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(name, spark, sf, duck):
    frame = QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted((tuple(row[i] for i in order) for row in cursor.fetchall()), key=repr)
    got = sorted((tuple(row) for row in frame.select(*columns).collect()), key=repr)
    assert got == expected
