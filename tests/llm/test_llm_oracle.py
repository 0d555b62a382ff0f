"""Queries of the llm subpackage that SQL can express, against DuckDB."""

from pathlib import Path

import duckdb
import pytest

from tidemark.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(name, spark, sf):
    duck = duckdb.connect()
    for file in Path(sf).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    frame = QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted((tuple(row[i] for i in order) for row in cursor.fetchall()), key=repr)
    assert sorted((tuple(row) for row in frame.select(*columns).collect()), key=repr) == expected


def test_every_operator_has_a_query():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
