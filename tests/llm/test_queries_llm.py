"""Registered queries against DuckDB running their SQL on the same tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from gristmill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    with duckdb.connect() as c:
        for p in Path(SF).glob("*.parquet"):
            c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        yield c


def ordered(columns, rows):
    """Columns by name, and rows with their values in that order, sorted."""
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[k] for k in at], sorted(repr([row[k] for k in at]) for row in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert ordered(got.columns, map(list, got.collect())) == ordered(columns, want.fetchall())
