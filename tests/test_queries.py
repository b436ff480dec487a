"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(rows):
    """Rows whose fractions are rounded, in order."""
    value = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(float(x), 5) + 0.0 if isinstance(x, float) else x
    return sorted((tuple(map(value, r)) for r in rows), key=str)


@pytest.mark.skipif(not Path(SF).is_dir(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(got.columns)
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    expected = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert plain([tuple(r[c] for c in columns) for r in got.collect()]) == plain(expected)


def test_every_query_with_sql_is_registered():
    assert set(SQL) <= set(__spark_entry__.queries())
