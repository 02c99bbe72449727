"""Every query with SQL gives the same rows as DuckDB."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_module
from quillframe.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rounded(v):
    if isinstance(v, float):
        return round(v, 4)
    return tuple(map(rounded, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(repr([rounded(x) for x in r]) for r in df.select(*columns).collect())
    result = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    theirs = sorted(repr([rounded(x) for _, x in sorted(zip(names, r))]) for r in result.fetchall())
    assert columns == sorted(names)
    assert mine == theirs


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
