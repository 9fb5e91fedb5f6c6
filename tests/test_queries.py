"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from lexgrove.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    shown = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    got = entry.QUERIES[name](spark, SF)
    want = con.sql(entry.ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    assert shown(got.select(*cols).collect()) == shown(want.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5 and all(r.markdown.startswith("# ") for r in rows)
    assert set(entry.oracle_sql()) <= set(entry.queries())
