"""Registered queries against DuckDB on the small tables.

A selection by default; ``TABLEGAUGE_ALL=1`` runs every query that has SQL.
"""

import glob
import os
import re

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
SELECTION = r"^(c3|c14|c15|c16|q20|q21|p1_types_(inv|cust)|a1_iqr_line|g4_agg.*median|g10|r17|r20|o5|m4_run_deltas$|m7|m16_|s3)"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


def plain(value):
    return value.isoformat() if hasattr(value, "isoformat") else value


def table(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def chosen():
    names = sorted(oracle_sql())
    return names if os.environ.get("TABLEGAUGE_ALL") else [n for n in names if re.search(SELECTION, n)]


@pytest.mark.parametrize("name", chosen())
def test_same_as_duckdb(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    got = table(df.columns, df.collect())
    cursor = duck.execute(oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == table(columns, cursor.fetchall())


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark).collect()
    assert [r["severity"] for r in rows] == ["CLEAN", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
    assert sum(r["n"] for r in rows) > 0
