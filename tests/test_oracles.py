"""Registered queries against their SQL oracles. AFFINOR_QUERIES, a pattern, picks some of them."""
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
NAMES = [n for n in ORACLES if re.search(os.environ.get("AFFINOR_QUERIES", "."), n)]


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got, cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(ORACLES[name])
    want, wcols = rows_of(rel.columns, rel.fetchall())
    assert cols == wcols
    assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())
