"""Every registered query with SQL gives what DuckDB gives on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lectern.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    expected = con.execute(registry.ORACLE_SQL[name])
    assert sorted(c[0] for c in expected.description) == cols
    order = [[c[0] for c in expected.description].index(c) for c in cols]
    want = sorted(repr([plain(r[i]) for i in order]) for r in expected.fetchall())
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
