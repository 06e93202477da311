"""Every query runs on the smallest tables; those with SQL give the same rows."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

from papyra.plans import registry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF_DIR}/{name}')")
    return con


def plain(value):
    if value is None or value != value:
        return None
    return round(float(value), 5) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    frame = registry.queries()[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    got = [tuple(plain(v) for v in r) for r in frame.select(*columns).collect()]
    assert got
    if name in registry.oracle_sql():
        found = duck.execute(registry.oracle_sql()[name])
        order = [[d[0] for d in found.description].index(c) for c in columns]
        want = [tuple(plain(r[i]) for i in order) for r in found.fetchall()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
