"""Every query with SQL gives DuckDB's rows over the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from factorloom.plans import catalogue, registry  # noqa: F401

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def shown(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return repr(float(value) + 0.0) if isinstance(value, float) else str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(shown(r[i]) for i in order) for r in data], key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    ours = df.collect()
    theirs = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(theirs.columns)
    assert rows(df.columns, ours) == rows(theirs.columns, theirs.fetchall())


def test_flagship(spark):
    assert registry.QUERIES[catalogue.FLAGSHIP](spark, DATA).count() > 0
