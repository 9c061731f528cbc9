"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

from tideline.plans import registry


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return float(v) if isinstance(v, Decimal) else v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    found = duck.execute(registry.SQL[name])
    order = [x[0] for x in found.description]
    assert sorted(order) == names
    theirs = sorted((tuple(plain(r[order.index(c)]) for c in names) for r in found.fetchall()), key=str)
    assert mine == theirs


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["pcm_macroblocks", "scene_changes", "nal_units", "init_duration", "amf_round_trip"])
def test_rows_of_one_file_are_dealt(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
