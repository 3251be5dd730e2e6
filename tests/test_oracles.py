"""Every query with an oracle gives the same rows as an independent engine."""

import decimal
import glob
import os

import duckdb
import pytest

from plumbline.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return str(v)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    found = QUERIES[name](spark, FOLDER)
    want = duck.sql(ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    assert rows == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)


def test_scan_is_pruned_and_pushed_down(spark):
    plan = QUERIES["filter_compare"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThan(l_quantity,10.0)" in plan
    assert "l_tax" not in plan.split("ReadSchema")[1].split("\n")[0]
