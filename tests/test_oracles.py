"""Every registered query against its SQL oracle, on the smallest test data."""

import datetime
import decimal
import math
import os

import pytest

import __spark_entry__ as entry
from thicket.plans.standins import BASE
from thicket.queries import load

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data is not there")

QUERIES, ORACLES = load()
TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz", "DATE": "date",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SF)
    cols = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr)
    result = duck.execute(ORACLES[key])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(([plain(r[i]) for i in at] for r in result.fetchall()), key=repr)
    assert got == want
    kinds = {d[0]: TYPES.get(str(d[1])) for d in result.description}
    assert {c: t for c, t in df.dtypes} == {c: kinds[c] or t for c, t in df.dtypes}


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_oracle(spark, key):
    assert QUERIES[key](spark, SF).limit(1).count() == 1


def test_entry(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0
