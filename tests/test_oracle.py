"""Every registered query against its SQL in DuckDB: rows, column names, types and values."""

import glob
import math
import os

import duckdb
import pytest

from siglume.plans.registry import ORACLE_SQL, QUERIES

SIZES = ("sf0.01",)


@pytest.fixture(scope="module")
def ducks():
    out = {}
    for sf in SIZES:
        out[sf] = duckdb.connect()
        for f in glob.glob(f"/root/testdata/{sf}/*.parquet"):
            out[sf].sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return out


def key(row):
    """An order in which floats that agree to five places stand alike."""
    return tuple((v is None, type(v).__name__ != "float", round(v, 5) + 0.0 if isinstance(v, float) else str(v)) for v in row)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isnan(a) and math.isnan(b) or abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))
    return type(a) is type(b) and a == b


@pytest.mark.parametrize("sf", SIZES)
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, ducks, name, sf):
    df = QUERIES[name](spark, f"/root/testdata/{sf}")
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    q = ducks[sf].sql(ORACLE_SQL[name])
    assert cols == sorted(q.columns)
    at = [q.columns.index(c) for c in cols]
    want = sorted((tuple(r[k] for k in at) for r in q.fetchall()), key=key)
    assert len(got) == len(want)
    odd = [(a, b) for a, b in zip(got, want) if not all(map(same, a, b))]
    assert not odd, odd[:3]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
