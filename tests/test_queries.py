"""Every registered query against its SQL on the smallest tables, and a run of those without."""

import math
import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from loomline.plans import ORACLES, QUERIES, load

load()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def norm(v):
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else round(float(v), 6) + 0.0
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLES[name])
    order = sorted(df.columns)
    assert order == sorted(rel.columns)
    got = Counter(tuple(norm(r[c]) for c in order) for r in df.collect())
    at = [rel.columns.index(c) for c in order]
    want = Counter(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
