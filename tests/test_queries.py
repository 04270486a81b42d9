"""Every registered query against its DuckDB twin on the small driver tables."""

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb
import pytest

from fieldcounts.plans.catalog import load_all
from conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]
REG = load_all()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 90


@pytest.mark.parametrize("name", sorted(n for n, q in REG.items() if q.sql))
def test_query_matches_sql(spark, con, name):
    q = REG[name]
    sdf = q.build(spark, SF_SMALL)
    scols = sdf.columns
    srows = sdf.collect()
    rel = con.sql(q.sql)
    dcols = rel.columns
    drows = rel.fetchall()
    assert sorted(scols) == sorted(dcols)
    order = sorted(scols)
    si = [scols.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    assert Counter(tuple(_norm(r[i]) for i in si) for r in srows) == \
        Counter(tuple(_norm(r[i]) for i in di) for r in drows)
