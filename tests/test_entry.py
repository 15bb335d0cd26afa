"""Every registered core query against its SQL on the smallest tables; those without SQL must run."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
import pytest

from filmloom.plans import catalogue, extended, preparation

MODULES = (catalogue, extended, preparation)
QUERIES = {n: f for m in MODULES for n, f in m.QUERIES.items()}
ORACLES = {n: s for m in MODULES for n, s in m.ORACLES.items()}


@pytest.fixture(scope="module")
def sql(tiny):
    c = duckdb.connect()
    for f in os.listdir(tiny):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{tiny}/{f}')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v if isinstance(v, (str, bool)) else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, tiny, name):
    df = QUERIES[name](spark, tiny)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in ORACLES:
        result = sql.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert got == Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_entry_module():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
