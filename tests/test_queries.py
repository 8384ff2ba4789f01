"""Every registered query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import pytest

from tallyspark.plans import catalog

catalog.load()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return out


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, list):
        return tuple(map(plain, value))
    return value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    got = Counter(tuple(plain(v) for v in r) for r in df.select(sorted(df.columns)).collect())
    assert got, "no rows"
    if name in catalog.ORACLES:
        cursor = con.execute(catalog.ORACLES[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        at = [names.index(c) for c in sorted(names)]
        assert Counter(tuple(plain(r[k]) for k in at) for r in cursor.fetchall()) == got
