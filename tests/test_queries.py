"""Every registered query that has SQL gives the same rows in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from cartograf.plans.oracle import ORACLE
from cartograf.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    assert got
    if name in ORACLE:
        rel = duck.sql(ORACLE[name])
        at = [rel.columns.index(c) for c in columns]
        assert sorted(rel.columns) == columns
        assert got == sorted(str([plain(r[i]) for i in at]) for r in rel.fetchall())


def test_only_known_oracles():
    assert set(ORACLE) <= set(QUERIES)
