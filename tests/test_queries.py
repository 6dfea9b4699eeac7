"""Every query against its DuckDB statement on the smallest data."""

import math

import duckdb
import pytest

from spectraloom.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8) + 0.0
    return v


def rows(data):
    return sorted((tuple(map(plain, r)) for r in data), key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = con.execute(ORACLE_SQL[name])
    theirs = [d[0] for d in got.description]
    assert sorted(theirs) == cols
    at = [theirs.index(c) for c in cols]
    assert rows([tuple(r[c] for c in cols) for r in df.collect()]) == rows([tuple(r[i] for i in at) for r in got.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"search_candidates"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
