"""Queries with a DuckDB statement against it, on the smallest data."""

import pytest

from spectraloom.llm.registry import ORACLE_SQL, QUERIES
from tests.test_queries import SF, con, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, con, name):  # noqa: F811
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = con.execute(ORACLE_SQL[name])
    at = [[d[0] for d in got.description].index(c) for c in cols]
    assert rows([tuple(r[c] for c in cols) for r in df.collect()]) == rows([tuple(r[i] for i in at) for r in got.fetchall()])
