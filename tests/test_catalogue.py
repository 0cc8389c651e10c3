"""The driver's contract: every core query runs, and agrees with its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalogue

Q, O = catalogue.REGISTRY.queries, catalogue.REGISTRY.oracles


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in sorted(os.listdir(data)):
        c.execute(f"create view {f[:-8]} as select * from '{data}/{f}'")
    return c


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def one(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return "~"
        if hasattr(v, "year"):
            return str(pd.Timestamp(v))
        return f"{float(v):.5g}" if isinstance(v, (int, float)) or type(v).__name__ in ("Decimal", "int64", "int32", "float64") else str(v)

    return sorted(tuple(one(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(O))
def test_query_equals_sql(spark, data, con, name):
    got, want = Q[name](spark, data).toPandas(), con.execute(O[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(Q) - set(O)))
def test_query_without_sql_runs(spark, data, name):
    df = Q[name](spark, data)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() >= 0
