"""Every registered query with a SQL oracle equals DuckDB on the sf0.001 tables."""

import math
import os
from dataclasses import replace

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from soilcast.plans import flows
from soilcast.plans import queries as Q

from .conftest import SF_SMALL


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _canon(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF_SMALL):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF_SMALL}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_equals_oracle(spark, con, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    assert _canon(got) == _canon(want)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_returns_ranked_rows(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 15 and {r.rk for r in rows} == {1, 2, 3}


TREES = {"boosted_a", "boosted_b", "boosted_c", "per_season", "tree_stack", "tree_grid", "hybrid_grid"}


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(E.oracle_sql())))
def test_rows_only_queries_run(spark, monkeypatch, name):
    if name in TREES:  # whole configs: bench and the driver
        monkeypatch.setattr(flows, "CONFIGS", {n: replace(c, rounds=1) for n, c in flows.CONFIGS.items()})
    got = Q.queries()[name](spark, SF_SMALL)
    assert got.count() > 0
    if name == "hybrid_grid":
        assert got.count() == 80
