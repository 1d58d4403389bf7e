"""One key or group holding a third (or more) of all rows: results stay whole and exact."""

import datetime as dt

import numpy as np
import pytest

from soilcast.operators import eda
from soilcast.sources.observations import plant_observations


def test_hot_key_in_line_items(spark):
    rows = [(1, 1, 5.0 + (i % 3), 0.05, 0.02, dt.datetime(2000, 7, 1 + i % 20)) for i in range(3000)]
    rows += [(k, 1, float(k % 50 + 1), 0.01, 0.03, dt.datetime(2000, 1, 5)) for k in range(2, 6002)]
    li = spark.createDataFrame(
        rows, "l_orderkey bigint, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_shipdate timestamp_ntz"
    ).repartition(8)
    obs = plant_observations(li)
    assert obs.count() == 6001
    hot = obs.filter("k1 = 1").first()
    assert hot.a0 == 5.0 and hot.ts == dt.datetime(2000, 7, 1) and hot.season == "summer"


def test_hot_group_quantiles_and_summary(spark):
    rng = np.random.default_rng(9)
    hot = rng.normal(size=20000)
    cold = rng.normal(size=2000) + 3
    rows = [("hot", float(v)) for v in hot] + [("cold", float(v)) for v in cold]
    df = spark.createDataFrame(rows, "season string, x double").repartition(8)
    probs = [0.05, 0.5, 0.95]
    got = {(r.season, r.prob): r.quantile for r in eda.quantile_summary(df, ["x"], probs, partitions=16).collect()}
    for g, v in (("hot", hot), ("cold", cold)):
        for p in probs:
            assert got[(g, p)] == pytest.approx(float(np.quantile(v, p)), abs=1e-12)
    s = {r.season: r for r in eda.numeric_summary(df, ["x"]).collect()}
    assert s["hot"].n == 20000 and s["hot"].mean == pytest.approx(float(hot.mean()))
