import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from soilcast.operators import crossprod
from soilcast.operators.eda import correlations


def test_equals_numpy_with_gaps_and_groups(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        v = rng.normal(size=5) + 1e5
        v[1] += v[0]
        cells = [None if rng.random() < 0.2 else float("nan") if rng.random() < 0.05 else float(x) for x in v]
        rows.append(([None, "a", "b"][i % 3], i % 2, *cells))
    df = spark.createDataFrame(rows, "g string, h int, a double, b double, c double, d double, e double").repartition(4)
    got = {(r.g, r.h, r.x, r.y): (r.n, r.r) for r in correlations(df, list("abcde"), ["g", "h"]).collect()}
    assert len(got) == 3 * 2 * 10
    for (g, h, x, y), (n, r) in got.items():
        own = np.array([[np.nan if c is None else c for c in row[2:]] for row in rows if row[0] == g and row[1] == h])
        p, q = own[:, "abcde".index(x)], own[:, "abcde".index(y)]
        both = ~np.isnan(p) & ~np.isnan(q)
        assert n == both.sum() and r == pytest.approx(np.corrcoef(p[both], q[both])[0, 1], abs=1e-9)


def test_small_blocks_change_nothing(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i % 3, *map(float, rng.normal(size=7))) for i in range(90)], "g int, " + ", ".join(f"c{i} double" for i in range(7)))
    cols = {f"c{i}": F.col(f"c{i}") for i in range(7)}
    rows = lambda d: {(r.g, r.x, r.y): (r.n, round(r.sxx, 9), round(r.syy, 9), round(r.sxy, 9)) for r in d.collect()}
    whole = rows(crossprod.pair_moments(df, cols, ["g"]))
    assert len(whole) == 63 and rows(crossprod.pair_moments(df.repartition(5), cols, ["g"], block=2, held_groups=1)) == whole


def test_awkward_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0, None, 1), (2.0, 5.0, None, 2), (None, 5.0, 3.0, 3)], "a double, k double, z double, i int")
    got = {(r.x, r.y): (r.n, r.r) for r in correlations(df, ["a", "k", "z", "i"], []).collect()}
    assert got["a", "k"] == (2, None) and got["a", "z"] == (0, None) and got["z", "i"] == (1, None) and got["a", "i"] == (2, pytest.approx(1.0))
    assert correlations(df.limit(0), ["a", "k"], []).count() == 0 and correlations(df, ["a"], []).count() == 0


def test_many_columns_are_planned_in_seconds(spark):
    cols = [f"x{i}" for i in range(300)]
    df = spark.range(50).select(*[(F.col("id") * (i % 7) + F.pmod(F.col("id") * i, F.lit(13))).cast("double").alias(c) for i, c in enumerate(cols)])
    began = time.time()
    out = correlations(df, cols, [])
    out._jdf.queryExecution().executedPlan()
    assert time.time() - began < 30
    assert out.count() == 300 * 299 // 2
