import numpy as np
import pytest
from pyspark.sql import functions as F

from soilcast.operators.models import LinearBase
from soilcast.operators.store import load, save


def test_lines_of_many_groups(spark):
    """100,000 groups: y = g + 2 a - b, fitted and applied without a list of groups on the driver."""
    df = spark.range(600_000).selectExpr(
        "id % 100000 AS g", "CAST(id % 7 AS DOUBLE) AS a", "CAST(id DIV 100000 AS DOUBLE) * (id % 3) + id % 5 AS b"
    ).withColumn("y", F.col("g") + 2 * F.col("a") - F.col("b"))
    fit = LinearBase("l", ["a", "b"]).fit_groups(df, "g")
    out = fit.oof(df)
    assert fit.lines.count() == 100_000
    assert out.agg(F.max(F.abs(F.col("p_l") - F.col("y")))).first()[0] < 1e-4
    assert "CASE WHEN" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_equals_least_squares(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = []
    for g in ("x", "y", None):
        a, b, c = rng.normal(size=(3, 40))
        y = 3 * a - 2 * b + 0.5 * c + rng.normal(size=40)
        rows += [(g, float(p), float(q), float(r), float(s)) for p, q, r, s in zip(a, b, c, y)]
    df = spark.createDataFrame(rows + [("x", None, 1.0, 1.0, 1.0), ("gap", None, 1.0, 1.0, 1.0)], "g string, a double, b double, c double, y double")
    base = LinearBase("l", ["a", "b", "c"])
    fit = base.fit_groups(df, "g")
    save(spark, fit, str(tmp_path / "lines"))
    for f in (fit, load(spark, str(tmp_path / "lines"))):
        got = {(r.g, r.a): r.p_l for r in f.oof(df).collect()}
        for g in ("x", "y", None):
            own = [r for r in rows if r[0] == g]
            x = np.array([[1.0, *r[1:4]] for r in own])
            beta = np.linalg.lstsq(x, np.array([r[4] for r in own]), rcond=None)[0]
            for r, p in zip(own, x @ beta):
                assert got[g, r[1]] == pytest.approx(p, abs=1e-8)
        assert got["gap", None] is None


def test_dependent_and_constant_features(spark):
    """A column that repeats others, a constant one, a group of one row."""
    rows = [("d", float(i), 2.0 * i, 5.0, 3.0 * i + 1) for i in range(20)] + [("one", 1.0, 2.0, 5.0, 7.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double, y double")
    for r in LinearBase("l", ["a", "b", "c"]).fit_groups(df, "g").oof(df).collect():
        assert r.p_l == pytest.approx(r.y, abs=1e-8)
    assert {r.p_l for r in LinearBase("l", []).fit_groups(df, "g").oof(df).collect()} == {29.5, 7.0}
