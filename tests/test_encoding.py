import hashlib
import math

import pytest
from pyspark.sql import functions as F

from soilcast.operators.encoding import ordered_target_encoding


def brute(rows, weight):
    """(k, c, y) → encoding, row by row."""
    ys = [y for _, _, y in rows if y is not None]
    prior = sum(ys) / len(ys) if ys else None
    at = [hashlib.md5(("" if k is None else str(k)).encode()).hexdigest() for k, _, _ in rows]
    out = []
    for i, (_, c, _) in enumerate(rows):
        seen = [rows[j][2] for j in range(len(rows)) if rows[j][1] == c and at[j] < at[i] and rows[j][2] is not None]
        n = len(seen) + weight
        out.append((sum(seen) + weight * prior) / n if n and prior is not None else None)
    return out


def rows_of(n):
    cat = lambda i: None if i % 11 == 0 else "half" if i % 2 else f"c{i % 3}"
    return [(i, cat(i), None if i % 13 == 5 else float(i % 17)) for i in range(n)] + [(3, "half", 100.0), (3, "half", 50.0), (None, "c0", 2.0)]


@pytest.mark.parametrize("weight,range_rows", [(1.0, 100_000), (2.5, 7), (0.0, 20)])
def test_equals_brute_force(spark, weight, range_rows):
    rows = rows_of(300)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "k long, c string, y double, i int").repartition(5)
    got, fit = ordered_target_encoding(df, "c", "y", ["k"], "e", weight, range_rows)
    for r, e in zip(sorted(got.collect(), key=lambda r: r.i), brute(rows, weight), strict=True):
        assert (r.e is None) == (e is None) and (e is None or math.isclose(r.e, e, abs_tol=1e-9)), r
    new = spark.createDataFrame([("half", "x"), (None, "x"), ("unseen", "x")], "c string, e string")
    ys = {c: [y for _, d, y in rows if d == c and y is not None] for c in ("half", None)}
    every = [y for _, _, y in rows if y is not None]
    prior = sum(every) / len(every)
    out = {r.c: r.e for r in fit.transform(new).collect()}
    for c in ys:
        assert out[c] == pytest.approx((sum(ys[c]) + weight * prior) / (len(ys[c]) + weight))
    assert out["unseen"] == (pytest.approx(prior) if weight else None)


def test_a_large_category_is_many_groups(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("c"), F.col("id").cast("double").alias("y"))
    got, _ = ordered_target_encoding(df, "c", "y", ["id"], range_rows=250)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "partitionBy" not in plan or "_range" in plan
    # No window of rows has fewer partition columns than (category, range); the other one runs over ranges.
    assert plan.count("windowspecdefinition(c") == plan.count("windowspecdefinition(c#")
    assert got.count() == 4000 and got.where("c_target IS NULL").count() == 0


def test_empty_and_without_target(spark):
    schema = "k long, c string, y double"
    got, fit = ordered_target_encoding(spark.createDataFrame([], schema), "c", "y", ["k"])
    assert got.count() == 0 and fit.transform(spark.createDataFrame([("a",)], "c string")).first().c_target is None
    got, _ = ordered_target_encoding(spark.createDataFrame([(1, "a", None), (2, "a", None)], schema), "c", "y", ["k"])
    assert [r.c_target for r in got.collect()] == [None, None]
