import pytest
from pyspark.sql import functions as F

from soilcast.operators.scoring import on_common_rows, regression_metrics, treatment_mask
from soilcast.sources.sinks import commit_results, manifest, read_results


def rows(spark, data):
    return spark.createDataFrame(data, "k long, scenario string, v double")


def got(spark, path, schema):
    return sorted(map(tuple, read_results(spark, path, schema).collect()), key=str)


def test_one_scenario_is_replaced(spark, tmp_path):
    path = str(tmp_path / "r")
    first = rows(spark, [(1, "a", 1.0), (2, "a/b=c", 2.0), (3, None, 3.0)])
    assert read_results(spark, path, first.schema).count() == 0
    assert commit_results(first, path) == 1
    assert commit_results(rows(spark, [(9, "a", 9.0)]), path) == 2
    assert got(spark, path, first.schema) == sorted([(9, "a", 9.0), (2, "a/b=c", 2.0), (3, None, 3.0)], key=str)
    assert commit_results(first.limit(0), path) == 3
    assert len(got(spark, path, first.schema)) == 3 and set(manifest(spark, path)) == {"a", "a/b=c", None}


def test_failed_write_and_second_writer_leave_the_old_result(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "r")
    first = rows(spark, [(1, "a", 1.0), (2, "b", 2.0)])
    commit_results(first, path)
    begun = read_results(spark, path, first.schema)
    with pytest.raises(Exception, match="boom"):
        commit_results(first.withColumn("v", F.raise_error(F.lit("boom")).cast("double")), path)
    assert got(spark, path, first.schema) == [(1, "a", 1.0), (2, "b", 2.0)]
    from soilcast.sources import sinks

    seen = sinks._versions(spark, path)
    commit_results(rows(spark, [(5, "a", 5.0)]), path)
    monkeypatch.setattr(sinks, "_versions", lambda *a: seen)  # a writer that began before that commit
    with pytest.raises(RuntimeError, match="another writer"):
        commit_results(rows(spark, [(6, "a", 6.0)]), path)
    monkeypatch.undo()
    assert got(spark, path, first.schema) == [(2, "b", 2.0), (5, "a", 5.0)]
    assert begun.count() == 2 and sorted(r.k for r in begun.collect()) == [1, 2]


def test_common_rows_are_a_filter(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 3.0), (3, None, None)], "k long, a double, b double")
    masked = df.withColumn("m", treatment_mask({"fill": [], "whole_a": ["a"], "whole": ["a", "b"]}))
    assert [r.m for r in masked.orderBy("k").collect()] == [3, 7, 1]
    out = on_common_rows(masked, "m", 3)
    assert [r.k for r in out.collect()] == [2] and "m" not in out.columns
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        treatment_mask({str(i): [] for i in range(32)})


def test_metrics_expand_only_the_small_table(spark):
    data = [("s", m, None if i % 7 == 0 else "wxyz"[i % 4], float(i % 11) + 1e6, float(i % 5) + 1e6) for i in range(200) for m in "ab"]
    df = spark.createDataFrame(data, "scenario string, model string, season string, y double, prediction double")
    plan = regression_metrics(df)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    assert next(i for i, x in enumerate(lines) if "Expand" in x) < max(i for i, x in enumerate(lines) if "Aggregate" in x)
    whole = {r.model: r for r in regression_metrics(df).where("level = 'all'").collect()}
    ys, ps = [r[3] for r in data[::2]], [r[4] for r in data[::2]]
    mean = sum(ys) / len(ys)
    sse = sum((a - b) ** 2 for a, b in zip(ys, ps))
    assert whole["a"].n == 200 and whole["a"].rmse == pytest.approx((sse / 200) ** 0.5)
    assert whole["a"].r2 == pytest.approx(1 - sse / sum((y - mean) ** 2 for y in ys), rel=1e-9)
    assert whole["b"].mae == pytest.approx(sum(abs(a - b) for a, b in zip(ys, ps)) / 200)


def test_rows_are_dealt_anew_before_the_write_sorts_them(spark):
    """A write by partition sorts all rows of its task, so its tasks must not be as large as those that made the rows."""
    from soilcast.sources.sinks import _evened

    df = spark.range(1000).selectExpr("id k", "array(id) a", "map('x', id) m", "if(id % 2 = 0, 'a', null) `a b`")
    plan = _evened(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("RebalancePartitions [k#")
    assert sorted(_evened(df).select("k").toPandas()["k"]) == list(range(1000))
    assert _evened(df.select("m")).count() == 1000
