"""NULL seasons, keys and folds, NaN, wholly missing columns, and wide or scattered gaps."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from soilcast.operators import eda
from soilcast.operators.features import split_train_test, with_split
from soilcast.operators.impute import IterativeFill, fit_iterative, fit_mean, imputation_error
from soilcast.operators.joins import join_fitted
from soilcast.operators.models import GroupMeanBase, LinearBase, boosted_base
from soilcast.operators.scoring import leaderboard, regression_metrics
from soilcast.operators.stack import fit_stack, out_of_fold
from soilcast.sources.observations import LINEITEM_SCHEMA, load_observations


@pytest.mark.parametrize("mode", ["table", "checkpoint", "cache"])
def test_quantiles_equal_in_every_mode(spark, mode):
    spark.conf.set("soilcast.materialize", mode)
    try:
        rng = np.random.default_rng(3)
        values = rng.exponential(size=20_000)
        df = spark.createDataFrame([(("s", None)[i % 2], float(v)) for i, v in enumerate(values)], "season string, x double")
        got = {(r.season, r.prob): r.quantile for r in eda.quantile_summary(df, ["x"], [0.1, 0.5, 0.9], partitions=16).collect()}
    finally:
        spark.conf.unset("soilcast.materialize")
    assert len(got) == 6
    for k, season in enumerate(["s", None]):
        for p in (0.1, 0.5, 0.9):
            assert got[season, p] == pytest.approx(np.quantile(values[k::2], p))


def test_statistics_skip_nan(spark):
    df = spark.createDataFrame([("s", 1.0, 2.0), ("s", 3.0, 4.0), ("s", float("nan"), 1.0), ("s", None, 5.0), ("s", 5.0, 7.0)], "season string, x double, y double")
    r = eda.numeric_summary(df, ["x"]).first()
    assert (r.n, r.mean, r.min, r.max) == (3, 3.0, 1.0, 5.0)
    assert eda.quantile_summary(df, ["x"], [1.0]).first().quantile == 5.0
    c = eda.correlations(df, ["x", "y"]).first()
    assert c.n == 3 and c.r == pytest.approx(np.corrcoef([1, 3, 5], [2, 4, 7])[0, 1])
    assert eda.missing_profile(df, ["x"]).first().n_missing == 2


def test_null_season_is_not_all_seasons(spark):
    rows = [("m", "x", "s", 1.0, 1.5), ("m", "x", "s", 2.0, 2.0), ("m", "x", None, 3.0, 3.0), ("m", "z", None, 3.0, 4.0), ("m", "z", "s", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "scenario string, model string, season string, y double, prediction double")
    got = {(r.model, r.level, r.season): r.n for r in regression_metrics(df).collect()}
    assert got == {("x", "all", None): 3, ("x", "season", "s"): 2, ("x", "season", None): 1, ("z", "all", None): 2, ("z", "season", None): 1, ("z", "season", "s"): 1}
    ranks = {(r.model, r.level, r.season): r.rk for r in leaderboard(regression_metrics(df)).collect()}
    assert ranks["x", "season", None] == 1 and ranks["z", "season", None] == 2 and ranks["x", "all", None] == 1


def test_split_keeps_null_keys(spark):
    df = spark.createDataFrame([(None,), (5,), (6,)], "k long")
    train, test = split_train_test(df, "k")
    assert sorted(r.k or 0 for r in train.collect()) == [0, 6] and [r.k for r in test.collect()] == [5]
    assert with_split(df, "k").where("split = 'train'").count() == train.count()


def test_fitted_tables_meet_null_keys(spark):
    df = spark.createDataFrame([(None, None), (None, 4.0), ("s", None), ("s", 1.0)], "season string, a double")
    filled = fit_mean(df, ["a"], by=["season"]).transform(df)
    assert sorted((r.season or "", r.a) for r in filled.collect()) == [("", 4.0), ("", 4.0), ("s", 1.0), ("s", 1.0)]
    fitted = spark.createDataFrame([(None, 7), ("s", 8)], "season string, v int")
    assert {(r.season, r.v) for r in join_fitted(df, fitted, "season").collect()} == {(None, 7), ("s", 8)}


def test_rows_without_fold_stay(spark):
    rows = [(i % 3 if i % 10 else None, "s", float(i), 2.0 * i) for i in range(120)]
    df = spark.createDataFrame(rows, "fold int, season string, a double, y double")
    bases = [boosted_base("A", ["a"], maxIter=2), LinearBase("line", ["a"]), GroupMeanBase("mean")]
    oof, fitted = out_of_fold(df, "fold", bases, 3)
    got = oof.collect()
    assert len(got) == 120
    for r in got:
        assert all((r[b.col] is None) == (r.fold is None) for b in bases)
    weights = fit_stack(oof, [b.col for b in bases])
    assert all(np.isfinite(weights.weights))
    assert fitted[1].predict(df.limit(1)).first().p_line == pytest.approx(2.0 * df.first().a)


def test_training_rows_are_read_once_per_fold(spark, tmp_path):
    spark.range(300).selectExpr("CAST(id % 3 AS INT) AS fold", "id * 1.0D AS a", "id * 2.0D AS y").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for m in (1, 2, 3):
        bases = [boosted_base(c, ["a"], maxIter=1) for c in "ABC"[:m]]
        oof, _ = out_of_fold(df, "fold", bases, 3)
        plan = oof._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"FileScan parquet", plan)) == 4  # three folds, and the rows of none


def test_merged_fold_moments_equal_separate_fits(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i % 3), *map(float, rng.normal(size=2)), float(rng.normal())) for i in range(60)]
    df = spark.createDataFrame(rows, "fold int, a double, b double, y double")
    fit = LinearBase("l", ["a", "b"]).fit(df, "fold", 3)
    for held in (0, 1, 2, -1):
        use = np.array([r[1:] for r in rows if r[0] != held])
        X = np.column_stack([np.ones(len(use)), use[:, :2]])
        w = np.linalg.lstsq(X, use[:, 2], rcond=None)[0]
        assert [fit.params[held][0], *fit.params[held][1]] == pytest.approx(list(w))


def test_wholly_missing_column(spark):
    df = spark.createDataFrame([(1.0, None, 1.0, 5.0), (None, None, 2.0, 6.0), (3.0, None, 3.0, 7.0)], "a double, b double, a0 double, b0 double")
    for method in ("passes", "patterns"):
        fill = fit_iterative(df, ["a", "b"], rounds=2, method=method)
        err = imputation_error(df, ["a", "b"], {"a": "a0", "b": "b0"}, {"it": fill, "mean": fit_mean(df, ["a", "b"])})
        got = {(r.treatment, r.column): (r.n, r.rmse) for r in err.collect()}
        assert got["it", "b"] == (3, None) and got["it", "a"][0] == 1 and got["it", "a"][1] is not None


def test_many_columns_and_scattered_gaps(spark):
    rng = np.random.default_rng(2)
    p, n = 64, 150
    base = rng.normal(size=(n, 4)) @ rng.normal(size=(4, p)) + 0.1 * rng.normal(size=(n, p))
    gone = rng.random((n, p)) < 0.05
    rows = [[None if g else float(v) for v, g in zip(vs, gs)] for vs, gs in zip(base, gone)]
    cols = [f"c{j}" for j in range(p)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).cache()
    with pytest.raises(ValueError, match="patterns"):
        fit_iterative(df, cols, method="patterns")
    few = cols[:6]
    scattered = df.select(*few)
    a = fit_iterative(scattered, few, rounds=2, method="patterns")
    b = fit_iterative(scattered, few, rounds=2, method="passes")
    for x, y in zip(a.steps, b.steps, strict=True):
        assert x[:2] == y[:2] and [x[2], *x[3]] == pytest.approx([y[2], *y[3]], abs=1e-8)
    wide = IterativeFill(cols, [0.0] * p, [(1, j, 0.0, [0.0 if k == j else 0.01 for k in range(p)]) for j in range(p)])
    out = wide.transform(df)
    assert out.columns == cols and all(v is not None for r in out.collect() for v in r)


def test_load_observations_reads_nan_as_null(spark, tmp_path):
    rows = [(1, 1, float("nan"), 0.5, 0.1, None), (2, 1, 3.0, float("nan"), None, None)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_shipdate timestamp_ntz")
    df.write.parquet(str(tmp_path / "l"))
    got = load_observations(spark, str(tmp_path / "l"), LINEITEM_SCHEMA, ["l_orderkey"], "l_shipdate", "l_quantity", ["l_discount", "l_tax"])
    assert {(r.l_orderkey, r.l_quantity, r.l_discount, r.season) for r in got.collect()} == {(1, None, 0.5, None), (2, 3.0, None, None)}
    assert got.where(F.isnan("l_quantity")).count() == 0
