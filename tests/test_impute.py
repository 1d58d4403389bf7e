import numpy as np
import pytest
from pyspark.sql import functions as F

from soilcast.operators.impute import complete_cases, fit_iterative, fit_mean, keep_missing


def test_mean_fill_global_and_group_fallback(spark):
    df = spark.createDataFrame(
        [("s", 1.0), ("s", 3.0), ("s", None), ("w", None), ("w", None)], "season string, x double"
    )
    glob = fit_mean(df, ["x"])
    assert glob.means["x"] == 2.0
    got = sorted(r.x for r in glob.transform(df).collect())
    assert got == [1.0, 2.0, 2.0, 2.0, 3.0]
    grp = fit_mean(df, ["x"], by=["season"])
    rows = grp.transform(df).collect()
    assert sorted((r.season, r.x) for r in rows) == [("s", 1.0), ("s", 2.0), ("s", 3.0), ("w", 2.0), ("w", 2.0)]


def test_column_wholly_missing_stays_null_under_mean(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, x double")
    fill = fit_mean(df, ["x"])
    assert fill.means["x"] is None
    assert all(r.x is None for r in fill.transform(df).collect())


def test_keep_missing_and_complete_cases(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, 2.0), (3, 3.0, 3.0)], "id int, a double, b double")
    km = {r.id: r for r in keep_missing(df, ["a", "b"]).collect()}
    assert km[1].b == -999.0 and km[1].b_missing == 1.0 and km[1].a_missing == 0.0
    assert [r.id for r in complete_cases(df, ["a", "b"]).collect()] == [3]
    assert sorted(r.id for r in complete_cases(df, ["a", "b"], how="all").collect()) == [1, 2, 3]


def brute_force_chained(X: np.ndarray, rounds: int) -> np.ndarray:
    """Row-wise chained regressions, the plain way (the reference for the statistic-based fit)."""
    miss = np.isnan(X)
    Z = np.where(miss, np.nanmean(X, axis=0), X)
    p = X.shape[1]
    for _ in range(rounds):
        for j in range(p):
            obs = ~miss[:, j]
            others = [k for k in range(p) if k != j]
            A = np.column_stack([np.ones(obs.sum()), Z[obs][:, others]])
            coef = np.linalg.lstsq(A, X[obs, j], rcond=None)[0]
            pred = coef[0] + Z[:, others] @ coef[1:]
            Z[miss[:, j], j] = pred[miss[:, j]]
    return Z


@pytest.mark.parametrize("p,rounds", [(3, 4), (4, 2)])
def test_iterative_equals_brute_force(spark, p, rounds):
    rng = np.random.default_rng(p)
    n = 400
    base = rng.normal(size=(n, 1))
    X = base @ rng.normal(size=(1, p)) + 0.3 * rng.normal(size=(n, p)) + 10
    X[rng.random((n, p)) < 0.2] = np.nan
    cols = [f"x{j}" for j in range(p)]
    rows = [(i, *[None if np.isnan(v) else float(v) for v in X[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in cols))
    fill = fit_iterative(df, cols, rounds=rounds)
    got = fill.transform(df).orderBy("id").toPandas()[cols].to_numpy()
    want = brute_force_chained(X, rounds)
    assert np.allclose(got, want, atol=1e-7)
    # observed cells never change, no gap left
    obs = ~np.isnan(X)
    assert np.array_equal(got[obs], X[obs])
    assert not np.isnan(got).any()


def test_iterative_constant_feature_and_single_row(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, None), (3, 5.0, 3.0), (4, None, 4.0)], "id int, a double, b double")
    fill = fit_iterative(df, ["a", "b"], rounds=3)
    got = {r.id: (r.a, r.b) for r in fill.transform(df).collect()}
    assert got[4][0] == pytest.approx(5.0)  # a is constant where observed
    assert got[2][1] is not None
    one = spark.createDataFrame([(1, 2.0, None)], "id int, a double, b double")
    f1 = fit_iterative(one, ["a", "b"], rounds=2)
    r = f1.transform(one).first()
    assert r.a == 2.0 and r.b is None  # b never observed: nothing to fill it from


def test_imputation_rules_do_not_touch_other_columns(spark):
    df = spark.createDataFrame([(1, 1.0, "x"), (2, None, "y")], "id int, a double, s string")
    out = fit_mean(df, ["a"]).transform(df)
    assert out.columns == df.columns
    assert [r.s for r in out.orderBy("id").collect()] == ["x", "y"]
    assert out.filter(F.col("a").isNull()).count() == 0


def test_iterative_tol_stops_early(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(300, 3)) @ np.array([[1.0, 0.5, 0.2], [0.0, 1.0, 0.3], [0.0, 0.0, 1.0]]) + 5
    X[rng.random(X.shape) < 0.15] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in X[i]]) for i in range(len(X))]
    df = spark.createDataFrame(rows, "id int, x0 double, x1 double, x2 double")
    long = fit_iterative(df, ["x0", "x1", "x2"], rounds=50)
    short = fit_iterative(df, ["x0", "x1", "x2"], rounds=50, tol=1e-6)
    assert max(s[0] for s in short.steps) < 50
    a = long.transform(df).orderBy("id").toPandas()[["x0", "x1", "x2"]].to_numpy()
    b = short.transform(df).orderBy("id").toPandas()[["x0", "x1", "x2"]].to_numpy()
    assert np.allclose(a, b, atol=1e-4)


def test_iterative_beats_mean_on_fixture(spark):
    from soilcast.operators.impute import imputation_error
    from soilcast.plans import flows

    obs = flows.prepared(spark, "/root/testdata/sf0.001")
    train, _ = flows.train_test(obs)
    cols = ["a", "b", "c"]
    fills = {"mean": fit_mean(train, cols), "iterative": fit_iterative(train, cols, rounds=5)}
    err = {(r.treatment, r.column): r.rmse for r in imputation_error(obs, cols, flows.TRUTH, fills).collect()}
    for c in cols:
        assert err[("iterative", c)] < err[("mean", c)]


def test_hide_cells_scores_only_hidden_cells(spark):
    from soilcast.operators.impute import hide_cells, imputation_error

    rng = np.random.default_rng(5)
    n = 2000
    x = rng.normal(size=n)
    rows = [(i, float(x[i]), float(2 * x[i] + 0.1 * rng.normal()) if i % 9 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    hidden = hide_cells(df, ["a", "b"], keys=["id"], share=0.2)
    assert hidden.filter("a_true IS NOT NULL").count() == hidden.filter("a IS NULL").count()  # a had no gap
    n_hidden_b = hidden.filter("b_true IS NOT NULL").count()
    assert 0.15 * n < n_hidden_b < 0.25 * n
    again = hide_cells(df, ["a", "b"], keys=["id"], share=0.2)
    assert hidden.exceptAll(again).count() == 0  # repeatable
    fills = {"mean": fit_mean(hidden, ["a", "b"]), "iterative": fit_iterative(hidden, ["a", "b"], rounds=3)}
    err = {(r.treatment, r.column): r for r in imputation_error(hidden, ["a", "b"], {"a": "a_true", "b": "b_true"}, fills).collect()}
    assert err[("mean", "b")].n == n_hidden_b
    # b follows a closely, except in the ~20% of hidden b cells whose a is hidden too (mean-like there),
    # so the error ratio is about sqrt(0.2)
    assert err[("iterative", "b")].rmse < 0.7 * err[("mean", "b")].rmse
    assert err[("iterative", "b")].mae < 0.5 * err[("mean", "b")].mae


def test_iterative_methods_agree(spark):
    rng = np.random.default_rng(11)
    X = rng.normal(size=(500, 3)) @ np.array([[1.0, 0.7, 0.1], [0.0, 1.0, 0.5], [0.0, 0.0, 1.0]]) + 3
    X[rng.random(X.shape) < 0.25] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in X[i]]) for i in range(len(X))]
    df = spark.createDataFrame(rows, "id int, x0 double, x1 double, x2 double")
    cols = ["x0", "x1", "x2"]
    fast = fit_iterative(df, cols, rounds=3)
    slow = fit_iterative(df, cols, rounds=3, method="passes")
    assert len(fast.steps) == len(slow.steps) == 9
    for (r1, j1, a1, b1), (r2, j2, a2, b2) in zip(fast.steps, slow.steps):
        assert (r1, j1) == (r2, j2)
        assert a1 == pytest.approx(a2, abs=1e-9) and b1 == pytest.approx(b2, abs=1e-9)


def wide_frame(spark, n: int, p: int, gaps: np.ndarray, seed: int):
    """Correlated columns with the given gaps."""
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, 4)) @ rng.normal(size=(4, p)) + 0.5 * rng.normal(size=(n, p)) + 2
    X[gaps] = np.nan
    cols = [f"x{j}" for j in range(p)]
    rows = [(i, *[None if np.isnan(v) else float(v) for v in X[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in cols)), cols, X


def replayed(fill, X: np.ndarray) -> np.ndarray:
    """The fitted steps applied to rows on the driver."""
    miss = np.isnan(X)
    U = np.where(miss, 0.0, X - fill.means)
    for _, j, alpha, beta in fill.steps:
        U[miss[:, j], j] = (alpha + U @ beta)[miss[:, j]]
    return U + fill.means


def test_iterative_factors_of_64_columns_equal_brute_force(spark):
    p, n = 64, 600
    rng = np.random.default_rng(64)
    kinds = rng.random((9, p)) < 0.15  # a few sets of gaps, one of them with most rows
    gaps = kinds[np.where(rng.random(n) < 0.6, 0, rng.integers(0, 9, n))]
    gaps[:40] = rng.random((40, p)) < 0.1  # and rows whose gaps nobody shares
    gaps[40:240] = False  # every column is observed
    df, cols, X = wide_frame(spark, n, p, gaps, 64)
    fill = fit_iterative(df.repartition(5), cols, rounds=2, method="factors")
    assert [s[:2] for s in fill.steps] == [(r, j) for r in (1, 2) for j in range(p)]
    assert np.allclose(replayed(fill, X), brute_force_chained(X, 2), atol=1e-6)


def test_iterative_factors_equal_passes(spark):
    p, n = 6, 500
    gaps = np.random.default_rng(6).random((n, p)) < 0.2
    df, cols, X = wide_frame(spark, n, p, gaps, 6)
    fast, slow = (fit_iterative(df, cols, rounds=2, method=m) for m in ("factors", "passes"))
    for (r1, j1, a1, b1), (r2, j2, a2, b2) in zip(fast.steps, slow.steps, strict=True):
        assert (r1, j1) == (r2, j2)
        assert a1 == pytest.approx(a2, abs=1e-8) and b1 == pytest.approx(b2, abs=1e-8)


def test_iterative_factors_of_20_columns_equal_brute_force(spark):
    p, n = 20, 800
    gaps = np.random.default_rng(20).random((n, p)) < 0.12  # nearly every row has gaps of its own
    df, cols, X = wide_frame(spark, n, p, gaps, 20)
    assert np.allclose(replayed(fit_iterative(df, cols, rounds=3), X), brute_force_chained(X, 3), atol=1e-7)


def test_iterative_factors_read_the_data_once_and_stay_small(spark):
    from soilcast.operators import patterns

    rng = np.random.default_rng(8)
    n, p = 5000, 3
    gaps = np.zeros((n, p), bool)
    gaps[:, 1] = rng.random(n) < 0.9  # most rows share one set of gaps
    df, cols, X = wide_frame(spark, n, p, gaps, 8)
    for held in (1 << 10, 1 << 25):  # handed on often, or once
        state = patterns.compress(df.repartition(7), [F.col(c) for c in cols], [0.0] * p, held_bytes=held)
        rows = {bytes(r.gaps): np.frombuffer(bytes(r.factor), "<f8").reshape(-1, p + 1) for r in state.collect()}
        assert len(rows) == state.count() == 2
        for key, m in rows.items():
            at = np.packbits(gaps, axis=1)[:, 0] == key[0]
            want = np.column_stack([np.ones(at.sum()), np.where(gaps[at], 0.0, X[at])])
            assert len(m) <= p + 1 and np.allclose(m.T @ m, want.T @ want)


def test_iterative_factors_of_no_rows_nan_and_one_column(spark):
    none = spark.createDataFrame([], "a double, b double")
    assert fit_iterative(none, ["a", "b"], rounds=2).steps == []
    one = spark.createDataFrame([(1.0,), (None,), (3.0,)], "a double")
    fill = fit_iterative(one, ["a"], rounds=2)
    assert sorted(r.a for r in fill.transform(one).collect()) == pytest.approx([1.0, 2.0, 3.0])


def test_column_blocks_stay_within_their_bytes():
    from soilcast.operators.patterns import column_blocks

    for p in (1, 3, 12, 64, 300, 1000):
        blocks = column_blocks(p)
        assert [j for b in blocks for j in b] == list(range(p))
        assert all(len(b) == 1 or (8 << len(b)) * (p + 1) ** 2 <= 1 << 20 for b in blocks)


def test_iterative_collinear_columns_with_and_without_ridge(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=300) + 4
    X = np.column_stack([x, 2 * x, x + rng.normal(scale=0.5, size=300)])
    X[rng.random(X.shape) < 0.15] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in X[i]]) for i in range(len(X))]
    df = spark.createDataFrame(rows, "id int, x0 double, x1 double, x2 double")
    cols = ["x0", "x1", "x2"]
    for ridge in (0.0, 1e-3):
        out = fit_iterative(df, cols, rounds=3, ridge=ridge).transform(df).toPandas()
        assert out[cols].notna().all().all()
        # x1 = 2 x0 exactly, so a row missing only x1 is filled close to 2 x0
        only_x1 = np.isnan(X[:, 1]) & ~np.isnan(X[:, 0])
        got = out.sort_values("id")["x1"].to_numpy()[only_x1]
        assert np.allclose(got, 2 * X[only_x1, 0], atol=0.05)
