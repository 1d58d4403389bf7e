import pytest
from pyspark.sql import functions as F

from soilcast.operators.models import GroupMeanBase, LinearBase, boosted_base
from soilcast.operators.scoring import leaderboard, regression_metrics, temperature_gap, to_long
from soilcast.operators.stack import fit_per_season, fit_stack, out_of_fold, predict_stack
from soilcast.plans import flows
from soilcast.sources.sinks import write_results
from soilcast.session import shared_dir

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def stack(spark):
    return flows.linear_stack(spark, SF_SMALL)


def test_oof_covers_every_training_row_once(spark, stack):
    oof, _, _, _ = stack
    obs = flows.prepared(spark, SF_SMALL)
    train, _ = flows.train_test(obs)
    assert oof.count() == train.count()
    assert oof.select("k1", "k2").distinct().count() == train.count()
    assert oof.filter(F.col("p_season_mean").isNull() | F.col("p_line_a").isNull()).count() == 0


def test_stack_not_worse_than_worst_base(spark, stack):
    _, _, _, pred = stack
    m = {r.model: r.rmse for r in regression_metrics(to_long(pred, flows.KEYS, flows.LINEAR_MODELS, "mean")).filter("season IS NULL").collect()}
    assert m["stack"] <= max(m["season_mean"], m["line_a"])


def test_leaderboard_ranks_within_season(spark, stack):
    _, _, _, pred = stack
    lb = leaderboard(regression_metrics(to_long(pred, flows.KEYS, flows.LINEAR_MODELS, "mean"))).collect()
    assert len(lb) == 3 * 5
    for s in {r.season for r in lb}:
        ranks = sorted(r.rk for r in lb if r.season == s)
        assert ranks == [1, 2, 3]
    top = leaderboard(regression_metrics(to_long(pred, flows.KEYS, flows.LINEAR_MODELS, "mean")), k=1).collect()
    assert len(top) == 5


def test_oof_fits_exclude_own_fold(spark):
    # fold 0 rows are predicted from folds 1 and 2 only
    df = spark.createDataFrame(
        [(0, "s", 100.0), (1, "s", 1.0), (2, "s", 3.0), (0, "w", 5.0), (1, "w", 7.0), (2, "w", 9.0)],
        "fold int, season string, y double",
    )
    oof, fitted = out_of_fold(df, "fold", [GroupMeanBase("m", ["season"])], 3)
    got = {(r.fold, r.season): r.p_m for r in oof.collect()}
    assert got[(0, "s")] == 2.0 and got[(1, "s")] == pytest.approx(51.5) and got[(0, "w")] == 8.0
    allfit = {r.season: r.p_m for r in fitted[0].predict(df.select("season").distinct()).collect()}
    assert allfit["s"] == pytest.approx(104 / 3)


def test_group_without_training_rows_falls_back(spark):
    train = spark.createDataFrame([(0, "s", 1.0), (1, "s", 3.0)], "fold int, season string, y double")
    test = spark.createDataFrame([("w", 0.0)], "season string, y double")
    _, fitted = out_of_fold(train, "fold", [GroupMeanBase("m", ["season"])], 2)
    assert fitted[0].predict(test).first().p_m == 2.0


def test_linear_base_recovers_line(spark):
    df = spark.createDataFrame([(i % 3, float(i), 2.0 + 3.0 * i) for i in range(30)], "fold int, x double, y double")
    _, fitted = out_of_fold(df, "fold", [LinearBase("l", ["x"])], 3)
    r = fitted[0].predict(spark.createDataFrame([(100.0,)], "x double")).first()
    assert r.p_l == pytest.approx(302.0)


def test_tree_stack_and_per_season(spark):
    obs = flows.prepared(spark, SF_SMALL)
    train, test = flows.train_test(obs)
    from soilcast.operators.impute import fit_mean

    fill = fit_mean(train, ["a", "b", "c"])
    trf, tef = fill.transform(train), fill.transform(test)
    gbt = boosted_base("A", ["a", "b", "c"], maxIter=3, maxDepth=3)
    oof, fitted = out_of_fold(trf, "fold", [gbt, LinearBase("line_a", ["a"])], 3)
    assert oof.count() == trf.count()
    meta = fit_stack(oof, [gbt.col, "p_line_a"], "y")
    pred = predict_stack(tef, fitted, meta)
    assert pred.filter(F.col("prediction").isNull()).count() == 0
    assert pred.count() == tef.count()
    models = {"gbt": gbt.col, "line": "p_line_a", "stack": "prediction"}
    m = {r.model: r.rmse for r in regression_metrics(to_long(pred, flows.KEYS, models, "mean")).filter("season IS NULL").collect()}
    assert m["stack"] <= max(m["gbt"], m["line"])
    per = fit_per_season(trf, tef.filter("season <> 'winter'"), gbt)
    assert per.count() == tef.filter("season <> 'winter'").count()
    # a season without training rows gets NULL predictions, not an error
    per2 = fit_per_season(trf.filter("season <> 'summer'"), tef, gbt)
    assert per2.filter("season = 'summer'").filter(F.col(gbt.col).isNotNull()).count() == 0


def test_gbt_refit_is_repeatable(spark):
    obs = flows.prepared(spark, SF_SMALL)
    train, test = flows.train_test(obs)
    from soilcast.operators.impute import fit_mean

    fill = fit_mean(train, ["a", "b", "c"])
    trf, tef = fill.transform(train), fill.transform(test)
    gbt = boosted_base("B", ["a", "b", "c"], maxIter=3)
    p1 = gbt.fit_one(trf).transform(tef).select("k1", "k2", gbt.col).orderBy("k1", "k2").collect()
    p2 = gbt.fit_one(trf).transform(tef).select("k1", "k2", gbt.col).orderBy("k1", "k2").collect()
    assert p1 == p2


def test_metrics_constant_target_and_gap(spark):
    df = spark.createDataFrame([("m", "x", "s", 1.0, 1.5), ("m", "x", "s", 1.0, 0.5)], "scenario string, model string, season string, y double, prediction double")
    rows = regression_metrics(df).collect()
    assert all(r.r2 is None and r.rmse == 0.5 for r in rows) and len(rows) == 2
    g = temperature_gap(spark.createDataFrame([("s", 1.0, 2.0, 4.0)], "season string, t double, f double, g double"), ["t", "f", "g"]).collect()
    assert {(r.measure_1, r.measure_2): r.mean_gap for r in g} == {("t", "f"): -1.0, ("t", "g"): -3.0, ("f", "g"): -2.0}


def test_sink_round_trip(spark, stack):
    _, _, _, pred = stack
    long = to_long(pred, flows.KEYS, flows.LINEAR_MODELS, "mean")
    path = f"{shared_dir(spark)}/test-sink"
    write_results(long, path)
    back = spark.read.parquet(path)
    assert sorted(back.columns) == sorted(long.columns)
    assert back.exceptAll(long.select(*back.columns)).count() == 0 and back.count() == long.count()


@pytest.mark.parametrize("intercept", [False, True])
def test_least_squares_meta_equals_linear_regression(spark, intercept):
    from pyspark.ml.regression import LinearRegression

    from soilcast.operators.stack import LeastSquares, stack_weights

    rows = [(float(i % 7), float((i * 3) % 11), 1.0 + 0.5 * (i % 7) + 2.0 * ((i * 3) % 11) + (i % 5) * 0.1) for i in range(200)]
    df = spark.createDataFrame(rows, "p1 double, p2 double, y double")
    ours = dict(stack_weights(fit_stack(df, ["p1", "p2"], "y", meta=LeastSquares(intercept)), ["p1", "p2"]))
    lr = LinearRegression(fitIntercept=intercept, regParam=0.0, solver="normal", standardization=False)
    ml = dict(stack_weights(fit_stack(df, ["p1", "p2"], "y", meta=lr), ["p1", "p2"]))
    assert ours.keys() == ml.keys()
    for k in ours:
        assert ours[k] == pytest.approx(ml[k], rel=1e-8, abs=1e-9)


@pytest.mark.parametrize("how", ["cache", "table"])
def test_materialize_modes_give_same_leaderboard(spark, how):
    from soilcast.plans.queries import q_leaderboard

    default = sorted(map(tuple, q_leaderboard(spark, SF_SMALL).collect()), key=repr)
    spark.conf.set("soilcast.materialize", how)
    try:
        other = sorted(map(tuple, q_leaderboard(spark, SF_SMALL).collect()), key=repr)
    finally:
        spark.conf.unset("soilcast.materialize")
    assert default == other


def test_fit_parallelism_cap(spark):
    from soilcast.session import fit_parallelism

    assert fit_parallelism(spark, 4) == 1  # one fit at a time unless the session asks for more
    spark.conf.set("soilcast.fit.parallelism", "3")
    assert fit_parallelism(spark, 4) == 3 and fit_parallelism(spark, 2) == 2
    spark.conf.set("soilcast.fit.parallelism", "1")
    try:
        assert fit_parallelism(spark, 4) == 1
        obs = flows.prepared(spark, SF_SMALL)
        train, test = flows.train_test(obs)
        from soilcast.operators.impute import fit_mean

        trf = fit_mean(train, ["a", "b", "c"]).transform(train)
        import threading

        from soilcast.operators.models import MLBase

        running, peak, lock = [0], [0], threading.Lock()

        class Counting(MLBase):
            def fit_one(self, train):
                with lock:
                    running[0] += 1
                    peak[0] = max(peak[0], running[0])
                try:
                    return super().fit_one(train)
                finally:
                    with lock:
                        running[0] -= 1

        def base(name):
            g = boosted_base("A", ["a", "b", "c"], maxIter=2, maxDepth=2)
            return Counting(name, g.estimator, g.features)

        oof, _ = out_of_fold(trf, "fold", [base("g1"), base("g2")], 3)
        assert oof.count() == trf.count()
        assert peak[0] == 1
    finally:
        spark.conf.unset("soilcast.fit.parallelism")


def test_fit_boosted_predicts_every_row(spark):
    from soilcast.operators.impute import fit_mean
    from soilcast.operators.models import fit_boosted

    obs = flows.prepared(spark, SF_SMALL)
    train, test = flows.train_test(obs)
    fill = fit_mean(train, ["a", "b", "c"])
    model = fit_boosted(fill.transform(train), ["a", "b", "c"], "y", "C", maxIter=3)
    out = model.transform(fill.transform(test))
    assert out.filter(F.col("p_gbt_C").isNull()).count() == 0 and out.count() == test.count()
