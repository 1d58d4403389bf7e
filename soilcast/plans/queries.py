"""

Doubles are rounded exactly as in the SQL oracles (6 decimals; 4 for values that come out of
fitted coefficients, whose last digits depend on the solver).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soilcast.operators import eda
from soilcast.operators.encoding import ordered_target_encoding
from soilcast.operators.features import (
    assemble_features,
    assign_fold,
    assign_season,
    encode_season,
    select_season,
    split_train_test,
)
from soilcast.operators.impute import (
    complete_cases,
    fit_iterative,
    fit_mean,
    imputation_error,
    keep_missing,
    normalise_missing,
)
from soilcast.operators.boosting import BoostConfig
from soilcast.operators.models import LinearBase
from soilcast.operators.scoring import gap_columns, leaderboard, regression_metrics, temperature_gap, to_long
from soilcast.operators.stack import StackModel, fit_per_season, fit_stack, out_of_fold, stack_weights
from soilcast.operators.store import load, save
from soilcast.plans import flows
from soilcast.plans.flows import TRUTH, prepared, train_test
from soilcast.session import shared_dir
from soilcast.sources.observations import LINEITEM_SCHEMA, load_observations, read_checked
from soilcast.sources.sinks import commit_results, read_results, write_results

Query = Callable[[SparkSession, str], DataFrame]
PROBS = [0.1, 0.25, 0.5, 0.75, 0.9]
EDA_COLS = ["a", "b", "c", "y"]


def rounded(df: DataFrame, digits: int = 6, only: list[str] | None = None) -> DataFrame:
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    if only is not None:
        cols = [c for c in cols if c in only]
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _obs(spark, sf):
    return prepared(spark, sf, persist=False)


# -- sources, projections, filters -------------------------------------------------------------


def q_load_observations(spark, sf):
    """The operator itself on the line items: keys, time, target and features, NaN to NULL, season."""
    keys, features = ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"]
    return load_observations(spark, f"{sf}/lineitem.parquet", LINEITEM_SCHEMA, keys, "l_shipdate", "l_quantity", features)


def q_observations(spark, sf):
    return rounded(_obs(spark, sf).drop("split", "fold"))


def q_write_results(spark, sf):
    pred = rounded(flows.linear_stack_long(spark, sf), 4, ["y", "prediction"])
    path = f"{shared_dir(spark)}/results/predictions-{uuid.uuid4().hex}"
    write_results(pred, path)
    return spark.read.parquet(path)


def q_commit_results(spark, sf):
    """Two scenarios committed, one of them again with other rows, and read back."""
    obs = _obs(spark, sf)
    path = f"{shared_dir(spark)}/results/committed-{uuid.uuid4().hex}"
    rows = [rounded(obs.select("k1", "k2", F.lit(s).alias("scenario"), F.col(c).alias("value"))) for s, c in (("first", "a0"), ("second", "b0"))]
    commit_results(rows[0].unionByName(rows[1]), path)
    commit_results(rounded(obs.select("k1", "k2", F.lit("second").alias("scenario"), F.col("c0").alias("value"))), path)
    return read_results(spark, path, rows[0].schema)


def q_assign_season(spark, sf):
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderdate", T.TimestampNTZType())])
    orders = read_checked(spark, f"{sf}/orders.parquet", schema)
    return assign_season(orders, "o_orderdate")


def q_select_season(spark, sf):
    obs = _obs(spark, sf)
    return rounded(select_season(obs, ["summer", "winter"]).select("k1", "k2", "season", "y"))


def q_normalise_missing(spark, sf):
    # The fixture has no NaN; a quantity of 1.0 is declared a sentinel to exercise the rule.
    obs = normalise_missing(_obs(spark, sf), ["a", "b", "c"], sentinels=[1.0])
    return rounded(obs.select("k1", "k2", "a", "b", "c"))


# -- EDA -----------------------------------------------------------------------------------------


def q_missing_profile(spark, sf):
    return rounded(eda.missing_profile(_obs(spark, sf), ["a", "b", "c"], by=["season"]))


def q_numeric_summary(spark, sf):
    return rounded(eda.numeric_summary(_obs(spark, sf), EDA_COLS, by=["season"]))


def q_quantile_summary(spark, sf):
    return rounded(eda.quantile_summary(_obs(spark, sf), EDA_COLS, PROBS, by=["season"]))


def q_quantile_summary_approx(spark, sf):
    return rounded(eda.quantile_summary(_obs(spark, sf), EDA_COLS, PROBS, by=["season"], accuracy=10000))


def q_quantile_approx_ranks(spark, sf):
    """Whether each approximate quantile stands where it should: within n / accuracy ranks of its share."""
    obs, accuracy = _obs(spark, sf), 1000
    approx = eda.quantile_summary(obs, EDA_COLS, PROBS, by=["season"], accuracy=accuracy)
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in EDA_COLS]))
    long = obs.select("season", cells).where("v IS NOT NULL").groupBy("season", "column", "v").agg(F.count(F.lit(1)).alias("cnt"))
    seen = approx.join(long, ["season", "column"]).groupBy("season", "column", "prob").agg(
        F.sum("cnt").alias("n"),
        F.sum(F.when(F.col("v") < F.col("quantile"), F.col("cnt")).otherwise(0)).alias("less"),
        F.sum(F.when(F.col("v") <= F.col("quantile"), F.col("cnt")).otherwise(0)).alias("upto"),
    )
    off = F.col("n") / accuracy + 1
    good = (F.col("less") <= F.col("prob") * F.col("n") + off) & (F.col("upto") >= F.col("prob") * F.col("n") - off)
    return seen.select("season", "column", "prob", good.alias("within"))


def q_loaded_stack(spark, sf):
    """The linear stack saved, loaded and applied to test rows: what another session would predict."""
    train, test = train_test(prepared(spark, sf))
    fill = fit_mean(train, ["a"])
    oof, fitted = out_of_fold(fill.transform(train), "fold", flows.linear_bases(), flows.FOLDS)
    model = StackModel(fitted, fit_stack(oof, [f.base.col for f in fitted], "y"))
    path = f"{shared_dir(spark)}/results/stack-{uuid.uuid4().hex}"
    save(spark, fill, f"{path}/fill")
    save(spark, model, f"{path}/stack")
    pred = load(spark, f"{path}/stack").transform(load(spark, f"{path}/fill").transform(test))
    return rounded(to_long(pred, flows.KEYS, flows.LINEAR_MODELS, "mean"), 4, ["y", "prediction"])


def q_histogram(spark, sf):
    return rounded(eda.histogram(_obs(spark, sf), "y", 5.0, by=["season"]))


def q_correlations(spark, sf):
    return rounded(eda.correlations(_obs(spark, sf), EDA_COLS, by=["season"]))


# -- treatments ----------------------------------------------------------------------------------


def q_impute_mean(spark, sf):
    obs = prepared(spark, sf)
    train, _ = train_test(obs)
    return rounded(fit_mean(train, ["a", "b", "c"]).transform(obs).select("k1", "k2", "a", "b", "c"))


def q_impute_mean_by_season(spark, sf):
    obs = prepared(spark, sf)
    train, _ = train_test(obs)
    fill = fit_mean(train, ["a", "b", "c"], by=["season"])
    return rounded(fill.transform(obs).select("k1", "k2", "season", "a", "b", "c"))


def q_keep_missing(spark, sf):
    cols = ["a", "b", "c"]
    return rounded(keep_missing(_obs(spark, sf), cols).select("k1", "k2", *cols, *[f"{c}_missing" for c in cols]))


def q_complete_cases(spark, sf):
    return rounded(complete_cases(_obs(spark, sf), ["a", "b", "c"]).select("k1", "k2", "a", "b", "c"))


def q_impute_iterative(spark, sf):
    obs = prepared(spark, sf)
    train, _ = train_test(obs)
    fill = fit_iterative(train, ["a", "b"], rounds=3, method="patterns")
    return rounded(fill.transform(obs).select("k1", "k2", "a", "b"), 4)


def q_iterative_coefficients(spark, sf):
    obs = prepared(spark, sf)
    train, _ = train_test(obs)
    fill = fit_iterative(train, ["a", "b"], rounds=3, method="patterns")
    schema = "round int, column string, term string, value double"
    return rounded(spark.createDataFrame(fill.coefficients(), schema), 4)


def q_impute_iterative_abc(spark, sf):
    """Three columns by the default method."""
    obs = prepared(spark, sf)
    train, _ = train_test(obs)
    fill = fit_iterative(train, ["a", "b", "c"], rounds=3)
    return rounded(fill.transform(obs).select("k1", "k2", "a", "b", "c"), 4)


def q_iterative_coefficients_abc(spark, sf):
    obs = prepared(spark, sf)
    train, _ = train_test(obs)
    fill = fit_iterative(train, ["a", "b", "c"], rounds=3)
    schema = "round int, column string, term string, value double"
    return rounded(spark.createDataFrame(fill.coefficients(), schema), 4)


def q_imputation_error(spark, sf):
    obs = prepared(spark, sf)
    train, _ = train_test(obs)
    cols = ["a", "b"]
    fills = {
        "mean": fit_mean(train, cols),
        "mean_by_season": fit_mean(train, cols, by=["season"]),
        "iterative": fit_iterative(train, cols, rounds=3, method="patterns"),
    }
    return rounded(imputation_error(obs, cols, TRUTH, fills), 4)


def q_imputation_error_all(spark, sf):
    """All three gap columns."""
    obs = prepared(spark, sf)
    train, _ = train_test(obs)
    cols = ["a", "b", "c"]
    fills = {
        "mean": fit_mean(train, cols),
        "mean_by_season": fit_mean(train, cols, by=["season"]),
        "iterative": fit_iterative(train, cols, rounds=5),
    }
    return rounded(imputation_error(obs, cols, TRUTH, fills), 4)


# -- features and splits -------------------------------------------------------------------------


def q_encode_season(spark, sf):
    out = encode_season(_obs(spark, sf))
    return out.select("k1", "k2", "season", "is_winter", "is_spring", "is_summer", "is_autumn")


def q_season_target_encoding(spark, sf):
    """Training rows with the season's mean target over the rows before in hash order, test rows with that over all training rows."""
    train, test = train_test(prepared(spark, sf))
    encoded, fit = ordered_target_encoding(train, "season", "y", flows.KEYS)
    cols = ["k1", "k2", "season", "split", "season_target"]
    return rounded(encoded.select(*cols).unionByName(fit.transform(test).select(*cols)))


def q_assemble_features(spark, sf):
    obs = prepared(spark, sf)
    train, _ = train_test(obs)
    filled = encode_season(fit_mean(train, ["a", "b", "c"]).transform(obs))
    cols = ["a", "b", "c", "is_winter", "is_spring", "is_summer", "is_autumn"]
    x = vector_to_array("x")
    return rounded(assemble_features(filled, cols, "x").select("k1", "k2", *[x[i].alias(f"x{i}") for i in range(len(cols))]))


def q_split_train_test(spark, sf):
    train, test = split_train_test(_obs(spark, sf).drop("split"), "k1", flows.SPLIT_MOD, flows.SPLIT_HOLD)
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return both.select("k1", "k2", "split")


def q_assign_fold(spark, sf):
    return assign_fold(_obs(spark, sf).drop("fold"), "k1", flows.FOLDS).select("k1", "k2", "fold")


# -- models ----------------------------------------------------------------------------------------

def _boosted(config):
    def q(spark, sf):
        pred = flows.boosted(spark, sf, flows.tree_configs((config,)), "mean")
        return pred.select("k1", "k2", "season", "y", F.col(f"p_gbt_{config}").alias("prediction"))

    return q


# Fixed values (ours): two trees of one split each on the finest grid, which SQL can follow.
STUMPS = BoostConfig(rounds=2, depth=1, step=0.5, bins=256)


def q_boosted_unfilled(spark, sf):
    """Stumps on features with gaps: missing values go to the better side of each split."""
    pred = flows.boosted(spark, sf, {"stumps": STUMPS}, "unfilled", flows.FEATURES)
    return rounded(pred.select("k1", "k2", "y", F.col("p_gbt_stumps").alias("prediction")), 4)


def q_boosted_out_of_fold(spark, sf):
    """Out-of-fold predictions of stumps on mean-filled features, the fits of all folds grown together."""
    oof = flows.boosted_out_of_fold(spark, sf, {"stumps": STUMPS}, "mean", flows.FEATURES)
    return rounded(oof.select("k1", "k2", "fold", "y", F.col("p_gbt_stumps").alias("prediction")), 4)


def q_per_season(spark, sf):
    return flows.boosted_per_season(spark, sf).select("k1", "k2", "season", "y", F.col("p_gbt_A").alias("prediction"))


def q_per_season_line(spark, sf):
    obs = prepared(spark, sf)
    train, test = train_test(obs)
    fill = fit_mean(train, ["a"])
    pred = fit_per_season(fill.transform(train), fill.transform(test), LinearBase("line_a", ["a"]))
    return rounded(pred.select("k1", "k2", "season", "y", "p_line_a"), 4)


def q_linear_abc(spark, sf):
    """Least-squares line on all three (mean-filled) features, fitted on training rows, test scored."""
    obs = prepared(spark, sf)
    train, test = train_test(obs)
    fill = fit_mean(train, flows.FEATURES)
    base = LinearBase("line_abc", flows.FEATURES)
    pred = base.fit(fill.transform(train), "fold", flows.FOLDS).predict(fill.transform(test))
    return rounded(pred.select("k1", "k2", "season", "y", base.col), 4)


def q_out_of_fold(spark, sf):
    oof, _, _, _ = flows.linear_stack(spark, sf)
    return rounded(oof.select("k1", "k2", "season", "fold", "y", "p_season_mean", "p_line_a"), 4)


def q_fit_stack(spark, sf):
    _, _, meta, _ = flows.linear_stack(spark, sf)
    rows = stack_weights(meta, ["p_season_mean", "p_line_a"])
    return rounded(spark.createDataFrame(rows, "base string, weight double"))


def q_predict_stack(spark, sf):
    return rounded(flows.linear_stack_long(spark, sf), 4, ["y", "prediction"])


def q_regression_metrics(spark, sf):
    return rounded(regression_metrics(flows.linear_stack_long(spark, sf)))


def q_leaderboard(spark, sf):
    lb = leaderboard(regression_metrics(flows.linear_stack_long(spark, sf)))
    return rounded(lb.withColumn("rk", F.col("rk").cast("long")))


def q_scenario_grid(spark, sf):
    lb = flows.scenario_grid(spark, sf)
    return rounded(lb.withColumn("rk", F.col("rk").cast("long")))


def q_scenario_grid_common(spark, sf):
    lb = flows.scenario_grid(spark, sf, common_rows=True)
    return rounded(lb.withColumn("rk", F.col("rk").cast("long")))


def q_best_models(spark, sf):
    """Top-1 report: the best treatment and model per season group (ties all kept)."""
    lb = flows.scenario_grid(spark, sf, k=1)
    return rounded(lb.withColumn("rk", F.col("rk").cast("long")))


def q_tree_stack(spark, sf):
    lb = leaderboard(regression_metrics(flows.tree_stack(spark, sf)))
    return rounded(lb.withColumn("rk", F.col("rk").cast("long")))


def q_hybrid_grid(spark, sf):
    """Tree configs and their stacked hybrid under every treatment, ranked (48 fits, grown together)."""
    lb = leaderboard(regression_metrics(flows.hybrid_grid(spark, sf)))
    return rounded(lb.withColumn("rk", F.col("rk").cast("long")))


def q_tree_grid(spark, sf):
    lb = leaderboard(regression_metrics(flows.tree_grid(spark, sf)))
    return rounded(lb.withColumn("rk", F.col("rk").cast("long")))


def q_temperature_gap_rows(spark, sf):
    gaps = gap_columns(_obs(spark, sf), ["a0", "b0", "c0"])
    return rounded(gaps.select("k1", "k2", "season", "gap_a0_b0", "gap_a0_c0", "gap_b0_c0"))


def q_temperature_gap(spark, sf):
    return rounded(temperature_gap(_obs(spark, sf), ["a0", "b0", "c0"], by=["season"]))


def queries() -> dict[str, Query]:
    return {
        "load_observations": q_load_observations,
        "observations": q_observations,
        "write_results": q_write_results,
        "commit_results": q_commit_results,
        "assign_season": q_assign_season,
        "select_season": q_select_season,
        "normalise_missing": q_normalise_missing,
        "missing_profile": q_missing_profile,
        "numeric_summary": q_numeric_summary,
        "quantile_summary": q_quantile_summary,
        "quantile_summary_approx": q_quantile_summary_approx,
        "quantile_approx_ranks": q_quantile_approx_ranks,
        "histogram": q_histogram,
        "correlations": q_correlations,
        "impute_mean": q_impute_mean,
        "impute_mean_by_season": q_impute_mean_by_season,
        "keep_missing": q_keep_missing,
        "complete_cases": q_complete_cases,
        "impute_iterative": q_impute_iterative,
        "impute_iterative_abc": q_impute_iterative_abc,
        "iterative_coefficients": q_iterative_coefficients,
        "iterative_coefficients_abc": q_iterative_coefficients_abc,
        "imputation_error": q_imputation_error,
        "imputation_error_all": q_imputation_error_all,
        "encode_season": q_encode_season,
        "season_target_encoding": q_season_target_encoding,
        "assemble_features": q_assemble_features,
        "split_train_test": q_split_train_test,
        "assign_fold": q_assign_fold,
        "boosted_a": _boosted("A"),
        "boosted_b": _boosted("B"),
        "boosted_c": _boosted("C"),
        "boosted_unfilled": q_boosted_unfilled,
        "boosted_out_of_fold": q_boosted_out_of_fold,
        "per_season": q_per_season,
        "per_season_line": q_per_season_line,
        "linear_abc": q_linear_abc,
        "out_of_fold": q_out_of_fold,
        "fit_stack": q_fit_stack,
        "predict_stack": q_predict_stack,
        "loaded_stack": q_loaded_stack,
        "regression_metrics": q_regression_metrics,
        "leaderboard": q_leaderboard,
        "temperature_gap": q_temperature_gap,
        "temperature_gap_rows": q_temperature_gap_rows,
        "scenario_grid": q_scenario_grid,
        "scenario_grid_common": q_scenario_grid_common,
        "best_models": q_best_models,
        "tree_stack": q_tree_stack,
        "tree_grid": q_tree_grid,
        "hybrid_grid": q_hybrid_grid,
    }
