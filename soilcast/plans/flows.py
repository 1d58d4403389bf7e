"""Flows on the planted observation fixture ``obs`` (see FIXTURES.md)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soilcast.operators.boosting import ALL, CONFIGS, BoostConfig, fit_boosted_together, score
from soilcast.functions.season import SEASONS
from soilcast.operators.features import assign_fold, encode_season, with_split
from soilcast.operators.impute import complete_cases, fit_iterative, fit_mean, keep_missing
from soilcast.operators.models import GroupMeanBase, LinearBase
from soilcast.operators.scoring import leaderboard, on_common_rows, regression_metrics, to_long, treatment_mask
from soilcast.operators.stack import fit_stack, out_of_fold, predict_stack
from soilcast.session import fit_parallelism, materialize, shared_dir
from soilcast.sources.observations import observations

KEYS = ["k1", "k2"]
FEATURES = ["a", "b", "c"]
TRUTH = {"a": "a0", "b": "b0", "c": "c0"}
# Fixed values of the evaluation design (ours): hold out pmod(k1, 5) = 0, 3 folds by pmod(k1, 3).
SPLIT_MOD, SPLIT_HOLD, FOLDS = 5, 0, 3


def prepared(spark: SparkSession, sf_dir: str, persist: bool = True) -> DataFrame:
    """obs + split + fold, materialised (``soilcast.materialize``) because flows run several jobs over it."""
    shared_dir(spark)  # lineage cuts inside pyspark.ml (tree checkpoints) need the shared folder
    obs = assign_fold(with_split(observations(spark, sf_dir), "k1", SPLIT_MOD, SPLIT_HOLD), "k1", FOLDS)
    return materialize(obs, "obs") if persist else obs


def train_test(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    return obs.filter(F.col("split") == "train"), obs.filter(F.col("split") == "test")


def linear_bases():
    return [GroupMeanBase("season_mean", ["season"]), LinearBase("line_a", ["a"])]


def linear_stack(spark: SparkSession, sf_dir: str):
    """Mean-filled scenario, bases 'training-season mean' and 'line on a', linear meta.

    Returns (oof rows, fitted bases, meta model, wide test predictions).
    """
    obs = prepared(spark, sf_dir)
    train, test = train_test(obs)
    fill = fit_mean(train, ["a"])
    trf, tef = fill.transform(train), fill.transform(test)
    bases = linear_bases()
    oof, fitted = out_of_fold(trf, "fold", bases, FOLDS)
    oof = materialize(oof, "oof")
    meta = fit_stack(oof, [b.col for b in bases], "y")
    pred = predict_stack(tef, fitted, meta)
    return oof, fitted, meta, pred


LINEAR_MODELS = {"season_mean": "p_season_mean", "line_a": "p_line_a", "stack": "prediction"}


def linear_stack_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, _, pred = linear_stack(spark, sf_dir)
    return to_long(pred, KEYS, LINEAR_MODELS, "mean")


def linear_leaderboard(spark: SparkSession, sf_dir: str, k: int | None = None) -> DataFrame:
    return leaderboard(regression_metrics(linear_stack_long(spark, sf_dir)), k=k)


# Fixed values of the scenario grid (ours): the gap columns, and the iterative fill's rounds.
GRID_COLS = ["a", "b"]
GRID_ROUNDS = 3


#: The columns that each treatment of the grid needs whole: complete cases are the one that leaves rows out.
GRID_NEEDS = {"mean": [], "mean_by_season": [], "iterative": [], "complete_cases": GRID_COLS}


def scenario_long(spark: SparkSession, sf_dir: str, obs: DataFrame | None = None) -> DataFrame:
    """Long test predictions over treatment × model (linear bases and their stack), with ``_mask``, the treatments that can
    score the row. Every treatment is fitted on training rows only."""
    obs = obs if obs is not None else prepared(spark, sf_dir)
    obs = obs.withColumn("_mask", treatment_mask(GRID_NEEDS))
    train, test = train_test(obs)
    treated = {
        "mean": (fit_mean(train, GRID_COLS),),
        "mean_by_season": (fit_mean(train, GRID_COLS, by=["season"]),),
        "iterative": (fit_iterative(train, GRID_COLS, rounds=GRID_ROUNDS, method="patterns"),),
        "complete_cases": None,
    }

    def run(item):
        scen, fit = item
        if fit is None:
            trf, tef = complete_cases(train, GRID_COLS), complete_cases(test, GRID_COLS)
        else:
            trf, tef = fit[0].transform(train), fit[0].transform(test)
        bases = linear_bases()
        oof, fitted = out_of_fold(trf, "fold", bases, FOLDS)
        meta = fit_stack(oof, [b.col for b in bases], "y")
        return to_long(predict_stack(tef, fitted, meta), [*KEYS, "_mask"], LINEAR_MODELS, scen)

    # Treatments are independent; one limit holds for the whole flow.
    with ThreadPoolExecutor(max_workers=fit_parallelism(spark, len(treated))) as pool:
        return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(spark)(run), treated.items()))


def scenario_grid(spark: SparkSession, sf_dir: str, k: int | None = None, common_rows: bool = False) -> DataFrame:
    """One leaderboard over treatment × model × season.

    ``complete_cases`` scores fewer test rows (those without a gap); the leaderboard carries ``n`` so the difference
    stays visible, and ``common_rows`` scores every treatment on the test rows all of them predict.
    """
    long = scenario_long(spark, sf_dir)
    long = on_common_rows(long, "_mask", len(GRID_NEEDS)) if common_rows else long
    return leaderboard(regression_metrics(long), k=k)


SEASON_FLAGS = ["is_winter", "is_spring", "is_summer", "is_autumn"]
TREATMENTS = ("mean", "unfilled", "iterative", "complete_cases")


def treated(train: DataFrame, test: DataFrame, treatment: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(training rows, test rows, features) under a missing-data treatment fitted on the training rows, with season
    indicators. ``unfilled`` gives the gaps to the learner as they are; ``keep_missing`` marks them (indicator and placeholder, for learners
    that take none); ``complete_cases`` drops rows with a gap."""
    feats = list(FEATURES)
    if treatment == "mean":
        fit = fit_mean(train, FEATURES).transform
    elif treatment == "iterative":
        fit = fit_iterative(train, FEATURES, rounds=GRID_ROUNDS, method="patterns").transform
    elif treatment == "unfilled":
        fit = lambda df: df
    elif treatment == "keep_missing":
        feats += [f"{c}_missing" for c in FEATURES]
        fit = lambda df: keep_missing(df, FEATURES)
    elif treatment == "complete_cases":
        fit = lambda df: complete_cases(df, FEATURES)
    else:
        raise ValueError(f"unknown treatment {treatment!r}")
    return encode_season(fit(train)), encode_season(fit(test)), feats + SEASON_FLAGS


def tree_configs(names=tuple(CONFIGS), **overrides) -> dict[str, BoostConfig]:
    return {n: replace(CONFIGS[n], **overrides) for n in names}


def _column(name: str) -> str:
    return f"p_gbt_{name}"


def hybrid_grid(
    spark: SparkSession, sf_dir: str, configs=tuple(CONFIGS), treatments=TREATMENTS, obs: DataFrame | None = None, meta=None, **overrides
) -> DataFrame:
    """Every tree config and their stacked hybrid under every treatment, in one table of long predictions on the test rows.

    The fits of all treatments, configs and folds grow in the same passes over the rows (treatments × configs × (folds + 1)
    of them); the hybrid's weights come from out-of-fold predictions. ``meta``: least squares, or any
    ``pyspark.ml`` regressor. ``overrides`` replace settings of the configs.
    """
    obs = obs if obs is not None else prepared(spark, sf_dir)
    train, test = train_test(obs)
    scen = {t: treated(train, test, t) for t in treatments}
    chosen = tree_configs(configs, **overrides)
    fits = fit_boosted_together({t: (trf, feats) for t, (trf, _, feats) in scen.items()}, chosen, "y", "fold", FOLDS, KEYS)
    models = {f"gbt_{c}": _column(c) for c in chosen} | {"stack": "prediction"}
    longs = []
    for t, (trf, tef, _) in scen.items():
        held = {_column(c): {f: m for f, m in fits[t, c].items() if f != ALL} for c in chosen}
        oof = score(trf.select("fold", "y", *FEATURES, *SEASON_FLAGS, *_extra(trf)), held, "fold")
        weights = fit_stack(oof, list(held), "y", meta)
        scored = score(tef, {_column(c): {ALL: fits[t, c][ALL]} for c in chosen})
        longs.append(to_long(predict_stack(scored, [], weights), KEYS, models, t))
    return reduce(DataFrame.unionByName, longs)


def _extra(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.endswith("_missing")]


def tree_stack(spark: SparkSession, sf_dir: str, configs=tuple(CONFIGS), treatment: str = "mean", **more) -> DataFrame:
    """The stacked hybrid of boosted trees under one treatment (see ``hybrid_grid``)."""
    return hybrid_grid(spark, sf_dir, configs, (treatment,), **more)


GRID_TREATMENTS = ("mean", "unfilled", "keep_missing", "iterative", "complete_cases")


def tree_grid(spark: SparkSession, sf_dir: str, configs=tuple(CONFIGS), obs: DataFrame | None = None, **overrides) -> DataFrame:
    """Boosted trees, fitted once each, under every treatment, gaps given as they are and by placeholder included. Long test
    predictions, scenario = treatment; all fits grow in the same passes."""
    train, test = train_test(obs if obs is not None else prepared(spark, sf_dir))
    scen = {t: treated(train, test, t) for t in GRID_TREATMENTS}
    chosen = tree_configs(configs, **overrides)
    fits = fit_boosted_together({t: (trf, feats) for t, (trf, _, feats) in scen.items()}, chosen, "y", keys=KEYS)
    models = {f"gbt_{c}": _column(c) for c in chosen}
    longs = [to_long(score(tef, {_column(c): fits[t, c] for c in chosen}), KEYS, models, t) for t, (_, tef, _) in scen.items()]
    return reduce(DataFrame.unionByName, longs)


def boosted(spark: SparkSession, sf_dir: str, configs: dict[str, BoostConfig], treatment: str, features: list[str] | None = None) -> DataFrame:
    """Test rows with ``p_gbt_<config>`` of models fitted on the training rows under one treatment."""
    trf, tef, feats = treated(*train_test(prepared(spark, sf_dir)), treatment)
    fits = fit_boosted_together({treatment: (trf, features or feats)}, configs, "y", keys=KEYS)
    return score(tef, {_column(c): fits[treatment, c] for c in configs})


def boosted_out_of_fold(spark: SparkSession, sf_dir: str, configs: dict[str, BoostConfig], treatment: str, features: list[str]) -> DataFrame:
    """Training rows with the predictions of the fits that left their fold out."""
    trf, _, _ = treated(*train_test(prepared(spark, sf_dir)), treatment)
    fits = fit_boosted_together({treatment: (trf, features)}, configs, "y", "fold", FOLDS, KEYS)
    return score(trf, {_column(c): fits[treatment, c] for c in configs}, "fold")


def boosted_per_season(spark: SparkSession, sf_dir: str, config: str = "A") -> DataFrame:
    """Test rows scored by the trees of their own season (mean-filled features); all seasons grow in the same passes."""
    trf, tef, _ = treated(*train_test(prepared(spark, sf_dir)), "mean")
    groups = {s: (trf.where(F.col("season") == s), FEATURES) for s in SEASONS}
    fits = fit_boosted_together(groups, tree_configs((config,)), "y", keys=KEYS)
    col = _column(config)
    parts = [score(tef.where(F.col("season") == s), {col: fits[s, config]}) for s in SEASONS]
    rest = tef.where(~F.coalesce(F.col("season").isin(*SEASONS), F.lit(False))).withColumn(col, F.lit(None).cast("double"))
    return reduce(DataFrame.unionByName, [*parts, rest])
