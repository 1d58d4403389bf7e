"""The whole analysis in one run: EDA, treatments, models, stack, rankings, written as parquet.

    python -m soilcast.plans.report <sf_dir> <out_dir> [--no-trees]

``out_dir`` must be a folder every executor can write (shared storage on a cluster). One
sub-folder per result table; predictions are partitioned by scenario.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from soilcast.operators import eda
from soilcast.operators.impute import fit_iterative, fit_mean, imputation_error
from soilcast.operators.scoring import leaderboard, on_common_rows, regression_metrics, temperature_gap
from soilcast.plans import flows
from soilcast.session import materialize
from soilcast.sources.sinks import write_results

EDA_COLS = ["a", "b", "c", "y"]
PROBS = [0.1, 0.25, 0.5, 0.75, 0.9]


def report_tables(spark: SparkSession, sf_dir: str, trees: bool = True) -> dict[str, DataFrame]:
    obs = flows.prepared(spark, sf_dir)
    train, _ = flows.train_test(obs)
    linear = materialize(flows.scenario_long(spark, sf_dir, obs), "report_linear")
    common = on_common_rows(linear, "_mask", len(flows.GRID_NEEDS))
    tables = {
        "missing_profile": eda.missing_profile(obs, flows.FEATURES),
        "numeric_summary": eda.numeric_summary(obs, EDA_COLS),
        "quantiles": eda.quantile_summary(obs, EDA_COLS, PROBS),
        "histogram_y": eda.histogram(obs, "y", 5.0),
        "correlations": eda.correlations(obs, EDA_COLS),
        "temperature_gap": temperature_gap(obs, [flows.TRUTH[c] for c in flows.FEATURES]),
        "imputation_error": imputation_error(
            obs,
            flows.FEATURES,
            flows.TRUTH,
            {
                "mean": fit_mean(train, flows.FEATURES),
                "mean_by_season": fit_mean(train, flows.FEATURES, by=["season"]),
                "iterative": fit_iterative(train, flows.FEATURES),
            },
        ),
        "leaderboard_linear": leaderboard(regression_metrics(linear)),
        "leaderboard_linear_common_rows": leaderboard(regression_metrics(common)),
    }
    if trees:
        hybrid = materialize(flows.hybrid_grid(spark, sf_dir, obs=obs), "report_hybrid")
        tables["predictions_hybrid"] = hybrid
        tables["leaderboard_hybrid"] = leaderboard(regression_metrics(hybrid))
        tables["leaderboard_tree_treatments"] = leaderboard(regression_metrics(flows.tree_grid(spark, sf_dir, obs=obs)))
    return tables


def run_report(spark: SparkSession, sf_dir: str, out_dir: str, trees: bool = True) -> dict[str, str]:
    paths = {}
    for name, df in report_tables(spark, sf_dir, trees).items():
        path = f"{out_dir.rstrip('/')}/{name}"
        write_results(df, path, partition_by=["scenario"] if name.startswith("predictions") else [])
        paths[name] = path
    return paths


def main() -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("sf_dir")
    ap.add_argument("out_dir")
    ap.add_argument("--no-trees", action="store_true")
    args = ap.parse_args()
    spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    for name, path in run_report(spark, args.sf_dir, args.out_dir, trees=not args.no_trees).items():
        print(name, path)


if __name__ == "__main__":
    main()
