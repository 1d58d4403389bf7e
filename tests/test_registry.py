
import __spark_entry__ as E

SURVEY_NAMES = """
load_observations write_results assign_season select_season normalise_missing missing_profile
numeric_summary quantile_summary histogram correlations impute_mean impute_mean_by_season keep_missing
complete_cases impute_iterative imputation_error encode_season assemble_features split_train_test
assign_fold boosted_a boosted_b boosted_c per_season out_of_fold fit_stack predict_stack
regression_metrics leaderboard temperature_gap
""".split()


def test_survey_names_registered():
    assert set(SURVEY_NAMES) <= set(E.queries())


def test_oracles_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert all(isinstance(v, str) and v.strip() for v in E.oracle_sql().values())
