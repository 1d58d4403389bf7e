from soilcast.plans.report import run_report
from soilcast.session import shared_dir

from .conftest import SF_SMALL


def test_report_writes_every_table(spark):
    out = f"{shared_dir(spark)}/report"
    paths = run_report(spark, SF_SMALL, out, trees=False)
    assert {"missing_profile", "quantiles", "imputation_error", "leaderboard_linear"} <= set(paths)
    for name, path in paths.items():
        assert spark.read.parquet(path).count() > 0, name
    lb = spark.read.parquet(paths["leaderboard_linear"])
    assert lb.filter("season IS NULL").count() == 4 * 3
