import pytest
from pyspark.sql import functions as F

from soilcast.operators.impute import fit_iterative, fit_mean
from soilcast.operators.models import GroupMeanBase, LinearBase, boosted, boosted_base
from soilcast.operators.stack import Stack, fit_per_season, fit_seasons
from soilcast.operators.store import load, save
from soilcast.plans import flows


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i % 3, ("s", "w")[i % 2], float(i % 17) if i % 5 else None, float(i % 7), float(i % 17) + 2.0 * (i % 7)) for i in range(240)]
    return spark.createDataFrame(data, "fold int, season string, a double, b double, y double").cache()


def same(x, y):
    cols = x.columns
    assert y.columns == cols
    a, b = (sorted(map(tuple, d.collect()), key=str) for d in (x, y))
    assert a == b


def test_fills_round_trip(spark, rows, tmp_path):
    for i, fit in enumerate([fit_mean(rows, ["a", "b"]), fit_mean(rows, ["a"], by=["season"]), fit_iterative(rows, ["a", "b"], rounds=2)]):
        save(spark, fit, str(tmp_path / f"f{i}"))
        same(fit.transform(rows), load(spark, str(tmp_path / f"f{i}")).transform(rows))


def test_stack_per_season_round_trip(spark, rows, tmp_path):
    full = fit_mean(rows, ["a"]).transform(rows)
    bases = [boosted_base("A", ["a", "b"], maxIter=2), LinearBase("line", ["a"]), GroupMeanBase("mean", ["season"])]
    stack = Stack(bases, "fold", 3)
    fit = fit_seasons(full, stack, levels=("s", "w"))
    save(spark, fit, str(tmp_path / "seasons"))
    again = load(spark, str(tmp_path / "seasons"))
    assert set(again.models) == {"s", "w"}
    other = full.unionByName(full.limit(2).withColumn("season", F.lit(None).cast("string")))
    scored = again.transform(other)
    same(fit.transform(other), scored)
    assert scored.count() == 242 and scored.where("season IS NULL AND prediction IS NOT NULL").count() == 0
    assert fit_per_season(full, other, stack, levels=("s",)).where("season = 'w' AND prediction IS NOT NULL").count() == 0
    with pytest.raises(TypeError):
        save(spark, object(), str(tmp_path / "x"))


def test_boosted_meta_learner(spark, rows, tmp_path):
    full = fit_mean(rows, ["a"]).transform(rows)
    bases = [boosted_base("A", ["a", "b"], maxIter=2), boosted_base("B", ["a", "b"], maxIter=2)]
    fit = Stack(bases, "fold", 3, meta=boosted("C", maxIter=2, minInstancesPerNode=2)).fit_one(full)
    save(spark, fit, str(tmp_path / "meta"))
    same(fit.transform(full), load(spark, str(tmp_path / "meta")).transform(full))


def test_registered_hybrid_uses_the_whole_configs(spark, monkeypatch):
    from soilcast.plans import queries

    seen = []

    def grid(spark, sf, **overrides):
        seen.append(overrides)
        return spark.createDataFrame([("mean", "stack", "s", 1.0, 2.0)], "scenario string, model string, season string, y double, prediction double")

    monkeypatch.setattr(flows, "hybrid_grid", grid)
    queries.q_hybrid_grid(spark, "")
    assert seen == [{}]
