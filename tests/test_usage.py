"""The README's weather-table example, on a small synthetic table (fewer boosting rounds)."""

import datetime as dt

import numpy as np
from pyspark.sql import types as T

from soilcast.operators import eda
from soilcast.operators.features import assign_fold, split_train_test
from soilcast.operators.impute import fit_iterative
from soilcast.operators.models import boosted_base
from soilcast.operators.scoring import leaderboard, regression_metrics, to_long
from soilcast.operators.stack import fit_stack, out_of_fold, predict_stack
from soilcast.sources import load_observations, write_results

FEATS = ["air", "humidity", "wind", "sun"]


def test_weather_example(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(2000):
        air, hum, wind, sun = rng.normal(15, 8), rng.uniform(20, 90), rng.exponential(3), rng.uniform(0, 10)
        g = 2 + 1.1 * air + 0.3 * sun - 0.05 * hum + rng.normal(0, 1)
        vals = [None if rng.random() < 0.1 else float(v) for v in (air, hum, wind, sun)]
        rows.append((i % 40, dt.datetime(2023, 1 + i % 12, 1 + i % 28, i % 24), float(g), *vals))
    schema = T.StructType(
        [T.StructField("station", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("ground", T.DoubleType())]
        + [T.StructField(c, T.DoubleType()) for c in FEATS]
    )
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "obs"))
    obs = load_observations(spark, str(tmp_path / "obs"), schema, keys=["station", "ts"], ts="ts", target="ground", features=FEATS)
    assert eda.missing_profile(obs, FEATS).count() == 4 * 4
    train, test = split_train_test(assign_fold(obs, "station", k=3), "station")
    fill = fit_iterative(train, FEATS, rounds=5)
    trf, tef = fill.transform(train), fill.transform(test)
    bases = [boosted_base(c, FEATS, y="ground", maxIter=5) for c in "ABC"]
    oof, fitted = out_of_fold(trf, "fold", bases, k=3)
    meta = fit_stack(oof, [b.col for b in bases], y="ground")
    pred = predict_stack(tef, fitted, meta)
    models = {b.name: b.col for b in bases} | {"stack": "prediction"}
    long = to_long(pred, ["station", "ts"], models, "iterative", y="ground")
    write_results(long, str(tmp_path / "pred"))
    assert spark.read.parquet(str(tmp_path / "pred")).count() == test.count() * 4
    lb = {r.model: r.rmse for r in leaderboard(regression_metrics(long, y="ground")).filter("season IS NULL").collect()}
    assert lb["stack"] <= max(v for k, v in lb.items() if k != "stack")
