import datetime as dt

import pytest
from pyspark.sql import types as T

from soilcast.sources.observations import load_observations, read_checked

SCHEMA = T.StructType(
    [
        T.StructField("station", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("air", T.DoubleType()),
        T.StructField("ground", T.DoubleType()),
    ]
)


@pytest.fixture(scope="module")
def weather_path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("wx") / "obs.parquet")
    rows = [(1, dt.datetime(2023, 7, 1, 12), 25.0, 31.5), (1, dt.datetime(2023, 1, 3, 6), -3.0, None), (2, dt.datetime(2023, 4, 9), 12.0, 14.0)]
    spark.createDataFrame(
        [(*r, "x") for r in rows], "station bigint, ts timestamp_ntz, air double, ground double, extra string"
    ).write.parquet(path)
    return path


def test_load_observations_prunes_and_adds_season(spark, weather_path):
    df = load_observations(spark, weather_path, SCHEMA, keys=["station", "ts"], ts="ts", target="ground", features=["air"])
    assert df.columns == ["station", "ts", "ground", "air", "season"]
    assert sorted(r.season for r in df.collect()) == ["spring", "summer", "winter"]


def test_missing_column_fails(spark, weather_path):
    bad = T.StructType([*SCHEMA.fields, T.StructField("humidity", T.DoubleType())])
    with pytest.raises(ValueError, match="missing columns"):
        read_checked(spark, weather_path, bad)


def test_wrong_type_fails(spark, weather_path):
    bad = T.StructType([T.StructField("air", T.StringType())])
    with pytest.raises(ValueError, match="wrong types"):
        read_checked(spark, weather_path, bad)


def test_unknown_feature_fails(spark, weather_path):
    with pytest.raises(ValueError, match="not in schema"):
        load_observations(spark, weather_path, SCHEMA, keys=["station"], ts="ts", target="ground", features=["wind"])
