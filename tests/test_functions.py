import datetime as dt
import math

from pyspark.sql import functions as F

from soilcast.functions import safe_div, season_of
from soilcast.operators.impute import normalise_missing


def test_season_mapping(spark):
    rows = [(m, dt.datetime(2020, m, 15)) for m in range(1, 13)] + [(0, None)]
    df = spark.createDataFrame(rows, "m int, ts timestamp_ntz")
    got = {r.m: r.season for r in df.select("m", season_of("ts").alias("season")).collect()}
    assert got[12] == got[1] == got[2] == "winter"
    assert got[3] == got[4] == got[5] == "spring"
    assert got[6] == got[7] == got[8] == "summer"
    assert got[9] == got[10] == got[11] == "autumn"
    assert got[0] is None


def test_safe_div_zero_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0)], "a double, b double")
    assert [r.q for r in df.select(safe_div(F.col("a"), F.col("b")).alias("q")).collect()] == [None, 0.5]


def test_normalise_nan_next_to_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, -999.0), (4, 5.0)], "id int, x double")
    got = {r.id: r.x for r in normalise_missing(df, ["x"], sentinels=[-999.0]).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 5.0}
    kept = {r.id: r.x for r in normalise_missing(df, ["x"]).collect()}
    assert kept[3] == -999.0 and kept[1] is None and not (isinstance(kept[1], float) and math.isnan(kept[1]))


def test_assign_and_select_season(spark):
    from soilcast.operators.features import assign_season, select_season

    df = spark.createDataFrame([(1, dt.datetime(2020, 1, 5)), (2, dt.datetime(2020, 7, 5)), (3, None)], "id int, d timestamp_ntz")
    out = assign_season(df, "d")
    assert {r.id: r.season for r in out.collect()} == {1: "winter", 2: "summer", 3: None}
    assert [r.id for r in select_season(out, "summer").collect()] == [2]
    assert sorted(r.id for r in select_season(out, ["summer", "winter"]).collect()) == [1, 2]
