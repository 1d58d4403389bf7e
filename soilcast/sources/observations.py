"""Observation tables.

``load_observations`` reads any observation table with an explicit schema and fails early on a
missing or mistyped column. ``plant_observations`` turns the line-item table of the test data into
the observation fixture ``obs`` (gaps, correlated features and a known seasonal target), because
the test data holds no weather.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soilcast.functions.numeric import nan_to_null
from soilcast.functions.season import season_of

LINEITEM_SCHEMA = T.StructType(
    [
        T.StructField("l_orderkey", T.LongType()),
        T.StructField("l_linenumber", T.IntegerType()),
        T.StructField("l_quantity", T.DoubleType()),
        T.StructField("l_discount", T.DoubleType()),
        T.StructField("l_tax", T.DoubleType()),
        T.StructField("l_shipdate", T.TimestampNTZType()),
    ]
)

# Fixed values of the planted fixture: which keys lose a cell, and the seasonal shift of the target.
GAP_RULES = {"a": (7, 3), "b": (11, 5), "c": (13, 4)}  # column: (modulus, remainder) of k1
SEASON_SHIFT = {"summer": 20.0, "winter": -20.0}


def read_checked(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read parquet with ``schema``; fail if a column is absent or has another type.

    The file schema comes from the footer (no data is read). Reading with the explicit schema then
    prunes every other column at the scan.
    """
    found = {f.name: f.dataType for f in spark.read.parquet(path).schema.fields}
    absent = [f.name for f in schema.fields if f.name not in found]
    if absent:
        raise ValueError(f"{path}: missing columns {absent}")
    wrong = [
        f"{f.name}: {found[f.name].simpleString()} != {f.dataType.simpleString()}"
        for f in schema.fields
        if found[f.name] != f.dataType
    ]
    if wrong:
        raise ValueError(f"{path}: wrong types {wrong}")
    return spark.read.schema(schema).parquet(path)


def load_observations(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    keys: list[str],
    ts: str,
    target: str,
    features: list[str],
) -> DataFrame:
    """Observation table with keys, time, target and features only; season is added from ``ts``.

    NaN in the target or a feature becomes NULL, the one missing marker of all operators.
    """
    wanted = [*keys, ts, target, *features]
    unknown = [c for c in wanted if c not in schema.fieldNames()]
    if unknown:
        raise ValueError(f"columns not in schema: {unknown}")
    df = read_checked(spark, path, T.StructType([schema[c] for c in dict.fromkeys(wanted)]))
    floats = [c for c in dict.fromkeys([target, *features]) if isinstance(schema[c].dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(c) for c in floats}).withColumn("season", season_of(ts))


def plant_observations(lineitem: DataFrame) -> DataFrame:
    """The ``obs`` fixture: one row per (l_orderkey, l_linenumber).

    The pair is not unique in the line items, so rows are grouped first (partial aggregation
    before the shuffle; a hot key sends one row per map task).
    """
    g = lineitem.groupBy(
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2")
    ).agg(
        F.min("l_shipdate").alias("ts"),
        F.min("l_quantity").alias("q"),
        F.min("l_discount").alias("d"),
        F.min("l_tax").alias("t"),
    )
    q, d, t = F.col("q"), F.col("d"), F.col("t")
    season = season_of("ts")
    truth = {"a": q, "b": F.lit(2.0) * q + F.lit(100.0) * d, "c": F.lit(100.0) * t + F.lit(0.5) * q}
    shift = F.lit(0.0)
    for name, value in SEASON_SHIFT.items():
        shift = F.when(season == name, F.lit(value)).otherwise(shift)
    cols = [F.col("k1"), F.col("k2"), F.col("ts"), season.alias("season")]
    cols += [truth[c].alias(f"{c}0") for c in truth]
    cols += [
        F.when(F.pmod("k1", F.lit(m)) != r, truth[c]).alias(c) for c, (m, r) in GAP_RULES.items()
    ]
    y = F.lit(1.5) * q + F.lit(50.0) * d + F.lit(30.0) * t + shift
    return g.select(*cols, y.alias("y"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``obs`` from the line items of a test-data folder."""
    return plant_observations(read_checked(spark, f"{sf_dir}/lineitem.parquet", LINEITEM_SCHEMA))
