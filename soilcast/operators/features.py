"""Feature preparation and repeatable splits (all narrow projections, no shuffle)."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soilcast.functions.season import METEO, SEASONS, season_of

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _bucket(df: DataFrame, key: str, mod: int) -> Column:
    """pmod of an integral key (engine-neutral), or of its xxhash64 for other key types."""
    k = F.col(key)
    if not isinstance(df.schema[key].dataType, _INTEGRAL):
        k = F.xxhash64(k)
    return F.pmod(k, F.lit(mod)).cast("int")


def assign_season(df: DataFrame, ts: str, mapping=METEO, out: str = "season") -> DataFrame:
    """Adds the season label of ``ts`` (NULL for a NULL date or an unmapped month)."""
    return df.withColumn(out, season_of(ts, mapping))


def select_season(df: DataFrame, seasons, season: str = "season") -> DataFrame:
    """Rows of one or more seasons (a filter Catalyst can push below projections)."""
    seasons = [seasons] if isinstance(seasons, str) else list(seasons)
    return df.filter(F.col(season).isin(*seasons))


def with_split(df: DataFrame, key: str, mod: int = 5, hold: int = 0, out: str = "split") -> DataFrame:
    """Adds ``split`` = 'test' where pmod(key, mod) = hold, else 'train'."""
    return df.withColumn(out, F.when(_bucket(df, key, mod) == hold, "test").otherwise("train"))


def split_train_test(df: DataFrame, key: str, mod: int = 5, hold: int = 0) -> tuple[DataFrame, DataFrame]:
    """(training rows, held-out rows) by the rule of ``with_split``; a NULL key is a training row."""
    held = F.coalesce(_bucket(df, key, mod) == hold, F.lit(False))
    return df.filter(~held), df.filter(held)


def assign_fold(df: DataFrame, key: str, k: int = 3, out: str = "fold") -> DataFrame:
    return df.withColumn(out, _bucket(df, key, k))


def encode_season(df: DataFrame, season: str = "season", levels=SEASONS, prefix: str = "is_") -> DataFrame:
    """One 0/1 double column per season level; a NULL season gives 0 everywhere."""
    return df.withColumns(
        {f"{prefix}{lv}": F.coalesce((F.col(season) == lv).cast("double"), F.lit(0.0)) for lv in levels}
    )


def assemble_features(df: DataFrame, cols: list[str], out: str = "x") -> DataFrame:
    """Feature vector; a NULL or NaN cell is an error (treat missing values first)."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(df)
