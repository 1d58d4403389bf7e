"""Joining a fitted (aggregated) table back onto rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_fitted(df: DataFrame, fitted: DataFrame, on, how: str = "left") -> DataFrame:
    """Join a fitted table whose row count is data dependent; NULL keys meet NULL keys.

    ``fitted`` should be written (``soilcast.session.materialize``), so that Spark knows its size in bytes and
    chooses the join by it; no hint and no extra job.
    """
    keys = [on] if isinstance(on, str) else list(on)
    right = fitted.select(*[F.col(k).alias(f"_on_{k}") for k in keys], *[c for c in fitted.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys])
    return df.join(right, same, how).drop(*[f"_on_{k}" for k in keys])
