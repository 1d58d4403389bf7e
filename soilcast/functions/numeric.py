"""Small numeric expressions shared by operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def safe_div(num: Column, den: Column) -> Column:
    """num / den, NULL when den is 0 or NULL (ANSI mode raises on a zero double divisor)."""
    return F.when(den != 0, num / den)


def nan_to_null(c: str | Column) -> Column:
    """NaN becomes NULL; other values, NULL included, pass through."""
    x = col(c)
    return F.when(~F.isnan(x), x)
