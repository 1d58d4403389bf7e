"""Ordered target encoding: a category becomes the mean target of the rows before, in an order that hashing fixes.

A row never sees its own target or a later one's, so the encoding can be a feature of the same training rows. New rows get the
mean over all training rows of their category. Prefix sums are split by ranges of the order: sums by (category, range) first, then a
running sum inside each range, so a category that holds half of all rows is many groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soilcast.operators.joins import join_fitted
from soilcast.session import materialize

#: Ranges of the order at most (four hexadecimal digits).
RANGES = 1 << 16


def hash_order(keys: list[str]) -> Column:
    """A place in the order that follows from the keys alone, the same in any engine: md5 of the keys joined by '-'. A NULL key is empty."""
    return F.md5(F.concat_ws("-", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))


@dataclass
class TargetEncoding:
    category: str
    out: str
    weight: float
    prior: float | None
    totals: DataFrame  # category, _s, _c: sum and number of the training targets

    def transform(self, df: DataFrame) -> DataFrame:
        """New rows: the mean target of all training rows of the category; the prior for an unseen one."""
        rows = join_fitted(df.drop(self.out), self.totals, [self.category])
        return rows.withColumn(self.out, _mean(F.col("_s"), F.col("_c"), self.weight, self.prior)).drop("_s", "_c")


def _mean(s: Column, c: Column, weight: float, prior: float | None) -> Column:
    zero = F.lit(0.0)
    n = F.coalesce(c, F.lit(0)) + F.lit(float(weight))
    total = F.coalesce(s, zero) + F.lit(float(weight)) * F.lit(prior).cast("double")
    return F.when(n > 0, total / n)


def ordered_target_encoding(
    train: DataFrame, category: str, y: str, keys: list[str], out: str | None = None, weight: float = 1.0, range_rows: int = 100_000
) -> tuple[DataFrame, TargetEncoding]:
    """(``train`` with ``out``, the encoding for new rows).

    ``out`` = (sum of the targets before + weight × prior) / (their number + weight), over the rows of the same category that come before in
    ``hash_order(keys)``; the prior is the mean target. Rows with one place (repeated keys) do not see each other. A NULL
    category is one of its own; a row without a target is encoded and adds nothing. ``range_rows``: rows of a range, about.
    """
    out = out or f"{category}_target"
    train = train.drop(out)
    n, prior = train.agg(F.count(F.lit(1)), F.avg(y)).first()
    ranges = 1
    while ranges < RANGES and n / ranges > range_rows:
        ranges *= 2
    place = hash_order(keys)
    rows = train.withColumns({"_at": place, "_range": F.floor(F.conv(F.substring(place, 1, 4), 16, 10).cast("long") * ranges / RANGES)})
    # Rows of one place are summed first: a window over rows could not tell them from earlier ones.
    places = rows.groupBy(category, "_range", "_at").agg(F.sum(y).alias("_ps"), F.count(y).alias("_pc"))
    places = materialize(places, "encoding_places")
    by_range = places.groupBy(category, "_range").agg(F.sum("_ps").alias("_rs"), F.sum("_pc").alias("_rc"))
    earlier = Window.partitionBy(category).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # categories × ranges rows
    before = by_range.select(category, "_range", F.sum("_rs").over(earlier).alias("_bs"), F.sum("_rc").over(earlier).alias("_bc"))
    inside = Window.partitionBy(category, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    running = places.select(category, "_range", "_at", F.sum("_ps").over(inside).alias("_is"), F.sum("_pc").over(inside).alias("_ic"))
    running = join_fitted(running, before, [category, "_range"]).select(
        category, "_at",
        (F.coalesce("_bs", zero) + F.coalesce("_is", zero)).alias("_s"),
        (F.coalesce("_bc", F.lit(0)) + F.coalesce("_ic", F.lit(0))).alias("_c"),
    )
    encoded = join_fitted(rows, running, [category, "_at"])
    encoded = encoded.withColumn(out, _mean(F.col("_s"), F.col("_c"), weight, prior)).drop("_s", "_c", "_at", "_range")
    totals = materialize(by_range.groupBy(category).agg(F.sum("_rs").alias("_s"), F.sum("_rc").alias("_c")), "encoding_totals")
    return encoded, TargetEncoding(category, out, weight, prior, totals)
