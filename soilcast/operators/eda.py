"""Exploratory aggregates.

Every statistic of every column is computed in ONE aggregation per call (partial aggregation on the
map side, so a hot group costs one row per task in the shuffle) and turned into long form with
``inline`` afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soilcast.functions.numeric import nan_to_null
from soilcast.operators.crossprod import pair_moments
from soilcast.operators.joins import join_fitted
from soilcast.session import materialize


def _long(agg: DataFrame, by: list[str], records: list[Column]) -> DataFrame:
    """One output row per struct in ``records`` for each aggregated row."""
    return agg.select(*by, F.inline(F.array(*records)))


def _present(df: DataFrame, c: str) -> Column:
    """The column with NaN read as missing, as everywhere."""
    return nan_to_null(c) if dict(df.dtypes)[c] in ("double", "float") else F.col(c)


def missing_profile(df: DataFrame, cols: list[str], by: list[str] = ("season",)) -> DataFrame:
    """by…, column, n, n_missing, share_missing (NULL or NaN counts as missing)."""
    by = list(by)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        aggs.append(F.sum(_present(df, c).isNull().cast("long")).alias(f"_m{i}"))
    agg = df.groupBy(*by).agg(*aggs)
    recs = [
        F.struct(
            F.lit(c).alias("column"),
            F.col("_n").alias("n"),
            F.col(f"_m{i}").alias("n_missing"),
            (F.col(f"_m{i}") / F.col("_n")).alias("share_missing"),
        )
        for i, c in enumerate(cols)
    ]
    return _long(agg, by, recs)


def numeric_summary(df: DataFrame, cols: list[str], by: list[str] = ("season",), moments: bool = True) -> DataFrame:
    """by…, column, n, mean, sd, min, max[, skewness, kurtosis] over non-missing values.

    ``skewness`` and ``kurtosis`` are the population (biased) forms, kurtosis in excess of 3.
    """
    by = list(by)
    stats = {
        "n": F.count,
        "mean": F.avg,
        "sd": F.stddev_samp,
        "min": F.min,
        "max": F.max,
    }
    if moments:
        stats.update({"skewness": F.skewness, "kurtosis": F.kurtosis})
    aggs = [fn(_present(df, c)).alias(f"_{s}{i}") for i, c in enumerate(cols) for s, fn in stats.items()]
    agg = df.groupBy(*by).agg(*aggs)
    recs = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"_{s}{i}").alias(s) for s in stats])
        for i, c in enumerate(cols)
    ]
    return _long(agg, by, recs)


def _melt(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """by…, column, v for every cell of ``cols`` that is neither NULL nor NaN."""
    recs = [F.struct(F.lit(c).alias("column"), _present(df, c).cast("double").alias("v")) for c in cols]
    return df.select(*by, F.inline(F.array(*recs))).filter(F.col("v").isNotNull())


#: Accuracy of the sketch behind ``select``, and how far brackets reach to both sides of a wanted share.
_SKETCH = 20_000
_REACH = 3.0 / _SKETCH


def _selected(df: DataFrame, cols: list[str], probs: list[float], by: list[str]) -> DataFrame | None:
    """Exact quantiles by selection, or None if a wanted place fell outside its bracket."""
    keys = [*by, "column"]
    shares = sorted({float(p) for p in probs})
    ends = [min(max(p + d, 0.0), 1.0) for d in (-_REACH, _REACH) for p in shares]
    aggs = []
    for i, c in enumerate(cols):
        v = _present(df, c).cast("double")
        aggs += [F.percentile_approx(v, ends, _SKETCH).alias(f"_q{i}"), F.count(v).alias(f"_n{i}"), F.min(v).alias(f"_lo{i}"), F.max(v).alias(f"_hi{i}")]
    m = len(shares)
    recs = []
    for i, c in enumerate(cols):
        # Brackets at the ends of the data reach to its ends.
        lo = [F.col(f"_lo{i}") if p <= 2 * _REACH else F.col(f"_q{i}")[j] for j, p in enumerate(shares)]
        hi = [F.col(f"_hi{i}") if p >= 1 - 2 * _REACH else F.col(f"_q{i}")[m + j] for j, p in enumerate(shares)]
        recs.append(F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("_n"), F.array(*lo).alias("_los"), F.array(*hi).alias("_his")))
    brackets = _long(df.groupBy(*by).agg(*aggs), by, recs).where(F.col("_n") > 0)
    brackets = materialize(brackets, "quantile_brackets")  # groups × columns rows
    rows = join_fitted(_melt(df, cols, by), brackets.select(*keys, "_los", "_his"), keys, "inner")
    # Brackets are in order, so the last one that begins at or below a value is the one that can hold it.
    below = F.size(F.filter("_los", lambda x: x <= F.col("v")))
    rows = rows.select(*keys, "v", below.alias("_at"), F.get(F.col("_his"), below - 1).alias("_to"))
    inside = F.when(F.col("v") <= F.col("_to"), F.col("v")).alias("v")
    counted = materialize(rows.select(*keys, "_at", inside).groupBy(*keys, "_at", "v").agg(F.count(F.lit(1)).alias("cnt")), "quantile_counts")
    steps = counted.groupBy(*keys, "_at").agg(F.sum("cnt").alias("_sub"))
    before = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select(*keys, "_at", F.coalesce(F.sum("_sub").over(before), F.lit(0)).alias("_off"))
    own = Window.partitionBy(*keys, "_at").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.where(F.col("v").isNotNull()).withColumn("_run", F.sum("cnt").over(own))
    ranked = join_fitted(ranked, steps, [*keys, "_at"], "inner").select(*keys, "v", "cnt", (F.col("_off") + F.col("_run") - F.col("cnt")).alias("_start"))
    h = (F.col("_n") - 1) * F.col("prob")
    wanted = brackets.select(*keys, "_n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
    wanted = wanted.select(*keys, "prob", (h - F.floor(h)).alias("_frac"), F.explode(F.array_distinct(F.array(F.floor(h), F.ceil(h)))).alias("_pos"))
    met = join_fitted(ranked, wanted, keys, "inner").where((F.col("_start") <= F.col("_pos")) & (F.col("_pos") < F.col("_start") + F.col("cnt")))
    met = materialize(met.select(*keys, "prob", "_frac", "_pos", "v"), "quantile_places")
    if met.count() != wanted.count():
        return None
    picked = met.groupBy(*keys, "prob").agg(F.min("v").alias("_vlo"), F.max("v").alias("_vhi"), F.max("_frac").alias("_frac"))
    return picked.select(*keys, "prob", (F.col("_vlo") + F.col("_frac") * (F.col("_vhi") - F.col("_vlo"))).alias("quantile"))


def quantile_summary(
    df: DataFrame,
    cols: list[str],
    probs: list[float],
    by: list[str] = ("season",),
    accuracy: int | None = None,
    partitions: int | None = None,
    method: str = "select",
) -> DataFrame:
    """by…, column, prob, quantile.

    Exact by default, with linear interpolation between order statistics (h = (n-1)·p). Two methods that give the same:

    * ``select``, for a few quantiles: a sketch brackets each wanted value, one pass counts what lies below the brackets and keeps only
      the values inside, and the counts tell whether each wanted place was met (if one was not, ``ranges`` answers). No row-sized
      exchange.
    * ``ranges``, for many: distinct values are counted, range-partitioned over ``partitions`` tasks (a group may span
      many), ranked inside each partition that holds a wanted place, and offset by the counts of the partitions before it.

    ``accuracy`` switches to ``percentile_approx``.
    """
    by = list(by)
    if method not in ("select", "ranges"):
        raise ValueError(f"quantile_summary: unknown method {method!r}")
    if accuracy is None and method == "select" and partitions is None and cols and probs:
        found = _selected(df, cols, probs, by)
        if found is not None:
            return found
    long = _melt(df, cols, by)
    keys = [*by, "column"]
    if accuracy is not None:
        recs = F.inline(
            F.array(
                *[
                    F.struct(F.lit(float(p)).alias("prob"), F.col("_q")[i].alias("quantile"))
                    for i, p in enumerate(probs)
                ]
            )
        )
        agg = long.groupBy(*keys).agg(F.percentile_approx("v", [float(p) for p in probs], accuracy).alias("_q"))
        return agg.select(*keys, recs)

    counts = long.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("cnt"))
    # Range partitions in (group, value) order; without ``partitions`` adaptive execution sizes them
    # (merging only neighbours, so ranges stay contiguous). Materialised so that both uses below see
    # the same partitions: the partition id is part of the result.
    by_range = counts.repartitionByRange(*([partitions] if partitions else []), *keys, "v")
    # The range number is stored with the rows: a written table is read in other partitions.
    ranged = materialize(by_range.withColumn("_pid", F.spark_partition_id()), "quantile_ranges")
    # Rows per (partition, group) and the offset of each partition within its group.
    sub = ranged.groupBy("_pid", *keys).agg(F.sum("cnt").alias("_sub"))
    w_off = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*keys)
    offsets = sub.select(
        "_pid",
        *keys,
        "_sub",
        F.coalesce(F.sum("_sub").over(w_off), F.lit(0)).alias("_off"),
        F.sum("_sub").over(w_all).alias("_n"),
    )
    # Wanted order statistics: positions floor(h) and ceil(h), 0-based, with the range each lies in. Positions come from
    # the small table of offsets, so only the ranges that hold one are ranked.
    h = (F.col("_n") - 1) * F.col("prob")
    at = offsets.select("_pid", *keys, "_off", "_sub", "_n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
    at = at.select("_pid", *keys, "_off", "_sub", "prob", (h - F.floor(h)).alias("_frac"), F.explode(F.array_distinct(F.array(F.floor(h), F.ceil(h)))).alias("_pos"))
    at = at.filter((F.col("_off") <= F.col("_pos")) & (F.col("_pos") < F.col("_off") + F.col("_sub")))
    held = at.select("_pid", *keys, "_off").distinct()
    w_local = Window.partitionBy("_pid", *keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    # ``held`` and ``at`` have groups × probs rows or so; AQE broadcasts them when they are measured small.
    ranked = join_fitted(ranged, held, ["_pid", *keys], "inner").select(
        "_pid", *keys, "v", (F.col("_off") + F.sum("cnt").over(w_local) - F.col("cnt")).alias("_start"), "cnt"
    )
    found = join_fitted(ranked, at.select("_pid", *keys, "prob", "_frac", "_pos"), ["_pid", *keys], "inner")
    found = found.filter((F.col("_start") <= F.col("_pos")) & (F.col("_pos") < F.col("_start") + F.col("cnt")))
    picked = found.groupBy(*keys, "prob").agg(F.min("v").alias("_vlo"), F.max("v").alias("_vhi"), F.max("_frac").alias("_frac"))
    q = F.col("_vlo") + F.col("_frac") * (F.col("_vhi") - F.col("_vlo"))
    return picked.select(*keys, "prob", q.alias("quantile"))


def histogram(df: DataFrame, col: str, width: float, by: list[str] = ("season",)) -> DataFrame:
    """by…, bin, lower, upper, n: counts in [bin·width, (bin+1)·width); NULL and NaN skipped."""
    by = list(by)
    x = F.col(col)
    b = F.floor(x / F.lit(float(width))).alias("bin")
    agg = df.filter(x.isNotNull() & ~F.isnan(x)).groupBy(*by, b).agg(F.count(F.lit(1)).alias("n"))
    return agg.select(
        *by,
        "bin",
        (F.col("bin") * F.lit(float(width))).alias("lower"),
        ((F.col("bin") + 1) * F.lit(float(width))).alias("upper"),
        "n",
    )


def correlations(df: DataFrame, cols: list[str], by: list[str] = ("season",)) -> DataFrame:
    """by…, x, y, n, r: Pearson r of every pair on rows where both are present, all pairs in one pass over the rows (after one for the
    means), as blocks of cross products. r is NULL where a column is constant on these rows, and for fewer than two rows."""
    by = list(by)
    sums = pair_moments(df, {c: _present(df, c) for c in cols}, by)
    names = F.array(*[F.lit(c) for c in cols])
    r = F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy"))
    r = F.when((F.col("n") > 1) & (F.col("sxx") > 0) & (F.col("syy") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    return sums.select(*by, names[F.col("x")].alias("x"), names[F.col("y")].alias("y"), "n", r.alias("r"))
