"""Mixing sources to target weights.

Documents get hash-random keys, are sorted by them within their source in key ranges, and distributed
prefix sums of their sizes find, for every source, the key at which its budget of words is reached
exactly. A source whose budget exceeds its size repeats whole epochs first.

Only one small row per document is shuffled, never a text. A hot source is split over its
``16 ** RANGE_DIGITS`` key ranges, and rows with one id are counted before they are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import reserved, stored, word_count

#: Leading hex digits of the key that name its range.
RANGE_DIGITS = 3


def hash_key(doc_id: Column, seed: int) -> Column:
    """A key in random order, the same on every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def source_targets(sizes: DataFrame, weights: list[int], share: float, max_epochs: int) -> DataFrame:
    """Word targets from ``sizes`` (``source``, ``source_size``; one row per source).

    Sources sorted by code point, NULL last, weigh ``weights`` in turn and share ``share`` times all
    words. A target stops at ``max_epochs`` times its source's size; what is over goes to the others
    by weight until none is above. That fixed point has a closed form: with sources sorted by
    (limit / weight), the level is the greatest (rest of the budget / rest of the weights).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.lit(weights[0])
    for k, w in enumerate(weights):
        weight = F.when((F.row_number().over(by_name) - 1) % len(weights) == k, F.lit(w)).otherwise(weight)
    s = sizes.withColumn("weight", weight.cast("double")).withColumn(
        "limit", (F.col("source_size") * max_epochs).cast("double")
    )
    by_need = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("limit").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    all_rows = Window.partitionBy()
    s = s.withColumn("budget", F.sum("source_size").over(all_rows) * F.lit(float(share)))
    s = s.withColumn("level", (F.col("budget") - before) / rest)
    s = s.withColumn("level", F.max("level").over(all_rows))
    return s.withColumn("target", F.least("limit", F.col("weight") * F.col("level"))).select(
        "source", "source_size", "target"
    )


def source_cuts(
    rows: DataFrame, weights: list[int], share: float, max_epochs: int = 2
) -> DataFrame:
    """One row per source from ``rows`` (``doc_id``, ``source``, ``size``, ``key``): ``source_size``,
    ``target``, ``epochs`` taken whole, and the group of equal rows at which the last epoch is cut
    (``cut_key``, ``cut_id``, ``cut_size``, ``cut_words`` taken of each; NULL where an epoch ends
    exactly).
    """
    key_range = F.substring("key", 1, RANGE_DIGITS)
    # Rows that agree in all four are interchangeable; counting them first keeps a repeated id cold.
    groups = rows.groupBy("source", key_range.alias("range"), "key", "doc_id", "size").agg(
        F.count(F.lit(1)).alias("copies")
    )
    groups = groups.withColumn("group_size", F.col("size") * F.col("copies"))
    ranges = groups.groupBy("source", "range").agg(F.sum("group_size").alias("range_size"))
    sizes = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    targets = source_targets(sizes, weights, share, max_epochs)
    # Of the rounded target: what is left is always less than an epoch.
    words = F.round("target").cast("long")
    targets = targets.withColumn(
        "epochs",
        F.when(F.col("source_size") > 0, F.least(F.lit(max_epochs), F.floor(words / F.col("source_size"))))
        .otherwise(F.lit(0))
        .cast("long"),
    )
    targets = targets.withColumn("rest", words - F.col("epochs") * F.col("source_size"))
    so_far = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(so_far), F.lit(0)))
    # The range that holds the cut, one per source, then the group in it.
    t, r = targets.alias("t"), starts.alias("r")
    hit = (F.col("t.rest") >= F.col("r.range_start")) & (F.col("t.rest") < F.col("r.range_start") + F.col("r.range_size"))
    cut_range = t.join(r, F.col("t.source").eqNullSafe(F.col("r.source")) & hit, "left").select(
        "t.*", "r.range", "r.range_start"
    )
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size")
    ends = groups.withColumn("end", F.sum("group_size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    c, g = cut_range.alias("c"), ends.alias("g")
    start = F.col("c.range_start") + F.col("g.end") - F.col("g.group_size")
    here = (F.col("c.rest") >= start) & (F.col("c.rest") < F.col("c.range_start") + F.col("g.end"))
    same = F.col("c.source").eqNullSafe(F.col("g.source")) & (F.col("c.range") == F.col("g.range"))
    return c.join(g, same & here, "left").select(
        "c.source", "c.source_size", "c.target", "c.epochs",
        F.col("g.key").alias("cut_key"), F.col("g.doc_id").alias("cut_id"), F.col("g.size").alias("cut_size"),
        F.floor((F.col("c.rest") - start) / F.col("g.copies")).cast("long").alias("cut_words"),
    )


def mix(
    df: DataFrame,
    weights: list[int],
    share: float = 1.5,
    max_epochs: int = 2,
    seed: int = 42,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """``df`` with ``size`` (words of the text, NULL: 0), ``source_size``, ``target`` and ``taken``, the
    words that the mix takes of the row, repeats counted: ``size`` for each epoch in which the whole
    row is taken, fewer where the budget ends inside it, 0 where it is not taken.

    Every row stays (filter on ``taken`` to drop). A source's ``taken`` add up to its rounded target,
    short by less than one word per copy where the cut falls on rows that agree in source, id and
    size: those take equally much. NULL sources are one source, NULL ids share one key. Columns of
    ``df`` with these names are replaced; an empty table gives an empty one.
    """
    names = {k: reserved(df, k) for k in ("_key", "_size")}
    key, size = names["_key"], names["_size"]
    keyed = df.withColumn(key, hash_key(F.col(id_col), seed)).withColumn(size, word_count(F.col(text_col)))
    rows = keyed.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(size).alias("size"), F.col(key).alias("key")
    )
    cuts = stored(source_cuts(rows, weights, share, max_epochs), "cuts")
    k, c = keyed.alias("k"), cuts.alias("c")
    cut = F.struct(F.col("c.cut_key"), F.col("c.cut_id"), F.col("c.cut_size"))
    own = F.struct(F.col(f"k.{key}"), F.col(f"k.{id_col}"), F.col(f"k.{size}"))
    last = (
        F.when(F.col("c.cut_key").isNull(), F.lit(0))
        .when(own < cut, F.col(f"k.{size}"))
        .when(own.eqNullSafe(cut), F.col("c.cut_words"))
        .otherwise(F.lit(0))
    )
    added = {
        "size": F.col(f"k.{size}"),
        "source_size": F.col("c.source_size"),
        "target": F.col("c.target"),
        "taken": (F.col("c.epochs") * F.col(f"k.{size}") + last).cast("long"),
    }
    keep = [F.col(f"k.{x}") for x in df.columns if x not in added]
    joined = k.join(c, F.col(f"k.{source_col}").eqNullSafe(F.col("c.source")), "left")
    return joined.select(*keep, *[v.alias(x) for x, v in added.items()])


def mixed_documents(df: DataFrame, mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of the mix: each row of ``mixed`` once per epoch that takes it, the last with its text
    cut behind the words that are left. Columns as in ``df``; ``n_chars`` follows the text. Rows with
    nothing taken are dropped.
    """
    n, copy = reserved(mixed, "_n"), reserved(mixed, "_copy")
    size, taken = F.col("size"), F.col("taken")
    whole = F.when(size > 0, F.floor(taken / size)).otherwise(F.lit(0)).cast("long")
    parts = F.transform(F.sequence(F.lit(1), whole), lambda _: size)
    parts = F.when(whole > 0, parts).otherwise(F.array().cast("array<bigint>"))
    rest = taken - whole * size
    parts = F.concat(parts, F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    out = mixed.withColumn(copy, F.explode(parts)).withColumn(n, F.col(copy))
    # Pieces that end where a word ends; joined again they are the text, white space included.
    text = F.col(text_col)
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    prefix = F.array_join(F.slice(pieces, F.lit(1), F.col(n).cast("int")), "")
    new = {text_col: F.when(F.col(n) < size, prefix).otherwise(text)}
    if "n_chars" in df.columns:
        new["n_chars"] = F.when(F.col(n) < size, F.length(prefix).cast("long")).otherwise(F.col("n_chars"))
    return out.select(*[new[x].alias(x) if x in new else F.col(x) for x in df.columns])
