"""SimHash document fingerprints and their search by permuted block tables.

The hash of every term votes on 64 signed bits, weighted by how often the term occurs. Two bits share
one long counter, so 32 sums per document hold all votes; a task adds up its own documents before
anything is shuffled. Only DataFrame functions are used.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import reserved, stored, words

#: Words in a term.
SHINGLE = 5
BITS = 64
_PAIR = (1 << 32) | 1


def _votes(term: Column) -> list[Column]:
    """Per pair of bits (k, k + 32): their values in the low and the high half of a long."""
    return [F.sum(F.shiftrightunsigned(term, k).bitwiseAND(F.lit(_PAIR))).alias(f"v{k}") for k in range(BITS // 2)]


def _majority() -> Column:
    """The bits that more than half of the votes set."""
    bits = F.lit(0).cast("long")
    for k in range(BITS // 2):
        v = F.col(f"v{k}")
        for at, count in ((k, v.bitwiseAND(F.lit((1 << 32) - 1))), (k + 32, F.shiftrightunsigned(v, 32))):
            value = (1 << at) - (1 << 64) * (at == 63)
            bits = bits.bitwiseOR(F.when(count * 2 > F.col("n"), F.lit(value)).otherwise(F.lit(0)).cast("long"))
    return bits


def simhash(df: DataFrame, keys: list[str], text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``keys`` and ``fp`` (long): one fingerprint for each combination of ``keys``.

    Terms are runs of ``shingle`` words; a shorter text is one term; a text without words (NULL too) has
    fingerprint 0, and a bit without a majority is 0. A term counts once for each place it occurs at. Rows with equal ``keys``
    are read as one text repeated, so copies do not change a fingerprint. NULL keys are kept.
    """
    w, at = reserved(df, "_words"), reserved(df, "_at")
    split = df.select(*keys, words(F.col(text_col)).alias(w))
    last = F.greatest(F.size(w) - shingle, F.lit(0))
    terms = split.select(*keys, w, F.explode(F.sequence(F.lit(0), last)).alias(at))
    term = F.xxhash64(*[F.get(w, F.col(at) + k) for k in range(shingle)])
    counted = terms.select(*keys, F.when(F.size(w) > 0, term).otherwise(F.lit(0)).alias("term"))
    return counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *_votes(F.col("term"))).select(
        *keys, _majority().alias("fp")
    )


def fp_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def _blocks(n: int) -> list[int]:
    """Masks of ``n`` blocks of nearly equal width that cover all bits."""
    edges = [BITS * k // n for k in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_fingerprints(queries: DataFrame, corpus: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All pairs of a distinct query ``fp`` and a distinct corpus ``fp`` at most ``radius`` bits apart:
    ``query_fp``, ``fp``, ``distance``.

    With ``blocks`` blocks, two fingerprints within the radius agree on ``blocks - radius`` of them at
    least, so one table for each such choice of blocks, keyed by their bits, holds every pair. A pair that
    agrees in several tables is met in the first of them only, and the radius is part of the join, so
    the join's rows are the result. More blocks give longer keys (fewer false meetings) and more tables.
    """
    if not 0 <= radius < blocks:
        raise ValueError("radius must be below the number of blocks")
    masks = _blocks(blocks)
    tables = [_signed(sum(masks[i] for i in chosen)) for chosen in combinations(range(blocks), blocks - radius)]
    table_masks = F.array(*[F.lit(m).cast("long") for m in tables])

    def keyed(df: DataFrame) -> DataFrame:
        distinct = df.select("fp").where(F.col("fp").isNotNull()).distinct()
        t = distinct.select("fp", F.posexplode(table_masks).alias("table", "mask"))
        return t.select("fp", "table", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))

    q, c = keyed(queries).alias("q"), keyed(corpus).alias("c")
    differ = F.col("q.fp").bitwiseXOR(F.col("c.fp"))
    first = F.lit(None).cast("int")
    for k in reversed(range(len(tables))):
        first = F.when(differ.bitwiseAND(F.lit(tables[k]).cast("long")) == 0, F.lit(k)).otherwise(first)
    meet = (F.col("q.table") == F.col("c.table")) & (F.col("q.key") == F.col("c.key"))
    return q.join(c, meet & (F.bit_count(differ) <= radius) & (first == F.col("q.table"))).select(
        F.col("q.fp").alias("query_fp"), F.col("c.fp").alias("fp"), F.bit_count(differ).alias("distance")
    )


def in_order(df: DataFrame, order: list[str], carry: list[str], name: str) -> DataFrame:
    """Rows of ``df`` with ``next_<c>`` and ``prev_<c>`` for each column of ``order`` and ``carry``: those of
    the neighbours in ascending ``order`` (NULL first), the last row followed by the first.

    Rows are dealt by ranges and each range is sorted by itself; the ends of ranges, one row each, are
    what the neighbouring ranges need. ``order`` must tell rows apart. Needs small rows.
    """
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = stored(ranged, name)  # the range number is stored: files read again are packed by size
    cols = [*order, *carry]
    row = F.struct(*[F.col(c) for c in cols])
    w = Window.partitionBy("_range").orderBy(*order)
    inside = ranged.withColumn("_next", F.lead(row).over(w)).withColumn("_prev", F.lag(row).over(w))
    ends = ranged.groupBy("_range").agg(F.min(row).alias("_first"), F.max(row).alias("_last"))
    ring = Window.orderBy("_range")  # one row for each range
    ends = ends.select(
        F.col("_range").alias("_r"),
        F.coalesce(F.lead("_first").over(ring), F.first("_first").over(ring)).alias("_after"),
        F.coalesce(
            F.lag("_last").over(ring),
            F.last("_last").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("_before"),
    )
    joined = inside.join(ends, F.col("_range") == F.col("_r"))
    joined = joined.withColumn("_next", F.coalesce("_next", "_after")).withColumn("_prev", F.coalesce("_prev", "_before"))
    near = [F.col(f"_next.{c}").alias(f"next_{c}") for c in cols] + [F.col(f"_prev.{c}").alias(f"prev_{c}") for c in cols]
    return joined.select(*df.columns, *near)
