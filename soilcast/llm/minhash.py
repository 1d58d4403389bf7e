"""Near-duplicates by ProbMinHash signatures of weighted word shingles, banding and verification.

Equal texts are one node each. Signatures agree register by register with the probability Jaccard
similarity, an element weighing 1 + ln(times), and 1 in a second group of bands; nodes that agree in a whole band
are compared. Links are pairs whose distinct shingles have a Jaccard similarity of ``threshold`` or more, which the
second group estimates however often a shingle repeats, and classes are the connected components.

A bucket's nodes are not all paired. They are first compared with one of them; a bucket left with
several classes is small and compared in full, or its nodes get a bound from the shingles that no other of them
has, which no pair of too different texts passes: they are compared with the most typical node, and what
still lies in different classes within the bounds is compared block by block, so that only links become rows.
No bucket or partner is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, reserved, stored
from .components import components
from .shingles import Shingler, overlap, prob_minhash

SHINGLE = 5
THRESHOLD = 0.8
#: Per group. A pair of similarity 0.8 misses all bands of weight 1 with a probability of 4e-6.
BANDS = 24
ROWS = 4
#: Nodes up to which a bucket with several classes is compared in full.
SMALL = 16
#: Nodes in a block of a larger bucket.
BLOCK = 256
_BATCH = 1 << 18


def _batches(raws: list[bytes]) -> Iterator[tuple[int, int]]:
    """Stretches of about ``_BATCH`` bytes."""
    start, held = 0, 0
    for k, raw in enumerate(raws):
        held += len(raw)
        if held >= _BATCH:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(raws):
        yield start, len(raws)


def _band_keys(best: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band, different for different bands."""
    from .shingles import mixed

    n, registers = best.shape
    bands = best.reshape(n, registers // rows, rows)
    keys = np.broadcast_to(np.arange(registers // rows, dtype=np.uint64), bands.shape[:2]).copy()
    for k in range(rows):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, k])
    return keys


def signatures(texts: DataFrame, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """``texts`` without its text and with ``bands`` (keys; none for a text without words) and ``n_shingles``.

    A text has ``bands`` keys from weights 1 + ln(times), and those from weight 1 that differ: none if no shingle repeats."""
    keep = [c for c in texts.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(shingle)
        for b in batches:
            raws = [t.encode("utf-8") for t in b.column(text_col).to_pylist()]
            for start, end in _batches(raws):
                owner, element, times = make.of(raws[start:end])
                n = end - start
                count = np.bincount(owner, minlength=n)
                keys = _band_keys(prob_minhash(owner, element, 1.0 + np.log(times), n, bands * rows), rows)
                plain = keys.copy()
                again = np.bincount(owner[times > 1], minlength=n) > 0
                if again.any():
                    of = again[owner]
                    at = (np.cumsum(again) - 1)[owner[of]]
                    best = prob_minhash(at, element[of], np.ones(len(at)), int(again.sum()), bands * rows)
                    plain[again] = _band_keys(best, rows)
                there = np.concatenate([np.broadcast_to(count[:, None] > 0, keys.shape), plain != keys], axis=1)
                held = np.concatenate([keys, plain], axis=1)[there].view(np.int64)
                ends = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
                cols = [pa.ListArray.from_arrays(pa.array(ends), pa.array(held)), pa.array(count.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*(c.slice(start, n) for c in (b.column(x) for x in keep)), *cols], [*keep, "bands", "n_shingles"])

    shape = texts.select(*keep, F.lit(None).cast("array<long>").alias("bands"), F.lit(0).cast("long").alias("n_shingles")).schema
    return map_batches(texts, run, shape)


def _shingle_sets(texts: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """``node`` and ``shingles``: the distinct shingles as sorted 32-bit hashes. (In a pair of texts with 500
    shingles each, a false match has a probability of 1 in 17,000, and would shift the similarity by 0.001.)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(shingle)
        for b in batches:
            raws = [t.encode("utf-8") for t in b.column(text_col).to_pylist()]
            for start, end in _batches(raws):
                owner, element, _ = make.of(raws[start:end])
                cut = np.searchsorted(owner, np.arange(end - start + 1))
                short = (element >> np.uint64(32)).astype("<u4")
                sets = [np.unique(short[s:e]).tobytes() for s, e in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([b.column("node").slice(start, end - start), pa.array(sets, pa.binary())], ["node", "shingles"])

    return map_batches(texts.select("node", text_col), run, "node long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose sets are similar enough."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = [
                overlap(np.frombuffer(p, "<u4"), np.frombuffer(q, "<u4")) >= threshold
                for p, q in zip(x.column("sa").to_pylist(), x.column("sb").to_pylist(), strict=True)
            ]
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([x.column("a").filter(mask), x.column("b").filter(mask)], ["a", "b"])

    return map_batches(pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb"), run, "a long, b long")


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Bucket rows with their class, of the buckets that hold several: adds ``label``, ``members``."""
    labels = components(links)
    rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = stored(rows, "near-labelled")
    seen = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("members"))
    # Written, so that a join can split a bucket with very many rows.
    return rows.join(stored(seen.where("lo <> hi").select("key", "members"), "near-several"), "key")


def near_links(buckets: DataFrame, sets: DataFrame, threshold: float = THRESHOLD, small: int = SMALL) -> DataFrame:
    """Links (``a``, ``b``) that connect just the nodes which links between any two nodes of a bucket
    connect. ``buckets``: ``key``, ``node``, two rows or more per key; ``sets``: ``node``, ``shingles``."""
    firsts = stored(buckets.groupBy("key").agg(F.min("node").alias("first")), "near-firsts")
    star = buckets.join(firsts, "key").where("node <> first").select(*_pair(F.col("node"), F.col("first"))).distinct()
    links = stored(_verified(star, sets, threshold), "near-star")

    mixed = stored(_labelled(buckets, links), "near-mixed")
    few, many = mixed.where(F.col("members") <= small), mixed.where(F.col("members") > small)
    x, y = few.alias("x"), few.alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label"))
    pairs = x.join(y, apart).select(*_pair(F.col("x.node"), F.col("y.node")))

    # Shingles that another node of these buckets has, too: a partner can share no others.
    nodes = many.select("node").distinct()
    sizes = F.octet_length("shingles") / 4
    each = sets.join(nodes, "node").select("node", sizes.cast("int").alias("size"), F.explode(_as_ints("shingles")).alias("s"))
    met = each.groupBy("s").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("s")
    common = each.join(met, "s").groupBy("node").agg(F.count(F.lit(1)).alias("common"), F.first("size").alias("size"))
    # Similarity t needs t / (1 + t) of both sizes in common; a partner of a set has t of its size at least.
    need = threshold / (1.0 + threshold)
    able = F.col("common") >= threshold * F.col("size") - 1e-9
    many = stored(many.join(common.where(able), "node"), "near-many")
    typical = many.groupBy("key").agg(F.max_by("node", F.struct(F.col("common") / F.col("size"), "node")).alias("first"))
    star = many.join(typical, "key").where("node <> first").select(*_pair(F.col("node"), F.col("first")))
    links = stored(links.unionByName(_verified(pairs.unionByName(star).distinct(), sets, threshold)), "near-links")

    rest = _labelled(many.drop("label", "members"), links)
    return links.unionByName(_by_blocks(rest, sets, threshold))


def _by_blocks(rest: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between nodes of a bucket (``key``) with different ``label``. A bucket is dealt into blocks of about ``BLOCK``
    nodes by hash; each pair of blocks is one row, whose shared shingles are counted by a matrix product."""
    blocks = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / BLOCK).cast("long")).alias("block")
    node = F.struct("node", "label", "shingles")
    held = rest.join(sets, "node").select("key", blocks, node.alias("node")).groupBy("key", "block").agg(
        F.collect_list("node").alias("nodes"), F.min("node.label").alias("lo"), F.max("node.label").alias("hi")
    )
    held = stored(held, "near-blocks")
    x, y = held.alias("x"), held.alias("y")
    several = F.least("x.lo", "y.lo") != F.greatest("x.hi", "y.hi")
    both = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.block") <= F.col("y.block")) & several)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                one, two = (b.column(c)[k].as_py() for c in ("one", "two"))
                i, j = _similar([r["shingles"] for r in one], [r["shingles"] for r in two], threshold)
                la, lb = (np.array([r["label"] for r in z]) for z in (one, two))
                na, nb = (np.array([r["node"] for r in z]) for z in (one, two))
                apart = la[i] != lb[j]
                yield pa.RecordBatch.from_arrays([pa.array(na[i[apart]]), pa.array(nb[j[apart]])], ["a", "b"])

    rows = both.select(F.col("x.nodes").alias("one"), F.col("y.nodes").alias("two"))
    return map_batches(rows, run, "a long, b long")


def _similar(one: list[bytes], two: list[bytes], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of sets that are similar enough."""
    a, b = ([np.frombuffer(s, "<u4") for s in z] for z in (one, two))
    shared = np.intersect1d(np.concatenate(a), np.concatenate(b))
    na, nb = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    common = np.zeros((len(a), len(b)), np.float32)
    for k in range(0, len(shared), 4096):  # the product in strips of bounded width
        strip = shared[k : k + 4096]
        common += _member(a, strip) @ _member(b, strip).T
    ok = common >= threshold * (na[:, None] + nb[None, :] - common) - 1e-4
    return np.nonzero(ok & (na[:, None] > 0))


def _member(sets: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(values)), np.float32)
    for i, s in enumerate(sets):
        at = np.searchsorted(values, s)
        at[at == len(values)] = 0
        out[i, at[values[at] == s]] = 1
    return out


def _as_ints(col: str) -> Column:
    """A binary of 4-byte values as an array of them (binary slices, equal where the values are)."""
    n = (F.octet_length(col) / 4).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda k: F.substring(F.col(col), k * 4 + 1, F.lit(4)))


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    small: int = SMALL,
) -> DataFrame:
    """``id_col``, ``t1``, ``t2`` (hash of the text), ``class_id`` (the least id of the row's class), ``class_size`` and ``node`` (of
    its text): a row per row of ``df``.

    Equal texts with words are always in one class. A text without words (NULL, empty, white space) is a class of its own in
    each row, with ``node`` NULL. NULL ids are ignored in the least id; a class with no other ids has NULL.
    """
    t1, t2, text = reserved(df, "_t1"), reserved(df, "_t2"), reserved(df, "_text")
    docs = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text))
    docs = docs.withColumns({t1: F.xxhash64(text), t2: F.xxhash64(F.lit(1), text)})
    signed = signatures(docs.select(F.col(id_col).alias("_id"), t1, t2, text), text, shingle, bands, rows)
    texts = signed.groupBy(t1, t2).agg(F.first("bands").alias("bands"), F.min("_id").alias("_id"), F.count(F.lit(1)).alias("copies"))
    # Numbered as the table is written, so the numbers stay.
    texts = stored(texts.where(F.size("bands") > 0).withColumn("node", F.monotonically_increasing_id()), "near-texts")
    keyed = texts.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    buckets = stored(keyed.join(stored(shared, "near-shared"), "key"), "near-buckets")
    asked = buckets.select("node").distinct().join(texts.select("node", t1, t2, "_id"), "node")
    same = [F.col(f"d.{c}") == F.col(f"a.{c}") for c in (t1, t2)] + [F.col(f"d.{id_col}").eqNullSafe(F.col("a._id"))]
    picked = docs.alias("d").join(asked.alias("a"), same).select("a.node", f"d.{text}")
    sets = _shingle_sets(picked, text, shingle).groupBy("node").agg(F.first("shingles").alias("shingles"))
    sets = stored(sets, "near-sets")
    links = near_links(buckets, sets, threshold, small)
    labels = components(links)
    named = texts.select(t1, t2, "node", "_id", "copies").join(labels, "node", "left")
    named = stored(named.withColumn("label", F.coalesce("label", "node")), "near-named")
    classes = named.groupBy("label").agg(F.min("_id").alias("class_id"), F.sum("copies").alias("class_size"))
    named = named.join(classes, "label").select(t1, t2, "node", "class_id", "class_size")
    out = docs.select(id_col, t1, t2).join(named, [t1, t2], "left")
    alone = F.col("node").isNull()
    return out.select(
        id_col, F.col(t1).alias("t1"), F.col(t2).alias("t2"),
        F.when(alone, F.col(id_col)).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1).cast("long")).otherwise(F.col("class_size")).alias("class_size"), "node",
    )


def one_per_class(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` with one row of each class: of its least id (NULL last), and of rows that share it the one whose
    text has the least hash, once. Texts without words all stay."""
    classes = near_duplicates(df, id_col, text_col, **options).where(F.col("node").isNotNull())
    order = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), "t1", "t2")
    classes = stored(classes.select("class_id", "class_size", order.alias("o")), "near-classes")
    # A class is known by its least id; classes of NULL ids alone by their text.
    kept = classes.groupBy("class_id", F.when(F.col("class_id").isNull(), F.col("o.t1")).alias("t")).agg(F.min("o").alias("o")).select("o.*")
    t1, t2 = reserved(df, "_t1"), reserved(df, "_t2")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.withColumns({t1: F.xxhash64(text), t2: F.xxhash64(F.lit(1), text)})
    wordless = F.btrim(text, F.lit(" \t\n\x0b\x0c\r")) == ""
    same = F.col(f"r.{id_col}").eqNullSafe(F.col("k.i")) & (F.col(f"r.{t1}") == F.col("k.t1")) & (F.col(f"r.{t2}") == F.col("k.t2"))
    one = rows.where(~wordless).alias("r").join(kept.alias("k"), same, "left_semi").dropDuplicates([id_col, t1, t2])
    return one.unionByName(rows.where(wordless)).drop(t1, t2)
