"""Hard-negative mining: for each anchor and each of its positives, the best-scoring rows of other labels in a window of scores.

Anchors are dealt in tiles of near ones, and each tile gets a spanning tree of least edges. Walking the tree, the scores
of a candidate at a parent anchor bound its score at the child: they differ by no more than the length of the edge times
the norm of the candidate. Only candidates whose interval meets a window that still matters are scored again; the
others hand their interval on. Candidates lie in blocks of bounded size, and every tile visits every block, so a task holds one
block and one tile; what is found in a block is merged by anchor in two steps. Two walks: positives, then negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, stored

#: Anchors of a tile.
TILE = 512
#: Blocks of candidates: about so many, each of rows within these bounds.
BLOCKS = 64
BLOCK_ROWS = (2048, 65_536)
#: Candidates that walk a tree together.
SLICE = 8192
#: Integers up to here are exact in doubles.
_EXACT = 2.0**53


def usable(df: DataFrame, vec_col: str = "embedding", label_col: str = "label") -> Column:
    """Rows that take part: a label, and a vector without a NULL, NaN or infinite component."""
    finite = F.forall(vec_col, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & finite, F.lit(False))


def least_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of a spanning tree of least edges over the rows of ``x``: parents come first; the
    root, the first in order, has parent -1."""
    n = len(x)
    near, parent = np.full(n, np.inf), np.full(n, -1)
    order, edge, open_ = [], np.zeros(n), np.ones(n, bool)
    at = 0
    for _ in range(n):
        order.append(at)
        open_[at] = False
        d = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        closer = open_ & (d < near)
        near[closer], parent[closer] = d[closer], at
        if open_.any():
            at = int(np.argmin(np.where(open_, near, np.inf)))
            edge[at] = near[at]
    return np.array(order, dtype=np.int64), parent, edge


class Best:
    """The ``k`` first of what is offered: higher scores first, ties by smaller id."""

    def __init__(self, k: int):
        self.k, self.score, self.row = k, np.zeros(0), np.zeros(0, np.int64)

    def offer(self, score: np.ndarray, row: np.ndarray, rank: np.ndarray) -> None:
        """``rank`` orders equal scores by row."""
        if self.full:
            fit = score >= self.score[-1]
            score, row = score[fit], row[fit]
        if not len(score):
            return
        score, row = np.concatenate([self.score, score]), np.concatenate([self.row, row])
        order = np.lexsort((rank[row], -score))[: self.k]
        self.score, self.row = score[order], row[order]

    @property
    def full(self) -> bool:
        return len(self.score) == self.k

    @property
    def least(self) -> float:
        """Lower scores no longer matter."""
        return self.score[-1] if self.full else -np.inf


class Tile:
    """Anchors with their tree and, for each, the windows that are searched."""

    def __init__(self, x: np.ndarray, label: np.ndarray, uid: np.ndarray, order, parent, edge, windows):
        self.x, self.label, self.uid, self.order, self.parent, self.edge, self.windows = x, label, uid, order, parent, edge, windows
        self.has_child = np.zeros(len(x), bool)
        self.has_child[parent[parent >= 0]] = True


class Block:
    """Candidates, in order of id."""

    def __init__(self, x: np.ndarray, label: np.ndarray, uid: np.ndarray, vec_id: list):
        self.x, self.label, self.uid, self.vec_id = x, label, uid, vec_id
        self.norm = np.sqrt((x**2).sum(axis=1))
        self.rank = np.empty(len(x), np.int64)
        self.rank[sorted(range(len(x)), key=lambda i: (vec_id[i] is None, vec_id[i] or 0, uid[i]))] = np.arange(len(x))


def search(tile: Tile, block: Block, k: int, same_label: bool) -> tuple[list[list[Best]], int]:
    """For each anchor and each of its windows (lowest, highest), the ``k`` first candidates in it that have the same
    label (other rows only) or another one; and how many scores were computed."""
    found = [[Best(k) for _ in w] for w in tile.windows]
    scored = 0
    limit = np.sqrt((tile.x**2).sum(axis=1)).max(initial=0.0) * block.norm.max(initial=0.0)
    exact = limit < _EXACT
    for s in range(0, len(block.x), SLICE):
        part = slice(s, s + SLICE)
        x, norm, uid, label = block.x[part], block.norm[part], block.uid[part], block.label[part]
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for at in tile.order.tolist():
            p = int(tile.parent[at])
            if p >= 0:
                # A little wider than the exact bound, for rounding.
                reach = tile.edge[at] * norm * (1 + 1e-9) + 1.0
                lo, hi = low[p] - reach, high[p] + reach
            else:
                lo, hi = np.full(len(x), -np.inf), np.full(len(x), np.inf)
            fits = (label == tile.label[at]) & (uid != tile.uid[at]) if same_label else label != tile.label[at]
            need = np.zeros(len(x), bool)
            for (a, b), best in zip(tile.windows[at], found[at], strict=True):
                need |= (hi >= max(a, best.least)) & (lo <= b)
            need &= fits
            if p < 0:
                need[:] = True  # the root's scores bound all others
            which = np.flatnonzero(need)
            if len(which):
                got = _scores(x, which, tile.x[at], exact)
                scored += len(which)
                lo[which] = hi[which] = got
                ok = fits[which]
                for (a, b), best in zip(tile.windows[at], found[at], strict=True):
                    inside = np.flatnonzero(ok & (got >= max(a, best.least)) & (got <= b))
                    if len(inside):
                        best.offer(got[inside], which[inside] + s, block.rank)
            if tile.has_child[at]:
                low[at], high[at] = lo, hi
    return found, scored


def _scores(x: np.ndarray, which: np.ndarray, anchor: np.ndarray, exact: bool) -> np.ndarray:
    if exact:  # every partial sum is below the product of the norms
        return (x if len(which) == len(x) else x[which]) @ anchor
    whole = [int(v) for v in anchor.tolist()]
    got = [sum(int(c) * v for c, v in zip(row, whole, strict=True)) for row in x[which].tolist()]
    if got and max(map(abs, got)) >= _EXACT:
        raise OverflowError("a score exceeds 2**53")
    return np.array(got, np.float64)


# ---------------------------------------------------------------------------------------------
# Tables


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _tiles(anchors: DataFrame, tile: int, width: int) -> DataFrame:
    """``tile``, ``uid``, ``lab``, ``x`` (arrays), ``tree_order``, ``parent``, ``edge``: anchors in tiles and their trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, rows, n = TaskContext.get().partitionId() << 32, [], 0

        def emit(some):
            x = _matrix([r["x"] for r in some], width)
            order, parent, edge = least_tree(x)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([task + n], pa.int64()), pa.array([[r["uid"] for r in some]], pa.list_(pa.int64())),
                    pa.array([[r["lab"] for r in some]], pa.list_(pa.int64())), pa.array([x.astype("<f8").tobytes()], pa.binary()),
                    pa.array([order.tolist()], pa.list_(pa.int32())), pa.array([parent.tolist()], pa.list_(pa.int32())),
                    pa.array([edge.tolist()], pa.list_(pa.float64())),
                ],
                ["tile", "uids", "labs", "x", "tree_order", "parent", "edge"],
            )

        for b in batches:
            rows += b.to_pylist()
            while len(rows) >= tile:
                yield emit(rows[:tile])
                rows, n = rows[tile:], n + 1
        if rows:
            yield emit(rows)

    shape = "tile long, uids array<long>, labs array<long>, x binary, tree_order array<int>, parent array<int>, edge array<double>"
    return map_batches(anchors.select("uid", "lab", "x"), run, shape)


_FOUND = "anchor long, window int, row long, vec_id long, score long, block long, scored long"


def _walk(rows: DataFrame, tiles: DataFrame, blocks: int, width: int, k: int, same_label: bool) -> DataFrame:
    """For each anchor (uid) and window the ``k`` first rows of every block: every tile meets every block once."""
    void = F.lit(None)
    tile_cols = {"tile": "long", "uids": "array<long>", "labs": "array<long>", "tx": "binary", "tree_order": "array<int>", "parent": "array<int>", "edge": "array<double>", "windows": "array<array<array<double>>>"}
    row_cols = {"uid": "long", "vec_id": "long", "lab": "long", "x": "array<double>"}
    visits = tiles.withColumnRenamed("x", "tx").select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), *tile_cols, *[void.cast(t).alias(c) for c, t in row_cols.items()]
    )
    cands = rows.select("block", *[void.cast(t).alias(c) for c, t in tile_cols.items()], *row_cols)
    dealt = cands.unionByName(visits).repartition("block").sortWithinPartitions("block", F.col("tile").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for b in batches:
            for r in b.to_pylist():
                if r["block"] != at:
                    at, held, block = r["block"], [], None
                if r["tile"] is None:
                    held.append((r["uid"], r["vec_id"], r["lab"], np.array(r["x"], np.float64)))
                    continue
                if block is None:
                    block = Block(
                        _matrix([h[3] for h in held], width), np.array([h[2] for h in held], np.int64),
                        np.array([h[0] for h in held], np.int64), [h[1] for h in held],
                    )
                    held = []
                x = np.frombuffer(r["tx"], "<f8").reshape(len(r["uids"]), -1) if r["uids"] else np.zeros((0, 0))
                windows = r["windows"] or [[[-np.inf, np.inf]]] * len(r["uids"])
                tile = Tile(
                    x, np.array(r["labs"], np.int64), np.array(r["uids"], np.int64), np.array(r["tree_order"], np.int64),
                    np.array(r["parent"], np.int64), np.array(r["edge"]), windows,
                )
                found, scored = search(tile, block, k, same_label)
                out = [
                    (u, w, int(block.uid[i]), block.vec_id[i], int(s))
                    for u, per in zip(r["uids"], found, strict=True) for w, best in enumerate(per) for s, i in zip(best.score, best.row, strict=True)
                ]
                cols = list(zip(*out, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
                arrays += [pa.array([at] * len(out), pa.int64()), pa.array([scored] * len(out), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["anchor", "window", "row", "vec_id", "score", "block", "scored"])

    return map_batches(dealt, run, _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` first of every anchor and window over all blocks, with ``rank`` from 1: in groups of blocks, then altogether."""
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("row")]
    some = Window.partitionBy("anchor", "window", "part").orderBy(*order)
    every = Window.partitionBy("anchor", "window").orderBy(*order)
    out = found.withColumn("part", F.pmod("block", F.lit(64))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    return out.withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    tile: int = TILE,
    block: int | None = None,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``vec_col`` holds integers; a score is an inner product, exact up to 2**53 (beyond that, an error). Rows take part if ``usable``.
    Anchors are the rows for which ``is_anchor`` holds; their positives are the first ``positives`` other rows of their label. For each, the
    first ``negatives`` rows of other labels with low * positive <= 100 * score <= high * positive (percentages) return. Higher scores come
    first, ties by smaller id, NULL ids last. A row repeated is a row of its own, an anchor
    excepts only itself. Shorter vectors are filled with zeros; empty ones score 0. An anchor without positives, or a positive
    without negatives, returns nothing; so does an empty table. Other columns are not read.
    """
    kept = df.where(usable(df, vec_col, label_col)).select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("lab"),
        F.col(vec_col).cast("array<double>").alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    rows = stored(kept, "vectors")
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    least, most = BLOCK_ROWS
    blocks, width = max(1, -(-n // (block or min(most, max(least, n // BLOCKS))))), width or 0
    rows = rows.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)))
    anchors = rows.where("anchor")
    parts = max(1, -(-anchors.count() // (8 * tile)))
    near = anchors.repartitionByRange(parts, "lab", F.element_at(F.concat("x", F.array(F.lit(0.0))), 1), "uid")
    tiles = stored(_tiles(near.sortWithinPartitions("lab", "uid"), tile, width), "anchor-tiles")
    none = tiles.withColumn("windows", F.lit(None).cast("array<array<array<double>>>"))
    liked = stored(_first(_walk(rows, none, blocks, width, positives, True), positives), "positives")
    windowed = _with_windows(tiles, liked, low, high)
    got = _first(_walk(rows, windowed, blocks, width, negatives, False), negatives)
    pos = liked.select("anchor", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = got.select("anchor", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(pos, ["anchor", "window"])
    ids = anchors.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return out.join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _with_windows(tiles: DataFrame, liked: DataFrame, low: int, high: int) -> DataFrame:
    """Tiles with, for each anchor, a window of scores for each of its positives."""
    p = F.col("score")
    # ceil(low * p / 100) and floor(high * p / 100) in whole numbers.
    least = -F.floor((-p * low - F.pmod(-p * low, F.lit(100))) / 100)
    most = F.floor((p * high - F.pmod(p * high, F.lit(100))) / 100)
    span = F.array(least.cast("double"), most.cast("double"))
    own = liked.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", span.alias("span")))).alias("w"))
    own = own.select("anchor", F.transform("w", lambda s: s["span"]).alias("w"))
    at = tiles.select("tile", F.posexplode("uids").alias("place", "anchor")).join(own, "anchor", "left")
    empty = F.array().cast("array<array<double>>")
    at = at.groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("w", empty).alias("w")))).alias("w"))
    at = at.select("tile", F.transform("w", lambda s: s["w"]).alias("windows"))
    return stored(tiles.join(at, "tile"), "anchor-windows")
