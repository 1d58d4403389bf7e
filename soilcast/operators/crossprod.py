"""Pairwise-complete cross products of many columns: blocks of sums, merged by block.

Each task adds up, for each group and block of columns, how many rows hold both columns, and the sums, squares and products over these
rows. A block is a few matrix products of a batch's values and of its presence mask, so the plan has one step however many pairs there
are, and a row of the shuffle is one block. Values are shifted by the column mean first, which keeps the sums small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soilcast.session import ship

#: Columns of a block.
BLOCK = 64
#: Groups whose sums a task holds before it hands them on.
HELD_GROUPS = 32
#: Sums of a block: rows with both, sums of the row column and of the column column, their squares, products.
_KINDS = 6


def _blocks(p: int, size: int) -> list[tuple[int, int]]:
    n = -(-p // size)
    return [(i, j) for i in range(n) for j in range(i, n)]


def block_sums(x: np.ndarray, blocks: list[tuple[int, int]], size: int) -> dict[tuple[int, int], np.ndarray]:
    """The sums of each block over the rows of ``x`` (NaN: missing)."""
    here = ~np.isnan(x)
    mask, v = here.astype(float), np.where(here, x, 0.0)
    sq = v * v
    out = {}
    for i, j in blocks:
        a, b = slice(i * size, (i + 1) * size), slice(j * size, (j + 1) * size)
        out[i, j] = np.stack([mask[:, a].T @ mask[:, b], v[:, a].T @ mask[:, b], mask[:, a].T @ v[:, b], sq[:, a].T @ mask[:, b], mask[:, a].T @ sq[:, b], v[:, a].T @ v[:, b]])
    return out


def pair_moments(df: DataFrame, cols: dict[str, Column], by: list[str], block: int = BLOCK, held_groups: int = HELD_GROUPS) -> DataFrame:
    """by…, ``x``, ``y`` (places in ``cols``, x < y), ``n``, ``sxx``, ``syy``, ``sxy``: the centred sums over rows where both are present."""
    ship(df.sparkSession)
    p, names = len(cols), [f"_v{i}" for i in range(len(cols))]
    rows = df.select(*by, *[c.cast("double").alias(n) for c, n in zip(cols.values(), names, strict=True)])
    first = rows.agg(*[F.avg(F.when(~F.isnan(n), F.col(n))).alias(n) for n in names]).first() if p else []
    shift = np.array([0.0 if v is None or not np.isfinite(v) else v for v in first])
    blocks = _blocks(p, block)
    key = rows.select(*by).schema
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key.fields)
    shape = (kept + ", " if by else "") + "bi int, bj int, sums binary"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict[tuple[int, int], np.ndarray]] = {}
        kinds = None
        for b in batches:
            kinds = [b.schema.field(c).type for c in by]
            x = np.column_stack([b.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names]) - shift
            groups: dict[tuple, list[int]] = {}
            for i, g in enumerate(zip(*(b.column(c).to_pylist() for c in by), strict=True) if by else [()] * b.num_rows):
                groups.setdefault(g, []).append(i)
            for g, at in groups.items():
                got = block_sums(x[at], blocks, block)
                old = held.get(g)
                held[g] = got if old is None else {k: old[k] + v for k, v in got.items()}
                if len(held) > held_groups:
                    yield _packed(held, kinds)
                    held = {}
        if held:
            yield _packed(held, kinds)

    def _packed(held, kinds) -> pa.RecordBatch:
        flat = [(g, i, j, s) for g, per in held.items() for (i, j), s in per.items()]
        keys = [pa.array([r[0][k] for r in flat], t) for k, t in enumerate(kinds)]
        rest = [pa.array([r[1] for r in flat], pa.int32()), pa.array([r[2] for r in flat], pa.int32()), pa.array([r[3].astype("<f8").tobytes() for r in flat], pa.binary())]
        return pa.RecordBatch.from_arrays([*keys, *rest], [*by, "bi", "bj", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, kinds = None, None, None
        for b in batches:
            kinds = [b.schema.field(c).type for c in by]
            for r in b.to_pylist():
                own = (tuple(r[c] for c in by), r["bi"], r["bj"])
                s = np.frombuffer(r["sums"], "<f8")
                if own != at:
                    if at is not None:
                        yield _pairs(at, total, kinds)
                    at, total = own, s
                else:
                    total = total + s
        if at is not None:
            yield _pairs(at, total, kinds)

    def _pairs(own, total, kinds) -> pa.RecordBatch:
        g, bi, bj = own
        n, sx, sy, xx, yy, xy = total.reshape(_KINDS, min(block, p - bi * block), -1)
        i, j = np.indices(n.shape)
        i, j = i + bi * block, j + bj * block
        with np.errstate(divide="ignore", invalid="ignore"):
            cells = [n, xx - sx * sx / n, yy - sy * sy / n, xy - sx * sy / n]
        up = i < j
        cols_ = [pa.array([g[k]] * int(up.sum()), t) for k, t in enumerate(kinds)]
        out = [pa.array(i[up].astype(np.int32)), pa.array(j[up].astype(np.int32)), pa.array(cells[0][up].astype(np.int64))]
        out += [pa.array(np.where(n[up] > 0, np.maximum(c[up], 0.0) if k < 2 else c[up], np.nan)) for k, c in enumerate(cells[1:])]
        return pa.RecordBatch.from_arrays([*cols_, *out], [*by, "x", "y", "n", "sxx", "syy", "sxy"])

    keys = [*by, "bi", "bj"]
    dealt = rows.mapInArrow(partial, shape).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(merge, (kept + ", " if by else "") + "x int, y int, n long, sxx double, syy double, sxy double")
