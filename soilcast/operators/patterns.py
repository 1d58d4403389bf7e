"""Rows compressed by their gaps, for chained regressions over any number of columns.

Rows with the same gaps go through the same regressions, so all their sums and cross products follow from a triangular factor of the
matrix [1, values]: as many rows as it has observed columns and one more, or fewer where there are fewer rows. The factor's rows are
moved on like rows of the data, with their first cell in the place of 1. The table is never larger than the values it stands for.

A pass gives the cross products of a block of columns' rows by which of the block are missing. Only cells of the block change while the
block is worked through, so these few matrices are all that its regressions need, one after another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soilcast.session import ship

#: Bytes of factors that a task holds before it hands them on, and of the cross products of one block.
HELD_BYTES = 32 << 20
BLOCK_BYTES = 1 << 20
#: Bytes of a batch of factors.
BATCH_BYTES = 4 << 20

_SHAPE = "gaps binary, factor binary"


def column_blocks(p: int, limit: int = BLOCK_BYTES) -> list[list[int]]:
    """The columns in order, cut so that the cross products of one block stay within ``limit`` bytes."""
    kinds = max(2, limit // (8 * (p + 1) ** 2))
    size = min(p, kinds.bit_length() - 1)
    return [list(range(i, min(i + size, p))) for i in range(0, p, size)]


def factor(m: np.ndarray) -> np.ndarray:
    """Rows with the cross products of ``m``, at most one for each column of ``m`` that is not all zero."""
    used = np.flatnonzero(m.any(axis=0))
    if len(m) <= len(used):
        return m
    out = np.zeros((len(used), m.shape[1]))
    out[:, used] = np.linalg.qr(m[:, used], mode="r")
    return out


def move(m: np.ndarray, missing: np.ndarray, steps: list[tuple[int, np.ndarray]]) -> None:
    """Refill in place: ``steps`` are (column, coefficients of the first cell and of every column)."""
    for j, coef in steps:
        at = missing[:, j]
        m[at, 1 + j] = m[at] @ coef


def _by_kind(kind: np.ndarray) -> Iterator[np.ndarray]:
    """The places of each different value (or row) of ``kind``."""
    if not len(kind):
        return
    _, at = np.unique(kind, axis=0, return_inverse=True)
    at = at.reshape(-1)
    order = np.argsort(at, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(at[order])) + 1)


class _Held:
    """Rows by gaps, compressed now and then."""

    def __init__(self, width: int):
        self.width, self.rows, self.size = width, {}, 0

    def add(self, gaps: bytes, m: np.ndarray) -> None:
        parts = self.rows.setdefault(gaps, [])
        parts.append(m)
        self.size += m.nbytes
        if sum(map(len, parts)) > 2 * self.width:
            before = sum(x.nbytes for x in parts)
            self.rows[gaps] = [factor(np.concatenate(parts))]
            self.size += self.rows[gaps][0].nbytes - before

    def pop(self) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for gaps, parts in self.rows.items():
            out.append((gaps, factor(np.concatenate(parts)).astype("<f8").tobytes()))
            size += len(out[-1][1])
            if size > BATCH_BYTES:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)
        self.rows, self.size = {}, 0


def _batch(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], ["gaps", "factor"])


def _unpacked(b: pa.RecordBatch, p: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Places of each row's factor, all factors' rows in one matrix, and which of their cells are gaps."""
    parts = [np.frombuffer(r, "<f8").reshape(-1, p + 1) for r in b.column("factor").to_pylist()]
    gaps = np.frombuffer(b"".join(b.column("gaps").to_pylist()), np.uint8).reshape(b.num_rows, -1)
    lens = [len(x) for x in parts]
    missing = np.unpackbits(gaps, axis=1, count=p).astype(bool)
    places = np.split(np.arange(sum(lens)), np.cumsum(lens)[:-1])
    return places, np.concatenate(parts), np.repeat(missing, lens, axis=0)


def compress(df: DataFrame, cols: list[Column], means: list[float], held_bytes: int = HELD_BYTES) -> DataFrame:
    """One row per set of gaps: ``gaps`` (a bit a column) and ``factor``, the factor of [1, column - mean], 0 in the gaps.

    NULL and NaN are gaps. Tasks compress their rows first, so a set of gaps with most of the rows sends one factor a task. No rows give no row.
    """
    ship(df.sparkSession)
    p, names = len(cols), [f"_v{i}" for i in range(len(cols))]
    rows = df.select(*[c.cast("double").alias(n) for c, n in zip(cols, names, strict=True)])
    shift = np.array(means)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(p + 1)
        for b in batches:
            x = np.column_stack([b.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names]) - shift
            missing = np.isnan(x)
            m = np.column_stack([np.ones(len(x)), np.where(missing, 0.0, x)])
            gaps = np.packbits(missing, axis=1)
            for at in _by_kind(gaps):
                held.add(gaps[at[0]].tobytes(), m[at])
            if held.size > held_bytes:
                yield from held.pop()
        yield from held.pop()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = _Held(p + 1), None
        for b in batches:
            for gaps, raw in zip(b.column("gaps").to_pylist(), b.column("factor").to_pylist()):
                if gaps != last and held.size > BATCH_BYTES:
                    yield from held.pop()
                held.add(gaps, np.frombuffer(raw, "<f8").reshape(-1, p + 1))
                last = gaps
        yield from held.pop()

    dealt = rows.mapInArrow(partial, _SHAPE).repartition("gaps").sortWithinPartitions("gaps")
    return dealt.mapInArrow(merge, _SHAPE)


def moved(state: DataFrame, p: int, steps: list[tuple[int, np.ndarray]]) -> DataFrame:
    """``state`` with its gaps refilled by ``steps``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                places, m, missing = _unpacked(b, p)
                move(m, missing, steps)
                yield _batch([(g, m[at].astype("<f8").tobytes()) for g, at in zip(b.column("gaps").to_pylist(), places)])

    return state.mapInArrow(run, _SHAPE)


def block_products(state: DataFrame, p: int, block: list[int], steps: list[tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Cross products of [1, values] after ``steps``, by which columns of ``block`` are missing (bit i: its i-th column).

    At most 2^len(block) matrices, within ``BLOCK_BYTES`` for blocks of ``column_blocks``; added up on executors before they come here.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            _, m, missing = _unpacked(b, p)
            move(m, missing, steps)
            kind = missing[:, block] @ (1 << np.arange(len(block)))
            for at in _by_kind(kind):
                g = m[at].T @ m[at]
                k = int(kind[at[0]])
                total[k] = total[k] + g if k in total else g
        yield _packed(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column("kind").to_pylist(), b.column("sums").to_pylist()):
                g = np.frombuffer(raw, "<f8")
                total[k] = total[k] + g if k in total else g
        yield _packed(total)

    def _packed(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        raw = [g.astype("<f8").tobytes() for g in total.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(raw, pa.binary())], ["kind", "sums"])

    shape = "kind long, sums binary"
    rows = state.mapInArrow(sums, shape).repartition(F.col("kind")).mapInArrow(merge, shape).collect()
    return {r["kind"]: np.frombuffer(bytes(r["sums"]), "<f8").reshape(p + 1, p + 1) for r in rows}
