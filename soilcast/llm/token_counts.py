"""Token counts of whole texts by a two-tier lookup, without moving pre-tokens.

A first pass over all texts keeps, in each task, a bounded summary of the frequent pre-tokens; summaries are merged
until one is left. Its pre-tokens and their lengths in tokens are a compact table that is broadcast. The second pass
adds up lengths: a pre-token in the table costs one lookup, another one is looked up in its worker's cache, and
those missing there are encoded by the library, many at a time. Table and caches only save time: the counts are
the library's whatever they hold.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, reserved, ship, stored
from .pretokens import Splitter

#: Entries of the broadcast table, and the UTF-8 bytes of each, at most: the table stays below 5 MB.
FREQUENT = 1 << 16
PIECE_BYTES = 64
#: Pre-tokens that a worker's cache holds at most.
CACHED = 200_000
#: Summaries that are merged into one.
FAN_IN = 16
#: UTF-8 bytes of text after which misses are encoded.
SLICE_BYTES = 1 << 20
_LOADED: dict[str, Splitter] = {}
_COUNTERS: dict[tuple[str, int], "Lookup"] = {}


def _splitter(path: str) -> Splitter:
    if path not in _LOADED:
        _LOADED[path] = Splitter(path, plain_special=False)
    return _LOADED[path]


def pruned(counts: Counter, most: int) -> Counter:
    """The ``most`` largest counts, each less the largest count left out: a count falls short of the true one by
    no more than total / ``most``, however many summaries are merged."""
    if len(counts) <= most:
        return counts
    top = heapq.nlargest(most + 1, counts.items(), key=lambda x: (x[1], x[0]))
    less = top[-1][1]
    return Counter({p: n - less for p, n in top[:-1] if n > less})


def _summary_row(counts: Counter, most: int) -> pa.RecordBatch:
    items = sorted(pruned(counts, most).items())
    return pa.RecordBatch.from_arrays(
        [pa.array([[p for p, _ in items]], pa.list_(pa.string())), pa.array([[n for _, n in items]], pa.list_(pa.int64()))],
        ["piece", "n"],
    )


def frequent_pieces(df: DataFrame, path: str, text_col: str = "text", most: int = FREQUENT) -> list[str]:
    """The frequent pre-tokens of all texts, at most ``most``, the commonest first; none of over ``PIECE_BYTES`` bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = _splitter(path), Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                for pieces in (split.pieces(text) if text else None) or ():
                    counts.update(pieces)
                    if len(counts) > 4 * most:
                        counts = pruned(short(counts), most)
        yield _summary_row(short(counts), most)

    def short(counts: Counter) -> Counter:
        return Counter({p: n for p, n in counts.items() if len(p) <= PIECE_BYTES and len(p.encode()) <= PIECE_BYTES})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, any_row = Counter(), False
        for b in batches:
            for pieces, n in zip(b.column("piece").to_pylist(), b.column("n").to_pylist(), strict=True):
                any_row = True
                for p, k in zip(pieces, n, strict=True):
                    counts[p] += k
                counts = pruned(counts, most)
        if any_row:
            yield _summary_row(counts, most)

    shape = "piece array<string>, n array<bigint>"
    rows = stored(map_batches(df.select(text_col), count, shape), "token-summaries")
    left = rows.count()
    while left > 1:  # a task merges FAN_IN summaries
        left = -(-left // FAN_IN)
        rows = stored(map_batches(rows.repartition(left), merge, shape), "token-summaries")
        if left > 1:
            left = rows.count()
    last = rows.first()
    if last is None:
        return []
    order = sorted(zip(last["n"], last["piece"], strict=True), key=lambda x: (-x[0], x[1]))
    return [p for _, p in order]


def packed_table(path: str, pieces: list[str]) -> bytes:
    """The table of ``pieces`` and their lengths in tokens, compressed."""
    got = _splitter(path).tokenizer.encode_batch_fast(pieces, add_special_tokens=False) if pieces else []
    raw = [p.encode() for p in pieces]
    sizes = np.array([[len(r) for r in raw], [len(e) for e in got]], "<u2").reshape(2, -1)
    return zstandard.compress(len(raw).to_bytes(4, "little") + sizes.tobytes() + b"".join(raw), 3)


def _unpacked(table: bytes) -> dict[str, int]:
    data = zstandard.decompress(table)
    n = int.from_bytes(data[:4], "little")
    sizes = np.frombuffer(data, "<u2", 2 * n, 4).reshape(2, n)
    ends = np.cumsum(sizes[0], dtype=np.int64) + 4 + 4 * n
    return {data[e - s : e].decode(): k for e, s, k in zip(ends.tolist(), sizes[0].tolist(), sizes[1].tolist(), strict=True)}


class Lookup(dict):
    """The first tier, by pre-token; what it lacks comes from the cache, or is noted and counts 0 for now."""

    def __init__(self, path: str, table: bytes, cached: int = CACHED):
        super().__init__(_unpacked(table))
        self.split, self.cached = _splitter(path), cached
        self.cache: dict[str, int] = {}
        self.missed: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self.cache.get(piece)
        if n is None:
            self.missed.append(piece)
            return 0
        return n

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        out, at, size = [0] * len(texts), 0, 0
        open_: list[tuple[int, list[str]]] = []
        get, library = self.__getitem__, self.split.tokenizer
        for at, text in enumerate(texts):
            if not text:
                continue
            lists = self.split.pieces(text)
            if lists is None:
                out[at] = len(library.encode(text, add_special_tokens=False))
                continue
            for pieces in lists:
                out[at] += sum(map(get, pieces))
                if self.missed:
                    open_.append((at, self.missed))
                    self.missed = []
                size += len(pieces)
                if size > SLICE_BYTES // 4:
                    self._settle(open_, out)
                    open_, size = [], 0
        self._settle(open_, out)
        return out

    def _settle(self, open_: list[tuple[int, list[str]]], out: list[int]) -> None:
        new = list({p for _, missed in open_ for p in missed})
        found: dict[str, int] = {}
        for k in range(0, len(new), 4096):
            some = new[k : k + 4096]
            found.update(zip(some, map(len, self.split.tokenizer.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        for at, missed in open_:
            out[at] += sum(map(found.__getitem__, missed))
        if len(self.cache) + len(found) > self.cached:
            self.cache = {}
        self.cache.update((p, n) for p, n in found.items() if len(p) <= PIECE_BYTES)


def count_tokens(
    df: DataFrame, path: str, text_col: str = "text", out_col: str = "n_tokens", frequent: int = FREQUENT, cached: int = CACHED
) -> DataFrame:
    """``df`` without its text and with ``out_col`` (long): the tokens of each whole text under the byte-level BPE file at ``path``, as the
    tokenizers library counts them without added special tokens; special strings inside a text are one token.

    NULL and empty texts have 0 tokens. Rows are independent, so repeated rows, ties and NULLs in other columns pass
    through, and an empty table gives an empty one. Very long texts are split in parts where no pre-token is cut. A
    column of ``df`` named ``out_col`` is replaced.
    """
    spark = df.sparkSession
    if out_col in df.columns and out_col != text_col:
        df = df.drop(out_col)
    spare = reserved(df, out_col)  # differs from ``out_col`` where that is the text
    keep = [c for c in df.columns if c != text_col]
    ship(spark)
    table = spark.sparkContext.broadcast(packed_table(path, frequent_pieces(df, path, text_col, frequent)))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, hash(table.value))
        if key not in _COUNTERS:
            _COUNTERS.clear()  # a worker holds one table
            _COUNTERS[key] = Lookup(path, table.value, cached)
        for b in batches:
            n = _COUNTERS[key].counts(b.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64())], [*keep, spare])

    got = map_batches(df, run, df.select(*keep, F.lit(0).cast("long").alias(spare)).schema)
    return got.withColumnRenamed(spare, out_col)
