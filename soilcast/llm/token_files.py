"""Token ids in files: canonical length-limited Huffman codes in independent blocks.

Global counts of the ids give code lengths (package-merge, at most ``LIMIT`` bits); canonical codes
follow from the lengths alone, which the codebook stores. Documents in id order are packed into blocks
that decode by themselves; a block lists the bit offset of every ``EVERY``-th id, and a decoder reads from
all these offsets at once through one table of ``2 ** LIMIT`` entries.

A dataset is a folder: ``codebook`` (id, length) and ``blocks``, with one folder per shard (``shard=N``, in
ascending document order); both are Parquet containers, so they live wherever Spark can write.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import LEAF, sliced, encoder
from .common import map_batches, scratch, stored

#: Greatest code length in bits.
LIMIT = 18
#: Pieces whose ids a worker keeps.
KEPT_PIECES = 400_000
#: Ids between two checkpoints of a block.
EVERY = 256
#: Ids after which a block is closed; a document never leaves its block.
BLOCK_IDS = 1 << 18

BLOCKS = (
    "shard int, block long, start long, doc_ids array<long>, n_tokens array<int>, checkpoints array<int>, "
    "n_bits long, payload binary"
)


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive ``counts`` (package-merge)."""
    n = len(counts)
    if n == 0:
        return np.zeros(0, np.uint8)
    if n > 1 << limit:
        raise ValueError("more symbols than codes of the greatest length")
    order = np.argsort(counts, kind="stable")
    weights = np.asarray(counts, np.float64)[order]
    lengths = np.zeros(n, np.uint8)
    if n == 1:
        return np.ones(1, np.uint8)
    packages, levels = np.zeros(0), []
    for _ in range(limit):
        both = np.concatenate([weights, packages])
        by = np.argsort(both, kind="stable")
        levels.append(by < n)
        merged = both[by]
        pairs = len(merged) // 2
        packages = merged[0 : 2 * pairs : 2] + merged[1 : 2 * pairs : 2]
    need = 2 * n - 2
    for leaf in reversed(levels):  # the lightest items of each level; leaves come in order of weight
        k = int(leaf[:need].sum())
        lengths[:k] += 1
        need = 2 * (need - k)
    out = np.zeros(n, np.uint8)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes: shorter first, then by id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, limit: int = LIMIT):
        if not 1 <= limit <= 25 or len(ids) and int(np.max(ids)) >= 1 << 27:
            raise ValueError("codes of at most 25 bits for ids below 2**27")
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths, self.limit = np.asarray(ids)[order].astype(np.int64), np.asarray(lengths)[order].astype(np.int64), limit
        width = np.left_shift(np.int64(1), limit - self.lengths)  # of each code in the decoding table
        starts = np.cumsum(width) - width
        self.codes = (starts >> (limit - self.lengths)).astype(np.uint64)
        self._width = width
        self._encode: tuple[np.ndarray, np.ndarray] | None = None
        self._decode: np.ndarray | None = None

    def encode(self, ids: np.ndarray, every: int = EVERY) -> tuple[bytes, int, np.ndarray]:
        """Payload, its number of bits, and the bit offset of every ``every``-th id."""
        if self._encode is None:
            size = int(self.ids.max(initial=0)) + 1
            codes, lengths = np.zeros(size, np.uint64), np.zeros(size, np.int64)
            codes[self.ids], lengths[self.ids] = self.codes, self.lengths
            self._encode = codes, lengths
        codes, lengths = self._encode
        size = lengths[ids]
        ends = np.cumsum(size)
        at = ends - size
        n_bits = int(ends[-1]) if len(ends) else 0
        words = np.zeros(n_bits // 64 + 2, np.uint64)
        word, room = at >> 6, 64 - (at & 63)
        over = size - room  # bits that do not fit the word they begin in
        value = codes[ids]
        high = value << np.maximum(-over, 0).view(np.uint64)
        spill = np.flatnonzero(over > 0)
        high[spill] = value[spill] >> over[spill].view(np.uint64)
        if len(ids):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[first]] = np.add.reduceat(high, first)  # bits of different codes never overlap
            words[word[spill] + 1] += value[spill] << (64 - over[spill]).view(np.uint64)
        return words.astype(">u8").tobytes()[: (n_bits + 7) // 8], n_bits, at[::every]

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int, every: int = EVERY) -> np.ndarray:
        """The ``n`` ids of a block, all checkpoints read side by side."""
        if self._decode is None:
            table = np.repeat((self.ids << 5) | self.lengths, self._width)
            self._decode = np.concatenate([table, np.full((1 << self.limit) - len(table), 1)]).astype(np.uint32)
        raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        top, mask = 32 - self.limit, (1 << self.limit) - 1
        bit = np.array(checkpoints, np.int64)
        out = np.empty((every, len(bit)), np.uint32)
        for k in range(min(every, n)):
            byte = np.minimum(bit >> 3, len(window) - 1)
            entry = self._decode[(window[byte] >> (top - (bit & 7)).astype(np.uint32)) & mask]
            out[k] = entry >> 5
            bit += entry & 31
        return out.T.reshape(-1)[:n]


def tokenised(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str, leaf: int) -> DataFrame:
    """Documents in ascending id order as ``shard``, ``at`` (ids before it in the shard), ``doc_id``, ``n_tokens``
    and ``raw`` (its ids in 2 or 4 bytes each), written to the shared folder."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    # Equal ids follow in order of a hash of the text, which also splits a hot id over ranges.
    order = ["doc_id", "tie"]
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, at = encoder(path, leaf, KEPT_PIECES), TaskContext.get().partitionId(), 0
        small = max(enc.vocab_size, end_id + 1) <= 1 << 16
        for b in sliced(batches):
            ids, ends = enc.encode_all(b.column("text").to_pylist())
            ids = np.insert(ids, ends, end_id).astype("<u2" if small else "<u4")
            n = np.diff(ends, prepend=0) + 1
            starts = at + np.cumsum(n) - n
            raw, cut = ids.tobytes(), (np.cumsum(n) * ids.itemsize).tolist()
            raws = [raw[s:e] for s, e in zip([0, *cut], cut, strict=False)]
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(n), pa.int32()), pa.array(starts), b.column("doc_id"), pa.array(n), pa.array(raws, pa.binary())],
                ["shard", "at", "doc_id", "n_tokens", "raw"],
            )

    spark = docs.sparkSession
    shape = "shard int, at long, doc_id long, n_tokens long, raw binary"
    where = scratch(spark, "token-rows")
    map_batches(rows, run, shape).write.option("compression", "zstd").parquet(where)
    return spark.read.schema(shape).parquet(where)


def _unpack(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if n and len(raw) == 2 * n else "<u4")


def id_counts(rows: DataFrame) -> DataFrame:
    """``id``, ``n`` over all documents; each task sends one row per distinct id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for b in batches:
            raws, n = b.column("raw").to_pylist(), b.column("n_tokens").to_numpy()
            got = np.bincount(_unpack(b"".join(raws), int(n.sum())))
            if len(got) > len(total):
                total = np.pad(total, (0, len(got) - len(total)))
            total[: len(got)] += got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], ["id", "n"])

    return map_batches(rows.select("raw", "n_tokens"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(
    docs: DataFrame,
    path: str,
    folder: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = LIMIT,
    every: int = EVERY,
    block_ids: int = BLOCK_IDS,
    leaf: int = LEAF,
) -> None:
    """Write the ids of every whole text of ``docs`` under the tokenizer file at ``path``, each document
    ended by ``end_id``, in ascending id order (NULL first, equal ids in order of a hash of the text) to
    ``folder``. NULL and empty texts give the end id alone; an empty table an empty dataset.
    """
    spark = docs.sparkSession
    rows = tokenised(docs, path, end_id, id_col, text_col, leaf)
    # One row per id of the vocabulary at most.
    counted = id_counts(rows).toPandas().sort_values("id")
    ids, counts = counted["id"].to_numpy(np.int64), counted["n"].to_numpy(np.int64)
    lengths = code_lengths(counts, limit)
    pairs = [(int(i), int(n)) for i, n in zip(ids, lengths, strict=True)]
    spark.createDataFrame(pairs, "id long, length int").coalesce(1).write.parquet(f"{folder}/codebook")
    book = spark.sparkContext.broadcast((ids, lengths))  # bounded by the vocabulary

    per_shard = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    offsets = per_shard.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # One row of two numbers per shard, that is per task: fit to broadcast, and rows keep their order.
    placed = rows.join(F.broadcast(stored(offsets, "shard-offsets")), "shard").select(
        "shard", (F.col("offset") + F.col("at")).alias("start"), "doc_id", "n_tokens", "raw"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Codebook(*book.value, limit)
        held: list[tuple[int, int, int | None, int, bytes]] = []

        def block() -> pa.RecordBatch:
            data = np.concatenate([_unpack(r[4], r[3]) for r in held]).astype(np.int64)
            payload, n_bits, points = code.encode(data, every)
            row = {
                "shard": held[0][0], "block": held[0][1], "start": held[0][1], "doc_ids": [r[2] for r in held],
                "n_tokens": [r[3] for r in held], "checkpoints": points.tolist(), "n_bits": n_bits, "payload": payload,
            }
            held.clear()
            return pa.RecordBatch.from_pylist([row], _SCHEMA)

        n, follows = 0, None
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (n >= block_ids or (r[0], r[1]) != follows):
                    yield block()
                    n = 0
                held.append(r)
                n += r[3]
                follows = (r[0], r[1] + r[3])
        if held:
            yield block()

    map_batches(placed, run, BLOCKS).write.partitionBy("shard").option("compression", "uncompressed").parquet(f"{folder}/blocks")


_SCHEMA = pa.schema(
    [
        ("shard", pa.int32()), ("block", pa.int64()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("n_tokens", pa.list_(pa.int32())), ("checkpoints", pa.list_(pa.int32())), ("n_bits", pa.int64()), ("payload", pa.binary()),
    ]
)


def _read_blocks(spark: SparkSession, folder: str) -> tuple[DataFrame, object]:
    book = spark.read.schema("id long, length int").parquet(f"{folder}/codebook").toPandas()
    shared = spark.sparkContext.broadcast((book["id"].to_numpy(np.int64), book["length"].to_numpy(np.int64)))
    return spark.read.schema(BLOCKS).parquet(f"{folder}/blocks"), shared


def _decoded(batches: Iterator[pa.RecordBatch], book, limit: int, every: int) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
    code = Codebook(*book.value, limit)
    for b in batches:
        for i in range(b.num_rows):
            n = np.asarray(b.column("n_tokens")[i].values.to_numpy(zero_copy_only=False), np.int64)
            points = b.column("checkpoints")[i].values.to_numpy(zero_copy_only=False)
            ids = code.decode(b.column("payload")[i].as_py(), points, int(n.sum()), every)
            yield b.column("start")[i].as_py(), b.column("doc_ids")[i].as_py(), n, ids


def read_tokens(spark: SparkSession, folder: str, limit: int = LIMIT, every: int = EVERY) -> DataFrame:
    """``doc_id``, ``start``, ``ids`` of a dataset."""
    blocks, book = _read_blocks(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for start, docs, n, ids in _decoded(batches, book, limit, every):
            ends = np.concatenate([[0], np.cumsum(n)])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends[:-1]), lists], ["doc_id", "start", "ids"])

    return map_batches(blocks, run, "doc_id long, start long, ids array<int>")


def read_digests(spark: SparkSession, folder: str, limit: int = LIMIT, every: int = EVERY) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers)
    of a dataset, from its decoded blocks."""
    blocks, book = _read_blocks(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for start, docs, n, ids in _decoded(batches, book, limit, every):
            ends = np.concatenate([[0], np.cumsum(n)])
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(start + ends[:-1]), pa.array(n), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return map_batches(blocks, run, "doc_id long, start long, n_tokens long, ids_crc32 long")
