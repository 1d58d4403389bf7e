"""Alignment of two tokenizers by external spill counting.

Two tokenizers cut the same bytes. Places where tokens of both end cut a text into groups; every A token of a group
is linked with every B token of it. Counting in how many documents an id pair is linked takes one record for each
pair and document, far more than memory holds:

1. A task aligns a chunk of documents and deals its records by the low digits of the A id into buckets. Each bucket's
   part is a run: its pairs in side-major order (A id, then B id) with their numbers of documents, and behind them the
   documents, both compressed with zstandard.
2. Runs of a bucket (a large bucket is dealt into several lots, by chunk) are merged with a k-way heap, block by block,
   over the pairs alone. Counted lots are runs again and are merged in rounds until a bucket is one
   run. Side-major order makes an A id's pairs neighbours, so the last merge also marks its highest counts.
3. The totals of a bucket pass beside its runs once more, and each run's contributions (a sum for each document of
   its chunk) stream back to the chunk.

A chunk's documents are known by their place in it, so records hold no document ids.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, release_memory, stored
from .pretokens import Splitter

#: UTF-8 bytes of text, and documents, after which a chunk ends.
CHUNK_BYTES = 1 << 21
CHUNK_DOCS = 4096
#: Buckets: a power of two, so a bucket is the low digits of an A id.
BUCKETS = 64
#: Records in a lot, about, and counted lots that are merged into one.
LOT_RECORDS = 4_000_000
FAN_IN = 32
#: Pairs in a block of a run, and those held back before merged ones are counted.
BLOCK = 1 << 15
HELD = 1 << 20
#: Pre-tokens whose A ids a worker keeps, and the characters of each.
CACHED = 150_000
CACHED_CHARS = 64
#: Bits of an id in the order of records; no vocabulary is larger.
ID_BITS = 20
#: Links expanded at a time; beyond it a chunk's links are expanded bucket by bucket.
EXPAND = 4_000_000
_LOADED: dict[tuple[str, str], "Aligner"] = {}


def _unbyte() -> dict[str, int]:
    """Bytes of the characters of byte-level entries: printable Latin-1 stands for itself, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, the bytes of their ids, and what is derived from them."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.split = Splitter(a_path, plain_special=True)
        self.a = self.split.tokenizer
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        unbyte = _unbyte()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            chars = [unbyte.get(c) for c in token]
            self.a_bytes[i] = token.encode() if None in chars else bytes(chars)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << ID_BITS:
            raise ValueError(f"vocabularies of over 2**{ID_BITS} ids are not supported")
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self.digits = {s: np.array([f"{i}{s}" for i in range(max(len(self.a_bytes), len(self.b_bytes)))], "S8") for s in ",|;"}
        self.cache: dict[str, bytes] = {}

    def a_ids(self, texts: list[str]) -> list[np.ndarray]:
        """The A ids of each text, through the pre-tokens that the worker has met."""
        if len(self.cache) > CACHED:
            self.cache.clear()
        cache, lists = self.cache, []
        for t in texts:
            got = self.split.pieces(t)
            lists.append(None if got is None else [p for part in got for p in part])
        new = list({p for pieces in lists if pieces for p in pieces if p not in cache})
        # Words with a space before them are encoded as one text: no pre-token spans a space inside it.
        words = [p for p in new if p[0] == " " and p[1:].isalpha() and p.count(" ") == 1]
        long: dict[str, bytes] = {}
        for k in range(0, len(words), 4096):
            some = words[k : k + 4096]
            for p, ids in zip(some, self._together(some), strict=True):
                (cache if len(p) <= CACHED_CHARS else long)[p] = ids
        rest = [p for p in new if p not in cache and p not in long]
        for k in range(0, len(rest), 4096):
            some = rest[k : k + 4096]
            for p, ids in zip(some, self._apart(some), strict=True):
                (cache if len(p) <= CACHED_CHARS else long)[p] = ids
        out = []
        for t, pieces in zip(texts, lists, strict=True):
            if pieces is None:
                out.append(np.frombuffer(self._apart([t])[0], "<u4"))
            else:
                raw = [cache[p] if p in cache else long[p] for p in pieces] if long else map(cache.__getitem__, pieces)
                out.append(np.frombuffer(b"".join(raw), "<u4"))
        return out

    def _apart(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece; none where they do not spell it, so that its text has no tokens."""
        got = [np.array(e.ids, "<u4") for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        spelt = [b"".join(map(self.a_bytes.__getitem__, x.tolist())) == p.encode() for p, x in zip(pieces, got, strict=True)]
        return [x.tobytes() if ok else b"" for x, ok in zip(got, spelt, strict=True)]

    def _together(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece from one encoding of all, cut where the pieces end; piece by piece where it cannot be cut so."""
        ids = np.array(self.a.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum([len(p.encode()) for p in pieces])
        token_ends = np.cumsum(self.a_len[ids])
        at = np.searchsorted(token_ends, ends)
        if not len(ids) or token_ends[-1] != ends[-1] or (token_ends[at] != ends).any():
            return self._apart(pieces)
        raw, cuts = ids.tobytes(), (4 * (at + 1)).tolist()
        return [raw[s:e] for s, e in zip([0, *cuts], cuts, strict=False)]

    def tokens(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """A and B ids of each text; none where it is empty or where either side's bytes are not those of the text."""
        none = np.zeros(0, np.int64)
        some = [t for t in texts if t]
        # A's bytes are those of its pre-tokens, which make up the text; B's may differ.
        a_got, b_got = iter(self.a_ids([f" {t}" for t in some])), iter(self.b.encode(some, num_threads=1) if some else ())
        a_all, b_all = [], []
        for t in texts:
            a, b = none, none
            if t:
                a, b_list, whole = next(a_got), next(b_got), f" {t}".encode()
                if int(self.a_len[a].sum()) == len(whole) and whole == b"".join(map(self.b_bytes.__getitem__, b_list)):
                    a, b = a.astype(np.int64), np.array(b_list, np.int64)
                else:
                    a = none
            a_all.append(a)
            b_all.append(b)
        return a_all, b_all


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _LOADED:
        _LOADED.clear()
        _LOADED[a_path, b_path] = Aligner(a_path, b_path)
    return _LOADED[a_path, b_path]


class Aligned:
    """The groups and links of a chunk of documents."""

    def __init__(self, al: Aligner, texts: list[str | None]):
        a_all, b_all = al.tokens(texts)
        n = self.n_docs = len(texts)
        self.n_a = np.array([len(x) for x in a_all], np.int64)
        self.n_b = np.array([len(x) for x in b_all], np.int64)
        self.a = np.concatenate(a_all) if n else np.zeros(0, np.int64)
        self.b = np.concatenate(b_all) if n else np.zeros(0, np.int64)
        # Both sides spell the same bytes, so offsets agree over the whole chunk and documents end on common cuts.
        a_end, b_end = np.cumsum(al.a_len[self.a]), np.cumsum(al.b_len[self.b])
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        self.a_group, self.b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
        self.a_size = np.bincount(self.a_group, minlength=len(cuts))
        self.b_size = np.bincount(self.b_group, minlength=len(cuts))
        first = np.cumsum(self.a_size) - self.a_size
        doc_of_a = np.repeat(np.arange(n), self.n_a)
        self.group_doc = doc_of_a[first] if len(cuts) else np.zeros(0, np.int64)
        self.n_groups = np.bincount(self.group_doc, minlength=n)
        self.n_links = np.zeros(n, np.int64)
        np.add.at(self.n_links, self.group_doc, self.a_size * self.b_size)
        self._digits = al.digits

    def digests(self) -> list[str]:
        """sha256 of ``a1,a2|b1;a3|b2,b3`` of each document; '' without tokens."""
        a_last = np.ones(len(self.a), bool)
        a_last[:-1] = self.a_group[1:] != self.a_group[:-1]
        b_last = np.ones(len(self.b), bool)
        b_last[:-1] = self.b_group[1:] != self.b_group[:-1]
        a_text = np.where(a_last, self._digits["|"][self.a], self._digits[","][self.a])
        b_text = np.where(b_last, self._digits[";"][self.b], self._digits[","][self.b])
        b_before = np.concatenate([[0], np.cumsum(self.b_size)])
        a_to = np.concatenate([[0], np.cumsum(self.a_size)])
        text = np.zeros(len(self.a) + len(self.b), "S8")
        text[np.arange(len(self.a)) + b_before[self.a_group]] = a_text
        text[np.arange(len(self.b)) + a_to[self.b_group + 1]] = b_text
        out, at = [], 0
        for n in (self.n_a + self.n_b).tolist():
            raw = text[at : at + n].tobytes().replace(b"\0", b"")[:-1]
            out.append(hashlib.sha256(raw).hexdigest() if n else "")
            at += n
        return out

    def _side(self, group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, id, times) of the distinct ids of each group."""
        key, times = np.unique((group << 32) | ids, return_counts=True)
        return key >> 32, key & 0xFFFFFFFF, times

    def records(self, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each bucket with records: (bucket, pair, document, links), in order of pair and document; a pair
        is ``A id << 32 | B id``. Distinct ids of a group are paired with the times they occur, so a group of repeats is small."""
        ag, a, at = self._side(self.a_group, self.a)
        bg, b, bt = self._side(self.b_group, self.b)
        b_size = np.bincount(bg, minlength=len(self.a_size))
        b_first = np.cumsum(b_size) - b_size
        if int(b_size[ag].sum()) <= EXPAND:
            yield from self._expanded(ag, a, at, b, bt, b_size, b_first, buckets)
            return
        for k in range(buckets):
            own = a % buckets == k
            yield from self._expanded(ag[own], a[own], at[own], b, bt, b_size, b_first, buckets)

    def _expanded(self, ag, a, at, b, bt, b_size, b_first, buckets):
        n = b_size[ag]
        i = np.repeat(np.arange(len(ag)), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + b_first[ag[i]]
        a_id, doc = a[i], self.group_doc[ag[i]]
        # bucket, A id, B id, document: the order of runs.
        shift = max(1, int(self.n_docs - 1).bit_length())
        key = ((((a_id % buckets) << ID_BITS | a_id) << ID_BITS | b[j]) << shift) | doc
        order = np.argsort(key, kind="stable")
        key, links = key[order], (at[i] * bt[j])[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        where = np.flatnonzero(first)
        if not len(where):
            return
        links, key = np.add.reduceat(links, where), key[where]
        doc = key & ((1 << shift) - 1)
        pair = key >> shift
        low = (1 << ID_BITS) - 1
        a_id, b_id, bucket = (pair >> ID_BITS) & low, pair & low, pair >> (2 * ID_BITS)
        edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        for s, e in zip(edge, edge[1:], strict=False):
            yield int(bucket[s]), (a_id[s:e] << 32) | b_id[s:e], doc[s:e], links[s:e]


# ---------------------------------------------------------------------------------------------
# Runs


def _packed(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(x.tobytes() for x in arrays), 1)


def write_blocks(pair: np.ndarray, *more: np.ndarray) -> list[bytes]:
    """Sorted pairs and the arrays beside them as blocks, each compressed by itself."""
    out = []
    for k in range(0, len(pair), BLOCK):
        p = pair[k : k + BLOCK]
        head = np.array([len(p)], "<i8")
        body = _packed(head, np.diff(p, prepend=0).astype("<i8"), *(x[k : k + BLOCK].astype("<i8") for x in more))
        out.append(int(p[0]).to_bytes(8, "little") + body)
    return out


def first_pair(raw: bytes) -> int:
    return int.from_bytes(raw[:8], "little")


def read_block(raw: bytes, columns: int = 1) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(zstandard.decompress(raw[8:]), "<i8")
    n = int(data[0])
    return np.cumsum(data[1 : 1 + n]), *(data[1 + k * n : 1 + (k + 1) * n] for k in range(1, columns + 1))


def merged(runs: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pairs, counts) of all runs together in order of pair, each pair once, in pieces.

    A heap holds the next unread block of every run by its first pair. The block with the least first pair is read, and
    what lies before all unread blocks is complete.
    """
    heads = [(first_pair(r[0]), k, 0) for k, r in enumerate(runs) if r]
    heapq.heapify(heads)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    while heads or held:
        if heads:
            _, k, at = heapq.heappop(heads)
            pair, count = read_block(runs[k][at])
            held.append((pair, count))
            size += len(pair)
            if at + 1 < len(runs[k]):
                heapq.heappush(heads, (first_pair(runs[k][at + 1]), k, at + 1))
            if heads and size < HELD:
                continue
        pair, count = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(pair, kind="stable")
        pair, count = pair[order], count[order]
        where = np.flatnonzero(np.diff(pair, prepend=-1))
        pair, count = pair[where], np.add.reduceat(count, where)
        done = int(np.searchsorted(pair, heads[0][0])) if heads else len(pair)
        if done:
            yield pair[:done], count[:done]
        held = [(pair[done:], count[done:])] if done < len(pair) else []
        size = len(pair) - done


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def _by_group(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    from itertools import groupby

    return groupby(_rows(batches), key=lambda r: tuple(r[k] for k in keys))


def count_runs(runs: DataFrame, last: bool) -> DataFrame:
    """``bucket``, ``lot``, ``pairs``: the runs of each lot of a bucket merged into one. With ``last``, a run has a third
    column: 1 for the pairs whose count is the highest of their A id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, lot), rows in _by_group(batches, ("bucket", "lot")):
            out: list[bytes] = []
            pair, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for p, n in merged([r["pairs"] for r in rows]):
                pair, count = np.concatenate([pair, p]), np.concatenate([count, n])
                # The last A id may go on in the next piece.
                cut = int(np.searchsorted(pair >> 32, pair[-1] >> 32)) if last else len(pair)
                out += write_blocks(pair[:cut], count[:cut], *([best(pair[:cut], count[:cut])] if last else []))
                pair, count = pair[cut:], count[cut:]
            if len(pair):
                out += write_blocks(pair, count, best(pair, count))
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([lot], pa.int64()), pa.array([out], pa.list_(pa.binary()))], ["bucket", "lot", "pairs"]
            )

    dealt = runs.select("bucket", "lot", "pairs").repartition("bucket", "lot").sortWithinPartitions("bucket", "lot")
    return map_batches(dealt, run, "bucket int, lot long, pairs array<binary>")


def best(pair: np.ndarray, count: np.ndarray) -> np.ndarray:
    """1 where the count is the highest of the A id; ``pair`` is in order and holds whole A ids."""
    a = pair >> 32
    where = np.flatnonzero(np.diff(a, prepend=-1))
    top = np.maximum.reduceat(count, where) if len(where) else count
    return (count == np.repeat(top, np.diff(np.append(where, len(a))))).astype(np.int64)


def _contributions(runs: DataFrame, totals: DataFrame) -> DataFrame:
    """``chunk``, ``sums``: for each run, what its links add to the documents of its chunk. ``totals`` holds each bucket's
    merged pairs once for every lot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_group(batches, ("bucket", "lot")):
            total: tuple[np.ndarray, ...] | None = None
            for r in rows:
                if r["chunk"] is None:  # the totals come first
                    total = tuple(np.concatenate(x) for x in zip(*(read_block(x, 2) for x in r["pairs"]), strict=True))
                    continue
                at_doc = 0
                docs, links = _documents(r["docs"])
                counts, bests = np.zeros(r["n_docs"], np.int64), np.zeros(r["n_docs"], np.int64)
                for block in r["pairs"]:
                    pair, n = read_block(block)
                    to = np.searchsorted(total[0], pair)
                    k = int(n.sum())
                    d, m = docs[at_doc : at_doc + k], links[at_doc : at_doc + k]
                    at_doc += k
                    np.add.at(counts, d, m * np.repeat(total[1][to], n))
                    np.add.at(bests, d, m * np.repeat(total[2][to], n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["chunk"]], pa.int64()), pa.array([_packed(counts, bests)], pa.binary())], ["chunk", "sums"]
                )

    void = F.lit(None)
    totals = totals.select("bucket", "lot", void.cast("long").alias("chunk"), void.cast("int").alias("n_docs"), "pairs", void.cast("binary").alias("docs"))
    both = runs.select("bucket", "lot", "chunk", "n_docs", "pairs", "docs").unionByName(totals)
    dealt = both.repartition("bucket", "lot").sortWithinPartitions("bucket", "lot", F.col("chunk").asc_nulls_first())
    return map_batches(dealt, run, "chunk long, sums binary")


def _document_bytes(docs: np.ndarray, links: np.ndarray) -> bytes:
    wide = int(links.max(initial=0)) > 255
    return (b"\1" if wide else b"\0") + _packed(docs.astype("<u2"), links.astype("<i8" if wide else "u1"))


def _documents(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.decompress(raw[1:])
    each = 10 if raw[0] else 3
    n = len(data) // each
    return np.frombuffer(data, "<u2", n).astype(np.int64), np.frombuffer(data, "<i8" if raw[0] else "u1", n, 2 * n).astype(np.int64)


def _summed(parts: DataFrame) -> DataFrame:
    """``chunk``, ``place``, ``count_sum``, ``n_best`` of the documents with links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (chunk,), rows in _by_group(batches, ("chunk",)):
            total: np.ndarray | int = 0
            for r in rows:
                total = total + np.frombuffer(zstandard.decompress(r["sums"]), "<i8")
            counts, bests = total.reshape(2, -1)
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, chunk)), pa.array(np.arange(n, dtype=np.int32)), pa.array(counts), pa.array(bests)],
                ["chunk", "place", "count_sum", "n_best"],
            )

    dealt = parts.repartition("chunk").sortWithinPartitions("chunk")
    return map_batches(dealt, run, "chunk long, place int, count_sum long, n_best long")


_DOC = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string"}
_RUN = {"bucket": "int", "n_docs": "int", "n_records": "long", "pairs": "array<binary>", "docs": "binary"}


def _aligned(df: DataFrame, id_col: str, text_col: str, a_path: str, b_path: str, buckets: int, chunk_bytes: int) -> DataFrame:
    """Rows of documents (``place`` set) and of runs (``bucket`` set), of the same chunks."""
    id_type = df.schema[id_col].dataType
    names = ["chunk", "place", "doc", *_DOC, *_RUN]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
        ids, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t or "") + 64
                if size >= chunk_bytes or len(ids) >= CHUNK_DOCS:
                    yield ids, texts
                    ids, texts, size = [], [], 0
        if ids:
            yield ids, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        al = aligner(a_path, b_path)
        task = TaskContext.get().partitionId() << 32
        kinds = [pa.int64(), pa.int32(), to_arrow_type(id_type), *[pa.int64()] * 4, pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.binary()]

        def batch(n: int, **cols) -> pa.RecordBatch:
            own = [pa.array(cols[c], k) if c in cols else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(own, names)

        for k, (ids, texts) in enumerate(chunks(batches)):
            got, n = Aligned(al, texts), len(ids)
            yield batch(
                n, chunk=[task + k] * n, place=list(range(n)), doc=ids, n_a=got.n_a, n_b=got.n_b, n_groups=got.n_groups,
                n_links=got.n_links, groups_sha256=got.digests(),
            )
            for bucket, pair, doc, links in got.records(buckets):
                where = np.flatnonzero(np.diff(pair, prepend=-1))
                held = np.diff(np.append(where, len(pair)))
                yield batch(
                    1, chunk=[task + k], bucket=[bucket], n_docs=[n], n_records=[len(pair)], pairs=[write_blocks(pair[where], held)],
                    docs=[_document_bytes(doc, links)],
                )
            del got
            release_memory()

    cols = [F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("int").alias("place"), F.col(id_col).alias("doc")]
    cols += [F.lit(None).cast(t).alias(c) for c, t in (_DOC | _RUN).items()]
    return map_batches(df.select(id_col, text_col), run, df.select(*cols).schema)


def align(
    df: DataFrame,
    a_path: str,
    b_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    lot_records: int = LOT_RECORDS,
    chunk_bytes: int = CHUNK_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """(documents, pair counts).

    Documents: ``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair's count is the highest
    of its A id, ties included), ``count_sum`` (the counts of all links), ``groups_sha256``; one row per row of ``df``.
    Pair counts: ``a``, ``b``, ``n`` (documents that link the two), ``best``.

    A is a byte-level BPE file of the tokenizers library on a space and the text, B a sentencepiece model on the text; special
    strings are plain text. NULL and empty texts, and texts that either side does not spell byte for byte, have no
    tokens: zeros and an empty digest. Every row is a document, repeated rows too. Ids may be NULL. Other columns are not
    read, so their names do not matter. An empty table gives empty results. A text is aligned in one
    piece, however long; its links are expanded a bucket at a time beyond ``EXPAND``. Counts fit 64 bits.
    """
    if buckets & (buckets - 1) or not 1 <= buckets <= 512:
        raise ValueError("buckets must be a power of two up to 512")
    rows = stored(_aligned(df, id_col, text_col, a_path, b_path, buckets, chunk_bytes), "aligned")
    runs = rows.where(F.col("bucket").isNotNull())
    sizes = {r["bucket"]: r["n"] for r in runs.groupBy("bucket").agg(F.sum("n_records").alias("n")).collect()}  # ``buckets`` rows at most
    lots = [max(1, -(-sizes.get(k, 0) // lot_records)) for k in range(buckets)]
    lots_of = F.element_at(F.array(*[F.lit(n).cast("long") for n in lots]), F.col("bucket") + 1)
    runs = runs.withColumn("lot", F.pmod(F.xxhash64("chunk"), lots_of))
    most, counted = max(lots), runs
    while most > FAN_IN:
        most = -(-most // FAN_IN)
        counted = stored(count_runs(counted, last=False).withColumn("lot", F.pmod("lot", F.lit(most))), "pair-counts")
    if max(lots) > 1:
        counted = stored(count_runs(counted, last=False).withColumn("lot", F.lit(0).cast("long")), "pair-counts")
    totals = stored(count_runs(counted, last=True), "pair-totals")
    every = totals.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), lots_of - 1)).alias("lot"), "pairs")
    sums = stored(_summed(_contributions(runs, every)), "link-sums").alias("s")
    docs = rows.where(F.col("place").isNotNull()).alias("d")
    at = (F.col("d.chunk") == F.col("s.chunk")) & (F.col("d.place") == F.col("s.place"))
    zero = F.lit(0).cast("long")
    docs = docs.join(sums, at, "left").select(
        F.col("d.doc").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
    return docs, _pair_rows(totals)


def _pair_rows(totals: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            for block in r["pairs"]:
                pair, n, top = read_block(block, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((pair >> 32).astype(np.int32)), pa.array((pair & 0xFFFFFFFF).astype(np.int32)), pa.array(n), pa.array(top == 1)], ["a", "b", "n", "best"]
                )

    return map_batches(totals.select("pairs"), run, "a int, b int, n long, best boolean")
