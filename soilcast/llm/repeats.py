"""Removal of repeated byte strings (suffix-array deduplication with a minimum length).

Which strings of ``width`` bytes start in more than one place of a corpus is decided in two steps.

1. Every window of ``width`` bytes has a minimizer, the byte ``GRAM`` in it with the least hash, which depends on
   nothing but the window's bytes. Neighbouring windows mostly share it; such a run of windows is one row
   (two hashes, a document and a position), so the corpus shrinks to a row per 75 bytes or so. Equal
   windows have equal minimizers: runs with a minimizer of their own hold nothing repeated, and
   runs equal to another run as a whole are repeated as a whole.
2. What is left are runs at the edges of repeats. Their bytes are fetched, and their windows sorted
   by the half of the window that lies mostly on one side of the minimizer: equal windows share the
   minimizer and the bytes on that side, ``width - (width - GRAM) / 2`` or so in all. Windows with such a core
   in common are searched by threshold-bounded interval expansion: a suffix array and its Burrows-Wheeler
   transform, in which breadth-first backward extension sets the common prefixes of neighbours in
   increasing order and stops at ``width``; places not reached share ``width`` bytes or more.

A core met in more than ``GROUP`` different stretches is no task's group: its windows are counted one by one,
hashed, as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, reserved, stored

WIDTH = 200
GRAM = 50
#: Different runs with one minimizer that are searched together at most.
GROUP = 2000
#: Bytes searched at a time.
TEXT = 1 << 19
#: Bytes hashed at a time; longer texts are read in pieces.
PIECE = 1 << 19

_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))  # odd, so they have inverses modulo 2**64
_STEP = _U(0xD6E8FEB86659FD93)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _STEP
    x = (x ^ (x >> _U(29))) * _BASES[0]
    return x ^ (x >> _U(32))


class _Hasher:
    """Polynomial hashes, modulo 2**64, of any stretch of a piece."""

    def __init__(self, size: int):
        self.up = [_powers(b, size + 1) for b in _BASES]
        self.down = [_powers(_U(pow(int(b), -1, 1 << 64)), size + 1) for b in _BASES]

    def prefixes(self, data: np.ndarray, which: int) -> np.ndarray:
        out = np.empty(len(data) + 1, np.uint64)
        out[0] = 0
        np.cumsum((data.astype(np.uint64) + _U(1)) * self.up[which][: len(data)], out=out[1:])
        return out

    def of(self, prefixes: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        return (prefixes[end] - prefixes[start]) * self.down[which][start]


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours."""
    n = len(v) - w + 1
    padded = np.full(-(-len(v) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def _runs(data: np.ndarray, ends: np.ndarray, width: int, gram: int, hasher: _Hasher) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer in texts laid end to end: text, first and last window start
    (in ``data``), the minimizer's distance from the first, and the two hashes."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < width:
        return none
    one, two = hasher.prefixes(data, 0), hasher.prefixes(data, 1)
    at = np.arange(len(data) - gram + 1)
    grams = _mixed(hasher.of(one, at, at + gram, 0))
    least = _least((grams & ~_U((1 << 24) - 1)) | at.astype(np.uint64), width - gram + 1)
    where = (least & _U((1 << 24) - 1)).astype(np.int64)
    starts = np.arange(len(where))
    text = np.searchsorted(ends, starts, side="right")
    inside = starts + width <= ends[text]
    starts, where, text = starts[inside], where[inside], text[inside]
    if not len(starts):
        return none
    new = np.ones(len(starts), bool)
    new[1:] = (where[1:] != where[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    lo, hi, m = starts[first], starts[last], where[first]
    shape = ((m - lo) * 4096 + (hi - lo)).astype(np.uint64)
    return text[first], lo, hi, m - lo, grams[m], _mixed(hasher.of(two, lo, hi + width, 1) + shape * _STEP)


def window_runs(docs: DataFrame, doc_key: str, check: str, bytes_col: str, width: int, gram: int) -> DataFrame:
    """``gram``, ``run`` (hashes), ``doc`` (``doc_key``), ``place``: the number of further windows in the low 8 bits, the
    minimizer's distance from the first window's start in the next 8, that start in 32, ``check`` in 15."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher(PIECE + width)

        def rows(parts: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
            data = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
            sizes = np.array([len(p[3]) for p in parts])
            ends = np.cumsum(sizes)
            text, lo, hi, m, g, r = _runs(data, ends, width, gram, hasher)
            begin = np.array([p[2] for p in parts], np.int64) - (ends - sizes)  # place in the document
            key = np.array([p[0] for p in parts], np.int64)[text]
            place = (np.array([p[1] for p in parts], np.int64)[text] << 48) | ((lo + begin[text]) << 16) | (m << 8) | (hi - lo)
            return pa.RecordBatch.from_arrays(
                [pa.array(g.view(np.int64)), pa.array(r.view(np.int64)), pa.array(key), pa.array(place)], ["gram", "run", "doc", "place"]
            )

        for b in batches:
            parts, held = [], 0
            for key, chk, raw in zip(b.column(doc_key).to_pylist(), b.column(check).to_pylist(), b.column(bytes_col).to_pylist(), strict=True):
                for k in range(0, max(1, len(raw) - width + 1), PIECE):
                    part = raw[k : k + PIECE + width - 1]
                    if len(part) < width:
                        continue
                    if parts and held + len(part) > PIECE + width - 1:
                        yield rows(parts)
                        parts, held = [], 0
                    parts.append((key, chk, k, part))
                    held += len(part)
            if parts:
                yield rows(parts)

    return map_batches(docs.select(doc_key, check, bytes_col), run, "gram long, run long, doc long, place long")


def sorted_suffixes(data: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``data`` in order of the ``depth`` or more bytes that follow (zeros behind the end)."""
    n = len(data)
    padded = np.concatenate([data.astype(np.uint64), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(7):  # 9-bit symbols: seven fit a key
        key = (key << _U(9)) | padded[k : k + n]
    sa = np.argsort(key, kind="stable")
    got = 7
    by = key[sa]
    head = np.ones(n, bool)
    head[1:] = by[1:] != by[:-1]
    while got < depth:
        slot = np.maximum.accumulate(np.where(head, np.arange(n), 0))  # first slot of each group
        rank = np.empty(n, np.int64)
        rank[sa] = slot + 1
        alone = head & np.append(head[1:], True)
        open_slots = np.flatnonzero(~alone)
        if not len(open_slots):
            break
        places = sa[open_slots]
        behind = places + got
        nxt = np.where(behind < n, rank[np.minimum(behind, n - 1)], 0)
        order = np.lexsort((nxt, slot[open_slots]))
        sa[open_slots] = places[order]
        s, x = slot[open_slots], nxt[order]
        head[open_slots] = np.append(True, (s[1:] != s[:-1]) | (x[1:] != x[:-1]))
        got *= 2
    return sa


def repeated_places(data: np.ndarray, width: int) -> np.ndarray:
    """Whether the ``width`` symbols (at most 511 each, 0 reserved) from each place on also start elsewhere.

    Interval expansion over the Burrows-Wheeler transform: an interval holds the suffixes that begin with
    one string; extending it by each symbol found before them gives intervals one longer. The place
    behind a new interval gets its common prefix the first time an interval ends there, and only
    such intervals are extended, so all steps together are linear in the text.
    """
    n = len(data)
    sa = sorted_suffixes(data, width)
    bwt = data[sa - 1].astype(np.int64)  # the last symbol stands before the first
    by_symbol = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by_symbol] = np.arange(n)
    keys = bwt[by_symbol] * (n + 1) + by_symbol
    following = np.full(n, n, np.int64)  # the next place with the same symbol
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    lo, hi = np.array([0]), np.array([n])
    for _ in range(width):  # intervals of strings of this length
        if not len(lo):
            break
        size = hi - lo
        begins = np.cumsum(size) - size
        item = np.arange(int(size.sum())) + np.repeat(lo - begins, size)
        last = following[item] >= np.repeat(hi, size)  # of its symbol in its interval
        owner = np.repeat(np.arange(len(lo)), size)[last]
        item = item[last]
        end = lf[item] + 1
        fresh = unset[end]
        item, owner, end = item[fresh], owner[fresh], end[fresh]
        unset[end] = False
        lo, hi = np.searchsorted(keys, bwt[item] * (n + 1) + lo[owner]), end
    out = np.zeros(n, bool)
    joined = np.flatnonzero(unset)  # share ``width`` symbols with the suffix before
    out[sa[joined]] = True
    out[sa[joined - 1]] = True
    return out


def _search(edges: DataFrame, width: int) -> DataFrame:
    """Repeated windows of the stretches in ``edges`` (``core``, ``doc``, ``place`` (check, start), ``alone``, ``data``), which
    hold all different stretches of their cores: ``doc``, ``place`` (as a run of windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list[tuple]) -> pa.RecordBatch:
            raws = [r[4] for r in rows]
            text = np.zeros(sum(map(len, raws)) + len(raws) + 1, np.int64)
            at, begins = 1, []
            for raw in raws:
                begins.append(at)
                text[at : at + len(raw)] = np.frombuffer(raw, np.uint8)
                text[at : at + len(raw)] += 1
                at += len(raw) + 1
            hit = repeated_places(text, width)
            docs, places = [], []
            for (_, doc, place, alone, raw), s in zip(rows, begins, strict=True):
                if not alone:
                    continue
                marks = np.flatnonzero(np.diff(np.concatenate([[0], hit[s : s + len(raw) - width + 1], [0]]).astype(np.int8)))
                for lo, hi in zip(marks[::2].tolist(), marks[1::2].tolist(), strict=True):
                    docs.append(doc)
                    places.append((place & ~0xFFFF) + (lo << 16) | (hi - lo - 1))
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(places, pa.int64())], ["doc", "place"])

        held, size, core = [], 0, None
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("core", "doc", "place", "alone", "data")), strict=True):
                if size >= TEXT and r[0] != core:
                    yield found(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[4]) + 1
                core = r[0]
        if held:
            yield found(held)

    rows = edges.select("core", "doc", "place", "alone", "data").repartition("core").sortWithinPartitions("core")
    return map_batches(rows, run, "doc long, place long")


def _search_by_window(edges: DataFrame, width: int) -> DataFrame:
    """The same for cores with very many different stretches: each window is a row, counted by its hash."""
    n = F.octet_length("data") - width
    each = edges.select("doc", "place", "alone", "data", F.explode(F.sequence(F.lit(0), n)).alias("k"))
    window = F.substring("data", F.col("k") + 1, F.lit(width))
    each = each.select("doc", "alone", "place", "k", F.xxhash64(window).alias("w1"), F.crc32(window).alias("w2"))
    twice = each.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    hits = each.where("alone").join(twice, ["w1", "w2"])
    start = F.shiftright("place", 16) + F.col("k")
    return hits.select("doc", F.shiftleft(start, 16).alias("place"))


def _one_of_each(rows: DataFrame, key: str, content: list[str], carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that equal another (same ``key`` and ``content``), and, for each ``key`` with several contents of which one occurs
    once, one row of each content: ``kinds`` (contents of the key), ``alone`` (it occurs once)."""
    kinds = rows.groupBy(key, *content).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "place", *carry)).alias("one"))
    kinds = stored(kinds, "repeats-kinds")
    whole = rows.join(stored(kinds.where("n > 1").select(key, *content), "repeats-whole"), [key, *content])
    sizes = kinds.groupBy(key).agg(F.count(F.lit(1)).alias("kinds"), F.max(F.col("n") == 1).alias("any_alone"))
    edges = kinds.join(sizes.where("kinds > 1 AND any_alone"), key).select(key, "kinds", (F.col("n") == 1).alias("alone"), "one.*")
    return whole.select("doc", "place"), edges


def repeated_windows(docs: DataFrame, doc_key: str, check: str, bytes_col: str, width: int = WIDTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``doc``, ``place`` of all windows of ``width`` bytes that also start elsewhere, as runs."""
    if not 0 < gram <= width or width - gram >= 256:
        raise ValueError("the minimizer must fit the width, with fewer than 256 places in it")
    runs = stored(window_runs(docs, doc_key, check, bytes_col, width, gram), "repeats-runs")
    grams = runs.groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"), F.min("run").alias("least"), F.max("run").alias("most")
    )
    shared = grams.where("n > 1").select("gram", (F.col("least") == F.col("most")).alias("alike"))
    met = stored(runs.join(stored(shared, "repeats-shared"), "gram"), "repeats-met")
    alike = met.where("alike").select("doc", "place")
    whole, edges = _one_of_each(met.where("NOT alike").drop("alike"), "gram", ["run"], [])

    row = F.struct("place", "alone")
    wanted = edges.groupBy("doc").agg(F.collect_list(row).alias("wanted"))  # runs of one document
    d = docs.select(F.col(doc_key).alias("doc"), F.col(check).alias("_check"), F.col(bytes_col).alias("_bytes"))
    fetched = d.join(wanted, "doc").select("doc", "_check", "_bytes", F.explode("wanted").alias("w"))
    fetched = fetched.where(F.shiftright("w.place", 48) == F.col("_check"))
    start = F.shiftright(F.col("w.place"), 16).bitwiseAND(F.lit((1 << 32) - 1))
    more = F.col("w.place").bitwiseAND(F.lit(0xFF)).cast("int")
    before = F.shiftright("w.place", 8).bitwiseAND(F.lit(0xFF)).cast("int")
    data = F.substring("_bytes", (start + 1).cast("int"), more + width)
    fetched = fetched.select("doc", "w.place", "w.alone", more.alias("more"), before.alias("before"), data.alias("data"))
    # Windows that begin ``half`` bytes or more before the minimizer, and the others.
    half = -(-(width - gram) // 2)
    left_last = F.least(F.col("more"), F.col("before") - half)
    left = fetched.where(F.col("before") >= half).select(
        "doc", "place", "alone", left_last.alias("last"), F.lit(0).alias("first"),
        F.substring("data", F.col("before") - half + 1, F.lit(gram + half)).alias("core"), "data",
    )
    right_first = F.greatest(F.lit(0), F.col("before") - half + 1)
    right = fetched.where(F.col("more") >= right_first).select(
        "doc", "place", "alone", F.col("more").alias("last"), right_first.alias("first"),
        F.substring("data", F.col("before") + 1, F.lit(width - half + 1)).alias("core"), "data",
    )
    both = left.unionByName(right).where("last >= first")
    at = F.shiftright("place", 16) + F.col("first")
    stretch = F.substring("data", F.col("first") + 1, F.col("last") - F.col("first") + width)
    # Of equal stretches one is searched; they are repeated as a whole.
    stretches = both.select(
        "doc", F.shiftleft(at, 16).bitwiseOR((F.col("last") - F.col("first")).cast("long")).alias("place"), "alone",
        F.xxhash64("core").alias("core"), stretch.alias("data"),
    ).withColumns({"c1": F.xxhash64("data"), "c2": F.crc32("data")})
    stretches = stored(stretches, "repeats-edges")
    again, left_over = _one_of_each(stretches, "core", ["c1", "c2"], ["data"])
    left_over = stored(left_over, "repeats-searched")
    found = _search(left_over.where(F.col("kinds") <= group), width)
    hot = _search_by_window(left_over.where(F.col("kinds") > group), width)
    return alike.unionByName(whole).unionByName(again).unionByName(found).unionByName(hot)


def remove_repeats(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    gram: int = GRAM,
    group: int = GROUP,
    as_text: bool = False,
) -> DataFrame:
    """``df`` with ``n_bytes``, ``spans`` (maximal removed stretches of the text's UTF-8 bytes, ``start`` and ``end``) and
    ``kept`` (the other bytes; as a string without the rests of characters cut through if ``as_text``).

    Removed is every byte of a ``width``-byte string that also starts at another place, of the same text or
    another row's, judged on the whole input; matches never cross rows. NULL is read as empty and
    texts shorter than ``width`` stay whole. Rows that agree in id and text are copies of each
    other like any two equal texts. Columns of ``df`` with these names are replaced.
    """
    added = ("n_bytes", "spans", "kept")
    keep = [c for c in df.columns if c not in added]
    key, check, raw, marks, hit = (reserved(df, c) for c in ("_doc", "_check", "_raw", "_marks", "_hit"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # A row's key has 79 bits, 64 to join on and 15 to check with.
    rows = df.select(
        *keep,
        F.xxhash64(F.col(id_col), text).alias(key),
        F.crc32(F.encode(F.concat(text, F.coalesce(F.col(id_col).cast("string"), F.lit("-"))), "UTF-8")).bitwiseAND(F.lit((1 << 15) - 1)).alias(check),
        F.encode(text, "UTF-8").alias(raw),
    )
    places = repeated_windows(rows, key, check, raw, width, gram, group)
    marked = places.groupBy(F.col("doc").alias(hit)).agg(F.collect_set("place").alias(marks))  # windows of one document
    joined = rows.join(marked, F.col(key) == F.col(hit), "left").drop(hit, key)
    spans_type = "array<struct<start:long,end:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            sizes, spans, left = [], [], []
            for data, chk, got in zip(b.column(raw).to_pylist(), b.column(check).to_pylist(), b.column(marks).to_pylist(), strict=True):
                cut = _spans(got, chk, width) if got else []
                sizes.append(len(data))
                spans.append([{"start": s, "end": e} for s, e in cut])
                edges = [0, *(x for se in cut for x in se), len(data)]
                left.append(b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)) if cut else data)
            rest = pa.array([x.decode("utf-8", "ignore") for x in left], pa.string()) if as_text else pa.array(left, pa.binary())
            cols = [pa.array(sizes, pa.int64()), pa.array(spans, spans_arrow), rest]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], [*keep, *added])

    shape = joined.select(
        *keep, F.lit(0).cast("long").alias("n_bytes"), F.lit(None).cast(spans_type).alias("spans"), F.lit("" if as_text else b"").alias("kept")
    ).schema
    return map_batches(joined, run, shape)


def _spans(places: list[int], check: int, width: int) -> list[tuple[int, int]]:
    p = np.array([x for x in places if x >> 48 == check], np.int64)
    if not len(p):
        return []
    lo = (p >> 16) & ((1 << 32) - 1)
    hi = lo + (p & 0xFF) + width
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    first = np.flatnonzero(np.append(True, lo[1:] > hi[:-1]))
    return list(zip(lo[first].tolist(), hi[np.append(first[1:], len(lo)) - 1].tolist(), strict=True))

