"""BPE encoding and decoding of whole texts, as the tokenizers library does it.

Where a vocabulary ignores white space between words, a text is the sum of its pieces between spaces;
each worker keeps the ids of the pieces it has met and asks the library for the others, many at a time.
Long unsplit pieces are encoded by tree concatenation: halves by themselves, then the window around each
join is encoded again and grown until its first and last token are those of the two sides. Every
neighbouring pair of the result then stands in a valid encoding, which makes the whole one valid.

Texts of more than ``long_chars`` characters are cut into rows first, so several tasks encode one text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, map_batches, reserved, stored

#: Pieces whose ids a worker keeps, and half as many letter runs; the memory this takes is bounded by them.
CACHED_PIECES = 200_000
#: Bytes of a piece that is kept, at most.
KEPT_BYTES = 256
#: Rows handed on at a time.
SLICE = 1024
#: Symbols above which an unsplit word is encoded by halves.
LEAF = 1024
#: Characters above which a text is cut into rows.
LONG_CHARS = 1 << 16
_CHUNK = 1 << 20
#: Marks that end a word and that no contraction begins with.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_MARK = "\x01"


def encoder(path: str, leaf: int = LEAF, kept: int | None = None) -> "Encoder":
    """The encoder of this process for the tokenizer file at ``path``, which keeps the ids of ``kept`` pieces (``CACHED_PIECES``)."""
    return held(("encoder", path, leaf, kept), lambda: Encoder(path, leaf, kept))


class Symbols:
    """The merges alone, on strings of symbols: no normaliser, no splitting. The last symbol of a word
    carries the word's end as a character of its own, so a half of a word is no word of its own."""

    def __init__(self, spec: dict):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self._spaced = None
        used = {c for t in model["vocab"] for c in t}
        free = (chr(c) for c in range(0xF0000, 0xFFFFE) if chr(c) not in used)
        ends = sorted({t[: -len(self.suffix)][-1:] for t in model["vocab"] if self.suffix and t.endswith(self.suffix)})
        self.end_of = dict(zip((e for e in ends if e), free, strict=False))
        vocab = {self._plain(t): i for t, i in model["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.tokenizer = Tokenizer(BPE(vocab, [(self._plain(a), self._plain(b)) for a, b in pairs]))
        self.text_of = {i: t for t, i in vocab.items()}
        ends = set(self.end_of.values())
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t[-1:] in ends]] = True

    def _plain(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and (body := token[: -len(self.suffix)]):
            return body[:-1] + self.end_of[body[-1]]
        return token

    def of_word(self, word: str) -> str:
        return word[:-1] + self.end_of.get(word[-1], word[-1]) if self.suffix else word

    def encode(self, symbols: str) -> list[int]:
        return self.tokenizer.encode(symbols, add_special_tokens=False).ids

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word (given as symbols, without spaces), all in one call."""
        from tokenizers.pre_tokenizers import WhitespaceSplit

        if self._spaced is None:
            self._spaced = type(self.tokenizer)(self.tokenizer.model)
            self._spaced.pre_tokenizer = WhitespaceSplit()
        ids = np.asarray(self._spaced.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
        if len(ends) != len(words):
            raise RuntimeError("words were not encoded one by one")
        raw = ids.tobytes()
        return [raw[s:e] for s, e in zip([0, *ends], ends, strict=False)]

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of the text of ``a`` followed by that of ``b``, from their encodings."""
        if not a or not b:
            return a + b
        n = 2
        while True:
            left, right = a[-n:], b[:n]
            ids = self.encode("".join(self.text_of[i] for i in (*left, *right)))
            if (n >= len(a) or ids[0] == left[0]) and (n >= len(b) or ids[-1] == right[-1]):
                return a[:-n] + ids + b[n:]
            n *= 2

    def tree(self, symbols: str, leaf: int) -> list[int]:
        if len(symbols) <= leaf:
            return self.encode(symbols) if symbols else []
        half = len(symbols) // 2
        return self.join(self.tree(symbols[:half], leaf), self.tree(symbols[half:], leaf))


class Encoder:
    def __init__(self, path: str, leaf: int = LEAF, kept: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.leaf, self.kept = leaf, kept or CACHED_PIECES
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.special = [t["content"] for t in self.spec.get("added_tokens") or []]
        self.vocab_size = self.tokenizer.get_vocab_size()
        self._symbols: Symbols | None = None
        self.table, self.hasher = _Table(), _Hasher()
        self.cores: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        own = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        a, b, mark = own("Ab1,"), own("c'd"), own(_MARK)
        #: White space only separates: a text is the sum of its pieces.
        self.by_pieces = own(" Ab1,  c'd\n") == a + b and own("\n") == [] and not self.spec.get("post_processor")
        #: Pieces can be encoded together, told apart by a token that stands for the mark alone.
        self.mark = mark[0] if self.by_pieces and len(mark) == 1 and own(f"Ab1, {_MARK} c'd") == a + mark + b else None
        names = json.dumps(self.spec.get("normalizer") or {})
        self.lowers = '"Lowercase"' in names and not re.search(r'"(NFKC|NFKD|NFD|StripAccents)"', names)
        #: Lower-case Latin-1 letters and the symbols they are; a run of them is a word of its own.
        self.letters: dict[int, str] = {}
        if self.by_pieces and self.lowers and self.spec["model"].get("end_of_word_suffix"):
            small = [c for c in map(chr, range(256)) if c.isalpha() and c == c.lower()]
            split = {c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c) for c in small}
            self.letters = {ord(c): s[0][0] for c, s in split.items() if len(s) == 1}
            run = "".join(map(chr, self.letters))
            if own(f"x{run}.,") != [*np.frombuffer(self._letter_runs([f"x{run}"])[0], "<u4").tolist(), *own(".,")]:
                self.letters = {}

    @property
    def symbols(self) -> Symbols:
        if self._symbols is None:
            self._symbols = Symbols(self.spec)
        return self._symbols

    def _has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def lowered(self, text: str) -> str:
        if self.lowers and not self._has_special(text) and (text.isascii() or _latin1(text)):
            # Within Latin-1 lower case here is the normaliser's; it must not make a special token.
            low = text.lower()
            return text if self._has_special(low) else low
        return text

    def pieces(self, text: str) -> list[str]:
        return self.lowered(text).replace("\n", " ").split(" ")

    def words(self, piece: str) -> list[str]:
        """Symbol strings of the words of a piece, as the normaliser and the splitter make them."""
        text = self.tokenizer.normalizer.normalize_str(piece) if self.tokenizer.normalizer else piece
        split = self.tokenizer.pre_tokenizer
        return [self.symbols.of_word(w) for w, _ in split.pre_tokenize_str(text)] if split else [text]

    def long_piece(self, piece: str) -> list[int]:
        if self._has_special(piece):  # the library takes special tokens out before it splits
            return self.tokenizer.encode(piece, add_special_tokens=False).ids
        out: list[int] = []
        for w in self.words(piece):
            out += self.symbols.tree(w, self.leaf)
        return out

    def _letter_runs(self, runs: list[str]) -> list[bytes]:
        symbols = [r if r.isascii() else r.translate(self.letters) for r in runs]
        return self.symbols.encode_words([self.symbols.of_word(w) for w in symbols])

    def _known_letters(self, run: str) -> bool:
        return run.isalpha() and len(run) <= self.leaf and (run.isascii() or self.letters.keys() >= set(map(ord, run))) and run == run.lower()

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces, those that are letters with marks behind them by their words."""
        if len(self.cores) > self.kept // 2:
            self.cores = dict(islice(self.cores.items(), self.kept // 4))
        if len(self.tails) > self.kept // 10:
            self.tails = {"": b""}
        cores, tails, out = self.cores, self.tails, [None] * len(pieces)
        rest = range(len(pieces))
        if self.letters:
            rest = [i for i, p in enumerate(pieces) if "<" in p and self._has_special(p)]
            split = [p.rstrip(_TAIL) for p in pieces]
            runs = [c for c in set(split).difference(cores) if self._known_letters(c)]
            for k in range(0, len(runs), 512):
                cores.update(zip(runs[k : k + 512], self._letter_runs(runs[k : k + 512]), strict=True))
            for i, (p, c) in enumerate(zip(pieces, split, strict=True)):
                ids = cores.get(c) if c else (b"" if len(p) <= self.leaf else None)
                if ids is None:
                    rest.append(i)
                    continue
                if len(c) < len(p):
                    tail = p[len(c) :]
                    if tail not in tails:
                        tails[tail] = self._one(tail)
                    ids = ids + tails[tail]
                out[i] = ids
        together = []
        for i in rest:
            p = pieces[i]
            if len(p) > self.leaf:
                out[i] = np.asarray(self.long_piece(p), "<u4").tobytes()
            elif self.mark is None or _MARK in p or self._has_special(p):
                out[i] = self._one(p)
            else:
                together.append(i)
        for k in range(0, len(together), 8192):
            part = together[k : k + 8192]
            ids = self.tokenizer.encode_batch_fast([f" {_MARK} ".join([pieces[i] for i in part])], add_special_tokens=False)[0].ids
            ids = np.asarray(ids, "<u4")
            at = np.flatnonzero(ids == self.mark)
            if len(at) != len(part) - 1:
                raise RuntimeError("a piece was encoded as the mark between pieces")
            raw = ids.tobytes()
            starts = [0, *(4 * (at + 1)).tolist()]
            ends = [*(4 * at).tolist(), len(raw)]
            for i, s, e in zip(part, starts, ends, strict=True):
                out[i] = raw[s:e]
        return out

    def _one(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other (unsigned 32-bit), and where each text's end; none for NULL."""
        if not self.by_pieces:
            got = [self.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
            return np.array([i for g in got for i in g], "<u4"), np.cumsum([len(g) for g in got], dtype=np.int64)
        parts, ends, total, at = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)], 0, 0
        while at < len(texts):
            some, n = [], 0
            while at < len(texts) and n < _CHUNK:
                some.append(self.lowered(texts[at] or "").encode("utf-8"))
                n += len(some[-1]) + 1
                at += 1
            ids, stops = self._encode_pieces(some)
            parts.append(ids)
            ends.append(stops + total)
            total += len(ids)
        return np.concatenate(parts), np.concatenate(ends)

    def _encode_pieces(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
        inside = (data != 32) & (data != 10)
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        start, end = edge[::2], edge[1::2]
        hashes = self.hasher.of(data, start, end)
        entry = self.table.find(hashes, data, start, end)
        new = np.flatnonzero(entry < 0)
        if len(new):
            if self.table.shrink(self.kept):
                entry = self.table.find(hashes, data, start, end)
                new = np.flatnonzero(entry < 0)
            raw = data.tobytes()
            pieces = [raw[s:e] for s, e in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            place: dict[bytes, int] = {}
            at = [place.setdefault(p, len(place)) for p in pieces]
            first = np.empty(len(place), np.int64)
            first[np.array(at[::-1], np.int64)] = new[::-1]
            got = self._ids_of(b"\n".join(place).decode("utf-8").split("\n"))
            self.table.add(list(place), hashes[first], got)
            fresh = np.fromiter(map(len, got), np.int64, len(got)) // 4
            fresh_begin = len(self.table.ids) + np.cumsum(fresh) - fresh
        size = self.table.size[entry] if len(self.table.size) else np.zeros(len(entry), np.int64)
        begin = self.table.begin[entry] if len(self.table.size) else np.zeros(len(entry), np.int64)
        pool = self.table.ids
        if len(new):
            size[new], begin[new] = fresh[at], fresh_begin[at]
            pool = np.concatenate([pool, np.frombuffer(b"".join(got), "<u4")])
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        shift = np.repeat(begin - (stop - size), size)
        ids = pool[np.arange(total) + shift]
        text_end = np.cumsum([len(r) + 1 for r in raws])
        pieces_before = np.searchsorted(start, text_end)
        return ids, np.concatenate([[0], stop])[pieces_before]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, ends = self.encode_all(texts)
        raw = ids.tobytes()
        for s, e in zip([0, *ends.tolist()], ends.tolist(), strict=False):
            yield raw[4 * s : 4 * e]


class _Hasher:
    """64-bit hashes of stretches of bytes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        base = 0x9E3779B97F4A7C15
        if len(data) >= len(self.up):
            up = np.full(2 * len(data) + 1, base, np.uint64)
            down = np.full(2 * len(data) + 1, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        h = (sums[end] - sums[start]) * self.down[start]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(32))) | np.uint64(1)


class _Table:
    """Ids by piece: an open-addressing table over hashes that is searched for many pieces at once. A hash only finds
    the entry; the piece's bytes decide, so pieces with one hash are never taken for each other (the later one is not kept)."""

    def __init__(self, bits: int = 18):
        self.hashes, self.entries = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        self.known, self.hits = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
        self.piece_begin, self.piece_size, self.pieces = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def _entries(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.hashes) - 1)
        slot = (h >> np.uint64(20)) & mask
        out = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        while len(todo):
            there = self.hashes[slot]
            same = there == h
            out[todo[same]] = self.entries[slot[same]]
            more = ~same & (there != 0)
            todo, h, slot = todo[more], h[more], (slot[more] + np.uint64(1)) & mask
        return out

    def find(self, h: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The entry of each piece (a stretch of ``data``), or -1."""
        out = self._entries(h)
        where = np.flatnonzero(out >= 0)
        entry, size = out[where], (end - start)[where]
        other = self.piece_size[entry] != size
        out[where[other]] = -1
        where, entry, size = where[~other], entry[~other], size[~other]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        step = np.arange(total)
        own = data[step + np.repeat(start[where] - (stop - size), size)]
        kept = self.pieces[step + np.repeat(self.piece_begin[entry] - (stop - size), size)]
        differ = np.flatnonzero(own != kept)
        if len(differ):
            out[where[np.searchsorted(stop, differ, side="right")]] = -1
        self.hits += np.bincount(out[out >= 0], minlength=len(self.hits))
        return out

    def add(self, pieces: list[bytes], h: np.ndarray, ids: list[bytes]) -> None:
        """Keep pieces the table lacks: those of ``KEPT_BYTES`` at most whose hash is no other's."""
        first = np.zeros(len(h), bool)
        first[np.unique(h, return_index=True)[1]] = True
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        keep = np.flatnonzero(first & (sizes <= KEPT_BYTES) & (self._entries(h) < 0))
        self._append([pieces[i] for i in keep.tolist()], h[keep], [ids[i] for i in keep.tolist()])

    def _append(self, pieces: list[bytes], fresh: np.ndarray, ids: list[bytes]) -> None:
        size, psize = (np.fromiter(map(len, some), np.int64, len(some)) // n for some, n in ((ids, 4), (pieces, 1)))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), "<u4")])
        self.piece_begin = np.concatenate([self.piece_begin, len(self.pieces) + np.cumsum(psize) - psize])
        self.piece_size = np.concatenate([self.piece_size, psize])
        self.pieces = np.concatenate([self.pieces, np.frombuffer(b"".join(pieces), np.uint8)])
        self.known = np.concatenate([self.known, fresh])
        self.hits = np.concatenate([self.hits, np.zeros(len(fresh), np.int64)])
        bits = len(self.hashes)
        while 3 * len(self.known) > bits:
            bits *= 2
        if bits > len(self.hashes):
            self.hashes, self.entries = np.zeros(bits, np.uint64), np.full(bits, -1, np.int32)
            self._place(self.known, np.arange(len(self.known)))
        else:
            self._place(fresh, np.arange(len(self.known) - len(fresh), len(self.known)))

    def _place(self, h: np.ndarray, entry: np.ndarray) -> None:
        mask = np.uint64(len(self.hashes) - 1)
        slot = (h >> np.uint64(20)) & mask
        while len(h):
            free = np.flatnonzero(self.hashes[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.hashes[slot[won]], self.entries[slot[won]] = h[won], entry[won]
            rest = np.ones(len(h), bool)
            rest[won] = False
            h, entry, slot = h[rest], entry[rest], (slot[rest] + np.uint64(1)) & mask

    def shrink(self, most: int) -> bool:
        """Keep the half of more than ``most`` entries that was found most often, the earlier ones first."""
        n = most // 2
        if len(self.known) <= most:
            return False
        kept = np.sort(np.argsort(-self.hits, kind="stable")[:n])
        known, hits, size, psize = self.known[kept], self.hits[kept] // 2, self.size[kept], self.piece_size[kept]
        ids, pieces = _stretches(self.ids, self.begin[kept], size), _stretches(self.pieces, self.piece_begin[kept], psize)
        self.__init__()
        self.size, self.ids, self.known, self.hits = size, ids, known, hits
        self.piece_size, self.pieces = psize, pieces
        self.begin, self.piece_begin = np.cumsum(size) - size, np.cumsum(psize) - psize
        self._append([], np.zeros(0, np.uint64), [])
        if 3 * len(known) <= len(self.hashes):
            self._place(known, np.arange(n))
        return True


def _stretches(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` that begin there, one after the other."""
    stop = np.cumsum(size)
    return pool[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(begin - (stop - size), size)]


def _latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, SLICE):
            yield b.slice(k, SLICE)


def _id_lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    if len(ids) >= 1 << 31:
        raise ValueError("a batch holds 2**31 ids or more; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))


def _raw_lists(raws: list[bytes]) -> pa.Array:
    return _id_lists(np.frombuffer(b"".join(raws), "<u4"), np.cumsum([len(r) // 4 for r in raws], dtype=np.int64))


def _decoded(tokenizer, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    starts = [0, *ends.tolist()]
    return pa.array(
        [tokenizer.decode(ids[s:e].tolist(), skip_special_tokens=False) for s, e in zip(starts, starts[1:], strict=False)], pa.string()
    )


def _encode_rows(df: DataFrame, text_col: str, path: str, leaf: int, out_col: str, decoded_col: str | None) -> DataFrame:
    rest = [c for c in df.columns if c != text_col]
    added = [out_col, decoded_col] if decoded_col else [out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, leaf)
        for b in sliced(batches):
            ids, ends = enc.encode_all(b.column(text_col).to_pylist())
            got = [_id_lists(ids, ends)] + ([_decoded(enc.tokenizer, ids, ends)] if decoded_col else [])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *got], [*rest, *added])

    kinds = [F.lit(None).cast(t).alias(c) for c, t in zip(added, ("array<int>", "string"), strict=False)]
    return map_batches(df, run, df.select(*rest, *kinds).schema)


def _cut(df: DataFrame, text_col: str, path: str, leaf: int, cols: list[str]) -> DataFrame:
    """Long texts as rows ``seg``, ``leaf``, ``leaves``, ``raw`` (symbols of a word, or text), ``part``."""
    rest = [c for c in df.columns if c != text_col]
    seg, node, leaves, raw, part = cols

    def rows(enc: Encoder, text: str, size: int) -> Iterator[tuple[int, int, int, bool, str]]:
        n, some, held = 0, [], 0
        for p in enc.pieces(text):
            if len(p) <= size or enc._has_special(p):
                some.append(p)
                held += len(p) + 1
                if held >= size:
                    yield n, 0, 1, False, " ".join(some)
                    n, some, held = n + 1, [], 0
                continue
            if some:
                yield n, 0, 1, False, " ".join(some)
                n, some, held = n + 1, [], 0
            for w in enc.words(p):
                count = -(-len(w) // size)
                for k in range(count):
                    yield n, k, count, True, w[k * size : (k + 1) * size]
                n += 1
        if some or not n:
            yield n, 0, 1, False, " ".join(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, leaf)
        for b in batches:
            for i, text in enumerate(b.column(text_col).to_pylist()):
                if enc.by_pieces:
                    got = list(rows(enc, text, max(leaf, LONG_CHARS // 4)))
                else:
                    got = [(0, 0, 1, False, text)]
                at = pa.array([i] * len(got), pa.int64())
                own = [pa.array(x, t) for x, t in zip(zip(*got, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in rest), *own], [*rest, seg, node, leaves, raw, part])

    fields = [F.lit(None).cast(t).alias(c) for c, t in zip(cols, ("int", "int", "int", "boolean", "string"), strict=True)]
    return map_batches(df, run, df.select(*rest, *fields).schema)


def _encode_long(df: DataFrame, text_col: str, path: str, leaf: int, out_col: str) -> DataFrame:
    rest = [c for c in df.columns if c != text_col]
    row = reserved(df, "_row")
    cols = [reserved(df, c) for c in ("_seg", "_leaf", "_leaves", "_raw", "_part")]
    seg, node, leaves, raw, part = cols
    cut = _cut(df.withColumn(row, F.monotonically_increasing_id()), text_col, path, leaf, cols)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, leaf)
        for b in batches:
            out = []
            for is_raw, text in zip(b.column(raw).to_pylist(), b.column(part).to_pylist(), strict=True):
                out.append(np.asarray(enc.symbols.tree(text, leaf), "<u4").tobytes() if is_raw else next(enc.encode([text])))
            names = [c for c in b.schema.names if c != part]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), _raw_lists(out)], [*names, out_col])

    # Rows of one text go to different tasks.
    spread = cut.repartition(F.col(row), F.col(seg), F.col(node))
    shape = cut.drop(part).withColumn(out_col, F.lit(None).cast("array<int>")).schema
    done = stored(map_batches(spread, encode, shape), "bpe-leaves")
    most = done.agg(F.max(leaves)).first()[0] or 1

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, leaf)
        for b in batches:
            out = []
            for halves in b.column(out_col).to_pylist():
                ids: list[int] = []
                for h in halves:
                    ids = enc.symbols.join(ids, h["ids"])
                out.append(np.asarray(ids, "<u4").tobytes())
            names = [c for c in b.schema.names if c != out_col]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), _raw_lists(out)], [*names, out_col])

    other = [c for c in rest if c != row]
    while most > 1:  # one level of the tree: neighbouring halves of a word meet in one row
        up = done.where(F.col(leaves) > 1)
        half = F.struct(F.col(node).alias("at"), F.col(out_col).alias("ids"))
        up = up.groupBy(row, seg, F.shiftright(node, 1).alias(node)).agg(
            *[F.first(c).alias(c) for c in other],
            F.first(F.shiftright(F.col(leaves) + 1, 1)).alias(leaves),
            F.first(raw).alias(raw),
            F.sort_array(F.collect_list(half)).alias(out_col),
        )
        up = map_batches(up.select(*[c for c in done.columns if c != out_col], out_col), join, done.schema)
        done = stored(done.where(F.col(leaves) <= 1).unionByName(up), "bpe-joined")
        most = (most + 1) // 2
    whole = F.sort_array(F.collect_list(F.struct(F.col(seg).alias("at"), F.col(out_col).alias("ids"))))
    whole = F.flatten(F.transform(whole, lambda x: x["ids"]))
    return done.groupBy(row).agg(*[F.first(c).alias(c) for c in other], whole.alias(out_col)).select(*other, out_col)


def encode(
    df: DataFrame,
    path: str,
    text_col: str = "text",
    out_col: str = "ids",
    leaf: int = LEAF,
    long_chars: int = LONG_CHARS,
    decoded_col: str | None = None,
) -> DataFrame:
    """``df`` without its text and with ``out_col``, the ids (array of int) of every whole text under the
    tokenizer file at ``path``, without special tokens being added.

    NULL and empty texts have no ids. Rows are independent: repeats, ties and NULLs elsewhere pass
    through. ``decoded_col`` adds the decoding of the ids (see ``decode``) in the same pass. Columns of ``df`` with
    these names are replaced.
    """
    df = df.drop(*[c for c in (out_col, decoded_col) if c and c in df.columns])
    text = F.coalesce(F.col(text_col), F.lit(""))
    long = F.length(text) > long_chars
    df = df.withColumn(text_col, text)
    short = _encode_rows(df.where(~long), text_col, path, leaf, out_col, decoded_col)
    joined = _encode_long(df.where(long), text_col, path, leaf, out_col)
    return short.unionByName(decode(joined, path, out_col, decoded_col) if decoded_col else joined)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with ``out_col``, the library's decoding of ``ids_col`` (special tokens kept). NULL ids read as
    none and give an empty text. A column of ``df`` named ``out_col`` is replaced."""
    if out_col in df.columns:
        df = df.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(path).tokenizer
        for b in sliced(batches):
            ids = b.column(ids_col)
            # Offsets of a slice still point into all values.
            at, values = ids.offsets.to_pylist(), ids.values.to_numpy(zero_copy_only=False)
            texts = [tok.decode(values[s:e].tolist(), skip_special_tokens=False) for s, e in zip(at, at[1:], strict=False)]
            names = b.schema.names
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, out_col])

    return map_batches(df, run, df.withColumn(out_col, F.lit("")).schema)


def digests(df: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``n_tokens``, ``ids_sha256`` (of the decimal ids joined by one space) and ``decoded_sha256``."""
    joined = F.array_join(F.col(ids_col).cast("array<string>"), " ")
    return df.withColumns(
        {
            "n_tokens": F.size(ids_col).cast("long"),
            "ids_sha256": F.sha2(joined, 256),
            "decoded_sha256": F.sha2(F.col(decoded_col), 256),
        }
    )
