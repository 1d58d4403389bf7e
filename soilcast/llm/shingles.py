"""Word shingles of many texts at once and their ProbMinHash signatures, as numpy arrays."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_INV = _U(pow(int(_A), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _B
    x = (x ^ (x >> _U(27))) * _C
    return x ^ (x >> _U(31))


_PLACES = 64


def _numbers() -> np.ndarray:
    """A number for each byte at each of the first places of a word."""
    return mixed(np.arange(_PLACES * 256, dtype=np.uint64) * _A + _C)


_NUMBERS = _numbers()


def _byte_numbers(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    key = (place << 8) + data
    out = _NUMBERS[np.minimum(key, _PLACES * 256 - 1)]
    far = np.flatnonzero(place >= _PLACES)  # long words
    if len(far):
        out[far] = mixed(key[far].astype(np.uint64) * _A + _C)
    return out


class Shingler:
    """Hashed shingles of the words ``[^\\x20\\x09-\\x0D]+``.

    A word's hash is the sum of a random-like number for each of its bytes at its place in the word, so no structure of the
    word, such as one that makes polynomials vanish, leads to equal hashes."""

    def __init__(self, size: int):
        self.size = size

    def of(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, shingle, times), sorted by both: the distinct shingles of each text. A text with fewer words
        than a shingle has one, of all its words; one without words has none."""
        data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
        ends = np.cumsum([len(r) + 1 for r in raws])
        word = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
        start, end = edge[::2], edge[1::2]
        place = np.arange(len(data))
        if len(start):
            place[start[0] :] -= np.repeat(start, np.diff(np.append(start, len(data))))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_numbers(data, place), out=sums[1:])
        h = mixed(sums[end] - sums[start] + (end - start).astype(np.uint64) * _A)
        text = np.searchsorted(ends, start, side="right")
        n = np.bincount(text, minlength=len(raws))
        k = self.size
        begin = np.cumsum(n) - n
        count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        owner = np.repeat(np.arange(len(raws)), count)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + begin[owner]
        out = np.zeros(len(owner), np.uint64)
        for j in range(k):
            there = at + j < begin[owner] + n[owner]
            out = out * _B + np.where(there, h[np.minimum(at + j, max(len(h) - 1, 0))] if len(h) else _U(0), _U(0))
        out = mixed(out)
        order = np.lexsort((out, owner))
        owner, out = owner[order], out[order]
        first = np.ones(len(out), bool)
        first[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
        where = np.flatnonzero(first)
        times = np.diff(np.append(where, len(out)))
        return owner[where], out[where], times


def prob_minhash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, registers: int, seed: int = 1) -> np.ndarray:
    """ProbMinHash signatures (``n`` by ``registers``): the element whose exponential arrival at a register is first.

    Every element arrives in a Poisson process whose rate is its weight, each time at a random
    register; both follow from the element alone. Two texts agree in a register with the probability
    that is their probability Jaccard similarity. An element stops once it arrives later than the latest
    of its text's registers. All texts take their k-th arrivals together. Texts without elements: zeros.
    """
    first = np.full((n, registers), np.inf)
    best = np.zeros((n, registers), np.uint64)
    latest = np.full(n, np.inf)
    flat_first, flat_best = first.reshape(-1), best.reshape(-1)
    at = np.zeros(len(element))
    k = 0
    while len(element):
        k += 1
        bits = mixed(element + _U((k * int(_A) + seed * int(_C)) & 0xFFFFFFFFFFFFFFFF))
        at = at - np.log1p(-(bits >> _U(11)).astype(np.float64) * 2.0**-53) / weight
        going = at < latest[owner]
        owner, element, weight, at, bits = owner[going], element[going], weight[going], at[going], bits[going]
        slot = owner * registers + (mixed(bits ^ _A) % _U(registers)).astype(np.int64)
        np.minimum.at(flat_first, slot, at)
        won = flat_first[slot] == at
        flat_best[slot[won]] = element[won]
        texts = np.unique(owner)
        latest[texts] = first[texts].max(axis=1) if len(texts) else 0.0
    return best


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct values; 0 for empty ones."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)
