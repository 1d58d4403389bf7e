import heapq
import random
import zlib

import numpy as np
import pytest

from soilcast.llm import queries, token_files
from soilcast.llm.token_files import Codebook, code_lengths

from .helpers import awkward, clashing, docs


def huffman_bits(counts):
    heap = list(counts)
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        total += x
        heapq.heappush(heap, x)
    return total


def test_lengths_are_optimal_and_limited():
    rng = random.Random(1)
    for n in (2, 3, 10, 300, 4000):
        counts = np.array([int(1 + 1e6 * rng.random() ** 9) for _ in range(n)])
        free = code_lengths(counts, 40)
        assert (free.astype(int) * counts).sum() == huffman_bits(counts.tolist())
        for limit in (int(np.ceil(np.log2(n))) or 1, 14):
            got = code_lengths(counts, limit)
            assert got.max() <= limit and np.sum(2.0 ** -got.astype(float)) <= 1
            assert (got.astype(int) * counts).sum() >= (free.astype(int) * counts).sum()
    fib = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    assert code_lengths(fib, 40).max() == 9 and code_lengths(fib, 4).max() == 4
    assert code_lengths(np.array([5]), 20).tolist() == [1] and len(code_lengths(np.array([], int), 20)) == 0
    with pytest.raises(ValueError):
        code_lengths(np.ones(5), 2)


def test_canonical_codes_round_trip():
    rng = np.random.default_rng(2)
    for n_symbols, size in ((1, 700), (3, 1), (5000, 70_000), (40_000, 3), (200, 256), (200, 512)):
        symbols = np.sort(rng.choice(60_000, n_symbols, replace=False))
        counts = rng.integers(1, 100_000, n_symbols) ** 2
        book = Codebook(symbols, code_lengths(counts, 20), 20)
        ids = rng.choice(symbols, size)
        payload, n_bits, points = book.encode(ids)
        assert len(payload) == (n_bits + 7) // 8 and len(points) == -(-size // token_files.EVERY)
        assert (book.decode(payload, points, size) == ids).all()
    # Canonical: codes of one length are consecutive in order of id.
    book = Codebook(np.array([7, 3, 9]), np.array([2, 2, 1]), 20)
    assert book.ids.tolist() == [9, 3, 7] and book.codes.tolist() == [0, 2, 3]


def test_query_against_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    df = awkward(spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op4_token_files(spark, str(tmp_path)).collect()
    lib = Tokenizer.from_file(queries.vocabulary())
    lib.no_truncation()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    expected = sorted((r.doc_id or -1, crc([*lib.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in df.collect())
    assert sorted((r.doc_id or -1, r.ids_crc32) for r in got) == expected
    at, last = 0, None
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (last is None or (r.doc_id is not None and r.doc_id >= last))
        at, last = at + r.n_tokens, r.doc_id


def test_small_blocks_and_empty_table(spark, tmp_path):
    path = queries.vocabulary()
    df = clashing(docs(spark, [(k, "word " * k) for k in range(60)]), "shard", "raw", "at", "start")
    token_files.write_tokens(df, path, f"{tmp_path}/t", 1, block_ids=100, every=16)
    assert spark.read.parquet(f"{tmp_path}/t/blocks").count() > 10
    rows = token_files.read_tokens(spark, f"{tmp_path}/t", every=16).collect()
    assert sorted(len(r.ids) for r in rows) == list(range(1, 61)) and all(r.ids[-1] == 1 for r in rows)
    token_files.write_tokens(df.limit(0), path, f"{tmp_path}/e", 1)
    assert token_files.read_digests(spark, f"{tmp_path}/e").count() == 0
