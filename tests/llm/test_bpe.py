import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from soilcast.llm import bpe, queries
from soilcast.llm.bpe import Encoder

from .helpers import awkward, clashing, docs, prose

PATH = queries.vocabulary()
STRANGE = [
    None, "", " ", "\n\t", "a", "Hello, WORLD's  they'll\tx\r\ny", "ÀÉÎ ß ẞ İ Σίσυφος ΣΑΣ", "é ́x á\ń", "日本語 テキスト 12 345",
    "<|endoftext|>", "x<|endoftext|>y <|STARTOFTEXT|> <|startoftext|>Ab", "\x01", "a \x01 b\x01", "\x1c\x85\xa0 z", "''s's 's''t", "🙂👍🏽 ok",
    "a" * 5000, "ab'" * 2000, "x1" * 3000, "é" * 2500 + " the end", "Ab\x00c", " q",
]




def thue_morse(n):
    """Words that any polynomial hash modulo 2**64 takes for each other from 1,024 letters on."""
    word = "".join("ab"[bin(k).count("1") & 1] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


STRANGE += [w for n in (512, 1024, 2048) for w in thue_morse(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("leaf", [16, 1024])
def test_encoder_is_the_library(library, leaf):
    import numpy as np

    enc = Encoder(PATH, leaf)
    assert enc.by_pieces and enc.mark is not None
    rng = random.Random(1)
    texts = STRANGE + ["".join(rng.choice("aAbthe  \n.,'sé1\x01<|>ßİ") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    for t, raw in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == ids_of(library, t), t


def test_pieces_with_one_hash_are_told_apart(library, monkeypatch):
    """Every piece has the same hash: only its bytes tell it from others."""
    import numpy as np

    monkeypatch.setattr(bpe._Hasher, "of", lambda self, data, start, end: np.full(len(start), 12345 << 20, np.uint64))
    enc = Encoder(PATH)
    texts = ["one two three", "three two", "two, one", prose(4, 200)] * 2
    for t, raw in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == ids_of(library, t)


def test_table_shrinks(library, monkeypatch):
    import numpy as np

    monkeypatch.setattr(bpe, "CACHED_PIECES", 50)
    enc = Encoder(PATH)
    for k in range(12):
        t = prose(k % 5, 150, vocabulary=90)
        assert np.frombuffer(next(enc.encode([t])), "<u4").tolist() == ids_of(library, t)
        assert len(enc.table.known) <= 50 + 90


def test_tree_joins_equal_the_whole():
    enc = Encoder(PATH)
    rng = random.Random(2)
    for _ in range(150):
        word = "".join(rng.choice(["the", "ing", "er", "a", "qx", "tion", "zz"]) for _ in range(rng.randint(2, 120)))
        symbols = enc.symbols.of_word(word)
        assert enc.symbols.tree(symbols, rng.choice([1, 2, 3, 7, 20])) == enc.symbols.encode(symbols)


def test_texts_cut_into_rows(spark, library):
    rows = [(k, t) for k, t in enumerate(STRANGE)] + [(100, prose(3, 20_000)), (101, "tion" * 9000), (102, "q" * 40_000 + " end " + "thing" * 7000)]
    got = {r.doc_id: r.ids for r in bpe.encode(docs(spark, rows), PATH, leaf=256, long_chars=1000).collect()}
    for i, t in rows:
        assert got[i] == ids_of(library, t), i


def test_query_digests(spark, tmp_path, library):
    df = awkward(spark).unionByName(docs(spark, [(50 + k, t) for k, t in enumerate(STRANGE)]))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op9_bpe(spark, str(tmp_path)).collect())
    expected = []
    for r in df.collect():
        ids = ids_of(library, r.text)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected.append((r.doc_id or -1, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(expected)


def test_other_vocabulary_without_pieces(spark):
    """A vocabulary whose tokens hold spaces is encoded text by text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = [(k, t) for k, t in enumerate(STRANGE[:14])]
    for r in bpe.decode(bpe.encode(docs(spark, rows), path, long_chars=20), path).collect():
        ids = lib.encode(rows[r.doc_id][1] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == lib.decode(ids, skip_special_tokens=False)


def test_clashing_columns_and_empty_table(spark):
    df = clashing(awkward(spark), "ids", "decoded", "_row", "_seg", "raw")
    out = bpe.decode(bpe.encode(df, PATH, long_chars=500), PATH)
    assert out.count() == 12 and out.columns.count("ids") == 1 and out.where(F.col("_row") == "own").count() == 12
    assert bpe.decode(bpe.encode(df.limit(0), PATH), PATH).count() == 0
    assert json.dumps(out.schema.jsonValue())
