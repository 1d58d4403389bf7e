import random

import pytest

from soilcast.llm import queries, token_counts
from soilcast.llm.pretokens import PART, Splitter, parts

from .helpers import awkward, clashing, docs, prose

PATH = queries.vocabulary(queries.COUNTED)
STRANGE = [
    None, "", " ", "\n\t", "  a  b \n\n c", "It's we'll I'D x''s", "ÀÉ ß İ Σίσυφος", "日本語 テキスト 12 345 ٣٤ Ⅷ ²", "<|endoftext|>",
    "a<|endoftext|> b <|endoftext|><|endoftext|>", "<|endoftext", "\x1c\x85\xa0 z ​", "🙂👍🏽 ok", "a" * 5000, " " * 3000 + "x", "\x00 \x01",
    "x1!" * 900, "tab\t\tend ", "﻿start", "\U0001f1e9\U0001f1ea ١\U000e0100",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda s: len(t.encode(s or "", add_special_tokens=False).ids)


def test_splitter_is_the_library():
    """Every character that the two could class apart is found, here one of every 64 of all planes."""
    split = Splitter(PATH, plain_special=True)
    rng = random.Random(1)
    texts = [t for t in STRANGE if t] + ["".join(rng.choice("aé1٣ \n\t.'s!<|>²\xa0") for _ in range(200)) for _ in range(200)]
    texts += ["".join(f"a{chr(c)} " for c in range(k, k + 64) if not 0xD800 <= c < 0xE000) for k in range(128, 0x30000, 4096)]
    for t in texts:
        got = split.pieces(t)
        assert got is None or [p for part in got for p in part] == split._split(t), t


def test_parts_are_no_cut_through_pretokens():
    split = Splitter(PATH, plain_special=True)
    text = "ab  cd \n e' f, 's 12 " * 400
    for size in (1, 7, 100):
        cut = list(parts(text, size))
        assert "".join(cut) == text and len(cut) > 1
        assert [p for t in cut for p in split._find(t)] == split._split(text)
    assert list(parts("x" * (PART + 5))) == ["x" * (PART + 5)] and list(parts("")) == [""]


def test_summaries_keep_frequent_pieces():
    from collections import Counter

    counts = Counter({"the": 500, **{f"w{k}": 1 for k in range(300)}})
    kept = token_counts.pruned(counts, 10)
    assert kept["the"] == 499 and len(kept) <= 10


@pytest.mark.parametrize("frequent,cached", [(1, 3), (50, 200_000), (1 << 16, 200_000)])
def test_counts_are_the_library_whatever_the_tiers_hold(spark, library, frequent, cached):
    df = awkward(spark).unionByName(docs(spark, [(100 + k, t) for k, t in enumerate(STRANGE)])).repartition(20)
    token_counts._COUNTERS.clear()
    got = token_counts.count_tokens(df, PATH, frequent=frequent, cached=cached).select("doc_id", "n_chars", "n_tokens").collect()
    expected = [(r.doc_id or -1, r.n_chars or -1, library(r.text)) for r in df.collect()]
    assert sorted((r.doc_id or -1, r.n_chars or -1, r.n_tokens) for r in got) == sorted(expected)


def test_frequent_pieces_cover_all_tasks(spark):
    rows = [(k, " common" * 50 + f" rare{k}") for k in range(40)]
    pieces = token_counts.frequent_pieces(docs(spark, rows).repartition(20), PATH, most=2)
    assert pieces[0] == " common" and len(pieces) <= 2
    assert token_counts._unpacked(token_counts.packed_table(PATH, [" common", "é x", ""]))[" common"] == 1


def test_query(spark, tmp_path, library):
    df = awkward(spark).unionByName(docs(spark, [(50, prose(3, 2000))]))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op13_token_counts(spark, str(tmp_path)).collect())
    expected = [(r.doc_id or -1, len((r.text or "").encode()), n := library(r.text), n > 1024) for r in df.collect()]
    assert got == sorted(expected)


def test_clashing_columns_and_empty_table(spark, tmp_path):
    df = clashing(awkward(spark), "n_tokens", "_tokens", "piece")
    out = token_counts.count_tokens(df, PATH)
    assert out.columns.count("n_tokens") == 1 and out.where("_tokens = 'own'").count() == 12
    assert token_counts.count_tokens(df, PATH, out_col="text").columns.count("text") == 1
    awkward(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_token_counts(spark, str(tmp_path)).count() == 0
