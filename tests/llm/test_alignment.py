import bisect
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from soilcast.llm import alignment, queries
from soilcast.llm.alignment import Aligner, merged, write_blocks

from .helpers import awkward, clashing, docs, prose

PATHS = [queries.vocabulary(n) for n in queries.ALIGNED]
STRANGE = [
    None, "", " ", "\n", "Hello, WORLD's  they'll\tx\r\ny", "a a a a a a b", "日本語 テキスト 12", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ a▁b",
    "🙂👍🏽 ok", "a" * 400, "ab" * 300, " lead", "trail ", "x\x00y", "é" * 100, "the the the cat", "ﬁ ² ½ Å",
]


def brute(rows):
    """Row by row, from the two libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a_lib.encode_special_tokens = True
    chars = alignment._unbyte()
    assert len(set(chars.values())) == 256
    each, pairs = [], Counter()
    for _, text in rows:
        a = a_lib.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        ab = [bytes(chars[c] for c in a_lib.id_to_token(i)) if i != 50256 else b"<|endoftext|>" for i in a]
        bb = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_lib.id_to_piece(i)]]
        whole = f" {text}".encode()
        if not text or b"".join(ab) != whole or b"".join(bb) != whole:
            a, b, ab, bb = [], [], [], []
        ae, be = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        cuts = sorted(set(ae) & set(be))
        groups = [([], []) for _ in cuts]
        for side, (ids, ends) in enumerate(((a, ae), (b, be))):
            for i, e in zip(ids, ends):
                groups[bisect.bisect_left(cuts, e)][side].append(i)
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        pairs.update(links.keys())
        text = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        each.append((len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if a else ""))
    top = defaultdict(int)
    for (x, _), n in pairs.items():
        top[x] = max(top[x], n)
    out = []
    for (i, _), (na, nb, ng, links, sha) in zip(rows, each):
        best = sum(m for p, m in links.items() if pairs[p] == top[p[0]])
        out.append((i if i is not None else -1, na, nb, ng, sum(links.values()), best, sum(m * pairs[p] for p, m in links.items()), sha))
    return sorted(out), pairs


def rows_of(df):
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((r.doc_id if r.doc_id is not None else -1, *(r[c] for c in names)) for r in df.collect())


ROWS = [(k, t) for k, t in enumerate(STRANGE)] + [(100 + k, prose(k, 60)) for k in range(30)] + [(7, "the the the cat"), (None, "the cat"), (200, prose(5, 3000))]


@pytest.mark.parametrize("buckets,lot,chunk", [(64, 4_000_000, 1 << 21), (4, 200, 3000), (1, 1000, 1000), (2, 300, 200)])
def test_align_equals_brute_force(spark, monkeypatch, buckets, lot, chunk):
    monkeypatch.setattr(alignment, "FAN_IN", 3)
    expected, pairs = brute(ROWS)
    got, counts = alignment.align(docs(spark, ROWS).repartition(3), *PATHS, buckets=buckets, lot_records=lot, chunk_bytes=chunk)
    assert rows_of(got) == expected
    if chunk == 1000:
        assert {(r.a, r.b): r.n for r in counts.collect()} == dict(pairs)
        top = defaultdict(int)
        for (x, _), n in pairs.items():
            top[x] = max(top[x], n)
        assert all(r.best == (r.n == top[r.a]) for r in counts.collect())


def test_links_beyond_the_bound_are_expanded_by_bucket(monkeypatch):
    al = Aligner(*PATHS)
    texts = [t for _, t in ROWS[:30]]
    whole = {k: (p.tolist(), d.tolist(), m.tolist()) for k, p, d, m in alignment.Aligned(al, texts).records(8)}
    monkeypatch.setattr(alignment, "EXPAND", 5)
    assert {k: (p.tolist(), d.tolist(), m.tolist()) for k, p, d, m in alignment.Aligned(al, texts).records(8)} == whole


def test_merge_of_runs(monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 4)
    monkeypatch.setattr(alignment, "HELD", 6)
    rng = np.random.default_rng(1)
    total, runs = Counter(), []
    for _ in range(9):
        pairs = np.unique(rng.integers(0, 60, 25))
        counts = rng.integers(1, 5, len(pairs))
        total.update(dict(zip(pairs.tolist(), counts.tolist())))
        runs.append(write_blocks(pairs, counts))
    got = [(p, n) for ps, ns in merged(runs) for p, n in zip(ps.tolist(), ns.tolist())]
    assert got == sorted(total.items()) and list(merged([])) == []


def test_special_strings_are_plain_text():
    al = Aligner(*PATHS)
    a, b = al.tokens(["<|endoftext|> x <s>"])
    assert 50256 not in a[0] and len(a[0]) and not {1, 2} & set(b[0].tolist())


def test_query_on_awkward_clashing_and_empty(spark, tmp_path):
    df = clashing(awkward(spark), "chunk", "place", "bucket", "pairs", "lot")
    df.write.parquet(f"{tmp_path}/a/documents.parquet")
    got = rows_of(queries.op11_alignment(spark, f"{tmp_path}/a"))
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])[0]
    df.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert queries.op11_alignment(spark, f"{tmp_path}/b").count() == 0
