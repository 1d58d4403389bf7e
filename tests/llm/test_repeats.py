import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from soilcast.llm import queries, repeats

from .helpers import awkward, clashing, docs, prose


def brute(rows, width):
    """(doc_id, n_bytes, removed, spans, kept) by counting every window."""
    raws = [(i, (t or "").encode()) for i, t in rows]
    n = Counter(raw[k : k + width] for _, raw in raws for k in range(len(raw) - width + 1))
    out = []
    for i, raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - width + 1):
            if n[raw[k : k + width]] > 1:
                gone[k : k + width] = True
        gone[len(raw)] = False
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append((-1 if i is None else i, len(raw), int(gone.sum()), int((np.diff(gone.astype(int)) == -1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df, **options):
    return sorted(
        (-1 if r.doc_id is None else r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest())
        for r in repeats.remove_repeats(df, **options).collect()
    )


@pytest.mark.parametrize("width", [4, 7, 30])
def test_interval_expansion(width):
    rng = random.Random(width)
    for _ in range(60):
        s = [rng.choice([1, 2, 3]) for _ in range(300)]
        for _ in range(4):
            a, b, n = rng.randrange(250), rng.randrange(250), rng.randint(1, 45)
            s[b : b + n] = s[a : a + n]
        s = [0, *s[:150], 0, *s[150:], 0]
        n = Counter(tuple(s[k : k + width]) for k in range(len(s)))
        hit = repeats.repeated_places(np.array(s), width)
        for k in range(len(s) - width + 1):
            if 0 not in s[k : k + width]:
                assert hit[k] == (n[tuple(s[k : k + width])] > 1)


@pytest.mark.parametrize(("width", "gram", "group"), [(200, 50, 2000), (200, 50, 0), (40, 12, 2000), (12, 12, 0)])
def test_against_brute_force(spark, width, gram, group):
    rng = random.Random(7)
    shared = [prose(500 + k, 60) for k in range(4)]
    rows = []
    for k in range(40):
        parts = [prose(k, rng.randint(0, 80))] + [s[rng.randint(0, 30) : len(s) - rng.randint(0, 30)] for s in rng.sample(shared, rng.randint(0, 3))]
        rows.append((k, rng.choice(["", " ", "\n"]).join(parts + [prose(900 + k, 10)])))
    rows += [(50, rows[3][1]), (51, rows[3][1] + "!"), (52, "é" * 300), (53, "z" * 900), (54, shared[0] + shared[0]), (None, shared[1]), (55, None), (56, "")]
    df = docs(spark, rows)
    assert result(df, width=width, gram=gram, group=group) == brute(rows, width)


def test_long_text_in_pieces(spark):
    rng = random.Random(1)
    text = "".join(rng.choices("abcdefgh ", k=repeats.PIECE + 50_000))
    passage = text[repeats.PIECE - 150 : repeats.PIECE + 450]  # across the end of a piece
    rows = [(1, text), (2, "before " + passage + " behind"), (3, text[100:500])]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in repeats.remove_repeats(docs(spark, rows)).collect()}
    start = repeats.PIECE - 150
    assert got[1][0][0] in (99, 100) and abs(got[1][1][0] - start) <= 3 and abs(got[1][1][1] - start - 600) <= 3 and len(got[1]) == 2
    assert len(got[2]) == 1 and abs(got[2][0][1] - got[2][0][0] - 600) <= 6 and got[3] == [(0, 400)]


def test_query_and_awkward_rows(spark, tmp_path):
    df = awkward(spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op8_repeats(spark, str(tmp_path)).collect())
    assert got == brute([(r.doc_id, r.text) for r in df.collect()], 200)
    clash = clashing(df, "spans", "_doc", "gram", "place", "doc", "kept")
    assert result(clash) == brute([(r.doc_id, r.text) for r in df.collect()], 200)
    assert repeats.remove_repeats(clash.limit(0)).count() == 0
    texts = repeats.remove_repeats(docs(spark, [(1, "é" * 150 + "x"), (2, "yé" + "é" * 150)]), as_text=True).collect()
    assert all(isinstance(r.kept, str) and "�" not in r.kept for r in texts)
