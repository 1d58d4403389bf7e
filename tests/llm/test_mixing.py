from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from soilcast.llm import mixing

from .helpers import awkward, clashing, docs, prose, words


def targets(sizes, weights, share, most):
    """The excess handed round by weight until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        unit = left / sum(w[s] for s in free)
        over = [s for s in free if w[s] * unit >= most * sizes[s]]
        if not over:
            return out | {s: w[s] * unit for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def test_targets_and_cut(spark):
    rows = [(i, prose(i, 5 + i % 90), ["big", "m", "tiny", None, ""][0 if i % 2 else (i // 2) % 5]) for i in range(600)]
    df = docs(spark, rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    expected = targets(dict(sizes), [3, 1, 2], 1.5, 2)
    got = mixing.mix(df, [3, 1, 2], 1.5).collect()
    taken = defaultdict(int)
    for r in got:
        assert r.size == len(words(r.text)) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        assert r.target == pytest.approx(expected[r.source])
        taken[r.source] += r.taken
    for s in sizes:
        assert taken[s] == round(expected[s])
    partial = [r for r in got if r.size and r.taken % r.size]
    assert len(partial) <= len(sizes)  # one cut a source
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mixing.mix(df.repartition(7), [3, 1, 2], 1.5).collect())


def test_equal_rows_take_equally(spark):
    rows = [(None, "a b c d", "s")] * 50 + [(i, "e f g", "t") for i in range(20)]
    got = mixing.mix(docs(spark, rows), [1], 0.9).where("source = 's'").collect()
    assert len({r.taken for r in got}) == 1 and abs(sum(r.taken for r in got) - got[0].target) <= 50


def test_targets_just_below_whole_epochs(spark):
    """Targets 7.875 of 4 words and 2.625 of 3: rounded, they are whole epochs."""
    df = docs(spark, [(1, "a b", "s"), (2, "c d", "s"), (3, "e f", "t"), (4, "g", "t")])
    assert {r.doc_id: r.taken for r in mixing.mix(df, [3, 1]).collect()} == {1: 4, 2: 4, 3: 2, 4: 1}


def test_documents_of_the_mix(spark):
    rows = [(i, f" a{i}  b{i}\tc{i}\nd{i} ", ["s", "t"][i % 3 == 0]) for i in range(40)]
    df = docs(spark, rows)
    mixed = mixing.mix(df, [1, 3], 1.2).cache()
    out = mixing.mixed_documents(df, mixed)
    assert out.columns == df.columns
    n = defaultdict(int)
    for r in out.collect():
        n[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text) and dict(rows_of(rows))[r.doc_id].startswith(r.text)
    assert {r.doc_id: r.taken for r in mixed.collect() if r.taken} == dict(n)


def rows_of(rows):
    return [(r[0], r[1]) for r in rows]


def test_awkward_rows(spark):
    df = clashing(awkward(spark), "size", "taken", "_key", "key", "epochs", "cut_key")
    out = mixing.mix(df, [3, 1, 2])
    assert out.count() == 12 and out.where(F.col("text").isNull() & (F.col("taken") != 0)).count() == 0
    assert mixing.mixed_documents(awkward(spark), mixing.mix(awkward(spark), [3, 1, 2])).where("text IS NULL OR text = ''").count() == 0
    assert mixing.mix(df.limit(0), [3, 1, 2]).count() == 0
    assert mixing.mix(docs(spark, [(1, None), (2, "")]), [1]).agg(F.sum("taken")).first()[0] == 0
