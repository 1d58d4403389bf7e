import random
from collections import defaultdict

import numpy as np
import pytest

from soilcast.llm import minhash, queries
from soilcast.llm.components import components
from soilcast.llm.shingles import Shingler, overlap, prob_minhash

from .helpers import awkward, clashing, docs, prose, words


def classes(rows, threshold=0.8):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-12:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[root(i)].append(doc)
    return {doc: min(least[root(i)]) for i, (doc, _) in enumerate(rows)}


def edited(text, rng, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.random()}"
    return " ".join(w)


@pytest.mark.parametrize("small", [1, 16])
def test_classes_against_brute_force(spark, small):
    """Groups of near copies whose members are often below the threshold to most others."""
    rng = random.Random(3)
    rows = [(i, prose(i, 60)) for i in range(40)]
    for g in range(3):
        base = prose(100 + g, 150, 5000)
        rows += [(1000 * (g + 1) + k, edited(base, rng, rng.randint(0, 6))) for k in range(50)]
    rows += [(9000 + k, rows[60][1]) for k in range(5)]
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, rows), small=small).collect()}
    expected = classes(rows)
    assert {i: r.class_id for i, r in got.items()} == expected
    sizes = defaultdict(int)
    for c in expected.values():
        sizes[c] += 1
    assert all(r.class_size == sizes[r.class_id] for r in got.values())


@pytest.mark.parametrize("times", [3, 30])
def test_links_where_the_differing_passage_repeats(spark, times):
    """Pairs of set Jaccard 0.8 and little more, one text with a passage of its own that repeats."""
    rows = []
    for g in range(80):
        base = " ".join(f"w{g}x{k}" for k in range(164))
        own = " ".join(f"o{g}x{k}" for k in range(36))
        rows += [(2 * g, base), (2 * g + 1, " ".join([base, *[own] * times]))]
    expected = classes(rows)
    assert all(expected[2 * g + 1] == 2 * g for g in range(80))
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs(spark, rows)).collect()} == expected


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 62, 200).astype(np.uint64), None
    b = np.concatenate([a[:150], rng.integers(0, 1 << 62, 50).astype(np.uint64)])
    wa, wb = rng.uniform(1, 3, 200), rng.uniform(1, 3, 200)
    wb[:150] = wa[:150]
    n = 20_000
    s = prob_minhash(np.repeat([0, 1], 200), np.concatenate([a, b]), np.concatenate([wa, wb]), 2, n)
    x, y = dict(zip(a.tolist(), wa, strict=True)), dict(zip(b.tolist(), wb, strict=True))
    exact = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())
    assert np.mean(s[0] == s[1]) == pytest.approx(exact, abs=0.02)
    tiny = prob_minhash(np.array([0]), np.array([7], np.uint64), np.array([1.0]), 2, 96)
    assert (tiny[0] == 7).all() and (tiny[1] == 0).all()


def test_shingles_against_brute_force():
    texts = ["a b c d e f a b c d e", "", " \t", "one two", "one two", "x" * 500 + " b\x0bc d e f", "é ü ö ä ß é ü ö ä ß"]
    owner, element, times = Shingler(5).of([t.encode() for t in texts])
    for k, t in enumerate(texts):
        w = words(t)
        grams = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
        assert sorted(times[owner == k]) == sorted(grams.count(g) for g in set(grams))
    assert set(element[owner == 3]) == set(element[owner == 4])
    assert overlap(np.array([1, 2, 3]), np.array([2, 3, 4])) == 0.5 and overlap(np.array([]), np.array([])) == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root(x) for x in touched}


def test_awkward_rows_and_one_per_class(spark):
    df = clashing(awkward(spark), "node", "_t1", "class_id", "key", "label", "bands")
    got = minhash.near_duplicates(df).collect()
    assert len(got) == 12
    for r in got:
        if r.doc_id in (1, 2):
            assert r.class_id == 1 and r.class_size == 4
        if r.doc_id in (3, 4, 5):
            assert r.class_id == r.doc_id and r.class_size == 1 and r.node is None
    out = minhash.one_per_class(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or -1 for r in out.collect())) == [-1, 1, 3, 4, 5, 6, 7, 8, 9]
    assert minhash.near_duplicates(df.limit(0)).count() == 0 and minhash.one_per_class(df.limit(0)).count() == 0


def test_structured_words_are_different_shingles(spark, tmp_path):
    """Words that polynomial hashes take for each other are documents of their own."""
    from .test_bpe import thue_morse

    rows = [(10 * k + j, w) for k, n in enumerate((1024, 2048)) for j, w in enumerate(thue_morse(n))]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op3_minhash(spark, str(tmp_path)).collect()
    assert len({r.class_id for r in got}) == 4 and {r.class_size for r in got} == {1}
