import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from soilcast.llm import negatives, queries
from soilcast.llm.negatives import Best, Block, Tile, least_tree, search

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    kept = []
    for i, v, lab in rows:
        if lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            lab = (lab + 1) % 10
        kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v], lab))
    out = []
    last = lambda i: (i is None, i or 0)
    for k, (i, v, lab) in enumerate(kept):
        if i is None or i % 50:
            continue
        score = [sum(a * b for a, b in zip(v, w)) for _, w, _ in kept]
        pos = sorted((n for n in range(len(kept)) if n != k and kept[n][2] == lab), key=lambda n: (-score[n], last(kept[n][0])))[:5]
        for p in pos:
            fit = [n for n in range(len(kept)) if kept[n][2] != lab and 50 * score[p] <= 100 * score[n] <= 95 * score[p]]
            for rank, n in enumerate(sorted(fit, key=lambda n: (-score[n], last(kept[n][0])))[:3], 1):
                out.append((i, kept[p][0], rank, kept[n][0], score[p], score[n]))
    return sorted(out, key=str)


def got_rows(df):
    return sorted((tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def table(seed, n, dims=8, labels=10):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, dims))
    x = centre[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(int(i), [float(np.float32(c)) for c in v], int(rng.integers(0, labels))) for i, v in enumerate(x)]


def strange():
    nan, inf = float("nan"), float("inf")
    rows = table(1, 500, labels=3)
    rows += [(50, None, 1), (100, [1.0] * 8, None), (150, [nan] + [0.5] * 7, 1), (200, [inf] + [0.5] * 7, 2), (250, [None] + [0.5] * 7, 2)]
    rows += [rows[50], rows[50], rows[53], (None, rows[50][1], rows[50][2]), (1000, [0.0] * 8, 1), (1050, [], 2), (1100, [0.5] * 3, 1), (1150, [0.5] * 8, 77)]
    rows += [(2000 + k, rows[100][1], k % 3) for k in range(40)]  # ties
    return rows


@pytest.mark.parametrize("seed,n,labels", [(1, 600, 10), (2, 300, 2), (3, 120, 1)])
def test_query_equals_brute_force(spark, tmp_path, seed, n, labels):
    rows = table(seed, n, labels=labels)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert got_rows(queries.op12_hard_negatives(spark, str(tmp_path))) == brute(rows)


def test_awkward_rows(spark, tmp_path):
    rows = strange()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("uid", "x", "lab", "block", "tile", "anchor")})
    df.write.parquet(f"{tmp_path}/a/embeddings.parquet")
    assert got_rows(queries.op12_hard_negatives(spark, f"{tmp_path}/a")) == brute(rows)
    df.limit(0).write.parquet(f"{tmp_path}/b/embeddings.parquet")
    assert queries.op12_hard_negatives(spark, f"{tmp_path}/b").count() == 0
    df.where("vec_id = 51").write.parquet(f"{tmp_path}/c/embeddings.parquet")
    assert queries.op12_hard_negatives(spark, f"{tmp_path}/c").count() == 0


def test_small_tiles_and_blocks_change_nothing(spark):
    rows = strange()
    df = spark.createDataFrame(rows, SCHEMA).where(negatives.usable(spark.createDataFrame(rows, SCHEMA)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    df = df.select("vec_id", F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("embedding"), label.alias("label"))
    anchor = F.col("vec_id") % 50 == 0
    got = got_rows(negatives.hard_negatives(df, anchor, tile=3, block=37))
    assert got == brute(rows)


def test_tree_spans_with_least_edges():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 5))
    order, parent, edge = least_tree(x)
    assert sorted(order.tolist()) == list(range(40)) and (parent == -1).sum() == 1
    place = {int(n): k for k, n in enumerate(order)}
    for n in range(40):
        if parent[n] >= 0:
            assert place[int(parent[n])] < place[n] and math.isclose(edge[n], np.linalg.norm(x[n] - x[parent[n]]))
    left, total = set(range(1, 40)), 0.0  # Kruskal's weight by another way
    root = list(range(40))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for d, i, j in sorted((float(np.linalg.norm(x[i] - x[j])), i, j) for i in range(40) for j in range(i)):
        if find(i) != find(j):
            root[find(i)] = find(j)
            total += d
    assert left and math.isclose(total, edge.sum())


def test_bounds_spare_scores_of_near_anchors():
    """Anchors close together, candidates far apart: most scores follow from the parent's."""
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(4000, 16)))
    a = np.floor(256 * rng.normal(size=16)) + np.round(3 * rng.normal(size=(60, 16)))
    lab = np.zeros(4000, np.int64)
    block = Block(x, lab, np.arange(4000) + 100, list(range(4000)))
    s = x @ a[0]
    cut = float(np.sort(s)[-40])
    order, parent, edge = least_tree(a)
    tile = Tile(a, np.ones(60, np.int64), np.arange(60), order, parent, edge, [[(cut / 2, cut)]] * 60)
    found, scored = search(tile, block, 3, False)
    assert scored < 0.3 * 60 * 4000
    for k in range(60):
        own = x @ a[k]
        fit = [i for i in np.lexsort((np.arange(4000), -own)) if cut / 2 <= own[i] <= cut][:3]
        assert found[k][0].row.tolist() == [int(i) for i in fit]


def test_best_keeps_the_first():
    b = Best(2)
    rank = np.arange(10)
    b.offer(np.array([1.0, 5.0]), np.array([3, 4]), rank)
    b.offer(np.array([5.0, 0.0]), np.array([2, 9]), rank)
    assert b.row.tolist() == [2, 4] and b.least == 5.0


def test_scores_beyond_doubles_are_exact_or_an_error():
    x = np.array([[2.0**27 + 1, 1.0], [2.0**25, 3.0]])
    assert negatives._scores(x, np.array([1]), np.array([2.0**26, 1.0]), False).tolist() == [2.0**51 + 3]
    with pytest.raises(OverflowError):
        negatives._scores(x, np.array([0]), np.array([2.0**27 + 1, 1.0]), False)
