import random

import xxhash
from pyspark.sql import functions as F

from soilcast.llm import fingerprints, queries

from .helpers import awkward, clashing, docs, words


def brute(text):
    w = words(text)
    votes, n = [0] * 64, 0
    for i in range(max(1, len(w) - 4) if w else 0):
        h = 42
        for x in w[i : i + 5]:
            h = xxhash.xxh64(x.encode(), seed=h).intdigest()
        n += 1
        for k in range(64):
            votes[k] += h >> k & 1
    return sum((2 * v > n) << k for k, v in enumerate(votes))


def test_votes_against_brute_force(spark):
    df = clashing(awkward(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), "_words", "term", "n")
    got = fingerprints.simhash(df, ["doc_id"]).withColumn("hex", fingerprints.fp_hex(F.col("fp"))).collect()
    texts = {r.doc_id: r.text for r in df.collect()}
    assert len(got) == len(texts)
    for r in got:
        assert r.hex == f"{brute(texts[r.doc_id]):016x}", r.doc_id
    assert fingerprints.simhash(df.limit(0), ["doc_id"]).count() == 0


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in list(fps):
        for _ in range(6):
            for b in rng.sample(range(64), rng.randint(1, 6)):
                f ^= 1 << b
            fps.append(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in [*fps, 0, 0]]
    df = spark.createDataFrame([(f,) for f in signed] + [(None,)], "fp long")
    for radius, blocks in ((3, 6), (2, 4), (0, 1)):
        got = sorted((r.query_fp, r.fp, r.distance) for r in fingerprints.near_fingerprints(df.limit(100), df, radius, blocks).collect())
        bits = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
        all_fps = set(signed)
        expected = sorted((a, b, bits(a, b)) for a in set(signed[:100]) for b in all_fps if bits(a, b) <= radius)
        assert got == expected


def test_order_is_a_ring(spark):
    df = spark.range(0, 1000, 7).selectExpr("id AS doc_id", "id * 2 AS n").repartition(5)
    df = df.unionByName(spark.createDataFrame([(None, 5)], "doc_id long, n long"))
    got = {r.doc_id: r for r in fingerprints.in_order(df, ["doc_id"], ["n"], "ring").collect()}
    ids = [None, *range(0, 1000, 7)]
    for k, i in enumerate(ids):
        assert got[i].next_doc_id == ids[(k + 1) % len(ids)] and got[i].prev_doc_id == ids[k - 1]
        assert got[i].prev_n == got[ids[k - 1]].n


def test_query_against_brute_force(spark, tmp_path):
    df = awkward(spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_simhash(spark, str(tmp_path)).collect()
    assert len(got) == 12
    rows = sorted({(r.doc_id, r.text or "") for r in df.collect()}, key=lambda r: (r[0] is not None, r[0] or 0))
    import hashlib

    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for k, (i, text) in enumerate(rows):
        if i is None:
            continue
        q = len(text) // 4
        nxt = rows[(k + 1) % len(rows)][1]
        if k + 1 < len(rows):  # the two rows without id are ordered by their texts' hash
            edited = text[: len(text) - q] + nxt[:q]
            assert by_id[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert by_id[i].fingerprint == f"{brute(text):016x}" and by_id[i].edited_fingerprint == f"{brute(edited):016x}"
            near = 1 - (brute(text) ^ brute(nxt)).bit_count() / 64
            assert by_id[i].near_next == near and by_id[i].n_chars == len(text)
