from pyspark.sql import functions as F

from soilcast.llm import language, queries

from .helpers import awkward, clashing, docs


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    out = queries.op10_language(spark, d)
    truth = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    rows = out.join(truth, "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang and r.n >= 40]
    assert len(rows) == 1000 and sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows) and {r.lang_pred for r in rows} <= {"en", "de", "fr", "es", "und"}


def test_dictionaries_are_bounded_and_repeatable(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("lang", "text")
    rows = rows.unionByName(spark.createDataFrame([(None, "x"), ("xx", None), ("xx", "12 34")], "lang string, text string"))
    a = language.dictionaries(rows, 10, 5000)
    assert a == language.dictionaries(rows.repartition(9), 10, 5000)
    assert set(a) == {"en", "de", "fr", "es"} and all(0 < len(x) <= 5000 for x in a.values())


def test_copies_and_long_texts_leave_room(spark):
    """One text copied 5000 times among 200, and one long enough to fill a dictionary alone."""
    by_hash = [r.text for r in spark.range(200).selectExpr("concat('wort', translate(id, '0123456789', 'abcdefghij'), ' ende') AS text").orderBy(F.xxhash64("text")).collect()]
    few = spark.createDataFrame([("de", t) for t in by_hash], "lang string, text string")
    many = few.unionByName(spark.range(5000).select(F.lit("de").alias("lang"), F.lit(by_hash[2]).alias("text")))
    assert language.training_texts(many).count() == language.training_texts(few).count() == language.SAMPLE_TEXTS
    assert language.dictionaries(many) == language.dictionaries(few)
    first = spark.range(1000).selectExpr("concat('lang', translate(id, '0123456789', 'abcdefghij'), repeat(' lang', 3000)) AS text").orderBy(F.xxhash64("text")).first().text
    rows = few.unionByName(spark.createDataFrame([("de", first)], "lang string, text string"))
    raw = language.dictionaries(rows, dictionary_bytes=4000)["de"]
    assert 3990 <= len(raw) <= 4000 and sum(language.letters_only(t) + b" " in raw for t in by_hash) == language.SAMPLE_TEXTS - 1


def test_awkward_rows(spark):
    dicts = {"a": b"lorem ipsum dolor sit amet " * 40, "b": b"quick brown fox jumps over " * 40}
    df = clashing(awkward(spark), "score", "_letters", "rejected").unionByName(clashing(docs(spark, [(70, "quick brown fox jumps"), (71, "12 3!"), (72, "lorem ipsum")]), "score", "_letters", "rejected"))
    got = {r.doc_id: r for r in language.identify(df, dicts).collect()}
    for i in (3, 4, 5, 71):
        assert got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected
    assert got[70].lang_pred == "b" and got[72].lang_pred == "a" and not got[70].rejected and got[6].lang_pred in dicts
    assert language.identify(df.limit(0), dicts).count() == 0
    assert {r.score for r in language.identify(docs(spark, [(1, "abc")]), {"a": b"abc"}).collect()} == {1.0}
    for some in (df, df.limit(0)):
        none = language.identify(some, {}).collect()
        assert {(r.lang_pred, r.score, r.rejected) for r in none} <= {("und", 0.0, True)} and len(none) == some.count()


def test_query_without_training_data(spark, tmp_path):
    df = awkward(spark)
    df.limit(0).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert queries.op10_language(spark, f"{tmp_path}/a").count() == 0
    df.withColumn("lang", F.lit(None).cast("string")).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert {(r.lang_pred, r.score) for r in queries.op10_language(spark, f"{tmp_path}/b").collect()} == {("und", 0.0)}


def test_sizes_and_sample_equal_brute_force(spark):
    import zstandard as zstd

    rows = [(k, f"{w} " * (k % 5 + 1) + str(k)) for k, w in enumerate(["alpha beta", "gamma delta", "eins zwei drei", "vier funf", "uno dos"] * 10)]
    df = docs(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 5 < 2, "g").when(F.col("doc_id") % 5 < 4, "d").otherwise("e"))
    dicts = language.dictionaries(df.select("lang", "text"), 7, 120)
    for r in language.identify(df, dicts).collect():
        sizes = {}
        for name, raw in dicts.items():
            d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=language.LEVEL)
            c = zstd.ZstdCompressor(level=language.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[name] = len(c.compress(language.letters_only(rows[r.doc_id][1])))
        assert r.lang_pred == min(dicts, key=lambda n: (sizes[n], list(dicts).index(n)))
    hashes = sorted((r.h, r.lang) for r in df.select(F.xxhash64("text").alias("h"), "lang").distinct().collect())
    chosen = {(r.h, r.lang) for r in language.training_texts(df, 7).collect()}
    assert chosen == {x for lang in "gde" for x in [y for y in hashes if y[1] == lang][:7]}
