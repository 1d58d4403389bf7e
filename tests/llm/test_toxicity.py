from pyspark.sql import functions as F

from soilcast.llm import queries, toxicity

from .helpers import awkward, clashing


NONE = toxicity.Lexicon({}, 0, 0)


def plain(text):
    return dict(zip(toxicity.PLAIN, toxicity.text_features(text, toxicity.Marks(NONE))[0], strict=True))


def test_features():
    f = plain("You are an IDIOT! 1d1ot m.o.r.o.n st*pid")
    assert f["insult_kinds"] == 1 and f["insult_near_you"] > 0 and f["shouted_rate"] > 0 and f["obfuscated_insults"] >= 1
    clean = plain("A calm day with quiet words.")
    assert clean["insult_kinds"] == clean["obfuscated_insults"] == clean["insult_near_you"] == 0
    for t in (None, ""):
        one, learned = toxicity.text_features(t, toxicity.Marks(NONE))
        assert one == [0.0] * len(toxicity.PLAIN) and learned == [[0.0] * len(toxicity.LEARNED)] * 3


def test_lexicon_is_learned_and_takes_a_text_out_again(spark):
    rows = [(k, f"grobulon wort{k} ende", 1) for k in range(40)] + [(100 + k, f"wort{k} ruhig ende", 0) for k in range(200)]
    df = spark.createDataFrame(rows, "h long, text string, toxic int")
    lex = toxicity.learn_lexicon(df)
    assert lex.counts["=grobulon"] == (40, 0) and "^grob" in lex.counts and "=ende" not in lex.counts
    assert (lex.toxic, lex.clean) == (40, 200) and len(toxicity.learn_lexicon(df, entries=2).counts) == 2
    whole, without, other = lex.best("grobulon")
    assert whole > without > 0 and lex.best("ruhig") == (0.0, 0.0, 0.0) and other > 0
    once = toxicity.Lexicon({"=x": (1, 0)}, 5, 50)
    assert once.best("x")[1] == 0.0  # nothing is left of an entry that only this text has taught
    marks = toxicity.Marks(lex)
    _, learned = toxicity.text_features("Grobulon, ruhig", marks)
    assert learned[0][1] >= learned[1][1] > 0 and learned[0][3] == 1.0


def test_held_out_accuracy(spark):
    """Over all held-out labels, whatever the lexicon holds."""
    d = "/root/testdata/sf0.1"
    out = queries.op7_toxicity(spark, d).cache()
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert out.count() == docs.count() and out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    rows = out.where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    toxic, clean = ([r.predicted for r in rows if r.toxic == k] for k in (1, 0))
    assert len(toxic) > 90 and sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.02 * len(clean)
    assert out.groupBy("held_out").count().count() == 2


def test_awkward_rows_and_few_labels(spark):
    df = clashing(awkward(spark), "score", "insult_density", "_probability", "_h")
    labels = spark.createDataFrame([(1, 0), (2, 0), (4, None), (None, 1), (3, 5)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0)):
        scores, model = toxicity.score_documents(df, some, F.lit(True))
        assert model.trees is None and scores.count() == 12 and {r.score for r in scores.collect()} == {0.0}
    mixed = spark.createDataFrame([(1, 0), (2, 1), (6, 0), (7, 0), (8, 1), (9, 1), (9, 0)], "doc_id long, toxic int")
    scores, _ = toxicity.score_documents(df, mixed, F.lit(True), iterations=2)
    assert scores.count() == 12 and scores.where("score BETWEEN 0 AND 1").count() == 12
    scores, _ = toxicity.score_documents(df.limit(0), mixed, F.lit(True))
    assert scores.count() == 0
