import corpus_pipeline
from soilcast.llm.common import stored

from .helpers import awkward, words


def test_stages_hand_on_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, before = docs.columns, docs
    counts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, before, d), "test-stage")
        assert after.columns == columns, name
        counts[name] = (before.count(), after.count())
        ids = after.select("doc_id").distinct()
        assert ids.join(before, "doc_id", "left_anti").count() == 0
        before = after
    assert counts["toxicity"][1] < counts["toxicity"][0]
    assert counts["suffix-array dedup"][0] == counts["suffix-array dedup"][1]
    assert corpus_pipeline.run(spark, d).count() == before.count()


def test_awkward_documents_pass_all_stages(spark):
    for rows in (awkward(spark), awkward(spark).limit(0)):
        docs = rows
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, "/root/testdata/sf0.001"), "test-stage")
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert (docs.count() == 0) == (rows.count() == 0)


def test_mix_holds_its_budget(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    total = sum(len(words(r.text)) for r in docs.collect())
    mixed = corpus_pipeline.mix_sources(spark, docs, d)
    assert abs(sum(len(words(r.text)) for r in mixed.collect()) - 1.5 * total) <= 20
