"""From raw documents to tokens: toxic documents go, one document of each near-duplicate class stays, repeated
passages are cut out, sources are mixed to their target weights, and the mix is tokenised.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soilcast.llm import bpe, minhash, mixing, repeats, toxicity
from soilcast.llm.common import read, stored
from soilcast.llm.queries import MIX_SHARE, MIX_WEIGHTS, held_out, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a calibrated toxicity of less than one half."""
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "text", text_hash.alias("h"))
    scores, _ = toxicity.score_documents(rows, read(spark, sf_dir, "labels"), ~held_out())
    rejected = stored(scores.where("score >= 0.5").select("doc_id", "h").distinct(), "toxic")
    d, r = docs.withColumn("h", text_hash).alias("d"), rejected.alias("r")
    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.h") == F.col("r.h"))
    return d.join(r, same, "left_anti").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that with the least id."""
    return minhash.one_per_class(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of repeated strings; a document that is all repeated stays, empty."""
    out = repeats.remove_repeats(docs, as_text=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept"))
    new = {"text": text, "n_chars": F.when(F.size("spans") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each epoch, the last of a source cut at its budget."""
    return mixing.mixed_documents(docs, mixing.mix(docs, MIX_WEIGHTS, MIX_SHARE))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of every document of the mix."""
    path = vocabulary()
    out = bpe.digests(bpe.encode(docs.select("doc_id", "text"), path, decoded_col="decoded"))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", tokenise),
]

#: Fitted trees, signatures and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
