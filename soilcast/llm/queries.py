"""The registered queries: each applies one operator to its whole table and derives the agreed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, fingerprints, language, minhash, mixing, negatives, quality, repeats, token_counts, token_files, toxicity, warc
from .common import read, scratch, stored

#: Mixing: weights of the sources in code point order, repeating, and the share of all words.
MIX_WEIGHTS = [3, 1, 2]
MIX_SHARE = 1.5
#: Ids divisible by this are the queries of searches.
QUERY_EVERY = 50
#: Rows whose crc32 of the id leaves 0 on division by this are held out.
FOLDS = 5
#: Tokens: the vocabulary, and the id that ends a document.
VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Vocabularies of the alignment and of the token counts, and the tokens beyond which a text is over the limit.
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")
COUNTED = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024
#: Hard negatives: components are multiplied by this and rounded down; every so many ids the label is moved by one of so many.
VECTOR_SCALE = 256
MOVED_EVERY, LABELS = 7, 10


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id: str = "doc_id"):
    """A NULL id is not held out."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % FOLDS == 0, F.lit(False))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_lines", "n_failed_lines",
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, MIX_WEIGHTS, MIX_SHARE).select("doc_id", "size", "source_size", "target", "taken")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text. ``n_near``: for every ``QUERY_EVERY``-th id, how many
    other documents' fingerprints lie within 3 bits (NULL for the other ids). Rows that agree in id and text
    are one document repeated: it has one place in the order, and each copy returns its row."""
    docs = read(spark, sf_dir, "documents")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    key = ["doc_id", "h"]
    ids = docs.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.max(F.length("text")).alias("n"))
    order = stored(fingerprints.in_order(ids, key, ["n"], "doc-ids"), "doc-order")

    def same(a: str, b: str, prefix: str = ""):
        return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.{prefix}doc_id")) & (F.col(f"{a}.h") == F.col(f"{b}.{prefix}h"))

    placed = docs.alias("d").join(order.alias("o"), same("d", "o")).select(
        "d.doc_id", "d.h", "d.text", "o.n", "o.prev_doc_id", "o.prev_h", F.floor(F.col("o.prev_n") / 4).cast("int").alias("need")
    )
    heads = placed.where("need > 0").groupBy("prev_doc_id", "prev_h").agg(F.max(F.expr("substring(text, 1, need)")).alias("head"))
    own = placed.alias("p").join(heads.alias("s"), same("p", "s", "prev_"), "left")
    kept_chars = F.col("p.n") - F.floor(F.col("p.n") / 4).cast("int")
    edited = F.concat(F.substring(F.col("p.text"), F.lit(1), kept_chars), F.coalesce("s.head", F.lit("")))
    both = own.select("p.doc_id", "p.h", F.col("p.text").alias("text"), edited.alias("edited"))
    both = both.withColumn("edited_sha256", F.sha2("edited", 256))
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), "text"), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text"))))
    texts = both.select(*key, "edited_sha256", kinds.alias("t")).select(*key, "edited_sha256", "t.kind", "t.text")
    fps = fingerprints.simhash(texts, [*key, "edited_sha256", "kind"])
    fps = fps.groupBy(*key).agg(
        F.max("edited_sha256").alias("edited_sha256"),
        F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"),
        F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp"),
    )
    fps = stored(fps, "fingerprints")
    rows = fps.alias("f").join(order.alias("o"), same("f", "o")).select("f.*", "o.n", "o.copies", "o.next_doc_id", "o.next_h")
    nxt = fps.select(F.col("doc_id").alias("n_id"), F.col("h").alias("n_h"), F.col("fp").alias("next_fp"))
    rows = rows.join(nxt, F.col("next_doc_id").eqNullSafe(F.col("n_id")) & (F.col("next_h") == F.col("n_h")))
    asked = F.col("doc_id") % QUERY_EVERY == 0
    pairs = fingerprints.near_fingerprints(rows.where(asked), rows)
    held = rows.groupBy("fp").agg(F.sum("copies").alias("held"))
    near = pairs.join(held, "fp").groupBy("query_fp").agg(F.sum("held").alias("found"))
    rows = rows.join(near, (F.col("fp") == F.col("query_fp")) & asked, "left")
    rows = rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        fingerprints.fp_hex(F.col("fp")).alias("fingerprint"),
        fingerprints.fp_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        fingerprints.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(asked, F.col("found") - 1).alias("n_near"),
    )


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "class_id", "class_size")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    folder = scratch(spark, "tokens")
    token_files.write_tokens(docs, vocabulary(), folder, END_ID)
    return token_files.read_digests(spark, folder)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = scratch(spark, "warc")
    warc.write_archives(warc.record_chunks(warc.with_roles(pages)), folder)
    return warc.read_records(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    scores, _ = toxicity.score_documents(docs, labels, ~held_out())
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    path = vocabulary()
    out = bpe.digests(bpe.encode(docs, path, decoded_col="decoded"))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    dicts = language.dictionaries(docs.where(~held_out()).select("lang", "text"))
    out = language.identify(docs.select("doc_id", "text"), dicts)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out, _ = alignment.align(docs, *map(vocabulary, ALIGNED))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A NULL vec_id keeps its label and is no anchor."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    rows = rows.where(negatives.usable(rows))
    label = F.when(F.col("vec_id") % MOVED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(VECTOR_SCALE) * x.cast("double")).cast("double"))
    rows = rows.select("vec_id", whole.alias("embedding"), label.alias("label"))
    return negatives.hard_negatives(rows, F.col("vec_id") % QUERY_EVERY == 0)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    out = token_counts.count_tokens(docs, vocabulary(COUNTED))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from corpus_pipeline import run

    return {
        "pipeline": run,
        "op1_quality_rules": op1_quality_rules,
        "op2_mixing": op2_mixing,
        "op3_minhash": op3_minhash,
        "op4_token_files": op4_token_files,
        "op5_simhash": op5_simhash,
        "op6_warc": op6_warc,
        "op7_toxicity": op7_toxicity,
        "op8_repeats": op8_repeats,
        "op9_bpe": op9_bpe,
        "op10_language": op10_language,
        "op11_alignment": op11_alignment,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_token_counts": op13_token_counts,
    }
