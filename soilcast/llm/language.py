"""Language identification by compression: a text belongs to the language whose zstandard dictionary, raw
content of training texts, compresses it best; narrow margins are rejected.

Texts and dictionaries are compared as runs of lower-case letters with single spaces between, so
capitals, digits and decoration do not count. Dictionaries come from a bounded, hash-chosen sample
of the labelled rows; every text is scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, reserved, stored

#: Bytes of text in a language's dictionary at most.
DICTIONARY_BYTES = 96 << 10
#: Texts sampled for a dictionary at most.
SAMPLE_TEXTS = 128
#: Parts of a language that are ranked by themselves first.
PARTS = 256
#: Share of the best size by which the next language must be larger.
MARGIN = 0.01
LEVEL = 7
UNDETERMINED = "und"
_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters_only(text: str) -> bytes:
    return _NO_LETTERS.sub(" ", text.lower()).strip().encode("utf-8")


def training_texts(labelled: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> DataFrame:
    """``lang``, ``text``: for each language ``sample_texts`` different texts at most, those with the least hash.

    Only languages and hashes are shuffled, copies made one before they are ranked, first in parts of each
    language, so that no task ranks a whole one; texts are fetched for the chosen hashes.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.rlike("text", F.lit(r"\p{L}")))
    rows = rows.select("lang", "text", F.xxhash64("text").alias("h"))
    chosen = rows.select("lang", "h").distinct().withColumn("part", F.pmod(F.xxhash64(F.lit(3), "h"), F.lit(PARTS)))
    for by in (["lang", "part"], ["lang"]):
        w = Window.partitionBy(*by).orderBy("h")
        chosen = chosen.withColumn("at", F.row_number().over(w)).where(F.col("at") <= sample_texts)
    chosen = stored(chosen.select("lang", "h"), "language-sample")
    return rows.join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.max("text").alias("text"))


def _turned(raw: bytes, h: int) -> bytes:
    """``raw`` from the word nearest to a place chosen by ``h`` on, its beginning put behind its end."""
    at = raw.find(b" ", h % max(1, len(raw))) + 1
    return raw if not at else raw[at:] + b" " + raw[: at - 1]


def _level(sizes: list[int], room: int) -> int:
    """The most that each may give so that all together fit into ``room``."""
    for k, size in enumerate(sorted(sizes)):
        share = room // (len(sizes) - k)
        if size > share:
            return share
        room -= size
    return max(sizes)


def dictionaries(
    labelled: DataFrame, sample_texts: int = SAMPLE_TEXTS, dictionary_bytes: int = DICTIONARY_BYTES
) -> dict[str, bytes]:
    """Raw-content dictionaries of the languages in ``labelled`` (``lang``, ``text``), the one with the most
    rows first (ties: by name). All sampled texts are in: short ones whole, of longer ones equally long stretches from a
    place chosen by hash, so that a dictionary is full where there is text enough. NULL languages and texts without letters teach nothing. Driver
    memory: ``sample_texts`` times ``dictionary_bytes`` a language at most."""
    texts = training_texts(labelled, sample_texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = [letters_only(t) for t in b.column("text").to_pylist()]
            raws = [r if len(r) <= dictionary_bytes else _turned(r, h)[:dictionary_bytes] for r, h in zip(raws, b.column("h").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("h"), pa.array(raws, pa.binary())], ["lang", "h", "raw"])

    found: dict[str, list[tuple[bytes, int]]] = {}
    for r in map_batches(texts.select("lang", "h", "text"), run, "lang string, h long, raw binary").orderBy("lang", "h").toLocalIterator():
        found.setdefault(r["lang"], []).append((bytes(r["raw"]), r["h"]))
    content: dict[str, bytes] = {}
    for lang, raws in found.items():
        most = max(_level([len(x) + 1 for x, _ in raws], dictionary_bytes) - 1, 0)
        content[lang] = b"".join((x if len(x) <= most else _turned(x, h)[:most]) + b" " for x, h in raws)[:dictionary_bytes]
    rows = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {k: content[k] for k in sorted(content, key=lambda k: (-rows[k], k))}


def identify(
    df: DataFrame,
    dicts: dict[str, bytes],
    text_col: str = "text",
    margin: float = MARGIN,
    level: int = LEVEL,
) -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` and ``rejected`` for every whole text.

    Of the languages, the one with the least compressed size wins (ties: the first of ``dicts``); ``score`` is
    0.5 where the next one is equally good and nears 1 as it gets worse; ``rejected`` tells that the next
    one is larger by less than the ``margin`` share. A NULL text and one without a letter are ``und``
    with score 0, rejected, and so are all texts if ``dicts`` is empty. With a single language its score is 1. An empty table gives an
    empty one. Columns of ``df`` with these names are replaced.
    """
    names = list(dicts)
    keep = [c for c in df.columns if c not in ("lang_pred", "score", "rejected")]
    letters = reserved(df, "_letters")
    rows = df.select(*keep).withColumn(letters, F.coalesce(F.rlike(text_col, F.lit(r"\p{L}")), F.lit(False)))
    shared = df.sparkSession.sparkContext.broadcast([dicts[n] for n in names])
    added = ["lang_pred", "score", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        compressors = []
        for raw in shared.value:
            d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            compressors.append(
                zstd.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            )
        for b in batches:
            preds, scores, rejected = [], [], []
            for text, has in zip(b.column(text_col).to_pylist(), b.column(letters).to_pylist(), strict=True):
                if not has or not names:
                    preds.append(UNDETERMINED)
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                raw = letters_only(text)
                sizes = [len(c.compress(raw)) for c in compressors]
                best = min(range(len(sizes)), key=sizes.__getitem__)
                rest = min((s for k, s in enumerate(sizes) if k != best), default=None)
                gap = 1.0 if rest is None else rest / sizes[best] - 1.0
                preds.append(names[best])
                scores.append(1.0 if rest is None else 0.5 + 0.5 * gap / (gap + 5 * margin))
                rejected.append(gap < margin)
            cols = [pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], [*keep, *added])

    shape = rows.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")).schema
    return map_batches(rows, run, shape)
