"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features are rates, so they mean the same in short and long texts. Beside a fixed list of insults there is a lexicon
learned from the labelled rows: words and word beginnings with their log odds of standing in a toxic text. A labelled text that
teaches the lexicon is measured with its own occurrences taken out, so the trees see features as of a new text. The trees are fitted
on a bounded sample of the labelled rows, the calibration on their predictions for rows they have not seen;
every whole text is scored.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, map_batches, reserved, ship, stored

#: Insults and slurs-of-degree in four languages.
INSULTS = (
    "bastard", "clown", "coward", "cretin", "crap", "damn", "disgusting", "dumb", "filth", "fool", "freak", "garbage",
    "hate", "idiot", "idiotic", "imbecile", "jerk", "liar", "loser", "moron", "moronic", "nasty", "parasite", "pathetic",
    "pig", "rat", "scum", "shit", "stupid", "trash", "ugly", "useless", "vermin", "vile", "worthless",
    "abschaum", "blöd", "dreck", "dumm", "dummkopf", "ekelhaft", "idioten", "trottel", "versager", "wertlos",
    "crétin", "dégoûtant", "imbécile", "minable", "ordure", "pathétique", "stupide",
    "asqueroso", "basura", "estúpido", "idiota", "imbécil", "inútil", "patético", "payaso", "perdedor",
)
#: Violent words.
THREATS = ("attack", "burn", "hurt", "kill", "murder", "punch", "shoot", "stab", "töten", "tuer", "matar")
#: Words that address the reader.
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "ihr", "euch",
    "tu", "te", "toi", "ton", "vous", "votre", "tú", "ti", "usted", "vosotros",
)
#: Characters that stand for letters in disguised words.
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e"}
#: Words between an insult and an address that count as near.
NEAR = 5

PLAIN = [
    "insult_density", "insult_kinds", "threat_density", "second_person_density", "insult_near_you",
    "capital_rate", "shouted_rate", "punctuation_rate", "exclamation_rate", "obfuscated_rate", "obfuscated_insults",
    "repeat_rate", "log_words",
]
LEARNED = ["learned_density", "learned_most", "learned_rate", "learned_kinds"]
FEATURES = PLAIN + LEARNED

#: Labelled ids that teach, about at most, chosen by hash.
LEARN_ROWS = 30_000
#: Of these the trees are fitted on so many different texts at most.
FIT_ROWS = 30_000
#: Entries of the learned lexicon, and the toxic texts that an entry must occur in.
ENTRIES = 8192
LEAST_TEXTS = 3
#: Letters of word beginnings that are entries besides whole words.
BEGINNINGS = (3, 4, 5, 6)
#: Lower bound of the log odds (one standard error below) from which an entry counts, and from which it counts as strong.
LEAST_ODDS, STRONG = 0.7, 3.0
#: Words whose marks a worker keeps.
CACHED = 150_000

_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[^\W\d_][0-9@$!€*.\-_]+[^\W\d_]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?![^\W_])")
_PLAIN = str.maketrans({**DISGUISES, **{c: "" for c in ".-_* "}})
_INSULT_SET, _THREAT_SET, _YOU_SET = frozenset(INSULTS), frozenset(THREATS), frozenset(SECOND_PERSON)


def _disguised(low: str) -> Iterator[str]:
    """The parts between white space that hold letters with other marks between, and letters set apart."""
    end = 0
    for m in _MIXED.finditer(low):
        if m.start() < end:  # the same part
            continue
        start, end = m.start(), m.end()
        while start and not low[start - 1].isspace():
            start -= 1
        while end < len(low) and not low[end].isspace():
            end += 1
        yield low[start:end]
    for m in _SPACED.finditer(low):
        yield m.group()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _repeats(codes: np.ndarray) -> int:
    """Runs of three or more of one character, line ends aside."""
    same = (codes[1:] == codes[:-1]) & (codes[1:] != 10)
    third = same[1:] & same[:-1]
    return int(third.sum() - (third[1:] & third[:-1]).sum()) if len(third) else 0


def terms(word: str) -> list[str]:
    """The entries that a word can meet: itself and its beginnings."""
    return [f"={word}", *(f"^{word[:k]}" for k in BEGINNINGS if len(word) > k)]


def text_terms(text: str | None) -> set[str]:
    return {t for w in set(_WORD.findall((text or "").lower())) for t in terms(w)}


class Lexicon:
    """Learned entries: in how many toxic and clean texts each occurs, of how many."""

    def __init__(self, counts: dict[str, tuple[int, int]], toxic: int, clean: int):
        self.counts, self.toxic, self.clean = counts, toxic, clean

    def odds(self, term: str, less: tuple[int, int] = (0, 0)) -> float:
        """Log odds one standard error below the estimate, with ``less`` texts taken out; 0 where they do not count."""
        a, b = self.counts[term]
        a, b = max(a - less[0], 0) + 0.5, max(b - less[1], 0) + 0.5
        w = math.log(a / (self.toxic - less[0] + 1)) - math.log(b / (self.clean - less[1] + 1)) - math.sqrt(1 / a + 1 / b)
        return w if w > LEAST_ODDS else 0.0

    def best(self, word: str) -> tuple[float, float, float]:
        """The highest log odds of a word's entries: as they are, without one toxic text, without one clean text."""
        found = [t for t in terms(word) if t in self.counts]
        if not found:
            return 0.0, 0.0, 0.0
        return tuple(max(self.odds(t, less) for t in found) for less in ((0, 0), (1, 0), (0, 1)))


class Marks(dict):
    """By word: what it counts as, packed in a whole number (1 insult, 2 threat, 4 second person; then three log odds, in
    hundredths, 12 bits each)."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        mark = (word in _INSULT_SET) | (word in _THREAT_SET) << 1 | (word in _YOU_SET) << 2
        for k, w in enumerate(self.lexicon.best(word)):
            mark |= min(4095, round(100 * w)) << (8 + 12 * k)
        if len(self) >= CACHED:
            self.clear()
        if len(word) <= 64:
            self[word] = mark
        return mark


def text_features(text: str | None, marks: Marks) -> tuple[list[float], list[list[float]]]:
    """``PLAIN`` of one whole text, and ``LEARNED`` three times: with the whole lexicon, and as if the text had taught it as a toxic
    or as a clean one and were taken out. All zero for NULL and empty."""
    none = [0.0] * len(LEARNED)
    if not text:
        return [0.0] * len(PLAIN), [none] * 3
    low = text.lower()
    found = _WORD.findall(low)
    got = np.fromiter(map(marks.__getitem__, found), np.int64, len(found))
    n_words = max(1, text.count(" ") + text.count("\n") + 1)
    n_chars = len(text)
    insults, you = np.flatnonzero(got & 1), np.flatnonzero(got & 4)
    near = 0
    if len(insults) and len(you):
        k = np.searchsorted(you, insults)
        left = np.where(k > 0, insults - you[np.maximum(k - 1, 0)], NEAR + 1)
        right = np.where(k < len(you), you[np.minimum(k, len(you) - 1)] - insults, NEAR + 1)
        near = int((np.minimum(left, right) <= NEAR).sum())
    disguised = n_mixed = 0
    for part in _disguised(low):
        n_mixed += 1
        disguised += part.translate(_PLAIN).strip("#%&,;:?\"'()") in _INSULT_SET
    codes = _codes(low)
    # Capitals are what lower case changes.
    own = codes if text == low else _codes(text)
    capitals = int((own != codes).sum()) if len(own) == len(codes) else sum(map(str.isupper, text))
    shouted = sum(1 for t in text.split() if len(t) > 2 and t.isupper()) if capitals else 0
    plain = [
        len(insults) / n_words,
        float(len({found[i] for i in insults.tolist()})),
        int((got >> 1 & 1).sum()) / n_words,
        len(you) / n_words,
        near / n_words,
        capitals / n_chars,
        shouted / n_words,
        sum(map(text.count, ".,;:?!\"'()*#$%&|<>")) / n_chars,
        text.count("!") / n_chars,
        n_mixed / n_words,
        float(disguised),
        _repeats(codes) / n_words,
        float(np.log1p(n_words)),
    ]
    learned = []
    for k in range(3):
        w = (got >> (8 + 12 * k) & 4095) / 100
        if not w.any():
            learned.append(none)
            continue
        strong = np.flatnonzero(w >= STRONG)
        total = max(1, len(found))
        learned.append([float(w.sum()) / total, float(w.max()), len(strong) / total, float(len({found[i] for i in strong.tolist()}))])
    return plain, learned


def learn_lexicon(labelled: DataFrame, entries: int = ENTRIES) -> Lexicon:
    """From ``labelled`` (``h``, ``text``, ``toxic``: different texts, a bounded number): the entries that speak most for a toxic text.

    The terms of toxic texts are counted first; the commonest are candidates, and only these are looked for in
    clean texts. Driver memory: sixteen times ``entries`` candidates at most."""

    def toxic_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                counts.update(text_terms(text))
            if len(counts) > 500_000:
                yield _counted(counts)
                counts = Counter()
        yield _counted(counts)

    def _counted(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon({}, toxic, clean)
    found = map_batches(labelled.where("toxic = 1").select("text"), toxic_terms, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = found.where(F.col("n") >= LEAST_TEXTS).orderBy(F.col("n").desc(), "term").limit(16 * entries)
    candidates = {r["term"]: r["n"] for r in found.collect()}
    wanted = labelled.sparkSession.sparkContext.broadcast(frozenset(candidates))

    def clean_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                counts.update(text_terms(text) & wanted.value)
        yield _counted(counts)

    rest = map_batches(labelled.where("toxic = 0").select("text"), clean_terms, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    against = {r["term"]: r["n"] for r in rest.collect()}  # candidates only
    lexicon = Lexicon({t: (n, against.get(t, 0)) for t, n in candidates.items()}, toxic, clean)
    odds = {t: lexicon.odds(t) for t in lexicon.counts}
    kept = sorted((t for t in odds if odds[t] > 0), key=lambda t: (-odds[t], t))[:entries]
    return Lexicon({t: lexicon.counts[t] for t in kept}, toxic, clean)


def features(df: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """``df`` without its text and with ``PLAIN`` and three times ``LEARNED`` (``_0``: of a new text, ``_1`` and ``_2``: of one that
    taught the lexicon as toxic or clean), double, one pass over whole texts."""
    names = [*PLAIN, *(f"{c}_{k}" for k in range(3) for c in LEARNED)]
    keep = [c for c in df.columns if c not in (text_col, *FEATURES, *names)]
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((lexicon.counts, lexicon.toxic, lexicon.clean))
    own = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = held(("toxicity", own), lambda: Marks(Lexicon(*shared.value)))
        for b in batches:
            rows = []
            for t in b.column(text_col).to_pylist():
                plain, learned = text_features(t, marks)
                rows.append(plain + learned[0] + learned[1] + learned[2])
            got = np.array(rows, np.float64).reshape(-1, len(names))
            cols = [pa.array(got[:, k]) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], [*keep, *names])

    shape = df.select(*keep, *[F.lit(0.0).alias(c) for c in names]).schema
    return map_batches(df.select(*keep, text_col), run, shape)


def _as(df: DataFrame, kind, keep: list[str]) -> DataFrame:
    """Features with the learned ones of a ``kind`` (0, 1 or 2; a Column)."""
    pick = [F.when(kind == 1, F.col(f"{c}_1")).when(kind == 2, F.col(f"{c}_2")).otherwise(F.col(f"{c}_0")).alias(c) for c in LEARNED]
    return df.select(*keep, *PLAIN, *pick)


class ToxicityModel:
    """Fitted trees and their calibration."""

    def __init__(self, trees: GBTClassificationModel | None, calibration: IsotonicRegressionModel | None, prior: float):
        self.trees, self.calibration, self.prior = trees, calibration, prior

    def score(self, feats: DataFrame) -> DataFrame:
        """``feats`` without the features and with ``score`` (0 to 1)."""
        keep = [c for c in feats.columns if c not in (*FEATURES, "score")]
        if self.trees is None:  # one class only: its share
            return feats.select(*keep, F.lit(self.prior).alias("score"))
        raw = _margins(self.trees, feats)
        if self.calibration is None:
            return raw.select(*keep, F.col("_probability").alias("score"))
        got = self.calibration.transform(raw)
        return got.select(*keep, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_calibrated"))).alias("score"))


def _margins(trees: GBTClassificationModel, feats: DataFrame) -> DataFrame:
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(feats)
    got = trees.transform(vectors)
    return got.withColumn("_probability", vector_to_array("_p").getItem(1)).drop("_p", "_raw", "_prediction", "_features")


#: Parts of the labelled rows; the calibration sees each part through trees fitted on the other ones.
PARTS = 3


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, iterations: int = 12, depth: int = 3, seed: int = 7) -> ToxicityModel:
    """Fit on ``labelled``: ``h`` (a hash of the text), ``toxic`` (0 or 1; other rows teach nothing) and the ``FEATURES``.

    Equal texts are one row, toxic if any is. Another hash of ``h`` bounds the rows to ``fit_rows`` in expectation
    and deals them into ``PARTS``: every row is predicted by trees that have not seen it, and these predictions calibrate the
    trees fitted on all rows. So few labels serve both."""
    rows = labelled.where(F.col("toxic").isin(0, 1)).groupBy("h").agg(F.max(F.struct("toxic", *FEATURES)).alias("r")).select("h", "r.*")
    rows = rows.withColumn("toxic", F.col("toxic").cast("double"))
    rows = rows.withColumn("_h", F.pmod(F.xxhash64(F.lit(seed), "h"), F.lit(1 << 30)))
    rows = stored(rows.withColumn("_part", (F.col("_h") % PARTS).cast("int")), "toxicity-labelled")
    n, pos = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0.0))).first()
    if not n or pos in (0, n):
        return ToxicityModel(None, None, pos / n if n else 0.0)
    if n > fit_rows:
        rows = rows.where(F.floor(F.col("_h") / PARTS) < fit_rows / n * ((1 << 30) // PARTS))
    gbt = GBTClassifier(
        featuresCol="_features", labelCol="toxic", predictionCol="_prediction", maxIter=iterations, maxDepth=depth,
        stepSize=0.3, seed=seed, minInstancesPerNode=5,
    )
    gbt.setProbabilityCol("_p").setRawPredictionCol("_raw")

    def trees_on(some: DataFrame) -> GBTClassificationModel:
        train = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(some)
        # Few, full partitions: a boosting round is as quick as its slowest task.
        return gbt.fit(train.select("toxic", "_features").coalesce(rows.sparkSession.sparkContext.defaultParallelism))

    both = {r["_part"] for r in rows.groupBy("_part").agg(F.countDistinct("toxic").alias("k")).where("k = 2").collect()}
    if len(both) < PARTS:  # too few labels to hold any out
        return ToxicityModel(trees_on(rows), None, pos / n)
    held = None
    for k in range(PARTS):
        own = _margins(trees_on(rows.where(F.col("_part") != k)), rows.where(F.col("_part") == k)).select("toxic", "_probability")
        held = own if held is None else held.unionByName(own)
    iso = IsotonicRegression(featuresCol="_probability", labelCol="toxic", predictionCol="_calibrated", isotonic=True)
    return ToxicityModel(trees_on(rows), iso.fit(held), pos / n)


def score_documents(
    docs: DataFrame, labels: DataFrame, learn_from, id_col: str = "doc_id", text_col: str = "text", learn_rows: int = LEARN_ROWS, **fitting
) -> tuple[DataFrame, ToxicityModel]:
    """``docs`` without its text and with ``score``, one row per row; and the model. ``labels`` holds ``id_col`` and
    ``toxic``; the model learns from the labelled rows for which ``learn_from`` (a Column over ``id_col``) holds, from
    about ``learn_rows`` ids of them at most (chosen by hash).

    NULL and empty texts have features of zero and are scored like any other. Rows with a NULL id
    are scored and teach nothing; a text that occurs repeatedly teaches once, as toxic if any of its labels is. With
    labels of one class only, or none, every score is that class's share (0 without labels). Very long texts are read whole, row by
    row. An empty table gives an empty result. Columns of ``docs`` named like a feature or ``score`` are dropped.
    """
    marks = labels.select(F.col(id_col), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & learn_from)
    marks = stored(marks.groupBy(id_col).agg(F.max("toxic").alias("toxic")), "toxicity-labels")
    n = marks.count()
    if n > learn_rows:
        marks = marks.where(F.pmod(F.xxhash64(F.lit(11), id_col), F.lit(1 << 30)) < learn_rows / n * (1 << 30))
    marks = F.broadcast(marks)  # about ``learn_rows`` ids and labels at most
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    taught = docs.select(id_col, F.col(text_col).alias("text")).where(learn_from).join(marks, id_col)
    taught = taught.groupBy(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))
    lexicon = learn_lexicon(stored(taught, "toxicity-texts"))
    kept, place = [c for c in docs.columns if c not in (*FEATURES, "score", text_col)], reserved(docs, "_text_hash")
    feats = stored(features(docs.select(*kept, text_col, h.alias(place)), lexicon, text_col), "toxicity-features")
    seen = feats.where(learn_from).join(marks, id_col)
    model = fit(_as(seen, F.when(F.col("toxic") == 1, 1).otherwise(2), [F.col(place).alias("h"), "toxic"]), **fitting)
    return model.score(_as(feats, F.lit(0), kept)), model
