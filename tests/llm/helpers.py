"""Small tables with every awkward case, and word helpers for brute-force versions."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    out = ["".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(2, 8))) for _ in range(vocabulary)]
    return " ".join(rng.choice(out) for _ in range(n))


def docs(spark, rows):
    """Documents from (doc_id, text[, source])."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward(spark):
    """NULL id, text and source, empty and white texts, ties, repeated rows, a very long text and one without a space."""
    base = prose(1, 120)
    rows = [
        (1, base, "a"), (2, base, "a"), (2, base, "a"), (3, None, "b"), (4, "", "b"), (5, " \t\n ", None), (None, base, None),
        (None, None, None), (6, "x" * 30_000, "c"), (7, prose(2, 30_000), "c"), (8, "one", ""), (9, base.upper(), "b"),
    ]
    return docs(spark, rows)


def clashing(df, *names):
    """``df`` with extra columns of these names."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("own") for n in names})
