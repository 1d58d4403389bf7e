"""Line-first quality rules: punctuation, navigation and boilerplate are judged line by line, failing
lines go, and a document that loses too much of its text with them is rejected.

Only DataFrame functions: every document is handled inside its own row, so nothing is shuffled and
no group of rows can be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, reserved, words

#: Prose has one of these behind a word, closing quotes or brackets apart.
PAUSE = r"""[.!?:;,…。！？]["'”’»)\]]*([\x20\x09-\x0D]|\z)"""
#: Marks between menu entries.
SEPARATORS = ("|", "»", "›", "•", "·", ">")
#: Characters of markup and noise.
SYMBOLS = "#*$%&|<>"
#: Phrases of legal notices, consent banners and page furniture (lower case).
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "enable javascript",
    "licensed under",
    "powered by",
    "privacy policy",
    "sign up for our newsletter",
    "subscribe to our",
    "terms of service",
    "terms of use",
    "use of cookies",
    "we use cookies",
)
WINDOW = 5


def _without(text: Column, chars) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _count(text: Column, chars) -> Column:
    return F.length(text) - F.length(_without(text, chars))


def line_fails(line: Column, max_symbols: float = 0.1, max_separators: int = 2, max_shouts: float = 0.3) -> Column:
    """The line rules; true when one of them fails.

    * punctuation: no pause or sentence end on the line, more than ``max_symbols`` of its characters are
      markup symbols, or more than ``max_shouts`` exclamation marks a word;
    * navigation: more than ``max_separators`` menu separators;
    * boilerplate: it holds one of the ``BOILERPLATE`` phrases.

    A line without a word never fails (it holds no text to lose).
    """
    n_words = F.length(F.regexp_replace(line, r"[^\x20]+", "")) + 1
    shouts = _count(line, "!")
    lowered = F.lower(line)
    phrase = F.lit(False)
    for p in BOILERPLATE:
        phrase = phrase | F.contains(lowered, F.lit(p))
    punctuation = (
        ~F.rlike(line, F.lit(PAUSE))
        | (_count(line, SYMBOLS) > max_symbols * F.length(line))
        | ((shouts > 2) & (shouts > max_shouts * n_words))
    )
    navigation = _count(line, SEPARATORS) > max_separators
    return (F.btrim(line, F.lit(SPACES)) != "") & (punctuation | navigation | phrase)


def clean_lines(df: DataFrame, text_col: str = "text", max_lost: float = 0.5, **rules) -> DataFrame:
    """``df`` with the line-first verdict.

    Adds ``clean_text`` (the lines that pass, in order), ``n_lines`` (lines with a word),
    ``n_failed_lines``, ``lost`` (share of the characters of those lines that failed) and ``accepted``
    (``lost`` is at most ``max_lost``). NULL and empty texts: no lines, ``lost`` 0, accepted, and
    ``clean_text`` is the text itself. Columns of ``df`` with one of these names are replaced. Rows
    are independent of each other, so repeats and ties need no rule.
    """
    lines, passing = reserved(df, "_lines"), reserved(df, "_passing")
    text = F.col(text_col)
    out = df.withColumn(lines, F.split(F.coalesce(text, F.lit("")), "\n", -1))
    out = out.withColumn(passing, F.filter(lines, lambda x: ~line_fails(x, **rules)))
    # Characters and number of the lines with a word, by whole-array functions (no loop over lines).
    chars = lambda c: F.length(F.array_join(c, ""))
    total, kept = chars(lines), chars(passing)
    n_lines = F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(SPACES)) != "")).cast("long")
    added = {
        "clean_text": F.when(text.isNotNull(), F.array_join(passing, "\n")),
        "n_lines": n_lines,
        "n_failed_lines": (F.size(lines) - F.size(passing)).cast("long"),
        "lost": F.when(total > 0, (total - kept) / total).otherwise(F.lit(0.0)),
    }
    keep = [c for c in df.columns if c not in (*added, "accepted")]
    out = out.select(*keep, *[v.alias(k) for k, v in added.items()])
    return out.withColumn("accepted", F.col("lost") <= max_lost)


def text_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with whole-text counts: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and
    ``n_repeat_words`` (words in ``WINDOW``-word windows found twice or more in the text, the first
    included), all long. NULL counts as a text without words. Windows are told apart by 64-bit hashes
    of their words, within one text only.
    """
    names = {k: reserved(df, k) for k in ("_words", "_hashes", "_sorted", "_linelist")}
    w, h, s, ln = names.values()
    text = F.coalesce(F.col(text_col), F.lit(""))
    full_lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    # Generated, so that a later filter on a count is not rewritten into the loops over windows.
    out = df.select("*", F.inline(F.array(F.struct(words(F.col(text_col)).alias(w), full_lines.alias(ln)))))
    starts = F.when(F.size(w) >= WINDOW, F.sequence(F.lit(0), F.size(w) - WINDOW)).otherwise(
        F.array().cast("array<int>")
    )
    out = out.withColumn(h, F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])))
    # Only texts with a repeated window sort their windows.
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    ordered = F.when(F.size(F.array_distinct(h)) < F.size(h), pairs)
    out = out.select("*", F.inline(F.array(F.struct(ordered.alias(s)))))
    same = lambda j, x: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    twice = F.filter(s, lambda x, j: same(j - 1, x) | same(j + 1, x))
    covered = F.aggregate(
        F.sort_array(F.transform(twice, lambda x: x["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct(
            (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end")
        ),
        lambda a: a["n"],
    )
    added = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": _count(text, SYMBOLS),
        "n_dup_lines": F.size(ln) - F.size(F.array_distinct(ln)),
        "n_repeat_words": F.when(F.col(s).isNull(), F.lit(0)).otherwise(covered),
    }
    keep = [c for c in df.columns if c not in added]
    return out.select(*keep, *[v.cast("long").alias(k) for k, v in added.items()])


def quality_rules(
    df: DataFrame,
    text_col: str = "text",
    max_lost: float = 0.5,
    min_words: int = 10,
    max_repeat_pct: int = 20,
    **rules,
) -> DataFrame:
    """The whole verdict: line-first cleaning and the document counts.

    Adds the columns of ``clean_lines`` and ``text_counts``, ``base_failed`` (fewer than ``min_words``
    words, or more than ``max_repeat_pct`` percent of them in repeated windows) and ``kept`` (not
    ``base_failed`` and accepted by the line rules). NULL and empty texts have no words and fail.
    """
    out = text_counts(clean_lines(df, text_col, max_lost, **rules), text_col)
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_pct)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & F.col("accepted"))
