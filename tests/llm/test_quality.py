from collections import Counter

from soilcast.llm import quality

from .helpers import awkward, clashing, docs, prose, words


def repeated(text):
    w = words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)})


def test_counts_against_brute_force(spark):
    loop = "a b c d e f " * 3 + prose(4, 30) + "\nx y\nx y\n \n \nx y # <b>"
    rows = [(10, loop), (11, "a a a a a a a"), (12, "a b c d e a b c d e"), (13, "a b c d"), (14, "é è # ü\n#")]
    df = awkward(spark).unionByName(docs(spark, rows))
    for r in quality.text_counts(df).collect():
        w = words(r.text)
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        assert r.n_words == len(w) and r.word_chars == sum(map(len, w))
        assert r.n_symbols == sum((r.text or "").count(c) for c in "#*$%&|<>")
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == repeated(r.text)


def test_line_rules_and_rejection(spark):
    good = "A sentence that stays where it is, and another one that follows it."
    text = "\n".join([good, "Home | News | Sport | Contact.", "no end", "All rights reserved.", "", "BUY! NOW!! YES!!!", "#$% %% ## &&."])
    junk = "Home | News | Sport | Contact.\n" * 5 + good
    got = {r.doc_id: r for r in quality.clean_lines(docs(spark, [(1, text), (2, junk), (3, good)])).collect()}
    assert got[1].clean_text == good + "\n" and got[1].n_lines == 6 and got[1].n_failed_lines == 5
    assert got[1].accepted == (got[1].lost <= 0.5)
    assert not got[2].accepted and got[2].lost > 0.5
    assert got[3].accepted and got[3].lost == 0 and got[3].clean_text == good


def test_null_empty_and_clashing_columns(spark):
    df = clashing(awkward(spark), "kept", "lost", "_lines", "_words", "clean_text", "n_words")
    out = quality.quality_rules(df)
    got = out.collect()
    assert len(got) == 12 and out.columns.count("kept") == 1 and got[0]["_lines"] == "own"
    for r in got:
        if r.text is None:
            assert r.clean_text is None and r.n_words == 0 and r.base_failed and not r.kept and r.accepted
    assert quality.quality_rules(df.limit(0)).count() == 0


def test_clean_labelled_documents_stay(spark):
    d = "/root/testdata/sf0.01"
    out = quality.quality_rules(spark.read.parquet(f"{d}/documents.parquet"))
    rows = out.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("NOT base_failed").select("quality", "kept").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)
