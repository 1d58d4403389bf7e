import numpy as np
import pytest

from soilcast.operators import eda


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    rows = []
    for g in ["s", "w"]:
        vals = np.round(rng.normal(size=3000), 2)  # many ties
        vals[:1000] = 0.5  # a hot value holding a third of the group
        rows += [(g, float(v)) for v in vals]
    rows.append(("one", 7.0))
    rows.append(("s", None))
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.1, 0.33, 0.5, 0.9, 1.0]
    got = {(r.g, r.prob): r.quantile for r in eda.quantile_summary(df, ["x"], probs, by=["g"], partitions=7).collect()}
    for g in ["s", "w", "one"]:
        v = np.array([x for gg, x in rows if gg == g and x is not None])
        for p in probs:
            assert got[(g, p)] == pytest.approx(float(np.quantile(v, p)), abs=1e-12)


def test_approx_quantiles_within_rank_error(spark):
    vals = [float(i) for i in range(10000)]
    df = spark.createDataFrame([("g", v) for v in vals], "g string, x double")
    got = {r.prob: r.quantile for r in eda.quantile_summary(df, ["x"], [0.5], by=["g"], accuracy=1000).collect()}
    assert abs(got[0.5] - 5000) <= 10000 / 1000


def test_missing_profile_group_without_values(spark):
    df = spark.createDataFrame([("s", None), ("s", 1.0), ("w", None), ("w", float("nan"))], "season string, x double")
    got = {r.season: (r.n, r.n_missing, r.share_missing) for r in eda.missing_profile(df, ["x"]).collect()}
    assert got == {"s": (2, 1, 0.5), "w": (2, 2, 1.0)}


def test_summary_histogram_correlations(spark):
    df = spark.createDataFrame([("s", 1.0, 2.0), ("s", 2.0, 4.0), ("s", 4.0, 8.1), ("s", None, 1.0)], "season string, a double, b double")
    s = {r.column: r for r in eda.numeric_summary(df, ["a", "b"]).collect()}
    assert s["a"].n == 3 and s["a"].mean == pytest.approx(7 / 3) and s["a"].max == 4.0
    h = {r.bin: r.n for r in eda.histogram(df, "b", 2.0).collect()}
    assert h == {0: 1, 1: 1, 2: 1, 4: 1}
    c = eda.correlations(df, ["a", "b"]).first()
    assert c.n == 3 and c.r == pytest.approx(np.corrcoef([1, 2, 4], [2, 4, 8.1])[0, 1])


def test_ungrouped_eda(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 7.0), (None, 1.0)], "a double, b double")
    prof = {r.column: (r.n, r.n_missing) for r in eda.missing_profile(df, ["a", "b"], by=[]).collect()}
    assert prof == {"a": (4, 1), "b": (4, 1)}
    q = {(r.column, r.prob): r.quantile for r in eda.quantile_summary(df, ["a", "b"], [0.5], by=[]).collect()}
    assert q == {("a", 0.5): 2.0, ("b", 0.5): 2.0}
    s = {r.column: r.mean for r in eda.numeric_summary(df, ["a"], by=[]).collect()}
    assert s == {"a": 2.0}
    assert eda.histogram(df, "a", 1.0, by=[]).count() == 3
    assert eda.correlations(df, ["a", "b"], by=[]).first().n == 2


def test_selection_and_ranges_agree_without_a_row_sized_exchange(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    rows = [(["x", "y", None][i % 3], float(v), None if i % 5 == 0 else float(round(v * 3))) for i, v in enumerate(rng.normal(size=3000))]
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(6)
    probs = [0.0, 0.01, 0.5, 0.731, 0.99, 1.0]
    got = [
        sorted((str(r.g), r.column, r.prob, round(r.quantile, 12)) for r in eda.quantile_summary(df, ["a", "b"], probs, ["g"], method=m).collect())
        for m in ("select", "ranges")
    ]
    assert got[0] == got[1] and len(got[0]) == 3 * 2 * 6
    for g in ("x", "y", None):
        own = [r[1] for r in rows if r[0] == g]
        want = dict(zip(probs, np.quantile(own, probs)))
        assert all(abs(want[p] - q) < 1e-9 for s, c, p, q in got[0] if s == str(g) and c == "a")


def test_selection_falls_back_when_a_bracket_misses(spark, monkeypatch):
    monkeypatch.setattr(eda, "_SKETCH", 2)
    monkeypatch.setattr(eda, "_REACH", 0.0)
    df = spark.range(2000).selectExpr("'g' AS g", "CAST(id AS DOUBLE) AS a")
    assert eda._selected(df, ["a"], [0.37], ["g"]) is None
    assert eda.quantile_summary(df, ["a"], [0.37], ["g"]).first().quantile == 0.37 * 1999
