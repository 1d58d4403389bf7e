"""DuckDB SQL oracles for the registered queries (tables are pre-registered views).

Every double is rounded as in the Spark query; integers are cast to the Spark type.
"""

from __future__ import annotations

R6, R4 = 6, 4

OBS = """
obs_g AS (
  SELECT l_orderkey AS k1, l_linenumber AS k2, min(l_shipdate) AS ts,
         min(l_quantity) AS q, min(l_discount) AS d, min(l_tax) AS t
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
obs_s AS (
  SELECT *, CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) IN (3, 4, 5) THEN 'spring'
                 WHEN month(ts) IN (6, 7, 8) THEN 'summer' WHEN month(ts) IN (9, 10, 11) THEN 'autumn' END AS season
  FROM obs_g),
obs AS (
  SELECT k1, k2, ts, season,
         q AS a0, 2e0 * q + 100e0 * d AS b0, 100e0 * t + 0.5e0 * q AS c0,
         CASE WHEN k1 % 7 <> 3 THEN q END AS a,
         CASE WHEN k1 % 11 <> 5 THEN 2e0 * q + 100e0 * d END AS b,
         CASE WHEN k1 % 13 <> 4 THEN 100e0 * t + 0.5e0 * q END AS c,
         1.5e0 * q + 50e0 * d + 30e0 * t
           + CASE season WHEN 'summer' THEN 20e0 WHEN 'winter' THEN -20e0 ELSE 0e0 END AS y,
         CASE WHEN k1 % 5 = 0 THEN 'test' ELSE 'train' END AS split,
         CAST(k1 % 3 AS INTEGER) AS fold
  FROM obs_s),
tr AS (SELECT * FROM obs WHERE split = 'train'),
te AS (SELECT * FROM obs WHERE split = 'test')"""


def with_obs(body: str) -> str:
    return "WITH " + OBS + ",\n" + body


def r(x: str, d: int = R6) -> str:
    return f"round({x}, {d})"


def linear_stack_sql(pre: str, trf: str, tef: str, scenario: str) -> str:
    """CTEs of the linear stack for one scenario; ``trf``/``tef`` give k1, k2, season, y, (fold,) a.

    Bases: training-season mean and line on a; meta: least squares without intercept.
    Ends with ``{pre}long`` (keys, season, scenario, model, y, prediction).
    """
    return f"""
{pre}trf AS ({trf}),
{pre}tef AS ({tef}),
{pre}folds AS (SELECT DISTINCT fold AS h FROM {pre}trf),
{pre}sm_oof AS (SELECT h, season, avg(y) AS m FROM {pre}folds JOIN {pre}trf ON fold <> h GROUP BY h, season),
{pre}om_oof AS (SELECT h, avg(y) AS m FROM {pre}folds JOIN {pre}trf ON fold <> h GROUP BY h),
{pre}ln_oof AS (SELECT h, regr_slope(y, a) AS s, regr_intercept(y, a) AS i FROM {pre}folds JOIN {pre}trf ON fold <> h GROUP BY h),
{pre}oof AS (
  SELECT x.k1, x.k2, x.season, x.fold, x.y, coalesce(sm.m, om.m) AS p1, ln.i + ln.s * x.a AS p2
  FROM {pre}trf x LEFT JOIN {pre}sm_oof sm ON sm.h = x.fold AND sm.season = x.season
  JOIN {pre}om_oof om ON om.h = x.fold JOIN {pre}ln_oof ln ON ln.h = x.fold),
{pre}mm AS (SELECT sum(p1 * p1) AS s11, sum(p1 * p2) AS s12, sum(p2 * p2) AS s22,
              sum(p1 * y) AS s1y, sum(p2 * y) AS s2y FROM {pre}oof),
{pre}w AS (SELECT (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS w1,
             (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS w2 FROM {pre}mm),
{pre}sm_all AS (SELECT season, avg(y) AS m FROM {pre}trf GROUP BY season),
{pre}om_all AS (SELECT avg(y) AS m FROM {pre}trf),
{pre}ln_all AS (SELECT regr_slope(y, a) AS s, regr_intercept(y, a) AS i FROM {pre}trf),
{pre}pred AS (
  SELECT e.k1, e.k2, e.season, e.y, coalesce(sm.m, om.m) AS p1, ln.i + ln.s * e.a AS p2
  FROM {pre}tef e LEFT JOIN {pre}sm_all sm ON sm.season = e.season CROSS JOIN {pre}om_all om CROSS JOIN {pre}ln_all ln),
{pre}long AS (
  SELECT k1, k2, season, '{scenario}' AS scenario, 'season_mean' AS model, y, p1 AS prediction FROM {pre}pred
  UNION ALL SELECT k1, k2, season, '{scenario}', 'line_a', y, p2 FROM {pre}pred
  UNION ALL SELECT k1, k2, season, '{scenario}', 'stack', y, w1 * p1 + w2 * p2 FROM {pre}pred CROSS JOIN {pre}w)"""


MET = """
met AS (
  SELECT scenario, model, season, CASE WHEN grouping(season) = 1 THEN 'all' ELSE 'season' END AS level, count(*) AS n,
         sqrt(avg((prediction - y) * (prediction - y))) AS rmse,
         avg(abs(prediction - y)) AS mae,
         1e0 - sum((prediction - y) * (prediction - y)) / (count(*) * var_pop(y)) AS r2
  FROM long GROUP BY GROUPING SETS ((scenario, model, season), (scenario, model)))"""

def stumps_sql(pre: str, train: str, features=("a", "b", "c"), rounds: int = 2, step: float = 0.5, bins: int = 256) -> str:
    """CTEs that boost stumps on the rows of ``train`` (y and the features, NULL being missing).

    Edges are the distinct quantiles at i/bins of ``{pre}edge_rows`` (given by the caller); each round takes the split of
    most gain, missing values tried left (0) and right (1). Ends with ``{pre}s0`` (start) and ``{pre}b1``… (fi, e, side, vl, vr).
    """
    fs = list(enumerate(features))
    out = [f"{pre}s0 AS (SELECT avg(y) AS m FROM {train})"]
    out.append(f"{pre}g1 AS (SELECT t.*, y - m AS g FROM {train} t CROSS JOIN {pre}s0)")
    probs = "[" + ", ".join(f"{i / bins!r}" for i in range(1, bins)) + "]"
    out.append(
        f"{pre}edges AS ("
        + " UNION ALL ".join(f"SELECT DISTINCT {i} AS fi, unnest(quantile_cont({f}, {probs})) AS e FROM {pre}edge_rows" for i, f in fs)
        + ")"
    )
    for n in range(1, rounds + 1):
        v = " UNION ALL ".join(f"SELECT {i} AS fi, {f} AS x, count(*) AS n, sum(g) AS s FROM {pre}g{n} GROUP BY {f}" for i, f in fs)
        out.append(f"{pre}v{n} AS ({v})")
        out.append(
            f"{pre}t{n} AS (SELECT fi, sum(n) AS tn, sum(s) AS ts, coalesce(sum(n) FILTER (WHERE x IS NULL), 0) AS nm, "
            f"coalesce(sum(s) FILTER (WHERE x IS NULL), 0e0) AS sm FROM {pre}v{n} GROUP BY fi)"
        )
        out.append(
            f"{pre}c{n} AS (SELECT e.fi, e.e, sum(v.n) AS nl, sum(v.s) AS sl FROM {pre}edges e JOIN {pre}v{n} v ON v.fi = e.fi AND v.x <= e.e GROUP BY e.fi, e.e)"
        )
        out.append(
            f"{pre}d{n} AS (SELECT c.fi, c.e, side, tn, ts, CASE WHEN side = 0 THEN nl + nm ELSE nl END AS n1, "
            f"CASE WHEN side = 0 THEN sl + sm ELSE sl END AS s1 FROM {pre}c{n} c JOIN {pre}t{n} t ON t.fi = c.fi "
            f"CROSS JOIN (VALUES (0), (1)) AS z(side) WHERE side = 0 OR nm > 0)"
        )
        out.append(
            f"{pre}b{n} AS (SELECT fi, e, side, {step!r} * s1 / n1 AS vl, {step!r} * (ts - s1) / (tn - n1) AS vr FROM {pre}d{n} "
            f"WHERE n1 > 0 AND tn > n1 ORDER BY s1 * s1 / n1 + (ts - s1) * (ts - s1) / (tn - n1) DESC, side, fi, e LIMIT 1)"
        )
        out.append(f"{pre}g{n + 1} AS (SELECT r.* REPLACE (g - {stump_value(f'b', features)} AS g) FROM {pre}g{n} r CROSS JOIN {pre}b{n} b)")
    return ",\n".join(out)


def stump_value(b: str, features=("a", "b", "c"), row: str = "r") -> str:
    """What the stump ``b`` adds to a row."""
    x = "CASE " + " ".join(f"WHEN {b}.fi = {i} THEN {row}.{f}" for i, f in enumerate(features)) + " END"
    return f"CASE WHEN {x} IS NULL THEN CASE WHEN {b}.side = 0 THEN {b}.vl ELSE {b}.vr END WHEN {x} <= {b}.e THEN {b}.vl ELSE {b}.vr END"


# The flagship: mean-filled a (training mean).
LINEAR_STACK = (
    "fm AS (SELECT avg(a) AS ma FROM tr),"
    + linear_stack_sql(
        "",
        "SELECT tr.k1, tr.k2, tr.season, tr.y, tr.fold, coalesce(tr.a, fm.ma) AS a FROM tr, fm",
        "SELECT te.k1, te.k2, te.season, te.y, coalesce(te.a, fm.ma) AS a FROM te, fm",
        "mean",
    )
    + ","
    + MET
)


def grid_sql(common_rows: bool = False) -> str:
    """Scenario × model × season leaderboard over the gap columns a and b."""
    sel = "SELECT {t}.k1, {t}.k2, {t}.season, {t}.y{fold}, {a} AS a FROM {src}"
    parts = [_mean_fills(("a", "b")), _iterative()]
    specs = {
        "mean": ("coalesce(o.a, gm.m_a)", "obs o CROSS JOIN gm", None),
        "mean_by_season": ("coalesce(o.a, sm.m_a, gm.m_a)", "obs o LEFT JOIN sm USING (season) CROSS JOIN gm", None),
        "iterative": ("f.z_a", "obs o JOIN itf f USING (k1, k2)", None),
        "complete_cases": ("o.a", "obs o", "o.a IS NOT NULL AND o.b IS NOT NULL"),
    }
    longs = []
    for i, (scen, (a, src, cond)) in enumerate(specs.items()):
        pre = f"g{i}_"
        where_tr = f" WHERE o.split = 'train'" + (f" AND {cond}" if cond else "")
        where_te = f" WHERE o.split = 'test'" + (f" AND {cond}" if cond else "")
        trf = sel.format(t="o", fold=", o.fold", a=a, src=src) + where_tr
        tef = sel.format(t="o", fold="", a=a, src=src) + where_te
        parts.append(linear_stack_sql(pre, trf, tef, scen).strip())
        longs.append(f"SELECT * FROM {pre}long")
    if common_rows:
        parts.append("long_all AS (" + " UNION ALL ".join(longs) + ")")
        parts.append(
            "common AS (SELECT k1, k2 FROM long_all WHERE prediction IS NOT NULL GROUP BY k1, k2 "
            "HAVING count(DISTINCT scenario) = (SELECT count(DISTINCT scenario) FROM long_all))"
        )
        parts.append("long AS (SELECT * FROM long_all WHERE (k1, k2) IN (SELECT (k1, k2) FROM common))")
    else:
        parts.append("long AS (" + " UNION ALL ".join(longs) + ")")
    parts.append(MET.strip())
    return with_obs(",\n".join(parts) + f" SELECT {{cols}}, rank() OVER (PARTITION BY level, season ORDER BY round(rmse, 6)) AS rk FROM met")


MET_COLS = f"scenario, model, season, level, n, {r('rmse')} AS rmse, {r('mae')} AS mae, {r('r2')} AS r2"


def _iterative(cols: tuple[str, str] = ("a", "b"), rounds: int = 3) -> str:
    """Two-column chained regressions written out round by round; last CTE is it{rounds}_{cols[1]}."""
    a, b = cols
    parts = [
        f"im AS (SELECT avg({a}) AS m_{a}, avg({b}) AS m_{b} FROM tr)",
        f"it0_{b} AS (SELECT obs.k1, obs.k2, obs.split, obs.{a}, obs.{b}, "
        f"coalesce(obs.{a}, m_{a}) AS z_{a}, coalesce(obs.{b}, m_{b}) AS z_{b} FROM obs, im)",
    ]
    prev = f"it0_{b}"
    for rnd in range(1, rounds + 1):
        for tgt, oth in ((a, b), (b, a)):
            cur = f"it{rnd}_{tgt}"
            parts.append(
                f"co{rnd}_{tgt} AS (SELECT regr_slope({tgt}, z_{oth}) AS s, regr_intercept({tgt}, z_{oth}) AS i "
                f"FROM {prev} WHERE split = 'train' AND {tgt} IS NOT NULL)"
            )
            z_t = f"CASE WHEN {tgt} IS NULL THEN i + s * z_{oth} ELSE {tgt} END"
            z_o = f"z_{oth}"
            z_a, z_b = (z_t, z_o) if tgt == a else (z_o, z_t)
            parts.append(
                f"{cur} AS (SELECT k1, k2, split, {a}, {b}, {z_a} AS z_{a}, {z_b} AS z_{b} FROM {prev}, co{rnd}_{tgt})"
            )
            prev = cur
    parts.append(f"itf AS (SELECT * FROM {prev})")
    return ",\n".join(parts)


def _iterative_abc(rounds: int) -> str:
    """Chained regressions of a, b and c on the two others, solved from the moments; the last CTE is itf3."""
    cols = ("a", "b", "c")
    start = ", ".join(f"coalesce(obs.{c}, m_{c}) AS z_{c}" for c in cols)
    parts = [
        "im3 AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}" for c in cols) + " FROM tr)",
        f"it3_0 AS MATERIALIZED (SELECT obs.k1, obs.k2, obs.split, obs.a, obs.b, obs.c, {start} FROM obs, im3)",
    ]
    prev, step = "it3_0", 0
    for _ in range(rounds):
        for t in cols:
            u, v = (c for c in cols if c != t)
            step += 1
            parts.append(
                f"mo3_{step} AS (SELECT var_pop(z_{u}) AS uu, var_pop(z_{v}) AS vv, covar_pop(z_{u}, z_{v}) AS uv, "
                f"covar_pop(z_{u}, {t}) AS ut, covar_pop(z_{v}, {t}) AS vt, avg(z_{u}) AS mu, avg(z_{v}) AS mv, avg({t}) AS mt "
                f"FROM {prev} WHERE split = 'train' AND {t} IS NOT NULL)"
            )
            parts.append(
                f"sl3_{step} AS (SELECT (ut * vv - vt * uv) / (uu * vv - uv * uv) AS su, "
                f"(vt * uu - ut * uv) / (uu * vv - uv * uv) AS sv, mu, mv, mt FROM mo3_{step})"
            )
            parts.append(
                f"co3_{step} AS MATERIALIZED (SELECT su, sv, mt - su * mu - sv * mv AS i FROM sl3_{step})"
            )
            z = {c: f"z_{c}" for c in cols} | {t: f"CASE WHEN {t} IS NULL THEN i + su * z_{u} + sv * z_{v} ELSE {t} END"}
            moved = ", ".join(f"{e} AS z_{c}" for c, e in z.items())
            parts.append(f"it3_{step} AS MATERIALIZED (SELECT k1, k2, split, a, b, c, {moved} FROM {prev}, co3_{step})")
            prev = f"it3_{step}"
    return ",\n".join([*parts, f"itf3 AS (SELECT * FROM {prev})"])


def _mean_fills(cols=("a", "b", "c")) -> str:
    means = ", ".join(f"avg({c}) AS m_{c}" for c in cols)
    return (
        f"gm AS (SELECT {means} FROM tr),\n"
        f"sm AS (SELECT season, {means} FROM tr GROUP BY season)"
    )


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    obs_cols = "k1, k2, ts, season, " + ", ".join(r(c) + f" AS {c}" for c in ["a0", "b0", "c0", "a", "b", "c", "y"])
    q["observations"] = with_obs(f"x AS (SELECT 1) SELECT {obs_cols} FROM obs")
    q["load_observations"] = (
        "SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity, l_discount, l_tax, "
        "CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 'winter' WHEN month(l_shipdate) IN (3, 4, 5) THEN 'spring' "
        "WHEN month(l_shipdate) IN (6, 7, 8) THEN 'summer' WHEN month(l_shipdate) IN (9, 10, 11) THEN 'autumn' END AS season "
        "FROM lineitem"
    )
    q["assign_season"] = (
        "SELECT o_orderkey, o_orderdate, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' "
        "WHEN month(o_orderdate) IN (3, 4, 5) THEN 'spring' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'summer' "
        "WHEN month(o_orderdate) IN (9, 10, 11) THEN 'autumn' END AS season FROM orders"
    )
    q["select_season"] = with_obs(
        f"x AS (SELECT 1) SELECT k1, k2, season, {r('y')} AS y FROM obs WHERE season IN ('summer', 'winter')"
    )
    q["normalise_missing"] = with_obs(
        "x AS (SELECT 1) SELECT k1, k2, "
        + ", ".join(f"round(CASE WHEN {c} <> 1e0 THEN {c} END, 6) AS {c}" for c in "abc")
        + " FROM obs"
    )
    # EDA
    q["missing_profile"] = with_obs(
        "x AS (SELECT 1) "
        + " UNION ALL ".join(
            f"SELECT season, '{c}' AS column, count(*) AS n, CAST(count(*) - count({c}) AS BIGINT) AS n_missing, "
            f"round((count(*) - count({c})) / count(*), 6) AS share_missing FROM obs GROUP BY season"
            for c in "abc"
        )
    )
    summ = []
    for c in ["a", "b", "c", "y"]:
        summ.append(
            f"SELECT season, '{c}' AS column, count({c}) AS n, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS sd, "
            f"{r(f'min({c})')} AS min, {r(f'max({c})')} AS max, "
            f"{r(f'avg(power({c} - mu_{c}, 3)) / power(var_pop({c}), 1.5)')} AS skewness, "
            f"{r(f'kurtosis_pop({c})')} AS kurtosis FROM ow GROUP BY season"
        )
    mus = ", ".join(f"avg({c}) OVER (PARTITION BY season) AS mu_{c}" for c in ["a", "b", "c", "y"])
    q["numeric_summary"] = with_obs(f"ow AS (SELECT *, {mus} FROM obs) " + " UNION ALL ".join(summ))
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    q["quantile_summary"] = with_obs(
        "x AS (SELECT 1) "
        + " UNION ALL ".join(
            f"SELECT season, '{c}' AS column, {p}e0 AS prob, {r(f'quantile_cont({c}, {p})')} AS quantile "
            f"FROM obs WHERE {c} IS NOT NULL GROUP BY season"
            for c in ["a", "b", "c", "y"]
            for p in probs
        )
    )
    q["quantile_approx_ranks"] = with_obs(
        "x AS (SELECT 1) "
        + " UNION ALL ".join(
            f"SELECT season, '{c}' AS column, {p}e0 AS prob, true AS within FROM obs WHERE {c} IS NOT NULL GROUP BY season"
            for c in ["a", "b", "c", "y"]
            for p in probs
        )
    )
    q["histogram"] = with_obs(
        "x AS (SELECT 1) SELECT season, CAST(floor(y / 5e0) AS BIGINT) AS bin, "
        "round(CAST(floor(y / 5e0) AS BIGINT) * 5e0, 6) AS lower, round((CAST(floor(y / 5e0) AS BIGINT) + 1) * 5e0, 6) AS upper, "
        "count(*) AS n FROM obs WHERE y IS NOT NULL GROUP BY season, floor(y / 5e0)"
    )
    pairs = [("a", "b"), ("a", "c"), ("a", "y"), ("b", "c"), ("b", "y"), ("c", "y")]
    q["correlations"] = with_obs(
        "x AS (SELECT 1) "
        + " UNION ALL ".join(
            f"SELECT season, '{x}' AS x, '{y}' AS y, count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) AS n, "
            f"{r(f'corr({x}, {y})')} AS r FROM obs GROUP BY season"
            for x, y in pairs
        )
    )
    # Treatments (fitted on training rows, applied to all rows)
    q["impute_mean"] = with_obs(
        _mean_fills() + " SELECT k1, k2, "
        + ", ".join(f"{r(f'coalesce({c}, m_{c})')} AS {c}" for c in "abc")
        + " FROM obs, gm"
    )
    q["impute_mean_by_season"] = with_obs(
        _mean_fills() + " SELECT k1, k2, season, "
        + ", ".join(f"{r(f'coalesce(obs.{c}, sm.m_{c}, gm.m_{c})')} AS {c}" for c in "abc")
        + " FROM obs LEFT JOIN sm USING (season) CROSS JOIN gm"
    )
    q["keep_missing"] = with_obs(
        "x AS (SELECT 1) SELECT k1, k2, "
        + ", ".join(f"{r(f'coalesce({c}, -999e0)')} AS {c}" for c in "abc")
        + ", "
        + ", ".join(f"CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END AS {c}_missing" for c in "abc")
        + " FROM obs"
    )
    q["complete_cases"] = with_obs(
        "x AS (SELECT 1) SELECT k1, k2, "
        + ", ".join(f"{r(c)} AS {c}" for c in "abc")
        + " FROM obs WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL"
    )
    coef = []
    for rnd in range(1, 4):
        for tgt, oth in (("a", "b"), ("b", "a")):
            coef.append(f"SELECT {rnd} AS round, '{tgt}' AS column, 'intercept' AS term, {r('i', R4)} AS value FROM co{rnd}_{tgt}")
            coef.append(f"SELECT {rnd}, '{tgt}', '{oth}', {r('s', R4)} FROM co{rnd}_{tgt}")
    q["iterative_coefficients"] = with_obs(_iterative() + " " + " UNION ALL ".join(coef))
    q["impute_iterative"] = with_obs(
        _iterative() + f" SELECT k1, k2, {r('z_a', R4)} AS a, {r('z_b', R4)} AS b FROM itf"
    )
    fills = {
        "mean": "coalesce(o.{c}, o.m_{c})",
        "mean_by_season": "coalesce(o.{c}, o.s_{c}, o.m_{c})",
        "iterative": "o.z_{c}",
    }
    err = []
    for t, expr in fills.items():
        for c in "ab":
            e = f"({expr.format(c=c)} - o.{c}0)"
            err.append(
                f"SELECT '{t}' AS treatment, '{c}' AS column, count(*) AS n, {r(f'sqrt(avg({e} * {e}))', R4)} AS rmse, "
                f"{r(f'avg(abs({e}))', R4)} AS mae FROM j o WHERE o.{c} IS NULL"
            )
    body = ",\n".join(
        [
            _mean_fills(),
            _iterative(),
            "j AS (SELECT obs.*, sm.m_a AS s_a, sm.m_b AS s_b, gm.m_a, gm.m_b, itf.z_a, itf.z_b "
            "FROM obs LEFT JOIN sm USING (season) CROSS JOIN gm JOIN itf USING (k1, k2))",
        ]
    )
    q["imputation_error"] = with_obs(body + " " + " UNION ALL ".join(err))
    q["impute_iterative_abc"] = with_obs(
        _iterative_abc(3) + " SELECT k1, k2, " + ", ".join(f"{r(f'z_{c}', R4)} AS {c}" for c in "abc") + " FROM itf3"
    )
    coef3 = []
    for k in range(9):
        t = "abc"[k % 3]
        u, v = (c for c in "abc" if c != t)
        for term, value in (("intercept", "i"), (u, "su"), (v, "sv")):
            coef3.append(f"SELECT {k // 3 + 1} AS round, '{t}' AS column, '{term}' AS term, {r(value, R4)} AS value FROM co3_{k + 1}")
    q["iterative_coefficients_abc"] = with_obs(_iterative_abc(3) + " " + " UNION ALL ".join(coef3))
    err3 = []
    for t, expr in fills.items():
        for c in "abc":
            e = f"({expr.format(c=c)} - o.{c}0)"
            err3.append(
                f"SELECT '{t}' AS treatment, '{c}' AS column, count(*) AS n, {r(f'sqrt(avg({e} * {e}))', R4)} AS rmse, "
                f"{r(f'avg(abs({e}))', R4)} AS mae FROM j3 o WHERE o.{c} IS NULL"
            )
    filled = ", ".join(f"sm.m_{c} AS s_{c}, gm.m_{c}, itf3.z_{c}" for c in "abc")
    j3 = f"j3 AS MATERIALIZED (SELECT obs.*, {filled} FROM obs LEFT JOIN sm USING (season) CROSS JOIN gm JOIN itf3 USING (k1, k2))"
    q["imputation_error_all"] = with_obs(",\n".join([_mean_fills(), _iterative_abc(5), j3]) + " " + " UNION ALL ".join(err3))
    # Features and splits
    feats = [f"coalesce({c}, m_{c})" for c in "abc"]
    feats += [f"CASE WHEN season = '{s}' THEN 1e0 ELSE 0e0 END" for s in ["winter", "spring", "summer", "autumn"]]
    q["assemble_features"] = with_obs(
        _mean_fills() + " SELECT k1, k2, " + ", ".join(f"round({x}, 6) AS x{i}" for i, x in enumerate(feats)) + " FROM obs, gm"
    )
    q["encode_season"] = with_obs(
        "x AS (SELECT 1) SELECT k1, k2, season, "
        + ", ".join(f"CASE WHEN season = '{s}' THEN 1e0 ELSE 0e0 END AS is_{s}" for s in ["winter", "spring", "summer", "autumn"])
        + " FROM obs"
    )
    q["split_train_test"] = with_obs("x AS (SELECT 1) SELECT k1, k2, split FROM obs")
    q["assign_fold"] = with_obs("x AS (SELECT 1) SELECT k1, k2, fold FROM obs")
    # Stack (linear bases), metrics, leaderboard
    q["out_of_fold"] = with_obs(
        LINEAR_STACK + f" SELECT k1, k2, season, fold, {r('y', R4)} AS y, {r('p1', R4)} AS p_season_mean, "
        f"{r('p2', R4)} AS p_line_a FROM oof"
    )
    q["fit_stack"] = with_obs(
        LINEAR_STACK
        + f" SELECT 'p_season_mean' AS base, {r('w1')} AS weight FROM w UNION ALL SELECT 'p_line_a', {r('w2')} FROM w"
    )
    pred_long = f"SELECT k1, k2, season, scenario, model, {r('y', R4)} AS y, {r('prediction', R4)} AS prediction FROM long"
    q["predict_stack"] = with_obs(LINEAR_STACK + " " + pred_long)
    q["write_results"] = q["predict_stack"]
    q["loaded_stack"] = q["predict_stack"]
    q["regression_metrics"] = with_obs(LINEAR_STACK + f" SELECT {MET_COLS} FROM met")
    q["leaderboard"] = with_obs(
        LINEAR_STACK + f" SELECT {MET_COLS}, rank() OVER (PARTITION BY level, season ORDER BY round(rmse, 6)) AS rk FROM met"
    )
    q["scenario_grid"] = grid_sql().replace("{cols}", MET_COLS)
    q["scenario_grid_common"] = grid_sql(common_rows=True).replace("{cols}", MET_COLS)
    q["best_models"] = (
        "SELECT * FROM (" + grid_sql().replace("{cols}", MET_COLS) + ") ranked WHERE rk <= 1"
    )
    q["per_season_line"] = with_obs(
        _mean_fills(("a",))
        + ", trf AS (SELECT tr.season, tr.y, coalesce(tr.a, gm.m_a) AS a FROM tr, gm),"
        + " ln AS (SELECT season, regr_slope(y, a) AS s, regr_intercept(y, a) AS i FROM trf GROUP BY season)"
        + f" SELECT te.k1, te.k2, te.season, {r('te.y', R4)} AS y, {r('ln.i + ln.s * coalesce(te.a, gm.m_a)', R4)} AS p_line_a"
        + " FROM te CROSS JOIN gm LEFT JOIN ln ON ln.season = te.season"
    )
    q["linear_abc"] = with_obs(
        """fm AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc FROM tr),
trf AS (SELECT y, coalesce(a, ma) AS a, coalesce(b, mb) AS b, coalesce(c, mc) AS c FROM tr, fm),
st AS (SELECT avg(y) AS my, avg(a) AS m1, avg(b) AS m2, avg(c) AS m3,
              covar_pop(a, a) AS c11, covar_pop(a, b) AS c12, covar_pop(a, c) AS c13,
              covar_pop(b, b) AS c22, covar_pop(b, c) AS c23, covar_pop(c, c) AS c33,
              covar_pop(a, y) AS d1, covar_pop(b, y) AS d2, covar_pop(c, y) AS d3 FROM trf),
dt AS (SELECT *, c11 * (c22 * c33 - c23 * c23) - c12 * (c12 * c33 - c23 * c13) + c13 * (c12 * c23 - c22 * c13) AS dd FROM st),
beta AS (SELECT *,
  (d1 * (c22 * c33 - c23 * c23) - c12 * (d2 * c33 - c23 * d3) + c13 * (d2 * c23 - c22 * d3)) / dd AS b1,
  (c11 * (d2 * c33 - c23 * d3) - d1 * (c12 * c33 - c23 * c13) + c13 * (c12 * d3 - d2 * c13)) / dd AS b2,
  (c11 * (c22 * d3 - d2 * c23) - c12 * (c12 * d3 - d2 * c13) + d1 * (c12 * c23 - c22 * c13)) / dd AS b3 FROM dt)
SELECT te.k1, te.k2, te.season, round(te.y, 4) AS y,
  round((my - b1 * m1 - b2 * m2 - b3 * m3) + b1 * coalesce(te.a, ma) + b2 * coalesce(te.b, mb) + b3 * coalesce(te.c, mc), 4)
    AS p_line_abc
FROM te CROSS JOIN fm CROSS JOIN beta"""
    )
    q["commit_results"] = with_obs(
        f"x AS (SELECT 1) SELECT k1, k2, 'first' AS scenario, {r('a0')} AS value FROM obs UNION ALL SELECT k1, k2, 'second', {r('c0')} FROM obs"
    )
    q["season_target_encoding"] = with_obs(
        """pr AS (SELECT avg(y) AS m FROM tr),
sm AS (SELECT season, sum(y) AS s, count(*) AS c FROM tr GROUP BY season)
SELECT k1, k2, season, split,
       round((coalesce(sum(y) OVER w, 0e0) + m) / (coalesce(count(y) OVER w, 0) + 1e0), 6) AS season_target
FROM tr CROSS JOIN pr
WINDOW w AS (PARTITION BY season ORDER BY md5(concat(k1, '-', k2)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
UNION ALL SELECT te.k1, te.k2, te.season, te.split, round((coalesce(sm.s, 0e0) + pr.m) / (coalesce(sm.c, 0) + 1e0), 6)
FROM te CROSS JOIN pr LEFT JOIN sm ON sm.season = te.season"""
    )
    q["boosted_unfilled"] = with_obs(
        "edge_rows AS (SELECT * FROM tr),\n" + stumps_sql("", "tr")
        + f" SELECT r.k1, r.k2, {r('r.y', R4)} AS y, round(m + {stump_value('b1')} + {stump_value('b2')}, 4) AS prediction"
        + " FROM te r CROSS JOIN s0 CROSS JOIN b1 CROSS JOIN b2"
    )
    trf = "trf AS (SELECT k1, k2, fold, y, coalesce(a, m_a) AS a, coalesce(b, m_b) AS b, coalesce(c, m_c) AS c FROM tr CROSS JOIN gm)"
    folds = [f"f{h}_rows AS (SELECT * FROM trf WHERE fold <> {h}),\nf{h}_edge_rows AS (SELECT * FROM trf),\n" + stumps_sql(f"f{h}_", f"f{h}_rows") for h in range(3)]
    q["boosted_out_of_fold"] = with_obs(
        _mean_fills(("a", "b", "c")) + f", {trf},\n" + ",\n".join(folds)
        + " "
        + " UNION ALL ".join(
            f"SELECT r.k1, r.k2, r.fold, {r('r.y', R4)} AS y, round(s.m + {stump_value('b1')} + {stump_value('b2')}, 4) AS prediction "
            f"FROM trf r CROSS JOIN f{h}_s0 s CROSS JOIN f{h}_b1 b1 CROSS JOIN f{h}_b2 b2 WHERE r.fold = {h}"
            for h in range(3)
        )
    )
    gaps = [("a0", "b0"), ("a0", "c0"), ("b0", "c0")]
    q["temperature_gap_rows"] = with_obs(
        "x AS (SELECT 1) SELECT k1, k2, season, "
        + ", ".join(f"{r(f'{x} - {y}')} AS gap_{x}_{y}" for x, y in gaps)
        + " FROM obs"
    )
    q["temperature_gap"] = with_obs(
        "x AS (SELECT 1) "
        + " UNION ALL ".join(
            f"SELECT season, '{x}' AS measure_1, '{y}' AS measure_2, count({x} - {y}) AS n, {r(f'avg({x} - {y})')} AS mean_gap, "
            f"{r(f'min({x} - {y})')} AS min_gap, {r(f'max({x} - {y})')} AS max_gap FROM obs GROUP BY season"
            for x, y in gaps
        )
    )
    return q
