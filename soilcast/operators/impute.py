"""Missing-data treatments.

``MeanFill``      fill with training means, global or per group (the mean-filled scenario)
``keep_missing``  indicator + placeholder, no filling (the unfilled scenario, for trees)
``complete_cases``drop rows with a gap (the unfilled scenario, other reading)
``IterativeFill`` chained linear regressions, observed cells never change (the iterative scenario)

NaN is not a missing marker for SQL averages: run ``normalise_missing`` first.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soilcast.functions.numeric import nan_to_null
from soilcast.operators import patterns
from soilcast.operators.joins import join_fitted
from soilcast.session import materialize


def normalise_missing(df: DataFrame, cols: list[str], sentinels: list[float] = ()) -> DataFrame:
    """NaN and any listed sentinel value become NULL in ``cols``."""
    out = {}
    for c in cols:
        x = nan_to_null(c)
        if sentinels:
            x = F.when(~F.col(c).isin(*[float(s) for s in sentinels]) | F.col(c).isNull(), x)
        out[c] = x
    return df.withColumns(out)


def keep_missing(df: DataFrame, cols: list[str], placeholder: float = -999.0, suffix: str = "_missing") -> DataFrame:
    """Adds a 0/1 indicator per column and replaces the gap by ``placeholder`` (tree learners only)."""
    ind = {f"{c}{suffix}": F.col(c).isNull().cast("double") for c in cols}
    fill = {c: F.coalesce(F.col(c), F.lit(float(placeholder))) for c in cols}
    return df.withColumns(ind).withColumns(fill)


def complete_cases(df: DataFrame, cols: list[str], how: str = "any") -> DataFrame:
    """Rows without a gap (``how='all'``: rows not wholly missing) in ``cols``."""
    return df.na.drop(how=how, subset=list(cols))


# ---------------------------------------------------------------------------------------------
# Mean fill


@dataclass
class MeanFill:
    cols: list[str]
    means: dict[str, float | None]
    by: list[str] = field(default_factory=list)
    grouped: DataFrame | None = None

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """Gap → group mean (when grouped and the group has one) → global mean."""
        out = df
        if self.grouped is not None:
            renamed = self.grouped.select(*self.by, *[F.col(c).alias(f"_gm_{c}") for c in self.cols])
            out = join_fitted(out, renamed, self.by, "left")
        filled = {}
        for c in self.cols:
            parts = [F.col(c)]
            if self.grouped is not None:
                parts.append(F.col(f"_gm_{c}"))
            parts.append(F.lit(self.means[c]).cast("double"))
            filled[f"{c}{suffix}"] = F.coalesce(*parts)
        out = out.withColumns(filled)
        if self.grouped is not None:
            out = out.drop(*[f"_gm_{c}" for c in self.cols])
        return out


def fit_mean(df: DataFrame, cols: list[str], by: list[str] = ()) -> MeanFill:
    """Training means: one global aggregate (p numbers to the driver); per group a table kept in Spark."""
    row = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    means = {c: row[c] for c in cols}
    grouped = materialize(df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in cols]), "group_means") if by else None
    return MeanFill(list(cols), means, list(by), grouped)


# ---------------------------------------------------------------------------------------------
# Iterative (chained-equation) fill


@dataclass
class IterativeFill:
    """Fitted chained regressions, in centred coordinates u = x - mean.

    ``steps`` holds (round, column index, intercept, coefficients over all columns, own one = 0).
    """

    cols: list[str]
    means: list[float]
    steps: list[tuple[int, int, float, list[float]]]
    empty: list[str] = field(default_factory=list)  # asked for, but never observed: stay as they are

    def coefficients(self) -> list[tuple[int, str, str, float]]:
        """(round, column, term, value) on the data's own scale; term 'intercept' or a predictor name."""
        out = []
        for rnd, j, alpha, beta in self.steps:
            intercept = alpha + self.means[j] - sum(b * m for b, m in zip(beta, self.means))
            out.append((rnd, self.cols[j], "intercept", float(intercept)))
            out += [(rnd, self.cols[j], self.cols[k], float(b)) for k, b in enumerate(beta) if k != j]
        return out

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """Replays the fitted steps as a few narrow projections (no shuffle); a column that was never observed
        keeps its gaps."""
        p = range(len(self.cols))
        z = [f"_z{j}" for j in p]
        out = df.withColumns({z[j]: F.coalesce(F.col(self.cols[j]) - F.lit(self.means[j]), F.lit(0.0)) for j in p})
        out = _replay(out, self.cols, z, self.steps)
        filled = {f"{c}{suffix}": F.col(z[j]) + F.lit(m) for j, (c, m) in enumerate(zip(self.cols, self.means))}
        return out.withColumns(filled | {f"{c}{suffix}": F.col(c) for c in self.empty}).drop(*z)


CHAIN = 16  # steps in one projection; each refers to the ones before it


def _replay(df: DataFrame, cols: list[str], z: list[str], steps) -> DataFrame:
    """``df`` with the current values ``z`` moved on by ``steps``, ``CHAIN`` of them per projection, in which later
    columns refer to earlier ones."""
    out = df
    for start in range(0, len(steps), CHAIN):
        now, added = list(z), []
        for i, (_, j, alpha, beta) in enumerate(steps[start : start + CHAIN]):
            pred = F.lit(alpha)
            for k, b in enumerate(beta):
                if k != j and b != 0.0:
                    pred = pred + F.lit(b) * F.col(now[k])
            name = f"_s{start + i}"
            added.append(F.when(F.col(cols[j]).isNull(), pred).otherwise(F.col(now[j])).alias(name))
            now[j] = name
        kept = [c for c in out.columns if c not in z]
        out = out.select("*", *added).select(*kept, *[F.col(n).alias(c) for n, c in zip(now, z)])
    return out


MAX_PATTERN_COLS = 12  # columns for which 2**p patterns' statistics may come to the driver


def fit_iterative(
    df: DataFrame,
    cols: list[str],
    rounds: int = 5,
    tol: float | None = None,
    ridge: float = 0.0,
    method: str = "factors",
) -> IterativeFill:
    """Chained linear regressions.

    Start: every gap at its column mean. Each round, column by column, regress the column on the
    current values of all others over rows where it is observed, then refill its gaps. Observed cells
    never change; a column that is never observed is left out and keeps its gaps.

    ``method`` is the caller's choice, the result is the same:

    * ``factors`` (any number of columns): the data is read once for the means and once to be compressed by gaps
      (``patterns.compress``). A round then takes one pass over the compressed rows per block of columns, and p×p sums
      per set of gaps within the block come to the driver;
    * ``passes`` (any number of columns): one aggregation over the data per (round, column), without Python workers. A
      round's values are written, so each pass replays one round at most;
    * ``patterns`` (``MAX_PATTERN_COLS`` columns at most): within one missingness pattern every current value
      is an affine map of the row's observed values, so all regressions follow from counts, sums and second
      moments per pattern. ONE aggregation with at most 2^p groups, then p×p matrices on the driver.
    """
    methods = {"factors": _fit_by_factors, "passes": _fit_by_passes, "patterns": _fit_by_patterns}
    if method not in methods:
        raise ValueError(f"fit_iterative: unknown method {method!r}")
    if method == "patterns" and len(cols) > MAX_PATTERN_COLS:
        raise ValueError(f"method 'patterns' takes {MAX_PATTERN_COLS} columns at most, got {len(cols)}; use 'factors'")
    mrow = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    empty = [c for c in cols if mrow[c] is None]
    cols = [c for c in cols if mrow[c] is not None]
    means = [float(mrow[c]) for c in cols]
    if not cols:
        return IterativeFill([], [], [], empty)
    return IterativeFill(cols, means, methods[method](df, cols, means, rounds, tol, ridge), empty)


def _solve_step(G, h, ridge: float, others: list[int], p: int):
    """(intercept, coefficients over all columns) of one regression."""
    if ridge:
        G[1:, 1:] += ridge * np.eye(p - 1)
    coef = np.linalg.lstsq(G, h, rcond=None)[0]
    beta = np.zeros(p)
    beta[others] = coef[1:]
    return float(coef[0]), beta


class _Progress:
    """The fitted steps, and the largest change of a coefficient since the round before."""

    def __init__(self):
        self.steps, self.prev, self.delta = [], {}, 0.0

    def add(self, rnd: int, j: int, alpha: float, beta) -> None:
        vec = np.concatenate([[alpha], beta])
        change = float(np.max(np.abs(vec - self.prev[j]))) if j in self.prev else float("inf")
        self.delta = max(self.delta, change)
        self.prev[j] = vec
        self.steps.append((rnd, j, alpha, [float(x) for x in beta]))


def _fit_by_patterns(df, cols, means, rounds, tol, ridge) -> list:
    p = len(cols)
    u = [F.coalesce(F.col(c) - F.lit(m), F.lit(0.0)) for c, m in zip(cols, means)]
    pattern = sum((F.col(c).isNull().cast("int") * (1 << j) for j, c in enumerate(cols)), F.lit(0))
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(u[i]).alias(f"s{i}") for i in range(p)]
    aggs += [F.sum(u[i] * u[k]).alias(f"m{i}_{k}") for i in range(p) for k in range(i, p)]
    pats = []
    for r in df.groupBy(pattern.alias("pat")).agg(*aggs).collect():  # at most 2**MAX_PATTERN_COLS rows
        miss = np.array([(r["pat"] >> j) & 1 == 1 for j in range(p)])
        s = np.array([r[f"s{i}"] for i in range(p)], dtype=float)
        M = np.zeros((p, p))
        for i in range(p):
            for k in range(i, p):
                M[i, k] = M[k, i] = r[f"m{i}_{k}"]
        pats.append({"n": float(r["n"]), "miss": miss, "s": s, "M": M, "A": np.diag((~miss).astype(float)), "b": np.zeros(p)})

    done = _Progress()
    for rnd in range(1, rounds + 1):
        done.delta = 0.0
        for j in range(p):
            others = [k for k in range(p) if k != j]
            G = np.zeros((p, p))  # [1, z_others] cross-products, intercept first
            h = np.zeros(p)
            for pt in pats:
                if pt["miss"][j]:
                    continue
                A, b, n, s, M = pt["A"][others], pt["b"][others], pt["n"], pt["s"], pt["M"]
                Sz = A @ s + n * b
                G[0, 0] += n
                G[0, 1:] += Sz
                G[1:, 0] += Sz
                G[1:, 1:] += A @ M @ A.T + np.outer(A @ s, b) + np.outer(b, A @ s) + n * np.outer(b, b)
                h[0] += s[j]
                h[1:] += A @ M[:, j] + b * s[j]
            alpha, beta = _solve_step(G, h, ridge, others, p)
            for pt in pats:
                if pt["miss"][j]:
                    pt["A"][j] = beta[others] @ pt["A"][others]
                    pt["b"][j] = alpha + beta[others] @ pt["b"][others]
            done.add(rnd, j, alpha, beta)
        if tol is not None and done.delta < tol:
            break
    return done.steps


def _fit_by_passes(df, cols, means, rounds, tol, ridge) -> list:
    p = len(cols)
    z = [f"_z{j}" for j in range(p)]
    start = {z[j]: F.coalesce(F.col(cols[j]) - F.lit(means[j]), F.lit(0.0)) for j in range(p)}
    state = df.select(*cols).withColumns(start)
    done = _Progress()
    for rnd in range(1, rounds + 1):
        done.delta = 0.0
        for j in range(p):
            others = [k for k in range(p) if k != j]
            now = _replay(state.filter(F.col(cols[j]).isNotNull()), cols, z, [s for s in done.steps if s[0] == rnd])
            xs = [F.lit(1.0)] + [F.col(z[k]) for k in others]
            sums = [F.sum(x).alias(f"t{a}") for a, x in enumerate(xs)] + [F.sum(xs[a] * xs[b]).alias(f"g{a}_{b}") for a in range(1, p) for b in range(a, p)]
            sums += [F.sum(x * F.col(z[j])).alias(f"h{a}") for a, x in enumerate(xs)]
            row = now.agg(*sums).first()
            G, h = np.zeros((p, p)), np.array([row[f"h{a}"] for a in range(p)], dtype=float)
            for a in range(p):
                G[0, a] = G[a, 0] = row[f"t{a}"]
                for b in range(max(a, 1), p):
                    if a:
                        G[a, b] = G[b, a] = row[f"g{a}_{b}"]
            alpha, beta = _solve_step(G, h, ridge, others, p)
            done.add(rnd, j, alpha, beta)
        if tol is not None and done.delta < tol:
            break
        if rnd < rounds:
            state = materialize(_replay(state, cols, z, [s for s in done.steps if s[0] == rnd]), "iterative_round")
    return done.steps


def _fit_by_factors(df, cols, means, rounds, tol, ridge) -> list:
    p = len(cols)
    state = materialize(patterns.compress(df, [F.col(c) for c in cols], means), "iterative_factors")
    done = _Progress()
    for rnd in range(1, rounds + 1):
        done.delta, replayed = 0.0, []
        for block in patterns.column_blocks(p):
            products = patterns.block_products(state, p, block, replayed)
            for i, j in enumerate(block):
                others = [k for k in range(p) if k != j]
                at = [0] + [1 + k for k in others]
                observed = sum(g for kind, g in products.items() if not kind >> i & 1)
                alpha, beta = _solve_step(observed[np.ix_(at, at)], observed[at, 1 + j], ridge, others, p)
                done.add(rnd, j, alpha, beta)
                refill = np.eye(p + 1)
                refill[1 + j] = np.concatenate([[alpha], beta])
                products = {kind: refill @ g @ refill.T if kind >> i & 1 else g for kind, g in products.items()}
                replayed.append((j, refill[1 + j]))
        if tol is not None and done.delta < tol:
            break
        if rnd < rounds:
            state = materialize(patterns.moved(state, p, replayed), "iterative_round")
    return done.steps


def hide_cells(
    df: DataFrame, cols: list[str], keys: list[str], share: float = 0.1, suffix: str = "_true", rule=None
) -> DataFrame:
    """Hides a repeatable share of observed cells of each column; their values move to ``<c><suffix>``.

    For data without a known truth: fit a treatment on the hidden frame, then score it with
    ``imputation_error(df, cols, {c: c + suffix}, fills)``. Only hidden cells have both a NULL cell and a
    truth. The default rule hashes the row keys with the column name (different cells per column, same
    cells on every rerun); ``rule(c) -> Column`` may replace it.
    """
    per_mille = int(round(share * 1000))
    out = {}
    for c in cols:
        hide = rule(c) if rule else F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(c)), F.lit(1000)) < per_mille
        out[f"{c}{suffix}"] = F.when(hide & F.col(c).isNotNull(), F.col(c))
        out[c] = F.when(~hide, F.col(c))
    return df.withColumns(out)


def imputation_error(df: DataFrame, cols: list[str], truth: dict[str, str], fills: dict[str, object]) -> DataFrame:
    """treatment, column, n, rmse, mae over cells that were missing, against their known truth.

    Every treatment writes its filled copy under its own suffix, so all treatments and columns are
    scored in one aggregation over one scan.
    """
    out = df
    for t, fitted in fills.items():
        out = fitted.transform(out, suffix=f"__{t}")
    aggs, recs = [], []
    for t in fills:
        for c in cols:
            m = F.col(c).isNull() & F.col(truth[c]).isNotNull()
            e = F.col(f"{c}__{t}") - F.col(truth[c])
            key = f"{t}__{c}"
            aggs += [
                F.count(F.when(m, F.lit(1))).alias(f"_n{key}"),
                F.sqrt(F.avg(F.when(m, e * e))).alias(f"_r{key}"),
                F.avg(F.when(m, F.abs(e))).alias(f"_a{key}"),
            ]
            recs.append(
                F.struct(
                    F.lit(t).alias("treatment"),
                    F.lit(c).alias("column"),
                    F.col(f"_n{key}").alias("n"),
                    F.col(f"_r{key}").alias("rmse"),
                    F.col(f"_a{key}").alias("mae"),
                )
            )
    return out.agg(*aggs).select(F.inline(F.array(*recs)))
