"""Stacking and per-season fits.

``out_of_fold``   base predictions for training rows from fits that did not see their fold
``fit_stack``     meta-learner over the out-of-fold predictions
``predict_stack`` bases refit on all training rows, then the meta-learner, on new rows
``fit_seasons``   one model per season, from a base or a whole ``Stack``; ``fit_per_season`` scores with it
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soilcast.functions.season import SEASONS
from soilcast.session import fit_parallelism


def out_of_fold(train: DataFrame, fold: str, bases: list, k: int) -> tuple[DataFrame, list]:
    """(training rows + one ``p_<base>`` column per base, fitted bases).

    Every training row appears exactly once, predicted by the fit that excluded its fold. A row whose fold is
    NULL (or none of the k) takes part in every fit and has NULL predictions. Bases are fitted one after
    another; a base's own fits share the limit of ``fit_parallelism``. The rows are read once per fold,
    however many bases there are.
    """
    fitted = [b.fit(train, fold, k) for b in bases]
    out = train
    for f in fitted:
        if not hasattr(f, "fold_model"):
            out = f.oof(out)
    by_fold = [f for f in fitted if hasattr(f, "fold_model")]
    if not by_fold:
        return out, fitted
    cols = out.columns + [f.base.col for f in by_fold]
    parts = []
    for h in range(k):
        part = out.filter(F.col(fold) == h)
        for f in by_fold:
            part = f.fold_model(h, part)
        parts.append(part.select(*cols))
    rest = out.filter(~F.coalesce(F.col(fold).between(0, k - 1), F.lit(False)))
    parts.append(rest.withColumns({f.base.col: F.lit(None).cast("double") for f in by_fold}).select(*cols))
    return reduce(DataFrame.unionByName, parts), fitted


class LeastSquaresModel:
    def __init__(self, p_cols: list[str], weights: list[float], intercept: float | None, prediction: str):
        self.p_cols, self.weights, self.intercept, self.prediction = list(p_cols), weights, intercept, prediction

    def transform(self, df: DataFrame) -> DataFrame:
        pred = F.lit(self.intercept if self.intercept is not None else 0.0)
        for c, w in zip(self.p_cols, self.weights):
            pred = pred + F.lit(w) * F.col(c)
        return df.withColumn(self.prediction, pred)


class LeastSquares:
    """Meta-learner y ≈ w·p (+ b): normal equations from ONE aggregation of cross-products.

    m base predictions give (m+1)² sums; the m×m solve runs on the driver. Same solution as an
    unpenalised ``LinearRegression(solver="normal")``, in one job instead of several.
    """

    def __init__(self, intercept: bool = False):
        self.intercept = intercept

    def fit(self, df: DataFrame, p_cols: list[str], y: str, prediction: str) -> LeastSquaresModel:
        xs = ([F.lit(1.0)] if self.intercept else []) + [F.col(c) for c in p_cols]
        m = len(xs)
        usable = df.na.drop(subset=[*p_cols, y])
        aggs = [F.sum(xs[i] * xs[j]).alias(f"g{i}_{j}") for i in range(m) for j in range(i, m)]
        aggs += [F.sum(xs[i] * F.col(y)).alias(f"h{i}") for i in range(m)]
        row = usable.agg(*aggs).first()
        G = np.zeros((m, m))
        for i in range(m):
            for j in range(i, m):
                G[i, j] = G[j, i] = row[f"g{i}_{j}"] or 0.0
        h = np.array([row[f"h{i}"] or 0.0 for i in range(m)])
        w = np.linalg.lstsq(G, h, rcond=None)[0]
        b = float(w[0]) if self.intercept else None
        return LeastSquaresModel(p_cols, [float(x) for x in w[1 if self.intercept else 0 :]], b, prediction)


def fit_stack(oof: DataFrame, p_cols: list[str], y: str = "y", meta=None, prediction: str = "prediction"):
    """Meta-learner over out-of-fold predictions: ``LeastSquares`` (default) or any pyspark.ml regressor."""
    meta = meta or LeastSquares()
    if isinstance(meta, LeastSquares):
        return meta.fit(oof, p_cols, y, prediction)
    meta = meta.copy().setFeaturesCol("_meta_x").setLabelCol(y).setPredictionCol(prediction)
    return Pipeline(stages=[VectorAssembler(inputCols=list(p_cols), outputCol="_meta_x", handleInvalid="error"), meta]).fit(oof)


def stack_weights(meta_model, p_cols: list[str]) -> list[tuple[str, float]]:
    if isinstance(meta_model, LeastSquaresModel):
        out = list(zip(meta_model.p_cols, meta_model.weights))
        if meta_model.intercept is not None:
            out.append(("intercept", meta_model.intercept))
        return out
    lr = meta_model.stages[-1]
    out = [(c, float(w)) for c, w in zip(p_cols, lr.coefficients.toArray())]
    if lr.getFitIntercept():
        out.append(("intercept", float(lr.intercept)))
    return out


def predict_stack(df: DataFrame, fitted: list, meta_model) -> DataFrame:
    """Rows of ``df`` with every base's prediction (fit on all training rows) and the stack's."""
    out = df
    for f in fitted:
        out = f.predict(out)
    out = meta_model.transform(out)
    return out.drop("_meta_x") if "_meta_x" in out.columns else out


class Stack:
    """A whole stack as one fitter: out-of-fold bases, meta-learner, prediction in ``col``."""

    def __init__(self, bases: list, fold: str, k: int, y: str = "y", meta=None, col: str = "prediction"):
        self.bases, self.fold, self.k, self.y, self.meta, self.col = bases, fold, k, y, meta, col

    def fit_one(self, train: DataFrame) -> "StackModel":
        oof, fitted = out_of_fold(train, self.fold, self.bases, self.k)
        return StackModel(fitted, fit_stack(oof, [b.col for b in self.bases], self.y, self.meta, self.col))


@dataclass
class StackModel:
    fitted: list
    meta: object

    def transform(self, df: DataFrame) -> DataFrame:
        return predict_stack(df, self.fitted, self.meta)


@dataclass
class SeasonFit:
    """One fitted model per season; ``transform`` scores each row by its season's model in column ``col``. Rows of a
    season without a model, or of none, have a NULL prediction."""

    models: dict
    season: str
    col: str

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [*df.columns, self.col]
        empty = F.lit(None).cast("double")
        parts = [m.transform(df.filter(F.col(self.season) == s)).select(*keep) for s, m in self.models.items()]
        known = F.coalesce(F.col(self.season).isin(*self.models), F.lit(False)) if self.models else F.lit(False)
        parts.append(df.filter(~known).withColumn(self.col, empty).select(*keep))
        return reduce(DataFrame.unionByName, parts)


def fit_seasons(train: DataFrame, fitter, season: str = "season", levels=SEASONS) -> SeasonFit:
    """One model per season of ``levels`` that has training rows, from any fitter with ``fit_one`` (an ``MLBase``, a
    ``Stack``). ``soilcast.fit.parallelism`` of them run side by side."""
    counts = {r[season]: r["n"] for r in train.filter(F.col(season).isin(*levels)).groupBy(season).agg(F.count(F.lit(1)).alias("n")).collect()}
    fit_levels = [lv for lv in levels if counts.get(lv, 0) > 0]
    with ThreadPoolExecutor(max_workers=fit_parallelism(train.sparkSession, max(1, len(fit_levels)))) as pool:
        fit_one = inheritable_thread_target(train.sparkSession)(lambda lv: fitter.fit_one(train.filter(F.col(season) == lv)))
        return SeasonFit(dict(zip(fit_levels, pool.map(fit_one, fit_levels))), season, fitter.col)


def fit_per_season(
    train: DataFrame, test: DataFrame, fitter, season: str = "season", levels=SEASONS
) -> DataFrame:
    """Test rows scored by the model of their own season, in column ``fitter.col``.

    Sufficient-statistic fitters fit every season in one grouped aggregation, other fitters run one distributed
    fit per season level (``fit_seasons``, which also gives the fitted models).
    """
    if hasattr(fitter, "fit_groups"):
        return fitter.fit_groups(train, season).oof(test)
    return fit_seasons(train, fitter, season, levels).transform(test)
