"""Base learners for the models and the stack.

Two kinds, one interface (``fit(train, fold, k)`` → a fitted object with ``oof`` and ``predict``):

* sufficient-statistic bases (``LinearBase``, ``GroupMeanBase``): all k out-of-fold fits and the
  fit on all training rows come from ONE aggregation by fold; the statistics of a fit are those of its
  folds, merged.
* ``MLBase``: any ``pyspark.ml`` regressor (e.g. the boosted-tree configs below); k+1 distributed fits.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soilcast.operators.joins import join_fitted
from soilcast.session import fit_parallelism, materialize

ALL = -1  # fit on every training row


def fold_targets(fold: str, k: int) -> Column:
    """The fits a row of fold f takes part in: every fold but f, and ALL."""
    return F.array_except(F.array(*[F.lit(i) for i in range(k)], F.lit(ALL)), F.array(F.col(fold)))


# ---------------------------------------------------------------------------------------------
# Linear regression from covariances


def _solve(n, mx, my, cxx, cxy):
    """OLS intercept and slopes from means and population covariances (min-norm when singular)."""
    beta = np.linalg.lstsq(np.asarray(cxx, float), np.asarray(cxy, float), rcond=None)[0] if len(mx) else np.zeros(0)
    return float(my - float(np.dot(beta, mx))), [float(b) for b in beta]


def _merged(parts):
    """Moments of the union of disjoint sets of rows."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    cov = sum(p[0] * (p[2] + np.outer(p[1] - mean, p[1] - mean)) for p in parts) / n
    return n, mean, cov


@dataclass
class LinearFit:
    base: "LinearBase"
    fold: str
    params: dict  # group value -> (intercept, slopes)

    def _expr(self, key: Column | None, only=None) -> Column:
        out = None
        for g, (b0, beta) in self.params.items():
            if only is not None and g != only:
                continue
            val = F.lit(b0)
            for x, b in zip(self.base.features, beta):
                val = val + F.lit(b) * F.col(x)
            if key is None:
                return val
            out = F.when(key == g, val) if out is None else out.when(key == g, val)
        return out if out is not None else F.lit(None).cast("double")

    def oof(self, df: DataFrame) -> DataFrame:
        held = {g: v for g, v in self.params.items() if g != ALL}
        return df.withColumn(self.base.col, LinearFit(self.base, self.fold, held)._expr(F.col(self.fold)))

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.base.col, self._expr(None, only=ALL) if ALL in self.params else F.lit(None).cast("double"))


class LinearBase:
    """y ~ intercept + features (ordinary least squares)."""

    def __init__(self, name: str, features: list[str], y: str = "y"):
        self.name, self.features, self.y = name, list(features), y

    @property
    def col(self) -> str:
        return f"p_{self.name}"

    def _aggs(self):
        xs, y = self.features, self.y
        out = [F.count(F.lit(1)).alias("n"), F.avg(y).alias("my")]
        out += [F.avg(x).alias(f"mx{i}") for i, x in enumerate(xs)]
        out += [F.covar_pop(xs[i], xs[j]).alias(f"c{i}_{j}") for i in range(len(xs)) for j in range(i, len(xs))]
        out += [F.covar_pop(x, y).alias(f"cy{i}") for i, x in enumerate(xs)]
        return out

    def _moments(self, r):
        """(n, means, population covariances) of the features and the target, the target last."""
        m = len(self.features)
        mean = np.array([*(r[f"mx{i}"] for i in range(m)), r["my"]], dtype=float)
        cov = np.zeros((m + 1, m + 1))
        for i in range(m):
            for j in range(i, m):
                cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
            cov[i, m] = cov[m, i] = r[f"cy{i}"]
        return float(r["n"]), mean, cov

    def _from_moments(self, n, mean, cov):
        return _solve(n, mean[:-1], mean[-1], cov[:-1, :-1], cov[:-1, -1])

    def _params(self, r):
        return self._from_moments(*self._moments(r))

    def _usable(self, df: DataFrame) -> DataFrame:
        return df.na.drop(subset=[*self.features, self.y])

    def fit(self, train: DataFrame, fold: str, k: int) -> LinearFit:
        """All fits from one aggregation by fold: the moments of a fit are those of its folds, merged."""
        own = F.when(F.col(fold).between(0, k - 1), F.col(fold)).otherwise(F.lit(k)).alias("_f")
        rows = self._usable(train).groupBy(own).agg(*self._aggs()).collect()  # ≤ k+1 rows
        parts = {r["_f"]: self._moments(r) for r in rows}
        fits = {}
        for target in [*range(k), ALL]:
            merged = [m for f, m in parts.items() if f != target]
            if merged:
                fits[target] = self._from_moments(*_merged(merged))
        return LinearFit(self, fold, fits)

    def fit_groups(self, train: DataFrame, group: str) -> "GroupLines":
        """One fit per value of ``group`` (any number of them; NULL is one of its own): moments by group in one aggregation, the
        normal equations solved in the plan, coefficients as a table."""
        m, xs = len(self.features), self.features
        rows = self._usable(train).groupBy(group).agg(*self._aggs())
        cell = lambda i, j: F.col(f"c{min(i, j)}_{max(i, j)}")
        system = F.array(*[F.array(*[cell(i, j) for j in range(m)], F.col(f"cy{i}")) for i in range(m)]) if m else F.array().cast("array<array<double>>")
        solved = solve_in_plan(rows.withColumn("_system", system), "_system", m)
        slopes = F.transform("_system", lambda r: r[m])
        start = F.aggregate(F.zip_with(slopes, F.array(*[F.col(f"mx{i}") for i in range(m)]), lambda b, x: b * x), F.col("my"), lambda s, v: s - v) if m else F.col("my")
        table = solved.select(group, start.alias("_b0"), *[slopes[i].alias(f"_b{i + 1}") for i in range(m)])
        return GroupLines(self, group, materialize(table, "group_lines"))


#: A feature whose remaining variance is below this share of its own is a combination of the features before.
_COLLINEAR = 1e-10


def solve_in_plan(df: DataFrame, system: str, m: int) -> DataFrame:
    """``df`` with the linear system in the column ``system`` (m rows of m coefficients and a right side; symmetric, positive
    semidefinite) eliminated, so that the last entry of each row is the solution. An unknown that depends on those before it is 0."""
    scale = "_scale"
    out = df.withColumn(scale, F.transform(system, lambda r, i: F.get(r, i)))
    for k in range(m):
        pivot = F.col(system)[k]
        lead = pivot[k]
        dead = (F.abs(lead) <= F.lit(_COLLINEAR) * F.abs(F.col(scale)[k])) | lead.isNull()

        def step(r, i):  # called at once, within this turn of the loop
            gone = F.transform(r, lambda x, j: F.when((j == k) | (i == k), F.lit(0.0)).otherwise(x))
            own = F.transform(r, lambda x: x / lead)
            other = F.zip_with(r, pivot, lambda x, p: x - r[k] * p / lead)
            return F.when(dead, gone).when(i == k, own).otherwise(other)

        out = out.withColumn(system, F.transform(system, step))
    return out.drop(scale)


@dataclass
class GroupLines:
    """Lines by group: ``lines`` holds the group, ``_b0`` and a slope for each feature. A row of a group without a fit has NULL."""

    base: "LinearBase"
    fold: str  # the grouping column
    lines: DataFrame

    def oof(self, df: DataFrame) -> DataFrame:
        val = F.col("_b0")
        for i, x in enumerate(self.base.features):
            val = val + F.col(f"_b{i + 1}") * F.col(x)
        rows = join_fitted(df, self.lines, [self.fold])
        return rows.withColumn(self.base.col, val).drop("_b0", *[f"_b{i + 1}" for i in range(len(self.base.features))])

    predict = oof


# ---------------------------------------------------------------------------------------------
# Group mean


@dataclass
class GroupMeanFit:
    base: "GroupMeanBase"
    fold: str
    means: DataFrame  # _t, by..., mean
    overall: DataFrame  # _t, overall mean (fallback for a group the fit did not see)

    def _attach(self, df: DataFrame, t: Column) -> DataFrame:
        by, c = self.base.by, self.base.col
        keyed = df.withColumn("_t", t)
        out = join_fitted(keyed, self.means, ["_t", *by])
        out = join_fitted(out, self.overall, ["_t"])
        return out.withColumn(c, F.coalesce(F.col("_gm"), F.col("_om"))).drop("_t", "_gm", "_om")

    def oof(self, df: DataFrame) -> DataFrame:
        return self._attach(df, F.col(self.fold))

    def predict(self, df: DataFrame) -> DataFrame:
        return self._attach(df, F.lit(ALL))


class GroupMeanBase:
    """Mean of y within groups of the training rows (e.g. the training-season mean)."""

    def __init__(self, name: str, by: list[str] = ("season",), y: str = "y"):
        self.name, self.by, self.y = name, list(by), y

    @property
    def col(self) -> str:
        return f"p_{self.name}"

    def fit(self, train: DataFrame, fold: str, k: int) -> GroupMeanFit:
        own = train.filter(F.col(self.y).isNotNull()).groupBy(fold, *self.by).agg(
            F.sum(self.y).alias("_s"), F.count(F.lit(1)).alias("_c")
        )
        # One pass over the rows; a fit's sums are those of its folds, added up from the small table.
        fan = own.select(F.explode(fold_targets(fold, k)).alias("_t"), *self.by, "_s", "_c")
        sums = materialize(fan.groupBy("_t", *self.by).agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c")), "group_sums")
        means = sums.select("_t", *self.by, (F.col("_s") / F.col("_c")).alias("_gm"))
        overall = materialize(sums.groupBy("_t").agg((F.sum("_s") / F.sum("_c")).alias("_om")), "overall_means")
        return GroupMeanFit(self, fold, means, overall)


# ---------------------------------------------------------------------------------------------
# Any pyspark.ml regressor


@dataclass
class MLFit:
    base: "MLBase"
    fold: str
    models: dict  # fold held out (or ALL) -> PipelineModel

    def _apply(self, model: PipelineModel, df: DataFrame) -> DataFrame:
        return model.transform(df).drop(self.base.vec)

    def fold_model(self, held: int, df: DataFrame) -> DataFrame:
        """Rows of the fold ``held`` with the prediction of the fit that excluded it."""
        return self._apply(self.models[held], df)

    def predict(self, df: DataFrame) -> DataFrame:
        return self._apply(self.models[ALL], df)


class MLBase:
    def __init__(self, name: str, estimator, features: list[str], y: str = "y"):
        self.name, self.estimator, self.features, self.y = name, estimator, list(features), y

    @property
    def col(self) -> str:
        return f"p_{self.name}"

    @property
    def vec(self) -> str:
        return f"_x_{self.name}"

    def pipeline(self) -> Pipeline:
        est = self.estimator.copy().setFeaturesCol(self.vec).setLabelCol(self.y).setPredictionCol(self.col)
        return Pipeline(stages=[VectorAssembler(inputCols=self.features, outputCol=self.vec, handleInvalid="error"), est])

    def fit_one(self, train: DataFrame) -> PipelineModel:
        return self.pipeline().fit(train)

    def fit(self, train: DataFrame, fold: str, k: int, parallelism: int | None = None) -> MLFit:
        """k out-of-fold fits and the fit on all rows.

        The fits are independent chains of small distributed jobs; ``soilcast.fit.parallelism`` (default 1)
        tells how many run side by side, each with its own cached copy of the training rows.
        """
        subsets = {f: train.filter(~F.col(fold).eqNullSafe(F.lit(f))) for f in range(k)}
        subsets[ALL] = train
        n = parallelism or fit_parallelism(train.sparkSession, len(subsets))
        with ThreadPoolExecutor(max_workers=n) as pool:
            futures = {f: pool.submit(inheritable_thread_target(train.sparkSession)(self.fit_one), d) for f, d in subsets.items()}
            models = {f: fut.result() for f, fut in futures.items()}
        return MLFit(self, fold, models)


# ---------------------------------------------------------------------------------------------
# Boosted-tree configurations standing in for the three named boosting libraries.
# Fixed values (our choice): none of these settings is published for the contest models.

BOOSTED = {
    # A: the CatBoost place: shallow, evenly grown trees, many small steps.
    "A": dict(maxDepth=4, maxIter=20, stepSize=0.1, maxBins=32, seed=7),
    # B: the XGBoost place: row and column subsampling per tree.
    "B": dict(maxDepth=5, maxIter=20, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=7),
    # C: the LightGBM place: fine histograms and a minimum leaf size.
    "C": dict(maxDepth=6, maxIter=20, stepSize=0.1, maxBins=255, minInstancesPerNode=20, seed=7),
}


def boosted(config: str, **overrides) -> GBTRegressor:
    params = {"lossType": "squared", "cacheNodeIds": False, "checkpointInterval": 10, **BOOSTED[config], **overrides}
    return GBTRegressor(**params)


def boosted_base(config: str, features: list[str], y: str = "y", **overrides) -> MLBase:
    """A boosted-tree base learner; predictions land in ``p_gbt_<config>``."""
    return MLBase(f"gbt_{config}", boosted(config, **overrides), features, y)


def fit_boosted(df: DataFrame, features: list[str], y: str = "y", config: str = "A", **overrides) -> PipelineModel:
    """One boosted-tree model (assembler + GBT); ``transform`` adds ``p_gbt_<config>``."""
    return boosted_base(config, features, y, **overrides).fit_one(df)
