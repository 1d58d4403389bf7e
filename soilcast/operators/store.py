"""Saving and loading fitted objects, to score later data in another session.

A fit is a folder: ``fit`` (one JSON line) and, where a fit holds tables or ``pyspark.ml`` models, a folder for each.
"""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from soilcast.operators.boosting import BoostedFits, BoostedModel, _Named
from soilcast.operators.impute import IterativeFill, MeanFill
from soilcast.operators.models import GroupLines, GroupMeanBase, GroupMeanFit, LinearBase, LinearFit, MLBase, MLFit
from soilcast.operators.stack import LeastSquaresModel, SeasonFit, StackModel


def save(spark: SparkSession, fit, path: str) -> None:
    """Write ``fit`` to the folder ``path``, which must not exist."""
    kind, facts = type(fit).__name__, {}
    if isinstance(fit, MeanFill):
        facts = {"cols": fit.cols, "means": fit.means, "by": fit.by}
        if fit.grouped is not None:
            fit.grouped.write.parquet(f"{path}/grouped")
    elif isinstance(fit, IterativeFill):
        facts = {"cols": fit.cols, "means": fit.means, "steps": fit.steps, "empty": fit.empty}
    elif isinstance(fit, LinearFit):
        facts = {"name": fit.base.name, "features": fit.base.features, "y": fit.base.y, "fold": fit.fold, "params": list(fit.params.items())}
    elif isinstance(fit, GroupLines):
        facts = {"name": fit.base.name, "features": fit.base.features, "y": fit.base.y, "group": fit.fold}
        fit.lines.write.parquet(f"{path}/lines")
    elif isinstance(fit, LeastSquaresModel):
        facts = {"p_cols": fit.p_cols, "weights": fit.weights, "intercept": fit.intercept, "prediction": fit.prediction}
    elif isinstance(fit, GroupMeanFit):
        facts = {"name": fit.base.name, "by": fit.base.by, "y": fit.base.y, "fold": fit.fold}
        fit.means.write.parquet(f"{path}/means")
        fit.overall.write.parquet(f"{path}/overall")
    elif isinstance(fit, MLFit):
        facts = {"name": fit.base.name, "features": fit.base.features, "y": fit.base.y, "fold": fit.fold, "models": list(fit.models)}
        for f, m in fit.models.items():
            m.save(f"{path}/model{f}")
    elif isinstance(fit, BoostedFits):
        facts = {"name": fit.base.name, "fold": fit.fold, "models": [[t, m.to_json()] for t, m in fit.models.items()]}
    elif isinstance(fit, PipelineModel):
        fit.save(f"{path}/model")
    elif isinstance(fit, StackModel):
        facts = {"n": len(fit.fitted)}
        for i, f in enumerate(fit.fitted):
            save(spark, f, f"{path}/base{i}")
        save(spark, fit.meta, f"{path}/meta")
    elif isinstance(fit, SeasonFit):
        facts = {"seasons": list(fit.models), "season": fit.season, "col": fit.col}
        for i, m in enumerate(fit.models.values()):
            save(spark, m, f"{path}/season{i}")
    else:
        raise TypeError(f"no way to save a {kind}")
    line = json.dumps({"kind": kind, **facts})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{path}/fit")


def load(spark: SparkSession, path: str):
    """The fit in the folder ``path``."""
    f = json.loads(spark.read.text(f"{path}/fit").first()["value"])
    kind = f.pop("kind")

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{name}")

    if kind == "MeanFill":
        return MeanFill(f["cols"], f["means"], f["by"], table("grouped") if f["by"] else None)
    if kind == "IterativeFill":
        return IterativeFill(f["cols"], f["means"], [tuple(s) for s in f["steps"]], f["empty"])
    if kind == "LinearFit":
        return LinearFit(LinearBase(f["name"], f["features"], f["y"]), f["fold"], {g: tuple(v) for g, v in f["params"]})
    if kind == "GroupLines":
        return GroupLines(LinearBase(f["name"], f["features"], f["y"]), f["group"], table("lines"))
    if kind == "LeastSquaresModel":
        return LeastSquaresModel(**f)
    if kind == "GroupMeanFit":
        return GroupMeanFit(GroupMeanBase(f["name"], f["by"], f["y"]), f["fold"], table("means"), table("overall"))
    if kind == "MLFit":
        models = {m: PipelineModel.load(f"{path}/model{m}") for m in f["models"]}
        return MLFit(MLBase(f["name"], None, f["features"], f["y"]), f["fold"], models)
    if kind == "BoostedFits":
        return BoostedFits(_Named(f["name"]), {t: BoostedModel.from_json(m) for t, m in f["models"]}, f["fold"])
    if kind == "PipelineModel":
        return PipelineModel.load(f"{path}/model")
    if kind == "StackModel":
        return StackModel([load(spark, f"{path}/base{i}") for i in range(f["n"])], load(spark, f"{path}/meta"))
    if kind == "SeasonFit":
        return SeasonFit({s: load(spark, f"{path}/season{i}") for i, s in enumerate(f["seasons"])}, f["season"], f["col"])
    raise TypeError(f"no way to load a {kind}")
