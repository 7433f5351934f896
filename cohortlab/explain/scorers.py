"""Fitted models as functions of arrays, for explanations that score many made-up rows inside a task.

``batch_form(model)`` returns a function from rows x features to rows x outputs: class probabilities or the predicted value. It holds
arrays alone, so it travels to the tasks and needs no Spark there. Every learner but KNN has one: that model is a table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    GBTClassificationModel,
    LinearSVCModel,
    LogisticRegressionModel,
    RandomForestClassificationModel,
)
from pyspark.ml.regression import (
    DecisionTreeRegressionModel,
    GBTRegressionModel,
    LinearRegressionModel,
    RandomForestRegressionModel,
)
from pyspark.sql import DataFrame, SparkSession

from ..learners import BaggedTrees, BoostedVote, CalibratedMargins, OneVsRestModel, PipelinePair, WeightedMedianTrees
from ..learners.base import ParamModel
from .nodes import packed, packed_scorer, tree_nodes
from .shap import kmeans_background, shap_kernel, shap_permutation

Scorer = Callable[[np.ndarray], np.ndarray]

TREES = (
    DecisionTreeClassificationModel, RandomForestClassificationModel, DecisionTreeRegressionModel, RandomForestRegressionModel, GBTRegressionModel,
)


def _logistic(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -700, 700)))


def _shares(p: np.ndarray) -> np.ndarray:
    return p / p.sum(axis=1, keepdims=True)


def _two(p: np.ndarray) -> np.ndarray:
    return np.column_stack([1 - p, p])


def margin_form(model) -> Scorer:
    """The margin of class 1 of a binary Spark ML model."""
    if isinstance(model, GBTClassificationModel):
        trees = packed_scorer(packed(tree_nodes(SparkSession.getActiveSession(), model)))
        return lambda x: trees(x)[:, 0]
    if isinstance(model, LinearSVCModel):
        w, b = model.coefficients.toArray(), float(model.intercept)
        return lambda x: x @ w + b
    raise TypeError(f"no margin of {type(model).__name__}")


def batch_form(model) -> Scorer:
    """The model as a function of arrays: rows x features to rows x outputs."""
    if isinstance(model, ParamModel):
        return model.batch()
    if isinstance(model, LogisticRegressionModel):
        w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
        if len(w) == 1:
            return lambda x: _two(_logistic(x @ w[0] + b[0]))

        def softmax(x: np.ndarray) -> np.ndarray:
            s = x @ w.T + b
            return _shares(np.exp(s - s.max(axis=1, keepdims=True)))

        return softmax
    if isinstance(model, LinearRegressionModel):
        w, b = model.coefficients.toArray(), float(model.intercept)
        return lambda x: (x @ w + b)[:, None]
    if isinstance(model, TREES):
        return packed_scorer(packed(tree_nodes(SparkSession.getActiveSession(), model)))
    if isinstance(model, GBTClassificationModel):
        margin = margin_form(model)
        return lambda x: _two(_logistic(2 * margin(x)))
    if isinstance(model, PipelinePair):
        second = batch_form(model.second)
        if model.first is None:
            return second
        first = model.first.batch()
        return lambda x: second(first(x))
    if isinstance(model, OneVsRestModel):
        margins = [margin_form(m) for m in model.models]
        return lambda x: _shares(_logistic(2 * np.column_stack([m(x) for m in margins])))
    if isinstance(model, CalibratedMargins):
        parts = [(margin_form(m), a, b) for m, (a, b) in zip(model.models, model.curves)]

        def calibrated(x: np.ndarray) -> np.ndarray:
            p = np.column_stack([_logistic(a * m(x) + b) for m, a, b in parts])
            return _shares(_two(p[:, 0]) if len(parts) == 1 else p)

        return calibrated
    if isinstance(model, BaggedTrees):
        parts = [(np.array(cols), batch_form(t)) for cols, t in model.trees]
        return lambda x: np.mean([t(x[:, cols]) for cols, t in parts], axis=0)
    if isinstance(model, BoostedVote):
        trees, alphas, k = [batch_form(t) for t in model.trees], np.array(model.alphas), model.k

        def voted(x: np.ndarray) -> np.ndarray:
            votes = np.zeros((len(x), k))
            for t, a in zip(trees, alphas):
                hit = t(x).argmax(axis=1)[:, None] == np.arange(k)
                votes += np.where(hit, a, 0.0 if k == 1 else -a / (k - 1))
            return _shares(np.exp(votes / alphas.sum() / max(k - 1, 1)))

        return voted
    if isinstance(model, WeightedMedianTrees):
        trees, weights = [batch_form(t) for t in model.trees], np.array(model.weights)

        def median(x: np.ndarray) -> np.ndarray:
            y = np.column_stack([t(x)[:, 0] for t in trees])
            order = np.lexsort((np.broadcast_to(weights, y.shape), y))
            enough = np.cumsum(weights[order], axis=1) >= 0.5 * float(weights.sum())
            return np.take_along_axis(np.take_along_axis(y, order, axis=1), enough.argmax(axis=1)[:, None], axis=1)

        return median
    raise TypeError(f"{type(model).__name__} has no batch form")


def explain_model(
    df: DataFrame, model, features: list[str], train: DataFrame, background: int = 50, method: str = "kernel", keep: list[str] = ("row_id", "label"), **options
) -> DataFrame:
    """Contributions of a fitted model's outputs against weighted centres of its training rows, as the long table."""
    centres, weights = kmeans_background(train, background)
    run = {"kernel": shap_kernel, "permutation": shap_permutation}[method]
    return run(df, batch_form(model), centres, weights, features, keep=keep, **options)


# ---- importances -------------------------------------------------------------------------------

def importance_of(model, width: int) -> np.ndarray:
    """One number per feature: split gains of trees, sizes of weights (over the classes) of linear models."""
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray()
    if isinstance(model, LogisticRegressionModel):
        return np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    if hasattr(model, "coefficients"):
        return np.abs(model.coefficients.toArray())
    if isinstance(model, OneVsRestModel):
        return np.mean([importance_of(m, width) for m in model.models], axis=0)
    if isinstance(model, BaggedTrees):
        out = np.zeros(width)
        for cols, t in model.trees:
            out[cols] += importance_of(t, len(cols)) / len(model.trees)
        return out
    if isinstance(model, (BoostedVote, WeightedMedianTrees)):
        weights = model.alphas if isinstance(model, BoostedVote) else model.weights
        return np.average([importance_of(t, width) for t in model.trees], axis=0, weights=weights)
    if isinstance(model, ParamModel) and model.linear_weights() is not None:
        return np.abs(model.linear_weights()).mean(axis=0)
    raise TypeError(f"{type(model).__name__} has no importances: explain it by its contributions")


def model_importances(spark: SparkSession, models: dict[str, list], features: list[str]) -> DataFrame:
    """``(model, fold, feature, importance)`` of models fitted on folds (``search.fold_models``); one row per number.

    ``views.fold_importance`` averages them over the folds of a model, ``views.top_importance`` takes the largest.
    """
    rows = [
        (name, fold, f, float(v)) for name, fitted in models.items() for fold, m in enumerate(fitted)
        for f, v in zip(features, importance_of(m, len(features)), strict=True)
    ]
    return spark.createDataFrame(rows, "model string, fold int, feature string, importance double")
