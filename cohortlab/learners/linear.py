"""Linear models of Spark ML with the penalties written as in the parameter grids."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import with_weights, without_summary


def fit_logreg(train: DataFrame, params: dict):
    """Logistic regression; C weighs the summed loss, so the mean loss is penalised with 1 / (C n)."""
    penalty = params.get("penalty", "l2")
    ratio = {"l1": 1.0, "l2": 0.0}.get(penalty, float(params.get("l1_ratio", 0.5)))
    df, weight = with_weights(train, params.get("class_weight"))
    est = LogisticRegression(
        regParam=1.0 / (float(params.get("C", 1.0)) * train.count()), elasticNetParam=ratio,
        maxIter=int(params.get("max_iter", 100)), tol=float(params.get("tol", 1e-6)), standardization=False,
    )
    return without_summary((est.setWeightCol(weight) if weight else est).fit(df))


def fit_ols(train: DataFrame, params: dict):
    return LinearRegression(solver="normal", regParam=0.0, fitIntercept=bool(params.get("fit_intercept", True))).fit(train)


def _penalised(train: DataFrame, l1: float, l2: float, tol: float = 1e-9):
    """Least squares with mean loss + l1 |w| + l2 / 2 w^2.

    Spark ML scales the label by its population std first and divides both penalties by it. That is
    right for |w| and one std too little for w^2, so l2 is multiplied by it.
    """
    l2 *= train.agg(F.stddev_pop("label")).first()[0] or 1.0
    total = l1 + l2
    return LinearRegression(
        solver="normal", regParam=total, elasticNetParam=l1 / total if total else 0.0, standardization=False, maxIter=1000, tol=tol
    ).fit(train)


def fit_ridge(train: DataFrame, params: dict):
    """alpha penalises the summed squared error, the mean loss is penalised with alpha / n."""
    return _penalised(train, 0.0, float(params.get("alpha", 1.0)) / train.count())


def fit_lasso(train: DataFrame, params: dict):
    return _penalised(train, float(params.get("alpha", 1.0)), 0.0)


def fit_elasticnet(train: DataFrame, params: dict):
    alpha, ratio = float(params.get("alpha", 1.0)), float(params.get("l1_ratio", 0.5))
    return _penalised(train, alpha * ratio, alpha * (1 - ratio))
