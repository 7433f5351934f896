"""Learners fitted from class moments: Gaussian naive Bayes and linear discriminant analysis."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import EXPRESSION_TERMS, LinearClassModel, ParamModel, argmax, batch_scorer, features_array, number, softmax_of
from .stats import feature_gram, feature_moments


def nb_stats(df: DataFrame, cols: list[str], label: str = "label") -> DataFrame:
    """``(label, n, feature, mean, var)`` with population variances, in one aggregation."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for j, c in enumerate(cols):
        aggs += [F.avg(f"`{c}`").alias(f"m_{j}"), F.var_pop(f"`{c}`").alias(f"v_{j}")]
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{j}").alias("mean"), F.col(f"v_{j}").alias("var")) for j, c in enumerate(cols)])
    return df.groupBy(label).agg(*aggs).select(label, "n", F.inline(rows))


class GaussianNBModel(ParamModel):
    """Class priors and per-class normal densities."""

    kind = "gaussian_nb"

    def transform(self, df: DataFrame) -> DataFrame:
        prior, mean, var, const = self._numbers()
        x = features_array(df)
        if mean.size <= EXPRESSION_TERMS:
            texts = [self._log_density(const[c], mean[c], var[c]) for c in range(len(prior))]
            out = softmax_of(df.withColumn("_x", x), texts).drop("_x")
        else:
            out = df.withColumn("probability", batch_scorer(self.batch(), x))
        return out.withColumn("prediction", argmax(F.col("probability")))

    def _numbers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        prior, mean, var = (np.asarray(self.params[k]) for k in ("prior", "mean", "var"))
        with np.errstate(divide="ignore"):  # classes that did not occur
            return prior, mean, var, np.log(prior) - 0.5 * np.log(2 * math.pi * var).sum(axis=1)

    def batch(self) -> Callable[[np.ndarray], np.ndarray]:
        prior, mean, var, const = self._numbers()

        def proba(v: np.ndarray) -> np.ndarray:
            s = np.stack([const[c] - 0.5 * ((v - mean[c]) ** 2 / var[c]).sum(axis=1) for c in range(len(prior))], axis=1)
            e = np.exp(s - s.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)

        return proba

    @staticmethod
    def _log_density(const: float, mean: np.ndarray, var: np.ndarray) -> str:
        squares = [f"(_x[{j}] - {number(m)}) * (_x[{j}] - {number(m)}) / {number(2 * v)}" for j, (m, v) in enumerate(zip(mean, var))]
        return f"{number(const)} - ({' + '.join(squares)})"


def fit_gaussian_nb(train: DataFrame, params: dict) -> GaussianNBModel:
    """Means and population variances per class; every variance grows by ``var_smoothing`` times the
    largest overall variance. The moments are one pass and the same for every candidate. A class number that does not
    occur keeps its place with prior 0."""
    moments = feature_moments(train, "label")
    classes = range(max(moments) + 1)
    width = len(next(iter(moments.values()))[1])
    moments = {c: moments.get(c, (0, np.zeros(width), np.ones(width))) for c in classes}
    n_all = sum(n for n, _, _ in moments.values())
    share = {c: moments[c][0] / n_all for c in classes}
    centre = sum(share[c] * moments[c][1] for c in classes)
    overall = sum(share[c] * (moments[c][2] + (moments[c][1] - centre) ** 2) for c in classes)
    eps = float(params.get("var_smoothing", 1e-9)) * overall.max()
    return GaussianNBModel(
        prior=[share[c] for c in classes],
        mean=np.stack([moments[c][1] for c in classes]),
        var=np.stack([moments[c][2] + eps for c in classes]),
    )


def ledoit_wolf_shrinkage(train: DataFrame, means: dict[int, np.ndarray], stds: dict[int, np.ndarray], corr: dict[int, np.ndarray]) -> dict[int, float]:
    """Shrinkage per class for standardised features (Ledoit & Wolf 2004).

    Needs one more number per class than the second moments: the sum of squared squared norms.
    """
    per_class = []
    for c in means:
        z2 = " + ".join(f"pow((_x[{j}] - {number(m)}) / {number(s or 1.0)}, 2)" for j, (m, s) in enumerate(zip(means[c], stds[c])))
        per_class.append(F.expr(f"CASE WHEN label = {c} THEN pow({z2}, 2) END"))
    sums = train.select("label", features_array(train).alias("_x")).agg(*[F.sum(e).alias(str(c)) for c, e in zip(means, per_class)], *[F.count(e).alias(f"n{c}") for c, e in zip(means, per_class)]).first()
    return {c: _ledoit_wolf(sums[str(c)], sums[f"n{c}"], s) for c, s in corr.items()}


def _ledoit_wolf(fourth: float, n: int, s: np.ndarray) -> float:
    """Shrinkage of the correlations ``s`` of n rows, from the sum of their squared squared norms."""
    p = len(s)
    mu = np.trace(s) / p
    inner = (s * s).sum()
    beta = (fourth / n - inner) / (p * n)
    delta = (inner - 2 * mu * np.trace(s) + p * mu * mu) / p
    return 0.0 if beta <= 0 or delta <= 0 else min(beta, delta) / delta


def fit_lda(train: DataFrame, params: dict) -> LinearClassModel:
    """Least-squares discriminant: prior-weighted class covariances, shrunk, solved for p weights."""
    shift = feature_moments(train)[0][1]
    grams = feature_gram(train, key="label", shift=shift)
    shrink = params.get("shrinkage", 0.0)
    if shrink != "auto":
        return shrunk_discriminant(grams, shift, float(shrink))
    means, stds, corr = standardised(grams)
    lw = ledoit_wolf_shrinkage(train, {c: m + shift for c, m in means.items()}, stds, corr)
    return _correlated(grams, shift, means, stds, corr, lw)


def standardised(grams: dict[int, np.ndarray]) -> tuple[dict, dict, dict]:
    """Means, standard deviations and correlations of every class: the shrinkage target is the identity of correlations."""
    means, covs = _class_moments(grams)
    stds = {c: np.sqrt(np.maximum(np.diag(s), 0)) for c, s in covs.items()}
    stds = {c: np.where(sd == 0, 1.0, sd) for c, sd in stds.items()}
    return means, stds, {c: covs[c] / np.outer(stds[c], stds[c]) for c in covs}


def _correlated(grams: dict, shift: np.ndarray, means: dict, stds: dict, corr: dict, lw: dict[int, float]) -> LinearClassModel:
    return _discriminant(grams, shift, means, {c: np.outer(stds[c], stds[c]) * _shrunk(corr[c], lw[c]) for c in corr})


def auto_discriminant(grams: dict[int, np.ndarray], shift: np.ndarray, fourth: dict[int, float]) -> LinearClassModel:
    """The discriminant with Ledoit-Wolf shrinkage; ``fourth`` has the sums of squared squared norms of standardised rows."""
    means, stds, corr = standardised(grams)
    return _correlated(grams, shift, means, stds, corr, {c: _ledoit_wolf(fourth[c], grams[c][0, 0], s) for c, s in corr.items()})


def shrunk_discriminant(grams: dict[int, np.ndarray], shift: np.ndarray, shrink: float) -> LinearClassModel:
    """The discriminant for a fixed shrinkage, from class Gram matrices of [1, x - shift]."""
    means, covs = _class_moments(grams)
    return _discriminant(grams, shift, means, {c: _shrunk(s, shrink) for c, s in covs.items()})


def _class_moments(grams: dict[int, np.ndarray]) -> tuple[dict, dict]:
    means = {c: g[0, 1:] / g[0, 0] for c, g in grams.items()}
    return means, {c: g[1:, 1:] / g[0, 0] - np.outer(means[c], means[c]) for c, g in grams.items()}


def _discriminant(grams: dict, shift: np.ndarray, means: dict, covs: dict) -> LinearClassModel:
    order = sorted(grams)
    n = np.array([grams[c][0, 0] for c in order])
    prior = n / n.sum()
    pooled = sum(p * covs[c] for p, c in zip(prior, order))
    # the shift only kept digits in the covariances
    m = np.stack([means[c] + shift for c in order])
    own = np.linalg.lstsq(pooled, m.T, rcond=None)[0].T
    # class numbers that did not occur keep their place
    coef, intercept = np.zeros((int(order[-1]) + 1, own.shape[1])), np.full(int(order[-1]) + 1, -np.inf)
    at = [int(c) for c in order]
    coef[at], intercept[at] = own, -0.5 * np.einsum("ij,ij->i", m, own) + np.log(prior)
    return LinearClassModel(coef=coef, intercept=intercept)


def _shrunk(s: np.ndarray, a: float) -> np.ndarray:
    return (1 - a) * s + a * np.trace(s) / len(s) * np.eye(len(s))
