"""Kernel learners on Nystroem features (Williams & Seeger 2001).

A bounded number of landmark rows turns any kernel into an ordinary feature vector, so support vector
machines and Gaussian processes become linear fits whose cost grows with the rows only linearly.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_key
from .base import LinearValueModel, ParamModel, argmax, batch_scorer, class_count, features_array, with_weights, without_summary
from .stats import feature_gram, feature_moments

LANDMARKS = 100


def kernel_rows(x: np.ndarray, l: np.ndarray, kernel: str, gamma: float = 1.0, degree: int = 3, coef0: float = 0.0, scale: float = 1.0) -> np.ndarray:
    """Kernel values between rows and landmarks; ``scale`` is the length scale of the process kernels."""
    if kernel in ("poly", "sigmoid", "linear", "dot_product"):
        dot = x @ l.T
        return {
            "linear": lambda: dot, "dot_product": lambda: dot + scale * scale,
            "poly": lambda: (gamma * dot + coef0) ** degree, "sigmoid": lambda: np.tanh(gamma * dot + coef0),
        }[kernel]()
    sq = np.maximum((x * x).sum(1)[:, None] + (l * l).sum(1)[None, :] - 2 * x @ l.T, 0)
    if kernel == "rbf":
        return np.exp(-gamma * sq)
    if kernel == "matern":
        r = math.sqrt(3) * np.sqrt(sq) / scale
        return (1 + r) * np.exp(-r)
    if kernel == "rational_quadratic":
        return 1 / (1 + sq / (2 * scale * scale))
    raise ValueError(f"unknown kernel {kernel}")


class NystroemMap(ParamModel):
    """Replaces ``features`` by K(x, L) K(L, L)^(-1/2)."""

    kind = "nystroem"

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("features", array_to_vector(batch_scorer(self.batch(), features_array(df))))

    def batch(self) -> Callable[[np.ndarray], np.ndarray]:
        land, root, options = np.asarray(self.params["landmarks"]), np.asarray(self.params["root"]), self.params["options"]
        return lambda v: kernel_rows(v, land, **options) @ root


def nystroem_features(df: DataFrame, kernel: str, m: int = LANDMARKS, seed=42, id_col: str = "row_id", **options) -> NystroemMap:
    """The map for ``m`` landmark rows, the first in hash order (a top-m, not a sort)."""
    first = df.select(features_array(df).alias("x"), id_col).orderBy(hash_key(f"{seed}-landmark", id_col), id_col).limit(m)
    land = np.unique(np.array([r["x"] for r in first.collect()]), axis=0)
    values, vectors = np.linalg.eigh(kernel_rows(land, land, kernel, **options))
    good = values > max(values.max(), 0) * 1e-10
    root = vectors[:, good] / np.sqrt(values[good])
    return NystroemMap(landmarks=land, root=root, options={"kernel": kernel, **options})


def kernel_width(train: DataFrame, gamma) -> float:
    """'scale' is 1 / (p var(all entries)), 'auto' is 1 / p."""
    if gamma not in ("scale", "auto"):
        return float(gamma)
    _, mean, var = feature_moments(train)[0]
    if gamma == "auto":
        return 1.0 / len(mean)
    spread = (var + mean**2).mean() - mean.mean() ** 2
    return 1.0 / (len(mean) * spread) if spread > 0 else 1.0


class PipelinePair:
    """A feature map followed by a model."""

    def __init__(self, first, second) -> None:
        self.first, self.second = first, second

    def members(self) -> tuple:
        return None, [self.first, self.second]

    @classmethod
    def of(cls, state, members):
        return cls(*members)

    def transform(self, df: DataFrame) -> DataFrame:
        kept = df.withColumn("_features", F.col("features"))
        out = self.second.transform(self.first.transform(kept) if self.first else kept)
        return out.drop("features").withColumnRenamed("_features", "features")


class CalibratedMargins:
    """Class probabilities from margins by Platt's logistic curves, normalised over classes."""

    def __init__(self, models: list, curves: list[tuple[float, float]]) -> None:
        self.models, self.curves = models, curves

    def members(self) -> tuple:
        return self.curves, self.models

    @classmethod
    def of(cls, state, members):
        return cls(members, [tuple(c) for c in state])

    def transform(self, df: DataFrame) -> DataFrame:
        out, share = df, []
        for c, (m, (a, b)) in enumerate(zip(self.models, self.curves)):
            out = m.copy().setRawPredictionCol(f"_raw{c}").setPredictionCol("").transform(out)
            share.append(1 / (1 + F.exp(-(F.lit(a) * vector_to_array(f"_raw{c}")[1] + F.lit(b)))))
        p = F.array(1 - share[0], share[0]) if len(share) == 1 else F.array(*share)
        out = out.withColumn("_p", p).drop(*[f"_raw{c}" for c in range(len(share))])
        total = F.aggregate("_p", F.lit(0.0), lambda x, v: x + v)
        out = out.withColumn("probability", F.transform("_p", lambda v: v / total))
        return out.withColumn("prediction", argmax(F.col("probability"))).drop("_p")


def _svc_models(df: DataFrame, est: LinearSVC, k: int) -> list:
    models = [est.fit(df)] if k == 2 else OneVsRest(classifier=est, parallelism=min(k, 4)).fit(df).models
    return [without_summary(m) for m in models]


def fit_svm(train: DataFrame, params: dict, id_col: str = "row_id") -> PipelinePair:
    """Linear SVM on kernel features, one class against the rest, probabilities by Platt scaling.

    The curves are fitted on margins of held-out rows (a fifth, by hash).
    """
    kernel, k = params.get("kernel", "rbf"), class_count(train)
    fmap, df = None, train
    if kernel != "linear":
        fmap = nystroem_features(
            train, kernel, int(params.get("landmarks", LANDMARKS)), params.get("seed", 42), id_col,
            gamma=kernel_width(train, params.get("gamma", "scale")), degree=int(params.get("degree", 3)))
        df = fmap.transform(train)
    df, weight = with_weights(df, params.get("class_weight"))
    df = df.withColumn("_held", hash_key("platt", id_col) % 5 == 0).persist()
    est = LinearSVC(regParam=1.0 / (float(params.get("C", 1.0)) * df.count()), maxIter=int(params.get("max_iter", 100)), standardization=False)
    est = est.setWeightCol(weight) if weight else est
    held, curves = df.filter("_held"), []
    for c, m in enumerate(_svc_models(df.filter("not _held"), est, k)):
        margins = m.transform(held).select(vector_to_array("rawPrediction")[1].alias("m"), (F.col("label") == (1 if k == 2 else c)).cast("int").alias("hit"))
        margins = VectorAssembler(inputCols=["m"], outputCol="mv").transform(margins)
        platt = LogisticRegression(featuresCol="mv", labelCol="hit").fit(margins)
        curves.append((float(platt.coefficients[0]), float(platt.intercept)))
    final = _svc_models(df, est, k)
    df.unpersist()
    return PipelinePair(fmap, CalibratedMargins(final, curves))


def fit_gp(train: DataFrame, params: dict, id_col: str = "row_id") -> PipelinePair:
    """Gaussian process by subset of regressors: y ~ Phi w, w ~ N(0, s I), noise alpha.

    Everything about a kernel follows from one Gram matrix of its Nystroem features. The length scale
    and s are chosen by marginal likelihood; ``n_restarts_optimizer`` widens the search.
    """
    kernel, alpha = params.get("kernel", "rbf"), max(float(params.get("alpha", 1e-10)), 1e-10)
    restarts = int(params.get("n_restarts_optimizer", 0))
    lengths = [1.0] if kernel == "dot_product" else [1.0, *[f for i in range(restarts) for f in (2.0 ** (i + 1), 0.5 ** (i + 1))]]
    best = None
    for length in lengths:
        options = {"gamma": 1 / (2 * length * length)} if kernel == "rbf" else {"scale": length}
        fmap = None if kernel == "dot_product" else nystroem_features(
            train, kernel, int(params.get("landmarks", LANDMARKS)), params.get("seed", 42), id_col, **options)
        g = feature_gram(fmap.transform(train) if fmap else train, ["label"])
        n, y = g[0, 0], g[-1]
        keep = slice(0, -1) if kernel == "dot_product" else slice(1, -1)  # constant column: the bias of the dot product
        phi, b, yy = g[keep, keep], y[keep], g[-1, -1]
        for s in (0.1, 1.0, 10.0, 100.0):
            noise = alpha / s + 1e-10 * np.trace(phi) / len(phi)
            a = phi + noise * np.eye(len(phi))
            w = np.linalg.solve(a, b)
            fit = max(yy - b @ w, 1e-12) / (noise * s)
            like = -0.5 * (fit + np.linalg.slogdet(a)[1] + (n - len(phi)) * math.log(noise) + n * math.log(2 * math.pi * s))
            if best is None or like > best[0]:
                best = (like, fmap, w)
    _, fmap, w = best
    coef, bias = (w[1:], w[0]) if fmap is None else (w, 0.0)
    return PipelinePair(fmap, LinearValueModel(coef=coef, intercept=bias))
