"""Parameter grids: expansion, clean-up and sampling.

A grid is a dict of lists. As a table it is ``(model, param_id, params MAP<STRING,STRING>)``.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_key

LAYERS = [[50], [100], [50, 25], [100, 50], [50, 50, 25]]


def powers(lo: int, hi: int) -> list[float]:
    return [10.0**e for e in range(lo, hi + 1)]


# Candidate settings per classifier.
CLASSIFIER_GRIDS: dict[str, dict[str, list]] = {
    "LogR": {
        "C": powers(-3, 2), "penalty": ["l1", "l2", "elasticnet"], "max_iter": [100, 500, 1000],
        "class_weight": [None, "balanced"], "l1_ratio": [0.0, 0.25, 0.5, 0.75, 1.0],
    },
    "LR-SGD": {
        "loss": ["log_loss", "modified_huber"], "penalty": ["l2", "l1", "elasticnet"], "alpha": powers(-6, -1),
        "learning_rate": ["constant", "invscaling", "adaptive"], "eta0": powers(-3, -1), "max_iter": [500, 1000],
        "tol": [1e-3, 1e-4], "early_stopping": [True], "validation_fraction": [0.1], "n_iter_no_change": [5],
        "class_weight": ["balanced"],
    },
    "LDA": {"shrinkage": ["auto", 0.0, 0.25, 0.5, 0.75, 1.0], "tol": [1e-4, 1e-3, 1e-2]},
    "DT": {
        "criterion": ["gini", "entropy"], "max_depth": [3, 5, 10, 15, 20, None], "min_samples_split": [2, 5, 10],
        "min_samples_leaf": [1, 2, 4], "max_features": [0.3, 0.5, 0.7, 1.0], "class_weight": [None, "balanced"],
    },
    "RF": {
        "n_estimators": [50, 100, 200], "max_depth": [5, 10, 20, None], "min_samples_split": [2, 5],
        "min_samples_leaf": [1, 2], "bootstrap": [True, False], "max_features": ["sqrt", "log2"],
        "class_weight": [None, "balanced"],
    },
    "AdaB": {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.1, 0.5, 1.0], "max_depth": [1, 2]},
    "XGB": {
        "n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.1, 0.3], "max_depth": [3, 5, 7],
        "subsample": [0.8, 1.0], "colsample_bytree": [0.8, 1.0], "gamma": [0, 0.1], "scale_pos_weight": [1, 2, 5],
    },
    "SVM": {
        "C": [0.1, 1, 10, 100], "kernel": ["linear", "poly", "rbf"], "degree": [2, 3], "gamma": ["scale", "auto"],
        "class_weight": [None, "balanced"],
    },
    "KNN": {
        "n_neighbors": list(range(1, 21, 2)), "weights": ["uniform", "distance"], "p": [1, 2],
        "metric": ["euclidean", "manhattan", "minkowski"],
    },
    "NB": {"var_smoothing": [10 ** (-12 + 9 * i / 19) for i in range(20)]},
    "MLP": {
        "hidden_layer_sizes": LAYERS, "activation": ["relu", "tanh"], "solver": ["adam", "sgd"],
        "alpha": powers(-5, -1), "learning_rate": ["constant", "adaptive"], "learning_rate_init": [1e-3, 1e-4],
        "batch_size": [4, 8, 16], "max_iter": [200, 400, 600], "early_stopping": [True],
        "validation_fraction": [0.1], "beta_1": [0.9, 0.99], "beta_2": [0.999, 0.9999], "epsilon": [1e-8, 1e-5],
        "n_iter_no_change": [10],
    },
}

# Candidate settings per regressor.
REGRESSOR_GRIDS: dict[str, dict[str, list]] = {
    "LR": {"fit_intercept": [True, False]},
    "Ridge": {"alpha": powers(-3, 2)},
    "Lasso": {"alpha": powers(-3, 2)},
    "ElasticNet": {"alpha": powers(-3, 0), "l1_ratio": [0.1, 0.5, 0.7, 1.0]},
    "DT": {
        "max_depth": [3, 5, 10, 15, 20, None], "min_samples_split": [2, 5, 10], "max_features": [0.3, 0.5, 0.7, 1.0],
    },
    "RF": {
        "n_estimators": [10, 50, 100], "max_depth": [3, 5, 10, 15, 20, None], "min_samples_split": [2, 5, 10],
        "min_samples_leaf": [1, 2, 4], "bootstrap": [True, False],
    },
    "AdaB": {"n_estimators": [10, 50, 100], "learning_rate": [0.01, 0.1, 0.5, 1.0]},
    "XGB": {
        "n_estimators": [10, 50, 100], "learning_rate": [0.01, 0.1, 0.3], "max_depth": [3, 5, 7],
        "min_child_weight": [1, 3, 5], "subsample": [0.8, 1.0], "colsample_bytree": [0.8, 1.0],
        "gamma": [0, 0.1, 0.2],
    },
    "Bagging": {
        "n_estimators": [10, 50, 100], "max_samples": [0.3, 0.5, 0.7, 1.0], "max_features": [0.3, 0.5, 0.7, 1.0],
    },
    "SVR": {
        "C": [0.01, 0.1, 1, 10, 100], "kernel": ["linear", "poly", "rbf", "sigmoid"], "epsilon": [0.01, 0.1, 1],
    },
    "GPR": {
        "kernel": ["rbf", "matern", "rational_quadratic", "dot_product"], "alpha": [1e-10, 1e-5, 1e-2],
        "n_restarts_optimizer": [0, 5, 10],
    },
    "MLP": {
        "hidden_layer_sizes": LAYERS, "activation": ["relu", "tanh"], "solver": ["adam"], "alpha": [1e-4, 1e-3],
        "learning_rate": ["constant", "adaptive"], "learning_rate_init": [1e-3, 1e-4], "max_iter": [500],
    },
}


def canonical(params: dict) -> dict:
    """Drop settings another one switches off, so equal candidates look equal."""
    out = dict(params)
    if out.get("penalty") in ("l1", "l2"):
        out.pop("l1_ratio", None)
    if out.get("kernel") in ("linear", "rbf", "sigmoid"):
        out.pop("degree", None)
    if out.get("kernel") == "linear":
        out.pop("gamma", None)
    metric = out.pop("metric", None)
    if metric in ("euclidean", "manhattan"):
        out["p"] = 2 if metric == "euclidean" else 1
    return out


def candidates(grid: dict[str, list]) -> list[dict]:
    """All distinct candidates, first parameter slowest. Grids hold up to a few ten thousand."""
    seen: dict[str, dict] = {}
    for values in itertools.product(*grid.values()):
        c = canonical(dict(zip(grid, values)))
        seen.setdefault(json.dumps(c, sort_keys=True), c)
    return list(seen.values())


def expand_grid(spark: SparkSession, grid: dict[str, list | Column], source: DataFrame | None = None) -> DataFrame:
    """The grid as a table: every combination of the values, one map per row, numbered in order.

    A value list may also be an array column of the one-row frame ``source`` (a grid that depends on
    data, such as kernel widths from the feature variance).
    """
    df = source if source is not None else spark.range(1).drop("id")
    names = list(grid)
    for n, v in grid.items():
        arr = v if isinstance(v, Column) else F.array(*[F.lit(json.dumps(x).strip('"')) for x in v])
        df = df.select("*", F.posexplode(arr).alias(f"_p_{n}", f"_v_{n}"))
    params = F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"_v_{n}").cast("string"))])
    order = Window.partitionBy(F.lit(0)).orderBy(*[f"_p_{n}" for n in names])
    return df.select(F.row_number().over(order).alias("param_id"), params.alias("params"))


def sample_grid(table: DataFrame, n: int = 10, seed=42) -> DataFrame:
    """``n`` candidates without repeats, in hash order of their number (a top-n, no full sort)."""
    return table.orderBy(hash_key(seed, "param_id"), "param_id").limit(n)


def sample_candidates(grid: dict[str, list], n: int = 10, seed: int = 42) -> list[dict]:
    """The same draw for driver loops."""
    import hashlib

    every = candidates(grid)
    order = sorted(range(len(every)), key=lambda i: hashlib.md5(f"{seed}|{i + 1}".encode()).hexdigest()[:13])
    return [every[i] for i in order[:n]]


def best_candidate(scores: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Candidate with the highest mean score over folds; the first one on ties."""
    means = scores.groupBy(*keys, "param_id").agg(F.avg("score").alias("mean_score"))
    return means.groupBy(*keys).agg(
        F.max_by("param_id", F.struct(F.col("mean_score"), -F.col("param_id"))).alias("param_id"),
        F.max("mean_score").alias("mean_score"),
    )
