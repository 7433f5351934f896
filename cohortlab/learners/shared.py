"""Fits of many candidates on many folds from one pass over the rows.

Second moments add up: the moments of a training part are those of all rows minus those of the fold
left out. So one job collects a Gram matrix per fold (and class), and every candidate on every fold is
a small solve. ``many(df, fold_col, n_folds, options)`` returns models[candidate][fold].

Several fold columns, as those of all outer folds of a nested search, share the pass as well, and so do the scores of
all their models: a row goes to Python once, whatever the number of folds and candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import LinearClassModel, LinearValueModel, features_array
from .bayes import GaussianNBModel, auto_discriminant, shrunk_discriminant, standardised

Grams = dict[int, np.ndarray]


def _slim(df: DataFrame, fold_cols: list[str], label: Column, x: Column) -> DataFrame:
    """What ``_arrays`` reads; rows outside a fold column's folds have -1 there."""
    folds = [F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(f"_f{j}") for j, c in enumerate(fold_cols)]
    return df.select(*folds, label.alias("_y"), x.alias("_x"))


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """(folds per fold column, labels, rows x features) of every batch."""
    for b in batches:
        if b.num_rows:
            *folds, y, x = b.columns
            yield [f.to_numpy() for f in folds], y.to_numpy(zero_copy_only=False), x.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _summed(df: DataFrame, partial: Callable, keys: list[str], values: list[str]) -> list:
    """Sums per key of what the tasks pass on: ``partial`` maps batches to a dict of keys and values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = partial(_arrays(batches))
        if sums:
            cols = [pa.array([k[i] for k in sums], pa.int32()) for i in range(len(keys))]
            cols += [pa.array([float(v[i]) for v in sums.values()], pa.float64()) for i in range(len(values))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, *values])

    schema = ", ".join([f"{k} int" for k in keys] + [f"{v} double" for v in values])
    return df.mapInArrow(run, schema).groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values]).collect()


def _fold_grams(df: DataFrame, fold_cols: list[str], n_folds: int, extra: list[str], n_classes: int, shift: np.ndarray) -> list[tuple[list[Grams], Grams]]:
    """Per fold column: (per left-out fold: class -> Gram matrix of the rest, the same of all its rows)."""
    x = features_array(df)
    packed = F.concat(x, F.array(*[F.col(c).cast("double") for c in extra])) if extra else x
    label = F.coalesce(F.col("label").cast("int"), F.lit(-1)) if n_classes > 1 else F.lit(0)
    lower = np.concatenate([shift, np.zeros(len(extra))])
    width = len(lower) + 1

    def partial(arrays: Iterator) -> dict:
        grams: dict[tuple, np.ndarray] = {}
        for folds, y, v in arrays:
            z = np.column_stack([np.ones(len(v)), v - lower])
            for j, fold in enumerate(folds):
                code = np.where((fold >= 0) & (y >= 0), fold * n_classes + y, -1)
                for c in np.unique(code[code >= 0]).tolist():
                    own = z[code == c]
                    grams[j, c] = grams.get((j, c), 0.0) + own.T @ own
        return {(*key, i, k): (g[i, k],) for key, g in grams.items() for i in range(width) for k in range(i, width)}

    found: list[Grams] = [{} for _ in fold_cols]
    for r in _summed(_slim(df, fold_cols, label, packed), partial, ["j", "code", "row", "col"], ["value"]):
        g = found[r["j"]].setdefault(r["code"], np.zeros((width, width)))
        g[r["row"], r["col"]] = g[r["col"], r["row"]] = r["value"]
    out = []
    for grams in found:
        total: Grams = {}
        for k, g in grams.items():
            total[k % n_classes] = total.get(k % n_classes, 0.0) + g
        out.append(([{c: t - grams.get(f * n_classes + c, 0.0) for c, t in total.items()} for f in range(n_folds)], total))
    return out


def _fourth_sums(df: DataFrame, fold_cols: list[str], shift: np.ndarray, grams: list[tuple[list[Grams], Grams]]) -> dict[tuple[int, int], dict[int, float]]:
    """Sums of squared squared norms of standardised rows: (fold column, left-out fold; -1 for none) -> class -> sum."""
    scale: dict[tuple[int, int], dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    for j, (folds, whole) in enumerate(grams):
        for f, g in [*enumerate(folds), (-1, whole)]:
            means, stds, _ = standardised(g)
            scale[j, f] = {c: (means[c] + shift, stds[c]) for c in g}

    def partial(arrays: Iterator) -> dict:
        sums: dict[tuple, tuple] = {}
        for folds, y, x in arrays:
            for (j, f), classes in scale.items():
                for c, (mean, std) in classes.items():
                    z = (x[(folds[j] >= 0) & (folds[j] != f) & (y == c)] - mean) / std
                    sums[j, f, c] = (sums.get((j, f, c), (0.0,))[0] + ((z * z).sum(axis=1) ** 2).sum(),)
        return sums

    out: dict[tuple[int, int], dict[int, float]] = {}
    label = F.coalesce(F.col("label").cast("int"), F.lit(-1))
    for r in _summed(_slim(df, fold_cols, label, features_array(df)), partial, ["j", "fold", "cls"], ["value"]):
        out.setdefault((r["j"], r["fold"]), {})[r["cls"]] = r["value"]
    return out


def _least_squares(g: np.ndarray, shift: np.ndarray, alpha_of_n, l1_ratio: float, intercept: bool) -> LinearValueModel:
    """Penalised least squares from the Gram matrix of [1, x - shift, y]."""
    n = g[0, 0]
    mean = g[0] / n if intercept else np.zeros(len(g))
    s = g / n - np.outer(mean, mean)
    a, b = s[1:-1, 1:-1], s[1:-1, -1]
    alpha = alpha_of_n(n)
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    if l1 == 0:
        w = np.linalg.lstsq(a + l2 * np.eye(len(b)), b, rcond=None)[0]
    else:
        w = np.zeros(len(b))
        for _ in range(10_000):
            before = w.copy()
            for j in range(len(w)):
                r = b[j] - a[j] @ w + a[j, j] * w[j]
                w[j] = np.sign(r) * max(abs(r) - l1, 0.0) / (a[j, j] + l2) if a[j, j] + l2 > 0 else 0.0
            if np.abs(w - before).max() <= 1e-12 * max(1.0, np.abs(w).max()):
                break
    bias = mean[-1] - w @ mean[1:-1] - w @ shift if intercept else 0.0
    return LinearValueModel(coef=w, intercept=bias)


class Shared:
    """``many`` of a learner: ``solve(Gram matrices by class, shift, parameters, fourth sums or None)`` makes a model."""

    def __init__(self, solve: Callable, classify: bool) -> None:
        self.solve, self.classify = solve, classify

    def __call__(self, df: DataFrame, fold_col: str, n_folds: int, options: list[dict]) -> list[list]:
        return self.nested(df, [fold_col], n_folds, options)[0][0]

    def nested(self, df: DataFrame, fold_cols: list[str], n_folds: int, options: list[dict]) -> list[tuple[list[list], list]]:
        """Per fold column: (models[candidate][fold], models[candidate] of all rows that have a fold there)."""
        first = df.agg(F.max("label").alias("top"), Summarizer.metrics("mean").summary(F.col("features")).alias("s")).first()
        k, mean = int(first["top"]) + 1 if self.classify else 1, first["s"]["mean"].toArray()
        shift = np.zeros(len(mean)) if any(not o.get("fit_intercept", True) for o in options) else mean
        grams = _fold_grams(df, fold_cols, n_folds, [] if self.classify else ["label"], k, shift)
        auto = any(o.get("shrinkage") == "auto" for o in options)
        fourth = _fourth_sums(df, fold_cols, shift, grams) if auto else {}
        return [
            ([[self.solve(g, shift, o, fourth.get((j, f))) for f, g in enumerate(folds)] for o in options],
             [self.solve(whole, shift, o, fourth.get((j, -1))) for o in options])
            for j, (folds, whole) in enumerate(grams)
        ]


def least_squares_many(settings) -> Shared:
    """``many`` of a linear regressor; ``settings(params)`` gives (penalty as a function of n, l1 ratio)."""
    return Shared(lambda g, shift, o, _: _least_squares(g[0], shift, *settings(o), bool(o.get("fit_intercept", True))), False)


def _naive_bayes(grams: Grams, shift: np.ndarray, o: dict, _) -> GaussianNBModel:
    order = sorted(grams)
    n = np.array([grams[c][0, 0] for c in order])
    mean = np.stack([grams[c][0, 1:] / grams[c][0, 0] for c in order])
    var = np.stack([np.diag(grams[c])[1:] / grams[c][0, 0] for c in order]) - mean**2
    total = sum(grams.values())
    overall = np.diag(total)[1:] / total[0, 0] - (total[0, 1:] / total[0, 0]) ** 2
    eps = float(o.get("var_smoothing", 1e-9)) * overall.max()
    return GaussianNBModel(prior=n / n.sum(), mean=mean + shift, var=var + eps)


def _discriminant(grams: Grams, shift: np.ndarray, o: dict, fourth: dict[int, float] | None) -> LinearClassModel:
    if o.get("shrinkage") == "auto":
        return auto_discriminant(grams, shift, fourth)
    return shrunk_discriminant(grams, shift, float(o.get("shrinkage", 0.0)))


nb_many, lda_many = Shared(_naive_bayes, True), Shared(_discriminant, True)


def shared_scores(df: DataFrame, fold_cols: list[str], models: list[list[list]], metric: str) -> list[list[dict]]:
    """Per fold column: (param_id, fold, score) of models[candidate][fold] on the rows of the fold, from one pass; accuracy or R2."""
    classify = metric == "accuracy"
    run = [[[m.batch() for m in folds] for folds in candidates] for candidates in models]
    centre = 0.0 if classify else df.agg(F.avg("label")).first()[0]

    def partial(arrays: Iterator) -> dict:
        sums: dict[tuple, np.ndarray] = {}
        for folds, y, x in arrays:
            for j, candidates in enumerate(run):
                for f in np.unique(folds[j][folds[j] >= 0]).tolist():
                    own = folds[j] == f
                    xs, ys = x[own], y[own]
                    known = ~np.isnan(ys)
                    d = ys[known] - centre
                    for i, models_of in enumerate(candidates):
                        out = models_of[f](xs)
                        hit = (ys[known] == out[known].argmax(axis=1)) if classify else (ys - out[:, 0])[known] ** 2
                        sums[j, i, f] = sums.get((j, i, f), 0.0) + np.array([len(ys), known.sum(), hit.sum(), d.sum(), (d * d).sum()])
        return sums

    found: list[list[dict]] = [[] for _ in fold_cols]
    slim = _slim(df, fold_cols, F.col("label").cast("double"), features_array(df))
    for r in _summed(slim, partial, ["j", "param_id", "fold"], ["n", "known", "hit", "d", "dd"]):
        n = r["known"]
        value = r["hit"] / n if classify else 1 - r["hit"] / ((r["dd"] / n - (r["d"] / n) ** 2) * r["n"])
        found[r["j"]].append({"param_id": r["param_id"], "fold": r["fold"], "score": float(value)})
    return [sorted(rows, key=lambda r: (r["param_id"], r["fold"])) for rows in found]


def shared_predictions(df: DataFrame, fold_col: str, models: list, classify: bool) -> DataFrame:
    """(row_id, label, fold, prediction and, for classes, probability): every row by the model of its fold, in one pass."""
    run = [m.batch() for m in models]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, label, fold, x = b.columns
            f, v = fold.to_numpy(), x.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            out = None
            for own in np.unique(f).tolist():
                got = run[own](v[f == own])
                out = np.full((len(f), got.shape[1]), np.nan) if out is None else out
                out[f == own] = got
            if out is None:
                continue
            names, cols = ["row_id", "label", "fold"], [ids, label, fold]
            if classify:
                ends = pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32))
                cols += [pa.array(out.argmax(axis=1).astype(float)), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))]
            else:
                cols.append(pa.array(out[:, 0]))
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "prediction", "probability"][:len(cols)])

    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c in ("row_id", "label")] + ["fold int", "prediction double"]
    slim = df.select("row_id", "label", F.col(fold_col).cast("int").alias("fold"), features_array(df).alias("_x"))
    return slim.mapInArrow(predict, ", ".join(kinds + (["probability array<double>"] if classify else [])))
