"""Shapley contributions as long tables ``(row_id, label, class, feature, feature_value, phi, base)``."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..learners.base import batch_scorer, features_array
from ..session import spread
from .nodes import Packed, packed, tree_groups, tree_nodes


def linear_contributions(
    df: DataFrame, features: list[str], coef: list[list[float]], intercept: list[float],
    background: DataFrame | None = None, keep: list[str] = ("row_id", "label"),
) -> DataFrame:
    """(keep, x, class, phi, base): one row per row and class; x and phi are arrays over ``features``.

    Means and bases are worked out once, in one row; nothing is shuffled.
    """
    background = df if background is None else background
    w = [_doubles(row) for row in coef]
    bases = ", ".join(
        f"aggregate(zip_with(m, {v}, (a, b) -> a * b), double('{float(b)!r}'), (s, t) -> s + t)" for v, b in zip(w, intercept)
    )
    means = "array(" + ", ".join(f"avg(`{f}`)" for f in features) + ") AS m"
    stats = background.selectExpr(means).selectExpr("m", f"array({bases}) AS base").selectExpr("struct(m, base) AS s").scalar()
    classes = ", ".join(
        f"struct({c} AS class, zip_with(zip_with(x, _s.m, (a, b) -> a - b), {v}, (a, b) -> a * b) AS phi, _s.base[{c}] AS base)" for c, v in enumerate(w)
    )
    x = "array(" + ", ".join(f"CAST(`{f}` AS DOUBLE)" for f in features) + ") AS x"
    # the row of means is bound to a column once: every mention of a subquery would be planned by itself
    return df.withColumn("_s", stats).selectExpr(*[f"`{k}`" for k in keep], x, "_s").selectExpr(*[f"`{k}`" for k in keep], "x", f"inline(array({classes}))")


def _doubles(values: list[float]) -> str:
    """A literal array of doubles; one text in the plan whatever its length."""
    return f"CAST(split('{','.join(repr(float(v)) for v in values)}', ',') AS ARRAY<DOUBLE>)"


def shap_linear(
    df: DataFrame,
    features: list[str],
    coef: list[list[float]],
    intercept: list[float],
    background: DataFrame | None = None,
    keep: list[str] = ("row_id", "label"),
) -> DataFrame:
    """phi_j = w_j (x_j - mean x_j), base = w . mean + b, for each class (one row of ``coef``), as a long table."""
    arrays = linear_contributions(df, features, coef, intercept, background, keep)
    names = F.array(*[F.lit(f) for f in features])
    long = arrays.select(*keep, "x", "class", "base", F.posexplode("phi").alias("_j", "phi"))
    return long.select(*keep, "class", names[F.col("_j")].alias("feature"), F.col("x")[F.col("_j")].alias("feature_value"), "phi", "base")


def long_contributions(df: DataFrame, phi: Column, base: list[float], features: list[str], keep: list[str] = ("row_id", "label"), x: Column | None = None) -> DataFrame:
    """An array of K x p contributions per row (class by class) to the long table."""
    p = len(features)
    x = features_array(df) if x is None else x
    names, bases = F.array(*[F.lit(f) for f in features]), F.array(*[F.lit(float(b)) for b in base])
    long = df.select(*keep, x.alias("_x"), F.posexplode(phi).alias("_i", "phi"))
    cls, j = (F.col("_i") / p).cast("int"), F.col("_i") % p
    return long.select(
        *keep, cls.alias("class"), names[j].alias("feature"), F.col("_x")[j].alias("feature_value"), "phi", bases[cls].alias("base")
    )


def _array_udf(fn: Callable[[np.ndarray], np.ndarray], x: Column) -> Column:
    return batch_scorer(lambda v: fn(v).reshape(len(v), -1), x)


# ---- trees -------------------------------------------------------------------------------------

def shap_tree(df: DataFrame, model, features: list[str], keep: list[str] = ("row_id", "label")) -> DataFrame:
    """Path-dependent tree contributions (Lundberg 2018) of a tree, forest or boosted model.

    Forests are explained in class probabilities (or the value), boosted classifiers in the margin.
    """
    nodes, p = tree_nodes(df.sparkSession, model), len(features)
    df = spread(df.select(*keep, "features"), keep[0])
    phi, base = None, 0.0
    # contributions add up over trees, so a model of any size goes to the tasks in parts
    for group in tree_groups(nodes):
        trees = packed(nodes.filter(F.col("tree").isin(group)))
        shared = df.sparkSession.sparkContext.broadcast(trees)
        base = base + expected_value(trees)
        part = _array_udf(lambda v, shared=shared: tree_contributions(v, shared.value, p), features_array(df))
        phi = part if phi is None else F.zip_with(phi, part, lambda a, b: a + b)
    return long_contributions(df, phi, list(base), features, keep)


def expected_value(trees: Packed) -> np.ndarray:
    """The mean output over the training rows: leaves weighted by their share of the root's rows."""
    out = np.zeros(trees.value.shape[1])
    for root in trees.roots:
        stack = [root]
        while stack:
            node = stack.pop()
            if trees.left[node] < 0:
                out += trees.value[node] * trees.cover[node] / trees.cover[root]
            else:
                stack += [trees.left[node], trees.right[node]]
    return out


#: Rows that walk a tree together.
WALKERS = 8192


def _extended(w: np.ndarray, zero: float, one: np.ndarray) -> np.ndarray:
    """Weights by coalition size after one more feature: the share ``zero`` of training rows goes on, ``one`` tells which rows do."""
    d = len(w)
    size = np.arange(d)[:, None]
    out = np.zeros((d + 1, w.shape[1]))
    out[:-1] = zero * w * (d - size) / (d + 1)
    out[1:] += one * w * (size + 1) / (d + 1)
    return out


def _without(w: np.ndarray, zero: float, one: np.ndarray) -> np.ndarray:
    """The summed weights of the path without one of its features."""
    d = len(w) - 1
    total, rest = np.zeros(w.shape[1]), w[d]
    absent = np.zeros(w.shape[1])
    for j in range(d - 1, -1, -1):
        share = rest * ((d + 1) / (j + 1))
        total = total + share
        rest = w[j] - share * (zero * (d - j) / (d + 1))
        absent = absent + w[j] * ((d + 1) / (zero * (d - j)))
    return np.where(one > 0, total, absent)


def tree_contributions(x: np.ndarray, trees: Packed, p: int) -> np.ndarray:
    """(rows, classes, features) contributions; a block of rows walks down every tree at once.

    At a node the path holds each feature split on so far, with the share of training rows that satisfy all its splits and whether
    a row does, and one weight per row and coalition size. A split extends the weights once for all rows and all leaves below. A feature
    that is split on again replaces its earlier entry. At a leaf each feature gets its share of the value.
    """
    out = np.zeros((len(x), trees.value.shape[1], p))
    for at in range(0, len(x), WALKERS):
        block, phi = x[at : at + WALKERS], out[at : at + WALKERS]
        start = np.ones((1, len(block)))
        for root in trees.roots:
            stack = [(root, {}, start)]
            while stack:
                node, path, w = stack.pop()
                if trees.left[node] < 0:
                    value = trees.value[node]
                    for f, (zero, one) in path.items():
                        phi[:, :, f] += ((one - zero) * _without(w, zero, one))[:, None] * value
                    continue
                f = trees.feature[node]
                low = block[:, f] <= trees.threshold[node]
                before, held = path.get(f, (1.0, 1.0))
                others = {k: v for k, v in path.items() if k != f}
                if f in path:
                    w = start
                    for zero, one in others.values():
                        w = _extended(w, zero, one)
                for child, goes in ((trees.left[node], low), (trees.right[node], ~low)):
                    zero, one = before * trees.cover[child] / trees.cover[node], held * goes.astype(float)
                    stack.append((child, {**others, f: (zero, one)}, _extended(w, zero, one)))
    return out


# ---- any scorer --------------------------------------------------------------------------------

def kmeans_background(df: DataFrame, k: int = 50, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """At most ``k`` weighted centres: (centres, shares)."""
    centres = kmeans_centres(df, k, seed).collect()
    return np.array([r["centre"] for r in centres]), np.array([r["weight"] for r in centres])


def kmeans_centres(df: DataFrame, k: int = 50, seed: int = 42) -> DataFrame:
    """``(cluster, centre, weight)``: the mean of a cluster's rows and its share of all, so the weighted mean of the centres is that of the rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.stat import Summarizer

    n = df.limit(k).count()
    model = KMeans(k=min(k, n), seed=seed, maxIter=20).fit(df)
    clusters = model.transform(df).groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.mean(F.col("features"))).alias("centre"))
    whole = F.sum("n").over(Window.partitionBy(F.lit(0)))  # one row per cluster
    return clusters.select("cluster", "centre", (F.col("n") / whole).alias("weight"))


def _masked_values(x: np.ndarray, masks: np.ndarray, predict: Callable, centres: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(rows, masks, outputs): mean prediction with the masked-out features taken from the centres."""
    rows = []
    for row in x:
        mixed = np.where(masks[:, None, :], row[None, None, :], centres[None, :, :])
        got = np.asarray(predict(mixed.reshape(-1, x.shape[1])))
        got = got.reshape(len(masks), len(centres), -1)
        rows.append(np.einsum("mbk,b->mk", got, weights))
    return np.stack(rows)


def _coalitions(p: int, samples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks and Shapley kernel weights: all of them where ``samples`` covers them, paired draws otherwise."""
    if p < 63 and 2**p - 2 <= samples:
        masks = np.array([[(m >> j) & 1 for j in range(p)] for m in range(1, 2**p - 1)], dtype=bool).reshape(-1, p)
        size = masks.sum(axis=1)
        return masks, np.array([(p - 1) / (math.comb(p, s) * s * (p - s)) for s in size])
    rng = np.random.default_rng(seed)
    sizes = np.arange(1, p)
    odds = (p - 1) / (sizes * (p - sizes))
    drawn = rng.choice(sizes, samples // 2, p=odds / odds.sum())
    masks = np.zeros((len(drawn), p), dtype=bool)
    for i, s in enumerate(drawn):
        masks[i, rng.choice(p, s, replace=False)] = True
    masks, counts = np.unique(np.vstack([masks, ~masks]), axis=0, return_counts=True)
    return masks, counts.astype(float)


def shap_kernel(
    df: DataFrame, predict: Callable[[np.ndarray], np.ndarray], centres: np.ndarray, weights: np.ndarray,
    features: list[str], samples: int = 2048, seed: int = 42, keep: list[str] = ("row_id", "label"),
) -> DataFrame:
    """Kernel SHAP (Lundberg & Lee 2017) for any batch scorer.

    ``samples`` is the number of coalitions; where it covers all 2^p - 2 of them, contributions are exact.

    All rows share the coalitions, so the weighted least squares is one small matrix worked out once.
    Rows are explained where they are: no explode, no shuffle.
    """
    p = len(features)
    masks, w = _coalitions(p, samples, seed)
    base = np.asarray(predict(centres)).reshape(len(centres), -1).T @ weights
    if p > 1:
        # phi sums to f(x) - base: eliminate the last feature
        z = masks[:, :-1].astype(float) - masks[:, -1:].astype(float)
        solve = np.linalg.solve((z * w[:, None]).T @ z, (z * w[:, None]).T)
    last = masks[:, -1].astype(float)

    def explain(x: np.ndarray) -> np.ndarray:
        full = np.asarray(predict(x)).reshape(len(x), -1) - base
        if p == 1:
            return full[:, :, None]
        v = _masked_values(x, masks, predict, centres, weights) - base
        phi = np.einsum("jm,nmk->nkj", solve, v - last[None, :, None] * full[:, None, :])
        return np.concatenate([phi, (full - phi.sum(axis=2))[:, :, None]], axis=2)

    return long_contributions(df, _array_udf(explain, features_array(df)), list(base), features, keep)


def shap_permutation(
    df: DataFrame, predict: Callable[[np.ndarray], np.ndarray], centres: np.ndarray, weights: np.ndarray,
    features: list[str], permutations: int = 10, seed: int = 42, keep: list[str] = ("row_id", "label"),
) -> DataFrame:
    """Average marginal gain along random feature orders, each walked forwards and backwards."""
    p = len(features)
    rng = np.random.default_rng(seed)
    orders = [o for _ in range(permutations) for o in (lambda a: (a, a[::-1]))(rng.permutation(p))]
    steps = np.zeros((len(orders), p + 1, p), dtype=bool)
    for i, o in enumerate(orders):
        for s in range(p):
            steps[i, s + 1:, o[s]] = True
    masks, back = np.unique(steps.reshape(-1, p), axis=0, return_inverse=True)
    back = back.reshape(len(orders), p + 1)
    base = np.asarray(predict(centres)).reshape(len(centres), -1).T @ weights

    def explain(x: np.ndarray) -> np.ndarray:
        v = _masked_values(x, masks, predict, centres, weights)
        phi = np.zeros((len(x), v.shape[2], p))
        for i, o in enumerate(orders):
            gains = np.diff(v[:, back[i], :], axis=1)
            phi[:, :, o] += gains.transpose(0, 2, 1)
        return phi / len(orders)

    return long_contributions(df, _array_udf(explain, features_array(df)), list(base), features, keep)
