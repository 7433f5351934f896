"""Local linear explanations (Ribeiro 2016) of many rows at once.

The perturbed samples are drawn from the training bins and do not depend on the row, so one bounded
sample is scored once, by any model. What differs per row is which samples share its bins; that gives
weights and a small ridge fit, worked out in the tasks that hold the rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..learners.base import features_array, score
from ..operators.ordering import exact_quantiles

SAMPLES = 5000


@dataclass
class Bins:
    """Quartile edges per feature and, per bin, share, mean, std, min and max of the training values."""

    names: list[str]
    edges: list[np.ndarray]
    stats: list[dict[int, tuple[float, float, float, float, float]]]

    def number(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(self.edges)], axis=1)

    def text(self, j: int, b: int) -> str:
        e, n = self.edges[j], self.names[j]
        if b == 0:
            return f"{n} <= {e[0]:.2f}"
        if b == len(e):
            return f"{n} > {e[-1]:.2f}"
        return f"{e[b - 1]:.2f} < {n} <= {e[b]:.2f}"


def quartile_bins(train: DataFrame, names: list[str]) -> Bins:
    """Bins from exact quartiles; the statistics are one row per feature and bin."""
    x = features_array(train)
    wide = train.select(*[x[j].alias(f"f{j}") for j in range(len(names))])
    q = exact_quantiles(wide, wide.columns, [0.25, 0.5, 0.75]).collect()
    edges = [np.unique([r["value"] for r in q if r["feature"] == f"f{j}"]) for j in range(len(names))]
    cells = []
    for j, e in enumerate(edges):
        v = F.col(f"f{j}")
        number = sum(((v > F.lit(float(t))).cast("int") for t in e), F.lit(0))
        cells.append(F.struct(F.lit(j).alias("j"), number.alias("b"), v.alias("v")))
    got = wide.select(F.inline(F.array(*cells))).groupBy("j", "b").agg(
        F.count("v").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi")
    ).collect()
    stats: list[dict] = [{} for _ in names]
    for r in got:
        stats[r["j"]][r["b"]] = (r["n"], r["m"], r["s"], r["lo"], r["hi"])
    return Bins(list(names), edges, stats)


def draw_samples(bins: Bins, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin numbers, values): bins by their training share, values from the normal cut to the bin."""
    rng, norm = np.random.default_rng(seed), NormalDist()
    number = np.zeros((n, len(bins.names)), dtype=int)
    value = np.zeros((n, len(bins.names)))
    for j, stats in enumerate(bins.stats):
        keys = sorted(stats)
        share = np.array([stats[b][0] for b in keys], dtype=float)
        number[:, j] = rng.choice(keys, n, p=share / share.sum())
        u = rng.random(n)
        for b in keys:
            _, m, s, lo, hi = stats[b]
            at = number[:, j] == b
            if not s:
                value[at, j] = m
                continue
            a, z = norm.cdf((lo - m) / s), norm.cdf((hi - m) / s)
            value[at, j] = np.clip([m + s * norm.inv_cdf(min(max(a + (z - a) * v, 1e-12), 1 - 1e-12)) for v in u[at]], lo, hi)
    return number, value


def _ridge(g: np.ndarray, b: np.ndarray, cols: list[int], alpha: float) -> np.ndarray:
    return np.linalg.solve(g[np.ix_(cols, cols)] + alpha * np.eye(len(cols)), b[cols])


def _choose(g: np.ndarray, b: np.ndarray, k: int) -> list[int]:
    """Up to six features are added greedily by fit, more are taken by weight."""
    p = len(b)
    if k >= p:
        return list(range(p))
    if k > 6:
        w = _ridge(g, b, list(range(p)), 0.01)
        return sorted(np.argsort(-np.abs(w), kind="stable")[:k])
    used: list[int] = []
    for _ in range(k):
        def explained(cols: list[int]) -> float:
            w = _ridge(g, b, cols, 1e-9)
            return 2 * w @ b[cols] - w @ g[np.ix_(cols, cols)] @ w

        used.append(max((j for j in range(p) if j not in used), key=lambda j: (explained([*used, j]), -j)))
    return used


def lime(
    df: DataFrame, train: DataFrame, model, names: list[str], top: int = 5, output: str = "probability", cls: int = 1,
    samples: int = SAMPLES, seed: int = 42, keep: list[str] = ("row_id",),
) -> DataFrame:
    """``(keep, feature, condition, weight, intercept)``: the ``top`` local weights of every row.

    ``output`` is ``probability`` (of ``cls``) or ``prediction``.
    """
    spark = df.sparkSession
    bins = quartile_bins(train, names)
    number, value = draw_samples(bins, samples, seed)
    # a bounded sample: scored by the model as any other table
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(value)]
    sample = spark.createDataFrame(rows, "row_id long, features array<double>")
    out = score(model, sample.withColumn("features", array_to_vector("features")))
    target = F.col("probability")[cls] if output == "probability" else F.col("prediction")
    scored = sorted((r["row_id"], r["y"]) for r in out.select("row_id", target.alias("y")).collect())
    got = np.array([y for _, y in scored])
    width2 = 0.75**2 * len(names)
    shared = spark.sparkContext.broadcast((bins, number.astype("int8"), got))

    @F.pandas_udf("array<struct<j int, b int, weight double, intercept double>>")
    def explain(v: pd.Series) -> pd.Series:
        bins_, number_, y = shared.value
        own = bins_.number(np.stack(v.to_numpy()))
        # rows in the same bins have the same explanation
        same, back = np.unique(own, axis=0, return_inverse=True)
        found = []
        for row in same:
            z = (number_ == row).astype(float)
            w = np.exp(-(len(row) - z.sum(axis=1)) / width2 / 2)
            zc, yc = z - np.average(z, axis=0, weights=w), y - np.average(y, weights=w)
            g, b = (zc * w[:, None]).T @ zc, (zc * w[:, None]).T @ yc
            cols = _choose(g, b, top)
            coef = _ridge(g, b, cols, 1.0)
            icept = np.average(y, weights=w) - coef @ np.average(z[:, cols], axis=0, weights=w)
            order = np.argsort(-np.abs(coef), kind="stable")
            found.append([{"j": int(cols[i]), "b": int(row[cols[i]]), "weight": float(coef[i]), "intercept": float(icept)} for i in order])
        return pd.Series([found[i] for i in np.ravel(back)])

    texts = F.array(*[F.array(*[F.lit(bins.text(j, b)) for b in range(len(bins.edges[j]) + 1)]) for j in range(len(names))])
    return df.select(*keep, F.inline(explain(features_array(df)))).select(
        *keep, F.array(*[F.lit(n) for n in names])[F.col("j")].alias("feature"), texts[F.col("j")][F.col("b")].alias("condition"), "weight", "intercept"
    )
