"""Second moments in one pass: the input of every learner with a closed form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import features_array

EXPRESSION_COLS = 12


def sufficient_stats(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """``(keys, i, j, value)`` with value = sum of x_i x_j for i <= j; column 0 is the constant 1.

    So (0, 0) is n and (0, j) the sum of column j. Few columns stay in plain aggregates. For many, a
    task keeps one matrix per key and passes on its cells, so the shuffle does not grow with the rows.
    """
    keys = list(keys)
    n = len(cols) + 1
    if n <= EXPRESSION_COLS:
        x = [F.lit(1.0)] + [F.col(f"`{c}`").cast("double") for c in cols]
        pairs = [(i, j) for i in range(n) for j in range(i, n)]
        sums = df.groupBy(*keys).agg(*[F.sum(x[i] * x[j]).alias(f"_{i}_{j}") for i, j in pairs])
        cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"_{i}_{j}").alias("value")) for i, j in pairs])
        return sums.select(*keys, F.inline(cells))
    packed = df.select(*keys, F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias("_x"))
    return gram_cells(packed, keys, "_x", len(cols))


def gram_cells(df: DataFrame, keys: list[str], vec: str, width: int) -> DataFrame:
    """As ``sufficient_stats`` for one array column of ``width`` numbers."""
    keys = list(keys)
    upper = np.triu_indices(width + 1)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            groups = pdf.groupby(keys, sort=False, dropna=False) if keys else [((), pdf)]
            for key, rows in groups:
                key = key if isinstance(key, tuple) else (key,)
                x = np.column_stack([np.ones(len(rows)), np.stack(rows[vec].to_numpy())])
                g = x.T @ x
                grams[key] = grams[key] + g if key in grams else g
        for key, g in grams.items():
            yield pd.DataFrame({**dict(zip(keys, key)), "i": upper[0].astype("int32"), "j": upper[1].astype("int32"), "value": g[upper]})

    types = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] + ["i int, j int, value double"])
    parts = df.select(*keys, vec).mapInPandas(partial, types)
    return parts.groupBy(*keys, "i", "j").agg(F.sum("value").alias("value"))


def collect_gram(cells: DataFrame, width: int) -> np.ndarray:
    """The (width + 1)^2 matrix on the driver: its size follows the features, not the rows."""
    g = np.zeros((width + 1, width + 1))
    for r in cells.select("i", "j", "value").toPandas().itertuples(index=False):
        g[r.i, r.j] = g[r.j, r.i] = r.value
    return g


def feature_moments(df: DataFrame, key: str | None = None) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """n, mean and population variance of the feature vector per value of ``key`` (0 without one)."""
    s = Summarizer.metrics("count", "mean", "variance").summary(F.col("features")).alias("s")
    grouped = df.groupBy(F.col(key).cast("int").alias("k")).agg(s) if key else df.agg(s).withColumn("k", F.lit(0))
    out = {}
    # one row per class
    for r in grouped.select("k", "s.*").collect():
        n = r["count"]
        out[r["k"]] = (n, r["mean"].toArray(), r["variance"].toArray() * ((n - 1) / n))
    return out


def feature_gram(df: DataFrame, extra: list[str] = (), key: str | None = None, shift: np.ndarray | None = None):
    """Gram matrix of [1, features - shift, extra columns]; a dict per value of ``key`` if given."""
    x = features_array(df)
    if shift is not None:
        x = F.zip_with(x, F.array(*[F.lit(float(v)) for v in shift]), lambda a, m: a - m)
    packed = F.concat(x, F.array(*[F.col(c).cast("double") for c in extra])) if extra else x
    slim = df.select(*([key] if key else []), packed.alias("_x"))
    width = len(shift) + len(extra) if shift is not None else len(slim.select("_x").first()["_x"])
    if key is None:
        return collect_gram(gram_cells(slim, [], "_x", width), width)
    out: dict[int, np.ndarray] = {}
    for r in gram_cells(slim, [key], "_x", width).toPandas().itertuples(index=False):
        g = out.setdefault(int(r[0]), np.zeros((width + 1, width + 1)))
        g[r.i, r.j] = g[r.j, r.i] = r.value
    return out
