"""Bootstrap intervals without copying the rows once per replicate.

Label metrics depend on the confusion cells only, so a replicate is one multinomial draw over K x K
cells. Error metrics need five weighted sums per replicate, a matrix product per batch. The AUC needs Poisson
counts per distinct score and running totals per score range.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread
from .hashing import md5_words, poisson_steps
from .metrics import LABEL_METRICS, confusion, label_metrics, regression_scores, summarize_with_ci, to_long


#: Numbers below which a 32-bit draw stands for weights 0, 1, 2, ...
_STEPS = np.array([int(bound, 16) for bound, _ in poisson_steps()], np.int64)
#: The weight of the smallest draw with these upper 16 bits, and whether a step lies among the others.
_UPPER = np.arange(1 << 16, dtype=np.int64) << 16
_WEIGHT = np.searchsorted(_STEPS, _UPPER, "right").astype(np.float32)
_SPLIT = _WEIGHT != np.searchsorted(_STEPS, _UPPER + 0xFFFF, "right")
#: Rows weighed at once: their weights are a matrix of rows and replicates.
_CHUNK = 256


def _weights(draws: np.ndarray) -> np.ndarray:
    """Poisson(1) weights of 32-bit draws: by their upper half, and by all bits where that leaves two."""
    upper = draws >> np.uint32(16)
    out = _WEIGHT[upper]
    close = np.nonzero(_SPLIT[upper])
    out[close] = np.searchsorted(_STEPS, draws[close].astype(np.int64), "right")
    return out


def poisson_matrix(ids: list[str | None], seed, replicates: int) -> np.ndarray:
    """Poisson(1) weights, rows x replicates: a digest of seed, block and id holds the draws of four replicates."""
    blocks = [f"{seed}|{b}".encode() for b in range((replicates + 3) // 4)]
    own = [b"" if i is None else b"|" + i.encode() for i in ids]
    return _weights(md5_words(own, blocks).reshape(len(ids), -1)[:, :replicates]).astype(float)


def _weighted_sums(df: DataFrame, replicates: int, seed, id_col: str, keys: list[str], values: dict) -> DataFrame:
    """Per (replicate, keys): sums of weight * value for hash-drawn Poisson(1) weights.

    A batch is one product of its weights and its values; a task keeps a matrix of replicates and values per key and passes that on,
    so no row is copied. Rows (an id and their values) are spread first: a row costs ``replicates`` draws. NULL values add nothing.
    """
    names = list(values)
    cols = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"_v_{n}") for n, c in values.items()]
    rows = df.select(*keys, F.col(id_col).cast("string").alias("_id"), *cols)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            groups = pdf.groupby(keys, sort=False, dropna=False) if keys else [((), pdf)]
            for key, own in groups:
                key = key if isinstance(key, tuple) else (key,)
                held = sums.setdefault(key, np.zeros((replicates, len(names))))
                ids, v = own["_id"].tolist(), own[[f"_v_{n}" for n in names]].to_numpy()
                for at in range(0, len(ids), _CHUNK):
                    held += poisson_matrix(ids[at : at + _CHUNK], seed, replicates).T @ v[at : at + _CHUNK]
        for key, held in sums.items():
            yield pd.DataFrame({**dict(zip(keys, key)), "replicate": np.arange(replicates), **{n: held[:, j] for j, n in enumerate(names)}})

    types = [f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] + ["replicate int", *[f"{n} double" for n in names]]
    return spread(rows, "_id").mapInPandas(partial, ", ".join(types)).groupBy(*keys, "replicate").agg(*[F.sum(n).alias(n) for n in names])


def bootstrap_regression(df: DataFrame, replicates: int = 1000, seed=42, p: int = 2, id_col: str = "row_id") -> DataFrame:
    """Mean, population std and percentiles of the six regression metrics over resamples.

    Sums of squares are taken around a fixed centre near the label mean, which leaves R2 unchanged
    and keeps the digits.
    """
    centre = df.agg(F.avg("label")).scalar()
    y = F.col("label") - centre
    e = F.col("label") - F.col("prediction")
    sums = _weighted_sums(df, replicates, seed, id_col, [], {
        "n": F.lit(1.0), "ae": F.abs(e), "rss": e * e, "y": y, "yy": y * y,
    })
    scored = regression_scores(
        sums.withColumn("tss", F.col("yy") - F.col("y") * F.col("y") / F.col("n")), ["replicate"], p
    )
    long = to_long(scored, ["replicate"], ["mae", "mse", "rmse", "r2", "aic", "bic"])
    return summarize_with_ci(long, ["metric"], population=True)


def bootstrap_confusion_rows(df: DataFrame, replicates: int, seed=42, id_col: str = "row_id") -> DataFrame:
    """Confusion cells per replicate from row weights (repeatable by any engine with md5)."""
    return _weighted_sums(df, replicates, seed, id_col, ["label", "prediction"], {"n": F.lit(1.0)})


def bootstrap_confusion_cells(df: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """Confusion cells per replicate by resampling the cells; the cost does not depend on n."""
    spark = df.sparkSession
    cells = confusion(df).agg(F.sort_array(F.collect_list(F.struct("label", "prediction", "n"))).alias("cells"))
    labels = df.schema["label"].dataType.simpleString()
    preds = df.schema["prediction"].dataType.simpleString()

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r, cell in zip(pdf["replicate"], pdf["cells"]):
                n = np.array([c["n"] for c in cell], dtype="int64")
                got = np.random.default_rng([seed, int(r)]).multinomial(n.sum(), n / n.sum())
                yield pd.DataFrame({
                    "replicate": r,
                    "label": [c["label"] for c in cell],
                    "prediction": [c["prediction"] for c in cell],
                    "n": got.astype("float64"),
                })

    reps = spark.range(replicates).select(F.col("id").alias("replicate")).withColumn("cells", cells.scalar())
    out = f"replicate long, label {labels}, prediction {preds}, n double"
    return reps.mapInPandas(draw, out).filter(F.col("n") > 0)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit hash of 64-bit numbers."""
    return _mix(x.copy(), np.empty_like(x))


def _mix(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """``_mixed`` in place: blocks of draws stay in the cache."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        np.right_shift(x, np.uint64(shift), out=spare)
        x ^= spare
        x *= np.uint64(factor)
    np.right_shift(x, np.uint64(31), out=spare)
    x ^= spare
    return x


#: P(weight <= k) for Poisson(1), as far as a double tells steps apart.
_LADDER = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(18)])
#: The count of draws with these upper 16 bits; _CLOSE where a step lies among them.
_CLOSE = 255
_COUNT = np.searchsorted(_LADDER, np.arange(1 << 16) / float(1 << 16), "right")
_COUNT[_COUNT != np.searchsorted(_LADDER, ((np.arange(1, (1 << 16) + 1) << 37) - 1) / float(1 << 53), "right")] = _CLOSE
_COUNT = _COUNT.astype(np.uint8)
#: Draws made at once.
_DRAWS = 1 << 15


def _counts_of_one(keys: np.ndarray, replicates: int) -> np.ndarray:
    """Poisson(1) per key and replicate: by the upper 16 bits of the draw, and by all of them where those leave two counts."""
    out, own = np.empty((len(keys), replicates), np.uint8), _mixed(np.arange(1, replicates + 1, dtype=np.uint64))
    step = max(1, _DRAWS // replicates)
    draws, spare = np.empty((step, replicates), np.uint64), np.empty((step, replicates), np.uint64)
    for at in range(0, len(keys), step):
        part = keys[at : at + step]
        u, upper = draws[: len(part)], spare[: len(part)]
        np.bitwise_xor(part[:, None], own, out=u)
        _mix(u, upper)
        np.right_shift(u, np.uint64(48), out=upper)
        got, u = out[at : at + step].reshape(-1), u.reshape(-1)
        np.take(_COUNT, upper.reshape(-1).view(np.int64), out=got, mode="clip")
        close = np.flatnonzero(got == _CLOSE)
        got[close] = np.searchsorted(_LADDER, (u[close] >> np.uint64(11)) / float(1 << 53), "right")
    return out


def _poisson_counts(keys: np.ndarray, counts: np.ndarray, replicates: int) -> np.ndarray:
    """Poisson(count) per row and replicate, from a hash of the row's key and the replicate alone."""
    one = counts == 1
    if one.all():
        return _counts_of_one(keys, replicates)
    out = np.zeros((len(counts), replicates))
    out[one] = _counts_of_one(keys[one], replicates)
    for i in np.flatnonzero(counts > 1):
        out[i] = np.random.default_rng(int(keys[i])).poisson(counts[i], replicates)
    return out


def _add_in_order(state: list, pos: np.ndarray, neg: np.ndarray, pos_at: np.ndarray, neg_at: np.ndarray) -> None:
    """Adds draws of the rows ``pos_at`` and ``neg_at`` to the running totals: positives, negatives, and pairs that the positive wins.

    A replicate's totals are short arrays, so going row by row keeps them in the cache. A negative in the same row counts half.
    """
    _, p, n, wins = state
    i = j = 0
    spare, ends = np.empty_like(n), [*neg_at.tolist(), -1]
    for row in pos_at.tolist():
        while j < len(neg) and ends[j] < row:
            n += neg[j]
            j += 1
        if ends[j] == row:
            np.divide(neg[j], 2, out=spare)
            spare += n
            spare *= pos[i]
        else:
            np.multiply(n, pos[i], out=spare)
        wins += spare
        i += 1
    for rest in neg[j:]:
        n += rest
    p += pos.sum(axis=0, dtype=np.float64)


def bootstrap_auc(df: DataFrame, replicates: int = 1000, seed: int = 42, classes: list[int] = (1,), probability: str = "probability") -> DataFrame:
    """AUC per replicate; several classes give the one-vs-rest average weighted by positives.

    Distinct scores are range partitioned and streamed in order. A task keeps one running total per
    replicate and emits one row per replicate and class, so nothing grows with the rows it has seen.
    """
    chunk = 256

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part: dict[int, list] = {}
        for pdf in batches:
            for cls, rows in pdf.groupby("cls", sort=True):
                state = part.setdefault(int(cls), [rows["score"].iloc[0], *np.zeros((3, replicates))])
                for at in range(0, len(rows), chunk):
                    block = rows.iloc[at:at + chunk]
                    # draws belong to the score, whatever block or task it comes in
                    key = _mixed(block["score"].to_numpy(np.float64).view(np.uint64) ^ np.uint64((seed * 1000003 + int(cls)) % 2**64))
                    n_pos, n_neg = block["pos"].to_numpy(), block["neg"].to_numpy()
                    pos_at, neg_at = np.flatnonzero(n_pos > 0), np.flatnonzero(n_neg > 0)
                    pos = _poisson_counts(key[pos_at], n_pos[pos_at], replicates)
                    neg = _poisson_counts(_mixed(key[neg_at] + np.uint64(1)), n_neg[neg_at], replicates)
                    _add_in_order(state, pos, neg, pos_at, neg_at)
        for cls, (first, p, n, a) in part.items():
            yield pd.DataFrame({"cls": cls, "first_score": first, "replicate": np.arange(replicates), "p": p, "n": n, "a": a})

    wanted = F.array(*[F.struct(F.lit(int(c)).alias("cls"), F.element_at(probability, int(c) + 1).cast("double").alias("score")) for c in classes])
    hit = (F.col("label") == F.col("cls")).cast("long")
    counts = df.select("label", F.inline(wanted)).groupBy("cls", "score").agg(
        F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg")
    )
    sums = counts.repartitionByRange("cls", "score").sortWithinPartitions("cls", "score").mapInPandas(
        partials, "cls int, first_score double, replicate long, p double, n double, a double"
    )
    before = Window.partitionBy("cls", "replicate").orderBy("first_score").rowsBetween(Window.unboundedPreceding, -1)
    joined = sums.withColumn("n_before", F.coalesce(F.sum("n").over(before), F.lit(0.0)))
    pairs = F.sum("p") * F.sum("n")
    per_class = joined.groupBy("replicate", "cls").agg(
        F.when(pairs > 0, F.sum(F.col("a") + F.col("p") * F.col("n_before")) / pairs).alias("auc"),
        F.sum("p").alias("p"),
    )
    return per_class.groupBy("replicate").agg((F.sum(F.col("auc") * F.col("p")) / F.sum("p")).alias("auc"))


def bootstrap_classification(df: DataFrame, replicates: int = 1000, seed: int = 42, probability: str | None = "probability", n_classes: int = 2) -> DataFrame:
    """Mean, population std and percentiles x 100 of the label metrics and the AUC."""
    wide = label_metrics(bootstrap_confusion_cells(df, replicates, seed), ["replicate"])
    long = to_long(wide, ["replicate"], LABEL_METRICS)
    if probability is not None:
        classes = [1] if n_classes == 2 else list(range(n_classes))
        auc = bootstrap_auc(df, replicates, seed, classes, probability)
        long = long.unionByName(to_long(auc, ["replicate"], ["auc"]))
    return summarize_with_ci(
        long.withColumn("value", F.col("value") * 100), ["metric"], population=True, skip_null=True
    )
