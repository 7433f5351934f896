"""Toxic passages as maximum-scoring segments of token log-odds.

1. Tokens (runs of letters, A-Z lower-cased) of labelled documents and their first PREFIXES bytes are counted by class in
   BINS hashed bins.
2. A token's log-odds come from nested Dirichlet priors (two classes: Beta): the share of toxic text at each level has the level
   above as its prior mean, with PRIOR pseudo-tokens: all text, prefixes from short to long, the word. So an unseen inflection
   inherits from its stem. Tokens below MIN_SCORE count as no more than DRIFT: clean text scores negative on average.
3. Per document, a linear-time scan (all maximal scoring segments, Ruzzo and Tompa) finds every passage.
4. Karlin-Altschul statistics: lambda solves sum p(s) exp(lambda s) = 1 over the scores s in clean text; a Gumbel fit to the
   best segments of clean documents gives K. A passage is significant if its expected number in clean text of that length is
   below MAX_EXPECTED.
5. The document's evidence is the best and the summed strength of its significant passages; a logistic curve fitted on
   labelled documents that were not counted turns them into a probability.

The model is fitted on at most ``sample`` labelled rows, those with the smallest hash of the id: a documented bound.
Scoring covers every document and its whole text. Only the model travels to the tasks: two float32 numbers a bin, 16 MB.

Defined results: NULL and empty texts have no passage and get the probability of that; without labelled rows of both classes every score is nearly 0;
a document labelled more than once is toxic if any label says so; labels without document or value are ignored;
repeated rows are scored alike; a NULL id counts as the empty string for the hold-out. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import LOWER, NOT_LETTERS, column_bytes, runs, words

BINS = 1 << 21
SAMPLE = 50_000
#: Tokens a task counts before it hands its counts on: they are 32-bit numbers.
MOST_COUNTED = (1 << 32) - 1
PREFIXES = (4, 6, 8)
PRIOR = 4.0
MIN_SCORE, DRIFT = 1.0, -0.05
MAX_EXPECTED = 0.05
#: Edges of the histogram of token scores.
EDGES = np.linspace(-8, 8, 65)


#: Curves used where there is nothing to learn from, or only one class to calibrate on.
NEVER, UNCALIBRATED = np.array([-30.0, 0, 0]), np.array([-3.0, 1.0, 1.0])


class Model(NamedTuple):
    counts: np.ndarray  # clean and toxic tokens by bin
    share: float  # of toxic tokens
    rate: float  # lambda
    size: float  # K
    weights: np.ndarray  # logistic curve: constant, best, sum


def held_out(id_col: str):
    """crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
    """(first row, last row, row, bins by level) of the tokens, in blocks of bounded size; the word is the last level."""
    data, offsets = column_bytes(column)
    for a, b in runs(offsets):
        w = words(LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], NOT_LETTERS, PREFIXES)
        yield a, b, w.row, [(h & np.uint64(BINS - 1)).astype(np.int64) for h in (*w.prefix, w.hash)]


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, toxic, counted): a bounded sample of the labelled rows that may be learnt from."""
    usable = (
        labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("_id is not null and toxic is not null")
        .filter(~held_out("_id"))
        .groupBy("_id").agg(F.max("toxic").alias("toxic"))
        .withColumn("_order", F.xxhash64("_id"))
    )
    n = usable.count()
    if n > sample:
        # a threshold on the hash first: far fewer rows than n take part in the exact cut
        most = int((min(1.0, 1.1 * sample / n) * 2 - 1) * (2**63 - 1))
        usable = usable.filter(F.col("_order") <= most).orderBy("_order").limit(sample)
    small = F.broadcast(usable)  # ``sample`` rows at most
    counted = (F.col("_order") % 5) != 0
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(small, "_id").select("text", "toxic", counted.alias("counted"))


def token_counts(rows: DataFrame) -> DataFrame:
    """(bin, clean, toxic): tokens by class; tasks add up their own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one small table a task, counted in place: several workers of an executor hold one at a time
        total, held = np.zeros(2 * BINS, np.uint32), 0

        def out() -> pa.RecordBatch:
            clean, toxic = total[:BINS], total[BINS:]
            seen = np.flatnonzero((clean > 0) | (toxic > 0))
            return pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(clean[seen].astype(float)), pa.array(toxic[seen].astype(float))], names=["bin", "clean", "toxic"])

        for b in batches:
            toxic = np.asarray(b.column(1)) > 0
            for first, _, row, levels in _tokens(b.column(0)):
                if held + len(row) * len(levels) > MOST_COUNTED:
                    yield out()
                    total[:], held = 0, 0
                held += len(row) * len(levels)
                offset = toxic[row + first].astype(np.int64) * BINS
                for at in levels:
                    np.add.at(total, offset + at, np.uint32(1))
        yield out()

    return (
        rows.filter("counted").select("text", "toxic")
        .mapInArrow(count, "bin int, clean double, toxic double")
        .groupBy("bin").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )


def token_scores(levels: list[np.ndarray], counts: np.ndarray, share: float) -> np.ndarray:
    """Log-odds of tokens given by their bins at each level; ``share`` is the prior mean of the first level."""
    mean = np.float32(share)
    for at in levels:
        clean, toxic = counts[0, at], counts[1, at]
        mean = (toxic + PRIOR * mean) / (clean + toxic + PRIOR)
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    out = np.log(mean / (1 - mean)) - np.log(share / (1 - share))
    return np.where(out >= MIN_SCORE, out, np.minimum(out, DRIFT))


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score) in linear time.

    Neighbours of one sign are merged first; the list then keeps candidate segments with the running sums before and after them.
    """
    positive = score > 0
    if not positive.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], positive.view(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    run = np.concatenate([[0.0], np.cumsum(score)])
    kept: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    link: list[int] = []  # the nearest earlier candidate with a smaller sum before it
    for s, e, left, right in zip(starts.tolist(), ends.tolist(), run[starts].tolist(), run[ends].tolist(), strict=True):
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j = link[j]
            if j < 0 or kept[j][3] >= right:
                kept.append((s, e, left, right))
                link.append(j)
                break
            s, left = kept[j][0], kept[j][2]
            del kept[j:], link[j:]
    return [(s, e, right - left) for s, e, left, right in kept]


def expected_one(p: np.ndarray, s: np.ndarray) -> float:
    """The positive lambda with sum p exp(lambda s) = 1."""
    if not (s > 0).any() or (p * s).sum() >= 0:
        return 1.0
    hi = 1e-3
    while (p * np.exp(np.minimum(hi * s, 500))).sum() < 1 and hi < 1e3:
        hi *= 2
    lo = 0.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * s, 500))).sum() < 1 else (lo, mid)
    return hi


def passages_of(column: pa.Array, counts: np.ndarray, share: float) -> Iterator[tuple[np.ndarray, list[tuple[int, int, float]]]]:
    """(token scores, maximal segments) of each row in turn."""
    for first, last, row, levels in _tokens(column):
        cut = np.searchsorted(row, np.arange(last - first + 1))
        value = token_scores(levels, counts, share)
        positive = np.zeros(last - first, bool)
        positive[row[value > 0]] = True
        for a, b, any_positive in zip(cut[:-1].tolist(), cut[1:].tolist(), positive.tolist(), strict=True):
            yield value[a:b], segments(value[a:b]) if any_positive else []


def evidence(found: list[tuple[int, int, float]], n: int, rate: float, size: float) -> list[tuple[int, int, float]]:
    """The significant ones of a document's segments; strength is -log of the number expected in clean text of ``n`` tokens."""
    strong = [(s, e, rate * x - np.log(size * max(n, 1))) for s, e, x in found]
    return [x for x in strong if x[2] > -np.log(MAX_EXPECTED)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Coefficients by Newton's method; the constant comes first."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _features(found: list[list[tuple[int, int, float]]]) -> np.ndarray:
    best = np.array([max((x[2] for x in f), default=0.0) for f in found])
    total = np.array([sum(x[2] for x in f) for f in found])
    return np.log1p(np.column_stack([best, total])) if len(found) else np.zeros((0, 2))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows = labelled(docs, labels, sample, id_col, text_col)
    seen = token_counts(rows).toArrow()  # BINS rows at most
    counts = np.zeros((2, BINS), np.float32)
    counts[:, seen["bin"].to_numpy()] = [seen["clean"].to_numpy(), seen["toxic"].to_numpy()]
    del seen
    if not counts[0].any() or not counts[1].any():
        return Model(counts, 0.5, 1.0, 1.0, NEVER)
    share = float(counts[1].sum(dtype=float) / counts.sum(dtype=float))
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, spread, best = [], [], []
            for value, found in passages_of(b.column(0), shared.value, share):
                n.append(len(value))
                spread.append(np.histogram(value, EDGES)[0].tolist())
                best.append([x[2] for x in found])
            yield pa.RecordBatch.from_arrays(
                [b.column(1), pa.array(n, pa.int64()), pa.array(spread, pa.list_(pa.int64())), pa.array(best, pa.list_(pa.float64()))], names=["toxic", "n", "spread", "raw"]
            )

    # the rows not counted calibrate: ``sample`` / 5 rows of numbers
    own = rows.filter("not counted").select("text", "toxic")
    seen = own.mapInArrow(raw, "toxic int, n bigint, spread array<bigint>, raw array<double>").toPandas()
    shared.unpersist()
    quiet = seen[(seen["toxic"] == 0) & (seen["n"] > 0)]
    if not len(quiet) or len(quiet) == len(seen):
        return Model(counts, share, 1.0, 1.0, UNCALIBRATED)
    spread = np.sum(np.stack(quiet["spread"].to_numpy()), axis=0)
    rate = expected_one(spread / spread.sum(), (EDGES[:-1] + EDGES[1:]) / 2)
    # Gumbel: P(top < x) = exp(-K n exp(-lambda x)); the likelihood is largest where the mean of n exp(-lambda x) is 1 / K
    tops = np.array([max(x, default=0.0) for x in quiet["raw"]])
    size = float(1 / np.mean(quiet["n"].to_numpy() * np.exp(-rate * tops)))
    found = [evidence([(0, 0, x) for x in raw], n, rate, size) for raw, n in zip(seen["raw"], seen["n"], strict=True)]
    weights = logistic(_features(found), (seen["toxic"] > 0).to_numpy(float))
    return Model(counts, share, rate, size, weights)


def _scorer(spark: SparkSession, model: Model) -> Callable[[pa.Array], tuple[np.ndarray, list]]:
    """For the tasks: probabilities and significant passages of a column of texts."""
    counts, share, rate, size, w = model
    shared = spark.sparkContext.broadcast(counts)

    def of(column: pa.Array) -> tuple[np.ndarray, list]:
        strong = [evidence(found, len(value), rate, size) for value, found in passages_of(column, shared.value, share)]
        return 1 / (1 + np.exp(-np.clip(w[0] + _features(strong) @ w[1:], -30, 30))), strong

    return of


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, score, passages) of every row; passages are token ranges start:end, comma-joined."""
    scorer = _scorer(docs.sparkSession, model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, strong = scorer(b.column(1))
            passages = pa.array([",".join(f"{s}:{e}" for s, e, _ in f) for f in strong], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), passages], names=["_id", "score", "passages"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(each, f"_id {id_type}, score double, passages string")


def clean(docs: DataFrame, model: Model, text_col: str = "text", below: float = 0.5) -> DataFrame:
    """The rows of ``docs`` scored under ``below``, with all their columns; nothing is shuffled."""
    scorer = _scorer(docs.sparkSession, model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scorer(b.column(b.schema.get_field_index(text_col)))[0] < below))

    return docs.mapInArrow(each, docs.schema)
