"""Document rates that bring expected domain shares to target weights, where the domain of most documents is only guessed.

1. Documents with a row in the label table teach a softmax classifier (shapes of words, length, variety). It is fitted on
   at most ``sample`` labelled rows, those with the smallest hash of the id: a documented bound.
2. Every document gets domain posteriors p and its number of words t.
3. Rates r >= 0 minimise || sum r t p - T ||^2 by projected gradient steps from rate 1: r <- r - a p.g, cut to the bounds, where g is what
   the sums miss of T. A step is one aggregation over a narrow table; its size a follows from the last two steps (spectral steps), and
   one that raises the loss over the last few is taken again at the size that always lowers it. Steps end when they hardly move
   any rate, or the targets are met. The driver keeps one vector g a step, from which a task computes its rows' rates, so lost work is done again.
   With bounded rates and no total given, the loss is what the sums miss of the target shares at their own total; where shares cannot be met at
   any total (rates go to 0), rates are the nearest ones at the total the scarcest domain allows.

Defined results: NULL and empty texts have 0 words, posteriors as the classifier gives them, and a rate like any document's; without labelled rows posteriors are
equal; a document labelled more than once counts with its largest domain; labels without document or value are
ignored; repeated rows each get the same rate; an empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.session import cut_lineage

from .words import column_bytes, distinct, runs, words

SAMPLE = 5_000
#: Shares met, and loss and movement of rates at which steps end; steps whose losses a new one is held against; an end to steps that rounding stalls.
TOLERANCE, EXACT, MEMORY, STEPS = 1e-4, 1e-6, 8, 2_000
#: Labelled rows that must show a feature for it to count, and rows whose features are made at once.
LEAST_ROWS, BLOCK = 5, 2048

#: Classes of bytes: lower case and non-ASCII, upper case, digits, full stop, comma, other.
KIND = np.full(256, 5, np.int64)
KIND[[*range(97, 123), *range(128, 256)]] = 0
KIND[65:91] = 1
KIND[48:58] = 2
KIND[ord(".")], KIND[ord(",")] = 3, 4
SHAPES = 6 * 6 * 6 * 4
FEATURES = SHAPES + 3


class Classifier(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # features + 1 x domains


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, features) of runs of rows."""
    data, offsets = column_bytes(column)
    blocks = [(k, min(k + BLOCK, b)) for a, b in runs(offsets) for k in range(a, b, BLOCK)]
    for a, b in blocks:
        own = data[offsets[a] : offsets[b]]
        w, n = words(own, offsets[a : b + 1] - offsets[a]), b - a
        kind = KIND[own]
        shape = ((kind[w.start] * 6 + kind[np.minimum(w.start + 1, w.end - 1)]) * 6 + kind[w.end - 1]) * 4 + np.minimum((w.end - w.start) // 4, 3)
        count = np.bincount(w.row, minlength=n)
        tf = np.bincount(w.row * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES) / np.maximum(count, 1)[:, None]
        flat, cut = distinct(w.row, w.hash, n)
        variety = np.diff(cut) / np.maximum(count, 1)
        more = np.column_stack([np.log1p(count), variety, np.log1p(np.diff(offsets[a : b + 1]) / np.maximum(count, 1))])
        yield count, np.hstack([np.sqrt(tf), more])


def _labelled(labels: DataFrame, domain: Column, sample: int, id_col: str) -> DataFrame:
    usable = (
        labels.select(F.col(id_col).alias("_id"), domain.cast("int").alias("domain")).filter("_id is not null and domain is not null")
        .groupBy("_id").agg(F.max("domain").alias("domain")).withColumn("_order", F.xxhash64("_id"))
    )
    n = usable.count()
    if n > sample:
        # a threshold on the hash first: far fewer rows than n take part in the exact cut
        usable = usable.filter(F.col("_order") <= int((min(1.0, 1.1 * sample / n) * 2 - 1) * (2**63 - 1))).orderBy("_order").limit(sample)
    return usable.select("_id", "domain")


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_classifier(x: np.ndarray, y: np.ndarray, domains: int, steps: int = 200, rate: float = 0.05, ridge: float = 1e-3) -> Classifier:
    """Softmax regression by Adam on all rows at once."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    used = np.flatnonzero(np.append((x != 0).sum(axis=0) >= LEAST_ROWS, True))  # most shapes never occur; the constant always
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))]).astype(np.float32)[:, used]
    w = np.zeros((z.shape[1], domains), np.float32)
    goal = np.eye(domains, dtype=np.float32)[y]
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        g = z.T @ (softmax(z @ w) - goal) / len(z) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    weights = np.zeros((x.shape[1] + 1, domains))
    weights[used] = w
    return Classifier(mean, scale, weights)


def train(docs: DataFrame, labels: DataFrame, domain: Column, domains: int, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Classifier | None:
    """None without labelled documents."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for_rows = [f for _, f in features(b.column(0))]
            x = np.vstack(for_rows).astype(np.float32) if for_rows else np.zeros((0, FEATURES), np.float32)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([row.tobytes() for row in x], pa.binary())], names=["domain", "x"])

    known = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(_labelled(labels, domain, sample, id_col)), "_id")
    # ``sample`` rows of FEATURES numbers
    rows = known.select("_text", "domain").mapInArrow(each, "domain int, x binary").toArrow()
    if not rows.num_rows:
        return None
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, FEATURES)
    return fit_classifier(x, rows["domain"].to_numpy(), domains)


def _posterior(column: pa.Array, model: Classifier | None, domains: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and probabilities of every row of a column."""
    counts, found = [np.zeros(0, np.int64)], [np.zeros((0, domains))]
    for count, x in features(column):
        counts.append(count)
        if model is None:
            found.append(np.full((len(x), domains), 1 / domains))
        else:
            found.append(softmax(np.hstack([(x - model.mean) / model.scale, np.ones((len(x), 1))]) @ model.weights))
    return np.concatenate(counts), np.vstack(found)


def posteriors(docs: DataFrame, model: Classifier | None, domains: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, n_words, p) of every row; p is an array of ``domains`` probabilities."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, found = _posterior(b.column(1), model, domains)
            p = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * domains, pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count), p], names=["_id", "n_words", "p"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(each, f"_id {id_type}, n_words bigint, p array<double>")


class Rates(NamedTuple):
    """Rates after these updates: 1, less p times each update, never under 0 (nor over ``most``)."""

    updates: list[np.ndarray]
    most: float | None = None

    @property
    def start(self) -> float:
        return 1.0 if self.most is None else min(1.0, self.most)

    def column(self) -> Column:
        """For rows with ``p``."""
        if not self.updates:
            return F.lit(self.start)

        def step(rate: Column, update: Column) -> Column:
            less = sum((F.col("p")[k] * update[k] for k in range(len(self.updates[0]))), F.lit(0.0))
            now = F.greatest(F.lit(0.0), rate - less)
            return now if self.most is None else F.least(F.lit(self.most), now)

        return F.aggregate(F.array(*[F.array(*[F.lit(float(x)) for x in u]) for u in self.updates]), F.lit(self.start), step)

    def of(self, p: np.ndarray) -> np.ndarray:
        """For a table of probabilities."""
        rate = np.full(len(p), self.start)
        for u in self.updates:
            rate = np.clip(rate - p @ u, 0.0, self.most)
        return rate


def _moved(rows: DataFrame, rates: Rates, z: float, domains: int) -> tuple[np.ndarray, float]:
    """(shares, mean square of what the last update changed, by words) of rows with n_words and p."""
    before = Rates(rates.updates[:-1], rates.most)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, p = b.column(0).to_numpy(zero_copy_only=False).astype(float), b.column(1).flatten().to_numpy().reshape(-1, domains)
            old = before.of(p)
            new = np.clip(old - p @ rates.updates[-1], 0.0, rates.most) if rates.updates else old
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*((t * new) @ p), t @ (new - old) ** 2)], names=[f"e{i}" for i in range(domains + 1)])

    sums = rows.select("n_words", "p").mapInArrow(each, ", ".join(f"e{i} double" for i in range(domains + 1)))
    got = np.array(sums.agg(*[F.sum(f"e{i}") for i in range(domains + 1)]).first(), float) / z
    return got[:-1], float(got[-1])


def _descend(rows: DataFrame, goal: np.ndarray, own_total: bool, z: float, moments: np.ndarray, most: float | None) -> tuple[Rates, np.ndarray]:
    """(rates, shares) at the end of projected gradient steps towards ``goal``, or towards its shares of the rates' own total."""
    k = len(goal)
    # what is missed, as a linear map of the shares; for shares of the own total, goal * total takes the place of the goal
    pull = np.eye(k) - np.outer(goal, np.ones(k)) if own_total else np.eye(k)
    aim = np.zeros(k) if own_total else goal
    safe = 1 / max(float(np.linalg.eigvalsh(pull @ moments @ pull.T).max()), 1e-12)
    rates, size = Rates([], most), safe
    now, _ = _moved(rows, rates, z, k)
    missed = pull @ now - aim
    losses = [missed @ missed / 2]
    for _ in range(STEPS):
        if np.abs(missed).max() <= EXACT * (now.sum() if own_total else 1.0):
            break
        trial = Rates([*rates.updates, size * (pull.T @ missed)], most)
        shares, square = _moved(rows, trial, z, k)
        miss = pull @ shares - aim
        loss = miss @ miss / 2
        if size > safe and loss > max(losses[-MEMORY:]) - 1e-4 / size * square:
            size = safe
            continue
        change = miss - missed
        rates, now, missed = trial, shares, miss
        losses.append(loss)
        if np.sqrt(square) <= EXACT * safe:
            break
        size = float(np.clip(square / max(change @ change, 1e-300), safe, 1e6 * safe))
    return rates, now


def fit_rates(rows: DataFrame, weights: Sequence[float], total: float | None = None, most: float | None = None) -> tuple[Rates, np.ndarray, np.ndarray]:
    """(rates, expected shares, target shares) for rows with n_words and p; shares are parts of all words.

    ``total`` is the wanted number of words as a part of those there are (all by default; with ``most`` whatever total
    the steps end at), ``most`` an upper bound of the rates.
    """
    k = len(weights)
    p = [F.col("p")[i] for i in range(k)]
    first = rows.agg(
        F.sum("n_words").alias("z"),
        *[F.sum(F.col("n_words") * p[i] * p[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(k)],
    ).first()
    z = first["z"] or 0
    if not z:
        return Rates([], most), np.zeros(k), np.zeros(k)
    moments = np.array([[first[f"a{i}_{j}"] for j in range(k)] for i in range(k)]) / z
    shares = moments.sum(axis=1)
    goal = np.asarray(weights, float) / np.sum(weights)
    if total is None and most is not None:
        rates, now = _descend(rows, goal, True, z, moments, most)
        if now.sum() > 0 and np.abs(now - goal * now.sum()).max() <= TOLERANCE * now.sum():
            return rates, now, goal * now.sum()
        total = min(1.0, float(np.min(most * shares[goal > 0] / goal[goal > 0])))
    goal = goal * (1.0 if total is None else total)
    rates, now = _descend(rows, goal, False, z, moments, most)
    return rates, now, goal


def mix(
    docs: DataFrame, labels: DataFrame, domain: Column, weights: Sequence[float], sample: int = SAMPLE, most: float | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(_id, n_words, p, rate) of every row of ``docs``."""
    model = train(docs, labels, domain, len(weights), sample, id_col, text_col)
    rows = cut_lineage(posteriors(docs, model, len(weights), id_col, text_col))
    rates, _, _ = fit_rates(rows, weights, most=most)
    return rows.withColumn("rate", rates.column())


def uniform(id_col: str, seed: int = 7) -> Column:
    """A number from 0 to 1 by hash of the id."""
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 11) / F.lit(float(1 << 53))


def draw(rate: str = "rate", seed: int = 7, id_col: str = "_id") -> Column:
    """Whole number of copies: the rate rounded up or down by a hash of the id, right on average."""
    return F.floor(F.col(rate) + uniform(id_col, seed))


def thin(docs: DataFrame, model: Classifier | None, rates: Rates, domains: int, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are drawn at least once, with all their columns; nothing is shuffled."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = b.select(list(range(b.num_columns - 1)))
            rate = rates.of(_posterior(b.column(b.schema.get_field_index(text_col)), model, domains)[1])
            yield kept.filter(pa.array(np.floor(rate + b.column(b.num_columns - 1).to_numpy()) >= 1))

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns], uniform(id_col, seed).alias("_drawn_by")).mapInArrow(each, docs.schema)
