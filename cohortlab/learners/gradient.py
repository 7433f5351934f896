"""Learners fitted by stochastic gradient steps, data-parallel with parameter averaging.

Each round is one job over shards: every shard runs its rows, in the order of their ids, through small batches from the current
parameters and passes on its parameters and row count; the row-weighted mean starts the next round (Zinkevich et
al. 2010). Shards are made of ids by hash, not of partitions, so a fit does not depend on the partitioning. Rows held out by
hash are scored with the incoming parameters in the same pass, which gives the early-stopping loss. Only vectors as
long as the parameters reach the driver.

Rows are packed once, as arrays of a shard's rows, and the shards of a task step side by side: a step is one operation on the
batches of all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform
from .base import ParamModel, argmax, batch_scorer, class_count, features_array, with_weights
from .kernel import LANDMARKS, PipelinePair, kernel_width, nystroem_features

#: Rows of a shard, about.
SHARD_ROWS = 20_000
#: Bytes of rows that step side by side, and steps whose rows are laid out at once.
GROUP_BYTES, LAID_OUT = 32 << 20, 256

Step = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, float, dict], np.ndarray]
Loss = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


PACKED = "shard long, x binary, y binary, w binary, held_x binary, held_y binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run of a shard's rows: doubles of those to learn from and of those held out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        shard, y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "y", "w"))
        held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
        width = pc.min_max(pc.list_value_length(batch.column("x"))).as_py()
        if batch.column("x").null_count or width["min"] != width["max"]:
            raise ValueError("features must be arrays of one length")
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
        cuts, rows = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(y)], []
        for lo, hi in zip(cuts, cuts[1:]):
            h, own = held[lo:hi], slice(lo, hi)
            parts = x[own][~h], y[own][~h], w[own][~h], x[own][h], y[own][h]
            rows.append([int(shard[lo]), *[np.ascontiguousarray(v, np.float64).tobytes() for v in parts]])
        names = ["shard", "x", "y", "w", "held_x", "held_y"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i else pa.int64()) for i, c in enumerate(zip(*rows))], names)


def _walk(step: Step, own: np.ndarray, parts: list[tuple], batch: int, eta: float, memory: dict) -> tuple[np.ndarray, dict]:
    """Parameters, one row per shard, after the small batches of every shard's (x, y, w); larger shards stand first.

    A last batch that is not full is filled up with rows of weight 0, which add nothing.
    """
    sizes, before = np.array([len(y) for _, y, _ in parts]), len(parts)
    for first in range(0, -(-sizes.max() // batch), LAID_OUT):
        begin, end = first * batch, (first + LAID_OUT) * batch
        live = int((sizes > begin).sum())
        steps = -(-(min(sizes[0], end) - begin) // batch)
        x, y, w = np.zeros((steps, live, batch, parts[0][0].shape[1])), np.zeros((steps, live, batch)), np.zeros((steps, live, batch))
        for s, part in enumerate(parts[:live]):
            for into, rows in zip((x, y, w), part):
                rows = rows[begin:end]
                full = len(rows) // batch
                into[:full, s] = rows[: full * batch].reshape(full, *into.shape[2:])
                if full < steps:
                    into[full, s, : len(rows) - full * batch] = rows[full * batch :]
        for i in range(steps):
            left = sizes[:live] - begin - i * batch
            n = int((left > 0).sum())
            if n < before:
                memory = {k: v[:n] if isinstance(v, np.ndarray) else v for k, v in memory.items()}
                before = n
            own[:n] = step(own[:n], x[i, :n], y[i, :n], w[i, :n], np.minimum(left[:n], batch).astype(float), eta, memory)
    return own, memory


class _Shards:
    """The steps of a task's shards in one round: those that fit together go side by side, a larger one in stretches."""

    def __init__(self, step: Step, start: np.ndarray, batch: int, eta: float) -> None:
        self.step, self.start, self.batch, self.eta = step, start, batch, eta
        self.total, self.n = np.zeros(len(start)), 0
        self.closed, self.bytes = [], 0
        self.shard, self.pieces, self.own, self.memory, self.seen = None, [], None, {}, 0

    def add(self, shard: int, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        if shard != self.shard:
            self.close()
            self.shard = shard
        self.pieces.append((x, y, w))
        self.bytes += x.nbytes + y.nbytes + w.nbytes + (0 if len(self.pieces) > 1 else self.start.nbytes)
        if self.bytes > GROUP_BYTES:
            self.run_closed()
            if sum(p[0].nbytes for p in self.pieces) > GROUP_BYTES:
                self.stretch()

    def rows(self) -> tuple:
        return tuple(np.concatenate(c) for c in zip(*self.pieces))

    def stretch(self) -> None:
        """Full batches of a shard that goes on; the other rows wait."""
        x, y, w = self.rows()
        stop = len(y) - len(y) % self.batch
        self.go_on((x[:stop], y[:stop], w[:stop]))
        self.pieces = [(x[stop:], y[stop:], w[stop:])]
        self.bytes = sum(v.nbytes for v in self.pieces[0])

    def go_on(self, part: tuple) -> None:
        own = self.start[None].copy() if self.own is None else self.own
        if len(part[1]):
            own, self.memory = _walk(self.step, own, [part], self.batch, self.eta, self.memory)
        self.own, self.seen = own, self.seen + len(part[1])

    def close(self) -> None:
        if self.own is not None:
            self.go_on(self.rows())
            self.total, self.n = self.total + self.own[0] * self.seen, self.n + self.seen
        elif self.pieces:
            self.closed.append(self.rows())
        self.pieces, self.own, self.memory, self.seen = [], None, {}, 0

    def run_closed(self) -> None:
        parts = sorted((p for p in self.closed if len(p[1])), key=lambda p: -len(p[1]))
        if parts:
            own, _ = _walk(self.step, np.tile(self.start, (len(parts), 1)), parts, self.batch, self.eta, {})
            sizes = [len(y) for _, y, _ in parts]
            self.total, self.n = self.total + np.array(sizes, float) @ own, self.n + sum(sizes)
        self.closed, self.bytes = [], sum(v.nbytes for p in self.pieces for v in p)

    def finish(self) -> None:
        self.close()
        self.run_closed()


def averaged_rounds(
    train: DataFrame, start: np.ndarray, step: Step, loss: Loss, rounds: int, rate: Callable[[int], float],
    batch: int = 32, held: float = 0.1, patience: int = 5, tol: float = 1e-4, adaptive: bool = False, seed=42, id_col: str = "row_id",
) -> np.ndarray:
    """Parameters with the best held-out loss after at most ``rounds`` passes.

    ``step`` maps (parameters, x, y, weights, rows, rate, memory) to new parameters for one small batch of every shard: all but the
    rate have the shards as their first axis, and ``memory`` holds numbers or arrays of that kind.
    With ``adaptive`` a stall divides the rate by five instead of stopping, until it is tiny.
    """
    weight = F.col("weight") if "weight" in train.columns else F.lit(1.0)
    shards = max(1, -(-train.count() // SHARD_ROWS))
    data = train.select(
        F.pmod(F.xxhash64(F.lit(str(seed)), F.col(id_col)), F.lit(shards)).cast("long").alias("shard"), F.col(id_col).alias("id"),
        features_array(train).alias("x"), F.col("label").cast("double").alias("y"), weight.cast("double").alias("w"),
        (hash_uniform(f"{seed}-held", id_col) < held).alias("held"),
    )
    data = data.repartition("shard").sortWithinPartitions("shard", "id").drop("id").mapInArrow(_pack, PACKED).persist()
    theta, best, best_loss, stalled, shrink = start, start, np.inf, 0, 1.0
    for r in range(rounds + 1):
        eta, current, last = rate(r) * shrink, theta, r == rounds

        def run(batches: Iterator[pa.RecordBatch], current=current, eta=eta, last=last) -> Iterator[pa.RecordBatch]:
            own, lost, n_held = _Shards(step, current, batch, eta), 0.0, 0
            for packed in batches:
                for row in packed.to_pylist():
                    x, y, w, hx, hy = (np.frombuffer(row[c], np.float64) for c in ("x", "y", "w", "held_x", "held_y"))
                    if len(hy):
                        lost += float(loss(current, hx.reshape(len(hy), -1), hy).sum())
                        n_held += len(hy)
                    if len(y) and not last:
                        own.add(row["shard"], x.reshape(len(y), -1), y, w)
            own.finish()
            pos, value = [-1], [lost]
            if own.n:
                pos, value = [-1, *range(len(own.total))], [lost, *own.total.tolist()]
            counts = [float(n_held)] + [float(own.n)] * (len(pos) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(pos, pa.int32()), pa.array(value, pa.float64()), pa.array(counts)], ["pos", "value", "n"])

        means = data.mapInArrow(run, "pos int, value double, n double").groupBy("pos").agg(F.sum("value").alias("v"), F.sum("n").alias("n"))
        got = {r_["pos"]: r_["v"] / r_["n"] for r_ in means.collect() if r_["n"] > 0}
        held_loss = got.pop(-1, -float(r))
        if held_loss < best_loss - tol:
            best, best_loss, stalled = theta, held_loss, 0
        else:
            stalled += 1
            if stalled >= patience:
                if not adaptive or shrink < 1e-3:
                    break
                shrink, stalled = shrink / 5, 0
        if last or not got:
            break
        theta = np.array([got[i] for i in range(len(start))])
    data.unpersist()
    return best


# ---- linear classifiers ------------------------------------------------------------------------

def _margin_gradient(loss: str, m: np.ndarray) -> np.ndarray:
    """Derivative of the loss by the margin y f."""
    if loss == "modified_huber":
        return np.where(m >= 1, 0.0, np.where(m >= -1, -2 * (1 - m), -4.0))
    return -1 / (1 + np.exp(np.clip(m, -500, 500)))


def _margin_loss(loss: str, m: np.ndarray) -> np.ndarray:
    if loss == "modified_huber":
        return np.where(m >= -1, np.maximum(0, 1 - m) ** 2, -4 * m)
    return np.logaddexp(0, -m)


class MarginModel(ParamModel):
    """One linear margin per class; probabilities as the loss implies, normalised."""

    kind = "margins"

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("probability", batch_scorer(self.batch(), features_array(df)))
        return out.withColumn("prediction", argmax(F.col("probability")))

    def linear_weights(self) -> np.ndarray:
        return np.asarray(self.params["coef"])[:, :-1]

    def batch(self) -> Callable[[np.ndarray], np.ndarray]:
        w, loss = np.asarray(self.params["coef"]), self.params["loss"]

        def proba(x: np.ndarray) -> np.ndarray:
            f = x @ w[:, :-1].T + w[:, -1]
            p = (np.clip(f, -1, 1) + 1) / 2 if loss == "modified_huber" else 1 / (1 + np.exp(-np.clip(f, -500, 500)))
            if p.shape[1] == 1:
                return np.column_stack([1 - p, p])
            total = p.sum(axis=1, keepdims=True)
            return np.where(total > 0, p / np.where(total > 0, total, 1), 1.0 / p.shape[1])

        return proba


def fit_sgd_classifier(train: DataFrame, params: dict, id_col: str = "row_id") -> MarginModel:
    """Linear classifier by SGD: log loss or modified Huber, l1 / l2 / elastic-net penalty."""
    loss, alpha = params.get("loss", "log_loss"), float(params.get("alpha", 1e-4))
    l1 = {"l1": 1.0, "l2": 0.0}.get(params.get("penalty", "l2"), float(params.get("l1_ratio", 0.15)))
    schedule, eta0 = params.get("learning_rate", "invscaling"), float(params.get("eta0", 0.1))
    k = class_count(train)
    rows = 1 if k == 2 else k
    width = len(train.select("features").first()[0])

    def targets(y: np.ndarray) -> np.ndarray:
        return np.where((y == 1)[..., None] if rows == 1 else y[..., None] == np.arange(k), 1.0, -1.0)

    def step(theta, x, y, w, n, eta, memory):
        t = theta.reshape(-1, rows, width + 1)
        f, s = x @ t[:, :, :-1].swapaxes(1, 2) + t[:, None, :, -1], targets(y)
        d = _margin_gradient(loss, s * f) * s * w[..., None] / n[:, None, None]
        new = t.copy()
        new[:, :, :-1] -= eta * (d.swapaxes(1, 2) @ x + alpha * (1 - l1) * t[:, :, :-1])
        new[:, :, -1] -= eta * d.sum(axis=1)
        if l1:
            cut = eta * alpha * l1
            new[:, :, :-1] = np.sign(new[:, :, :-1]) * np.maximum(np.abs(new[:, :, :-1]) - cut, 0)
        return new.reshape(len(theta), -1)

    def held_loss(theta, x, y):
        t = theta.reshape(rows, width + 1)
        return _margin_loss(loss, targets(y) * (x @ t[:, :-1].T + t[:, -1])).sum(axis=1)

    df, _ = with_weights(train, params.get("class_weight"))
    theta = averaged_rounds(
        df, np.zeros(rows * (width + 1)), step, held_loss, int(params.get("max_iter", 500)),
        (lambda r: eta0 / (1 + r) ** 0.5) if schedule == "invscaling" else (lambda r: eta0), int(params.get("batch_size", 8)),
        float(params.get("validation_fraction", 0.1)), int(params.get("n_iter_no_change", 5)), float(params.get("tol", 1e-4)),
        schedule == "adaptive", params.get("seed", 42), id_col)
    return MarginModel(coef=theta.reshape(rows, width + 1), loss=loss)


# ---- support vector regression -----------------------------------------------------------------

class LinearTail(ParamModel):
    kind = "linear_tail"

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", batch_scorer(self.batch(), features_array(df))[0])

    def linear_weights(self) -> np.ndarray:
        return np.asarray(self.params["coef"])[None, :-1]

    def batch(self) -> Callable[[np.ndarray], np.ndarray]:
        w, mu, sd = np.asarray(self.params["coef"]), self.params["mean"], self.params["std"]
        return lambda x: ((x @ w[:-1] + w[-1]) * sd + mu)[:, None]


def _target_scale(train: DataFrame) -> tuple[float, float]:
    mu, sd = train.agg(F.avg("label"), F.stddev_pop("label")).first()
    return float(mu), float(sd or 1.0)


def fit_svr(train: DataFrame, params: dict, id_col: str = "row_id") -> PipelinePair:
    """Regression with the epsilon-insensitive loss on kernel features.

    The target is standardised for the steps; epsilon is in units of the target.
    """
    kernel, c = params.get("kernel", "rbf"), float(params.get("C", 1.0))
    mu, sd = _target_scale(train)
    eps = float(params.get("epsilon", 0.1)) / sd
    fmap, df = None, train
    if kernel != "linear":
        fmap = nystroem_features(train, kernel, int(params.get("landmarks", LANDMARKS)), params.get("seed", 42), id_col,
                                 gamma=kernel_width(train, params.get("gamma", "scale")), degree=int(params.get("degree", 3)))
        df = fmap.transform(train)
    df = df.withColumn("label", (F.col("label") - mu) / sd)
    count = df.count()
    width = len(df.select("features").first()[0])
    decay = 1.0 / (c * count)

    def step(theta, x, y, w, n, eta, memory):
        e = (x @ theta[:, :-1, None])[..., 0] + theta[:, -1:] - y
        g = np.where(np.abs(e) > eps, np.sign(e), 0.0) * w / n[:, None]
        # scaled like AdaGrad, so features of different size move alike
        full = np.column_stack([(g[:, None] @ x)[:, 0] + decay * theta[:, :-1], g.sum(axis=1)])
        memory["sq"] = memory.get("sq", 1e-8) + full * full
        return theta - eta * full / np.sqrt(memory["sq"])

    def held_loss(theta, x, y):
        return np.maximum(np.abs(x @ theta[:-1] + theta[-1] - y) - eps, 0)

    theta = averaged_rounds(df, np.zeros(width + 1), step, held_loss, int(params.get("max_iter", 1000)),
                            lambda r: float(params.get("eta0", 0.3)) / (1 + r) ** 0.5, 32, seed=params.get("seed", 42), id_col=id_col)
    return PipelinePair(fmap, LinearTail(coef=theta, mean=mu, std=sd))


# ---- multi-layer perceptrons -------------------------------------------------------------------

def _unpack(theta: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    layers, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        layers.append((theta[..., at:at + a * b].reshape(*theta.shape[:-1], a, b), theta[..., None, at + a * b:at + a * b + b]))
        at += a * b + b
    return layers


def _forward(theta: np.ndarray, x: np.ndarray, sizes: list[int], act: str, classify: bool) -> list[np.ndarray]:
    out, layers = [x], _unpack(theta, sizes)
    for i, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        if i < len(layers) - 1:
            z = np.maximum(z, 0) if act == "relu" else np.tanh(z)
        elif classify:
            z = np.exp(z - z.max(axis=-1, keepdims=True))
            z /= z.sum(axis=-1, keepdims=True)
        out.append(z)
    return out


def _mlp_step(sizes: list[int], act: str, classify: bool, alpha: float, solver: str, beta1: float, beta2: float, tiny: float) -> Step:
    def step(theta, x, y, w, n, eta, memory):
        out = _forward(theta, x, sizes, act, classify)
        want = np.eye(sizes[-1])[y.astype(int)] if classify else y[..., None]
        delta = (out[-1] - want) * w[..., None] / n[:, None, None]
        parts = []
        for i, (wt, _) in reversed(list(enumerate(_unpack(theta, sizes)))):
            own = out[i].swapaxes(1, 2) @ delta + alpha * wt / n[:, None, None]
            parts.append(np.concatenate([own.reshape(len(theta), -1), delta.sum(axis=1)], axis=1))
            if i:
                delta = (delta @ wt.swapaxes(1, 2)) * ((out[i] > 0) if act == "relu" else 1 - out[i] ** 2)
        g = np.concatenate(parts[::-1], axis=1)
        if solver == "sgd":
            memory["v"] = 0.9 * memory.get("v", 0.0) - eta * g
            return theta + memory["v"]
        t = memory["t"] = memory.get("t", 0) + 1
        m = memory["m"] = beta1 * memory.get("m", 0.0) + (1 - beta1) * g
        v = memory["v"] = beta2 * memory.get("v", 0.0) + (1 - beta2) * g * g
        return theta - eta * (m / (1 - beta1**t)) / (np.sqrt(v / (1 - beta2**t)) + tiny)

    return step


class PerceptronModel(ParamModel):
    kind = "perceptron"

    def transform(self, df: DataFrame) -> DataFrame:
        run = batch_scorer(self.batch(), features_array(df))
        if self.params["classify"]:
            out = df.withColumn("probability", run)
            return out.withColumn("prediction", argmax(F.col("probability")))
        return df.withColumn("prediction", run[0])

    def batch(self) -> Callable[[np.ndarray], np.ndarray]:
        p, theta = self.params, np.asarray(self.params["theta"])
        scale, shift = (1.0, 0.0) if p["classify"] else (p["std"], p["mean"])
        return lambda x: _forward(theta, x, p["sizes"], p["activation"], p["classify"])[-1] * scale + shift


def _fit_mlp(train: DataFrame, params: dict, classify: bool, outputs: int, mu: float, sd: float, id_col: str) -> PerceptronModel:
    width = len(train.select("features").first()[0])
    sizes = [width, *params.get("hidden_layer_sizes", [100]), outputs]
    act = params.get("activation", "relu")
    rng = np.random.default_rng(int(params.get("seed", 42)))
    start = np.concatenate([
        np.concatenate([rng.uniform(-1, 1, a * b) * np.sqrt((2.0 if act == "tanh" else 6.0) / (a + b)), np.zeros(b)])
        for a, b in zip(sizes, sizes[1:])
    ])
    step = _mlp_step(sizes, act, classify, float(params.get("alpha", 1e-4)), params.get("solver", "adam"),
                     float(params.get("beta_1", 0.9)), float(params.get("beta_2", 0.999)), float(params.get("epsilon", 1e-8)))

    def held_loss(theta, x, y):
        out = _forward(theta, x, sizes, act, classify)[-1]
        if classify:
            return -np.log(np.maximum(out[np.arange(len(y)), y.astype(int)], 1e-12))
        return 0.5 * (out[:, 0] - y) ** 2

    eta = float(params.get("learning_rate_init", 1e-3))
    theta = averaged_rounds(
        train, start, step, held_loss, int(params.get("max_iter", 200)), lambda r: eta,
        int(params.get("batch_size", 16)), float(params.get("validation_fraction", 0.1)), int(params.get("n_iter_no_change", 10)),
        float(params.get("tol", 1e-4)), params.get("learning_rate") == "adaptive", params.get("seed", 42), id_col)
    return PerceptronModel(theta=theta, sizes=sizes, activation=act, classify=classify, mean=mu, std=sd)


def fit_mlp_classifier(train: DataFrame, params: dict, id_col: str = "row_id") -> PerceptronModel:
    return _fit_mlp(train, params, True, class_count(train), 0.0, 1.0, id_col)


def fit_mlp_regressor(train: DataFrame, params: dict, id_col: str = "row_id") -> PerceptronModel:
    """Squared loss on the standardised target."""
    mu, sd = _target_scale(train)
    scaled = train.withColumn("label", (F.col("label") - mu) / sd)
    return _fit_mlp(scaled, params, False, 1, mu, sd, id_col)
