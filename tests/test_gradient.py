import numpy as np
import pyarrow as pa
import pytest

from cohortlab.learners import gradient


def step(theta, x, y, w, n, eta, memory):
    """Least squares with momentum, so that a shard's memory counts."""
    e = ((x @ theta[:, :, None])[..., 0] - y) * w / n[:, None]
    memory["v"] = 0.5 * memory.get("v", 0.0) - eta * (e[:, None] @ x)[:, 0]
    memory["t"] = memory.get("t", 0) + 1
    return theta + memory["v"] / memory["t"]


def plain(shards, start, batch):
    total, n = np.zeros(len(start)), 0
    for x, y, w in shards:
        theta, memory = start[None].copy(), {}
        for at in range(0, len(y), batch):
            s = slice(at, at + batch)
            theta = step(theta, x[None, s], y[None, s], w[None, s], np.array([float(len(y[s]))]), 0.1, memory)
        total, n = total + theta[0] * len(y), n + len(y)
    return total, n


@pytest.mark.parametrize("room, laid_out", [(1, 256), (300, 2), (2000, 2), (1 << 20, 3), (1 << 20, 256)])
def test_shards_side_by_side_step_as_one_after_the_other(monkeypatch, room, laid_out):
    monkeypatch.setattr(gradient, "GROUP_BYTES", room)
    monkeypatch.setattr(gradient, "LAID_OUT", laid_out)
    rng, calls = np.random.default_rng(5), []
    shards = [(rng.normal(size=(n, 3)), rng.normal(size=n), rng.uniform(0.5, 2, n)) for n in (7, 1, 40, 24, 8, 16, 41, 3)]

    def counted(theta, *rest):
        calls.append(len(theta))
        return step(theta, *rest)

    own = gradient._Shards(counted, np.array([0.1, -0.2, 0.3]), 8, 0.1)
    for key, (x, y, w) in enumerate(shards):
        for at in range(0, len(y), 5):
            own.add(key, x[at : at + 5], y[at : at + 5], w[at : at + 5])
    own.finish()
    total, n = plain(shards, np.array([0.1, -0.2, 0.3]), 8)
    assert own.n == n and np.allclose(own.total, total, rtol=1e-12, atol=1e-12)
    if room == 1 << 20:
        assert len(calls) == 6 and max(calls) == len(shards)


def test_packed_rows_keep_their_order_and_bad_features_are_told():
    x = [[float(i), -float(i)] for i in range(6)]
    held = [False, True, False, False, False, True]
    cols = {"shard": pa.array([1, 1, 1, 4, 4, 4]), "x": pa.array(x), "y": pa.array([0.0, 1, None, 3, 4, 5]), "w": pa.array([1.0] * 6), "held": pa.array(held)}
    got = [r for b in gradient._pack(iter([pa.RecordBatch.from_pydict(cols)])) for r in b.to_pylist()]
    assert [r["shard"] for r in got] == [1, 4]
    assert np.frombuffer(got[0]["x"]).tolist() == [0, 0, 2, -2] and np.isnan(np.frombuffer(got[0]["y"])[1])
    assert np.frombuffer(got[1]["held_x"]).tolist() == [5, -5] and len(np.frombuffer(got[1]["w"])) == 2
    for bad in ([*x[:5], None], [*x[:5], [1.0]]):
        with pytest.raises(ValueError):
            list(gradient._pack(iter([pa.RecordBatch.from_pydict({**cols, "x": pa.array(bad)})])))
