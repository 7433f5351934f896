import time

import numpy as np
import pytest

from cohortlab.operators.neighbors import knn_join
from cohortlab.operators.pivot_tree import Block, PivotTree, block_distances, distances, nearest_in


def table(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "row_id long, features array<double>")


def test_leaves_do_not_grow_with_the_rows(spark):
    v = np.random.default_rng(1).random((20_000, 4))
    rows = table(spark, v).selectExpr("0L AS g", "features AS x", "array(row_id) AS ids")
    tree = PivotTree(rows, 4, 2)
    assert tree.subs.count() <= 24 and tree.leaves.count() == 20_000  # 40 and more when a leaf had 512 rows


def test_ranks_in_a_large_cell_fit(spark):
    rows = table(spark, np.arange(20.0).reshape(10, 2)).selectExpr("0L AS g", "features AS x", "array(row_id) AS ids")
    tree = PivotTree(rows, 2, 2, rows_per_leaf=1 << 30)  # rank times rows of a leaf, as in a cell of 100,000 rows with leaves of 30,000
    assert tree.leaves.count() == 10


def test_blocks_of_distances_join_to_the_whole(monkeypatch):
    rng = np.random.default_rng(2)
    q, s = rng.integers(0, 3, (50, 3)).astype(float), rng.integers(0, 3, (80, 3)).astype(float)
    ids, limit = rng.permutation(80), np.where(np.arange(50) % 2 == 0, np.inf, 1.5)
    qi, si, d = nearest_in(q, s, ids, 4, 2, limit)
    for i in range(50):
        dist = np.sqrt(((q[i] - s) ** 2).sum(axis=1))
        want = sorted((x, k) for x, k in zip(dist.tolist(), ids.tolist()) if x <= limit[i])[:4]
        assert [(x, ids[j]) for x, j in zip(d[qi == i].tolist(), si[qi == i])] == want
    monkeypatch.setattr("cohortlab.operators.pivot_tree.DISTANCES", 200)
    for a, b in zip(nearest_in(q, s, ids, 4, 2, limit), (qi, si, d)):
        assert (a == b).all()


def test_join_without_separate_leaves_is_exact(spark):
    v = np.random.default_rng(3).normal(size=(1500, 16))
    df = table(spark, v)
    got = {(r["row_id"], r["rank"]): r["neighbor_id"] for r in knn_join(df, df, 3, exclude_self=True).collect()}
    d = ((v[:, None] - v[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    near = d.argsort(axis=1)[:, :3]
    assert got == {(i, k + 1): near[i, k] for i in range(1500) for k in range(3)}


@pytest.mark.parametrize("p", [1, 2])
def test_a_query_leaves_the_tree_with_its_nearest_only(spark, p):
    v = np.random.default_rng(4).normal(size=(1200, 8))
    rows = table(spark, v).selectExpr("0L AS g", "features AS x", "array(row_id, row_id + 5000) AS ids")
    found = PivotTree(rows, 8, p, rows_per_leaf=100).nearest(None, 5).collect()
    assert len(found) == 1200  # k candidates of every leaf visited before
    for r in found[::40]:
        d = distances(np.repeat(v[r["q"]][None], len(v), axis=0), v, p)
        want = sorted((x, i) for j, x in enumerate(d.tolist()) for i in (j, j + 5000))[:5]
        assert [(n["distance"], n["neighbor_id"]) for n in r["near"]] == want


def test_blocks_meet_leaves_in_any_order():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    q, s = rng.normal(size=(30, 4)), np.round(rng.normal(size=(200, 4)), 1)
    names = rng.permutation(200)
    block = Block(q, np.arange(30), np.full(30, np.inf), 6, 1)
    for i in range(0, 200, 35):
        block.meet(s[i : i + 35], pa.array([[n] for n in names[i : i + 35].tolist()], pa.list_(pa.int64())))
    for i in range(30):
        d = distances(np.repeat(q[i][None], 200, axis=0), s, 1)
        assert list(zip(block.d[i], block.names[i])) == sorted(zip(d, names))[:6]


def test_sums_of_differences_take_a_fraction_of_their_time():
    rng = np.random.default_rng(6)
    q, s = rng.normal(size=(400, 64)), rng.normal(size=(5000, 64))
    took = []
    for f in (lambda: block_distances(q, s, 1), lambda: nearest_in(q, s, np.arange(5000), 20, 1, np.full(400, np.inf))):
        f()
        start = time.perf_counter()
        f()
        took.append(time.perf_counter() - start)
    assert took[1] < took[0] / 2, took  # more than it before


@pytest.mark.parametrize("change", [lambda x: np.round(x), lambda x: x * np.r_[1e7, np.ones(7)], lambda x: x + 1e5, lambda x: x * 1e-9, lambda x: np.zeros_like(x)])
def test_steps_lose_no_neighbour(change):
    rng = np.random.default_rng(7)
    q, s, names = change(rng.normal(size=(40, 8))), change(rng.normal(size=(900, 8))), rng.permutation(900)
    every = [sorted(zip(distances(np.repeat(x[None], 900, axis=0), s, 1).tolist(), names.tolist()))[:12] for x in q]
    for limit in (np.full(40, np.inf), np.array([e[-1][0] for e in every])):
        qi, si, d = nearest_in(q, s, names, 12, 1, limit)
        assert [[(x, n) for x, n, o in zip(d.tolist(), names[si].tolist(), qi) if o == i] for i in range(40)] == every
