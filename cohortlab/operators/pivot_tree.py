"""Exact nearest neighbours by a two-level tree of pivots, with a search radius of its own for every query.

Rows go to the nearest of some top pivots and, within that cell, to the nearest of the cell's own pivots: a leaf. Where distances do
not separate leaves every query visits every leaf, so there are ``MOST_LEAVES`` of them, however many rows. Beyond ``MOST_LEAVES``
times ``MOST_ROWS`` rows, leaves stay as large as a task should hold, and their number grows. The top level has the square root of it.

1. A query looks at a part of its home leaf; the k-th distance there, or a sum of distance and radius over cells that hold k rows, is its radius.
2. The triangle inequality with its own radius leaves the query some cells, and among their leaves those that its ball reaches.
3. The queries of a home leaf are dealt to blocks. The leaves that a block's queries visit stream past it, and every query keeps its k
   nearest so far: k rows leave the task, however many leaves were visited. A leaf is copied for every block that visits it.

Rows of one cell or leaf stream through a task behind the few rows they need: a cell's pivots, a part of a leaf, or a block of queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_key
from ..session import broadcast_if_small, cut_lineage

#: Rows of a leaf at least and, beyond the number of leaves wanted, at most, on average.
LEAST_ROWS, MOST_ROWS, MOST_LEAVES = 512, 65536, 16
#: Rows of a leaf that a query looks at first, on average.
HOME_ROWS = 8192
#: Queries that share one copy of a leaf at least, on average, and blocks that all queries make, besides one for each home leaf.
QUERY_BLOCK, MOST_BLOCKS = 2048, 32
#: Tasks that blocks are dealt to at most.
MOST_TASKS = 2048
#: Distances that a task holds at once.
DISTANCES = 1 << 21
#: A cell's number times LEAVES plus the number of a leaf in it is the leaf's; likewise groups and cells.
LEAVES, CELLS = 1 << 24, 1 << 20

#: Rows whose distances are added up at a time, so that they stay in a processor's cache.
TILE_ROWS, TILE_COLUMNS = 64, 2048
#: Sixteen bits hold the sum of a row's levels.
LEVELS = 65535
#: What streams: q and ids name rows, h is a number that belongs to the row, r a radius.
STREAM = "key long, block int, side int, q long, h long, r double, x array<double>, ids array<bigint>"


def distances(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Exact distances of matching rows."""
    d = np.abs(a - b)
    return d.sum(axis=1) if p == 1 else np.sqrt((d * d).sum(axis=1))


def block_distances(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """All distances between two blocks; for L2 up to rounding."""
    if p == 1:
        out = np.zeros((len(a), len(b)))
        for j in range(a.shape[1]):
            out += np.abs(a[:, j, None] - b[None, :, j])
        return out
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0.0))


def size_of(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """What rounding grows with, one number per query: squares cancel, so the root of their size counts."""
    return np.sqrt((q * q).sum(axis=1)) + (np.sqrt((s * s).sum(axis=1).max()) if len(s) else 0.0)


def slack_of(size: np.ndarray, d: np.ndarray) -> np.ndarray:
    return 1e-6 * (1.0 + np.where(np.isfinite(d), np.abs(d), 0.0)) + 1e-6 * size


def slack(q: np.ndarray, s: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What rounding can have moved a distance by, one number per query."""
    return slack_of(size_of(q, s), d)


def leaf_rows(n: int) -> int:
    """Rows of a leaf for ``n`` rows."""
    return min(max(LEAST_ROWS, -(-n // MOST_LEAVES)), MOST_ROWS)


class Squares:
    """Squared Euclidean distances, up to rounding, from one matrix product."""

    def __init__(self, q: np.ndarray, s: np.ndarray) -> None:
        self.left = np.column_stack([-2.0 * q, (q * q).sum(1), np.ones(len(q))])
        self.right = np.column_stack([s, np.ones(len(s)), (s * s).sum(1)]).T

    def cells(self, rows: slice) -> np.ndarray:
        return self.left[rows] @ self.right

    def limits(self, r: np.ndarray, rows: slice) -> np.ndarray:
        """A cell beyond its query's limit lies beyond distance r for certain."""
        return r * r

    def reaches(self, cells: np.ndarray, rows: slice) -> np.ndarray:
        """Distances that rows with such cells, one per query, or lesser ones do not pass."""
        return np.sqrt(np.maximum(cells, 0.0))


class Levels:
    """L1 distances in whole steps, sixteen bits each: |a - b| is twice the larger one less both.

    What rounding to steps takes from a row is known, so limits hold for certain.
    """

    def __init__(self, q: np.ndarray, s: np.ndarray) -> None:
        low = np.minimum(q.min(axis=0), s.min(axis=0))
        width = float((np.maximum(q.max(axis=0), s.max(axis=0)) - low).max())
        self.step = width / (LEVELS // q.shape[1] - 1) or 1.0
        (self.q, self.own, self.lost), (self.s, other, lost) = self._rounded(q - low), self._rounded(s - low)
        self.other, self.most_lost = (other + lost / self.step).astype(np.float32), lost.max()

    def _rounded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(levels by feature, their sum by row, what rounding took by row)."""
        levels = np.rint(x / self.step)
        return np.ascontiguousarray(levels.T.astype(np.uint16)), levels.sum(axis=1), np.abs(x - self.step * levels).sum(axis=1)

    def cells(self, rows: slice) -> np.ndarray:
        q = self.q[:, rows]
        larger = np.empty((q.shape[1], self.s.shape[1]), np.uint16)
        room = np.empty((TILE_ROWS, TILE_COLUMNS), np.uint16)
        for i in range(0, larger.shape[0], TILE_ROWS):
            for j in range(0, larger.shape[1], TILE_COLUMNS):
                sums = larger[i : i + TILE_ROWS, j : j + TILE_COLUMNS]
                one = room[: sums.shape[0], : sums.shape[1]]
                sums[:] = 0
                for x, y in zip(q[:, i : i + TILE_ROWS, None], self.s[:, None, j : j + TILE_COLUMNS]):
                    np.maximum(x, y, out=one)
                    np.add(sums, one, out=sums)
        out = larger.astype(np.float32)
        out *= 2
        out -= self.other
        return out

    def limits(self, r: np.ndarray, rows: slice) -> np.ndarray:
        # single precision moves a cell and a limit by far less than one level
        return ((r + self.lost[rows]) / self.step + self.own[rows] + 1.0).astype(np.float32)

    def reaches(self, cells: np.ndarray, rows: slice) -> np.ndarray:
        return self.step * (cells - self.own[rows] + 1.0) + self.lost[rows] + 2.0 * self.most_lost


class Plain:
    """Distances up to rounding."""

    def __init__(self, q: np.ndarray, s: np.ndarray, p: int) -> None:
        self.q, self.s, self.p = q, s, p

    def cells(self, rows: slice) -> np.ndarray:
        return block_distances(self.q[rows], self.s, self.p)

    def limits(self, r: np.ndarray, rows: slice) -> np.ndarray:
        return r

    def reaches(self, cells: np.ndarray, rows: slice) -> np.ndarray:
        return cells


def nearest_in(q: np.ndarray, s: np.ndarray, first_id: np.ndarray, k: int, p: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, exact distance) of each query's k nearest rows within its limit, ordered by distance and id."""
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if len(q) and len(s):
        size, plain = size_of(q, s), Squares(q, s) if p == 2 else Plain(q, s, p)
        levelled = p == 1 and len(s) > k and LEVELS // q.shape[1] > 16 and np.isfinite(q).all() and np.isfinite(s).all()
        quick = Levels(q, s) if levelled else plain
        step = max(1, DISTANCES // len(s))
        for at in range(0, len(q), step):
            rows = slice(at, at + step)
            places = _near(quick, rows, k, limit[rows], size[rows])
            n = len(size[rows])
            if quick is not plain and len(places) > max(16 * k * n, n * len(s) // 64):
                # features of very unlike widths leave few levels to most of them, and too much seems near
                quick = plain
                places = _near(quick, rows, k, limit[rows], size[rows])
            qi, si = np.divmod(places, len(s))
            parts.append(_first_of(q, s, first_id, k, p, qi + at, si))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _near(found, rows: slice, k: int, limit: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places, in the flat matrix, of the cells that may be among a query's k nearest within its limit."""
    cells = found.cells(rows)
    near = cells <= found.limits(limit + slack_of(size, limit), rows)[:, None]
    # few rows lie within a limit that was found elsewhere; only where many do, the k-th distance here is looked for
    if cells.shape[1] > k and np.count_nonzero(near) > 4 * k * len(limit):
        bound = np.minimum(limit, found.reaches(np.partition(cells, k - 1, axis=1)[:, k - 1], rows))
        near = cells <= found.limits(bound + slack_of(size, bound), rows)[:, None]
    return np.flatnonzero(near)


def _first_of(q: np.ndarray, s: np.ndarray, first_id: np.ndarray, k: int, p: int, qi: np.ndarray, si: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of matching queries and rows each query's k nearest, with the exact distance."""
    exact, step = np.empty(len(qi)), max(1, DISTANCES // q.shape[1])
    for i in range(0, len(qi), step):
        exact[i : i + step] = distances(q[qi[i : i + step]], s[si[i : i + step]], p)
    order = np.lexsort((first_id[si], exact, qi))
    qi, si, exact = qi[order], si[order], exact[order]
    own = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return qi[own], si[own], exact[own]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch | None, pa.RecordBatch]]:
    """(rows of side 0 of a key and block, some of its other rows), from sorted rows."""
    now: tuple | None = None
    held: list[pa.RecordBatch] = []
    whole: pa.RecordBatch | None = None
    for b in batches:
        if not b.num_rows:
            continue
        key, block, side = (b.column(k).to_numpy() for k in range(3))
        other = side > 0
        cut = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (other[1:] != other[:-1])) + 1
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows]):
            if (own := (int(key[i]), int(block[i]))) != now:
                now, held, whole = own, [], None
            if not other[i]:
                held.append(b.slice(i, j - i))
                whole = None
            else:
                if whole is None and held:
                    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                yield whole, b.slice(i, j - i)


def _ids(ids: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all ids, where a row's begin, how many it has)."""
    ends = ids.offsets.to_numpy()
    return ids.flatten().to_numpy(), ends[:-1] - ends[0], np.diff(ends)


def _named(found: tuple[np.ndarray, np.ndarray, np.ndarray], ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, distance, id) of each query's k nearest ids, from its k nearest rows."""
    qi, si, d = found
    flat, starts, counts = _ids(ids)
    n = counts[si]
    own = np.repeat(np.arange(len(si)), n)
    name = flat[starts[si][own] + np.arange(len(own)) - (np.cumsum(n) - n)[own]]
    return _least(qi[own], d[own], name, k)


def _least(q: np.ndarray, d: np.ndarray, name: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of every query by distance and id."""
    order = np.lexsort((name, d, q))
    q = q[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[kept], d[order][kept], name[order][kept]


class Block:
    """Queries of a block, each with its k nearest (distance, id) so far."""

    def __init__(self, x: np.ndarray, q: np.ndarray, theta: np.ndarray, k: int, p: int) -> None:
        self.x, self.q, self.theta, self.k, self.p = x, q, theta, k, p
        self.d, self.names = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)

    def meet(self, s: np.ndarray, ids: pa.Array) -> None:
        """Rows of one leaf; queries whose ball does not reach theirs are left out."""
        centre = s.mean(axis=0, keepdims=True)
        limit = np.minimum(self.theta, self.d[:, -1])
        gap = block_distances(self.x, centre, self.p)[:, 0] - distances(s, centre, self.p).max()
        near = np.flatnonzero(~(gap > limit + slack(self.x, centre, limit)))
        if not len(near):
            return
        flat, starts, _ = _ids(ids)
        qi, si, d = nearest_in(self.x[near], s, flat[starts], self.k, self.p, limit[near])
        q, d, name = _named((near[qi], si, d), ids, self.k)
        if not len(q):
            return
        met, place = np.unique(q, return_inverse=True)
        q = np.concatenate([np.repeat(np.arange(len(met)), self.k), place])
        _, d, name = _least(q, np.concatenate([self.d[met].ravel(), d]), np.concatenate([self.names[met].ravel(), name]), self.k)
        self.d[met], self.names[met] = d.reshape(-1, self.k), name.reshape(-1, self.k)

    def results(self) -> Iterator[pa.RecordBatch]:
        step = max(1, DISTANCES // (4 * self.k))
        for i in range(0, len(self.q), step):
            d, names = self.d[i : i + step], self.names[i : i + step]
            found = np.isfinite(d)
            ends = np.concatenate([[0], np.cumsum(found.sum(axis=1))]).astype(np.int32)
            near = pa.StructArray.from_arrays([pa.array(d[found]), pa.array(names[found])], names=["distance", "neighbor_id"])
            yield pa.RecordBatch.from_arrays([pa.array(self.q[i : i + step]), pa.ListArray.from_arrays(pa.array(ends), near)], names=["q", "near"])


def _block(held: list[pa.RecordBatch], k: int, p: int, dims: int) -> Block:
    x, q, theta = (np.concatenate([f(b) for b in held]) for f in (lambda b: matrix(b.column(5), dims), lambda b: b.column(3).to_numpy(zero_copy_only=False), lambda b: b.column(4).to_numpy()))
    return Block(x, q, theta, k, p)


def _results(block: Block | None, held: list[pa.RecordBatch], k: int, p: int, dims: int) -> Iterator[pa.RecordBatch]:
    if held:
        yield from (_block(held, k, p, dims) if block is None else block).results()


def _streamed(rows: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn`` over ``_walk`` of all rows: those of a key and block meet in one task."""
    names = [part.split()[0] for part in STREAM.split(", ")]
    return rows.select(*names).repartition("key", "block").sortWithinPartitions("key", "block", "side").mapInArrow(lambda b: fn(_walk(b)), schema)


def _row(key, side: int, q=None, h=None, r=None, x="x", ids=None, block=None):
    none = F.lit(None)
    return [
        key.cast("long").alias("key"), (F.lit(0) if block is None else block).cast("int").alias("block"), F.lit(side).alias("side"),
        (none if q is None else q).cast("long").alias("q"), (none if h is None else h).cast("long").alias("h"),
        (none if r is None else r).cast("double").alias("r"), F.col(x).alias("x"), (none if ids is None else ids).cast("array<bigint>").alias("ids"),
    ]


class PivotTree:
    """Leaves of some rows (g, x, ids): g is the number of the group, ids ascend."""

    def __init__(self, rows: DataFrame, dims: int, p: int, rows_per_leaf: int | None = None) -> None:
        self.dims, self.p = dims, p
        n = rows.count()
        rows_per_leaf = leaf_rows(n) if rows_per_leaf is None else rows_per_leaf
        leaves = n // rows_per_leaf + 1
        chosen = rows.select("x", "ids").orderBy(hash_key("pivot", F.col("ids")[0])).limit(int(np.ceil(np.sqrt(leaves)))).collect()
        self.tops = np.unique(np.array([r["x"] for r in chosen], dtype="float64").reshape(-1, dims), axis=0)
        placed = cut_lineage(self._in_cells(rows))
        stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("radius")).collect()  # groups x top pivots
        self.cells = {r["cell"]: (r["n"], r["radius"]) for r in stats}
        self.subs = cut_lineage(self._pivots(placed, rows_per_leaf))
        self.leaves = cut_lineage(self._in_leaves(placed.select(*_row(F.col("cell"), 1, F.col("ids")[0], ids=F.col("ids")))))
        inside = self.leaves.groupBy("leaf").agg(F.max("reach").alias("radius"), F.count(F.lit(1)).alias("n"))
        # pivots with the radius of their leaf; the one that no row chose has none
        self.balls = cut_lineage(self.subs.withColumn("leaf", F.col("cell") * LEAVES + F.col("j")).join(inside, "leaf"))

    def _pivots(self, placed: DataFrame, rows_per_leaf: int) -> DataFrame:
        """(cell, j, x): a cell's first rows in hash order, as many as it has leaves' worth of rows."""
        order = Window.partitionBy("cell").orderBy(hash_key("leaf", F.col("ids")[0]), F.col("ids")[0])
        # ranks times rows of a leaf pass 32 bits in a large cell
        ranked = placed.select("cell", "x", (F.row_number().over(order) - 1).cast("long").alias("j"))
        sizes = F.create_map(*[F.lit(v).cast("long") for c, (n, _) in self.cells.items() for v in (c, n)]) if self.cells else F.lit(None)
        return ranked.filter(F.col("j") * rows_per_leaf < F.element_at(sizes, F.col("cell"))).select("cell", "j", "x")

    def _in_cells(self, rows: DataFrame) -> DataFrame:
        """Adds ``cell`` and ``reach``, the distance to its pivot."""
        tops, p, dims = self.tops, self.p, self.dims

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = matrix(b.column(1), dims)
                at = block_distances(x, tops, p).argmin(axis=1)
                cell = b.column(0).to_numpy() * CELLS + at
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(distances(x, tops[at], p)), b.column(1), b.column(2)], names=["cell", "reach", "x", "ids"])

        return rows.select(F.col("g").cast("long").alias("g"), "x", "ids").mapInArrow(each, "cell long, reach double, x array<double>, ids array<bigint>")

    def _in_leaves(self, rows: DataFrame) -> DataFrame:
        """(leaf, reach, q, x, ids) of streamed rows keyed by cell; leaf is -1 where a cell has no rows of the tree."""
        p, dims = self.p, self.dims

        def assign(pairs: Iterator) -> Iterator[pa.RecordBatch]:
            for pivots, own in pairs:
                x = matrix(own.column(6), dims)
                if pivots is None:
                    leaf, reach = np.full(len(x), -1), np.full(len(x), np.nan)
                else:
                    v = matrix(pivots.column(6), dims)
                    at = block_distances(x, v, p).argmin(axis=1)
                    leaf = own.column(0).to_numpy() * LEAVES + pivots.column(4).to_numpy()[at]
                    reach = distances(x, v[at], p)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(reach), own.column(3), own.column(6), own.column(7)], names=["leaf", "reach", "q", "x", "ids"])

        pivots = self.subs.select(*_row(F.col("cell"), 0, h=F.col("j")))
        return _streamed(pivots.unionByName(rows), assign, "leaf long, reach double, q long, x array<double>, ids array<bigint>")

    def nearest(self, queries: DataFrame | None, k: int, query_block: int = QUERY_BLOCK) -> DataFrame:
        """(q, near): the k nearest (distance, neighbor_id) of every query (g, q, x), by distance and id.

        None stands for the tree's own rows, named by their first ids.
        """
        at_home = self._home(queries, k)
        return self._met(at_home, self._visits(at_home, k), k, query_block)

    def _home(self, queries: DataFrame | None, k: int) -> DataFrame:
        """(q, g, x, leaf, theta): theta is the k-th distance in a part of the home leaf."""
        p, dims = self.p, self.dims
        if queries is None:
            placed = self.leaves.select("leaf", F.col("ids")[0].alias("q"), "x", F.shiftright("leaf", 44).alias("g"))
        else:
            asked = self._in_cells(queries.select("g", "x", F.array("q").alias("ids")))
            # the group's number rides along as a list
            keyed = asked.select(*_row(F.col("cell"), 1, F.col("ids")[0], ids=F.array(F.shiftright("cell", 20))))
            placed = cut_lineage(self._in_leaves(keyed).select("leaf", "q", "x", F.col("ids")[0].alias("g")))
        large = self.balls.filter(F.col("n") > HOME_ROWS).select("leaf", F.ceil(F.col("n") / HOME_ROWS).alias("parts")).collect()
        parts = F.lit(1)
        if large:
            parts = F.coalesce(F.element_at(F.create_map(*[F.lit(v).cast("long") for r in large for v in r]), F.col("leaf")), F.lit(1))
        here = self.leaves.select(*_row(F.col("leaf"), 0, ids=F.col("ids"), block=F.pmod(F.xxhash64(F.col("ids")[0]), parts)))
        asked = placed.filter("leaf >= 0").select(*_row(F.col("leaf"), 1, F.col("q"), F.col("g"), block=F.pmod(F.xxhash64("q"), parts)))

        def look(pairs: Iterator) -> Iterator[pa.RecordBatch]:
            for rows, own in pairs:
                x = matrix(own.column(6), dims)
                theta = np.full(len(x), np.inf)
                if rows is not None:
                    s, ids = matrix(rows.column(6), dims), rows.column(7)
                    flat, starts, _ = _ids(ids)
                    qi, d, _ = _named(nearest_in(x, s, flat[starts], k, p, theta), ids, k)
                    held = np.bincount(qi, minlength=len(x))
                    theta[held == k] = d[np.cumsum(held)[held == k] - 1]
                yield pa.RecordBatch.from_arrays([own.column(3), own.column(4), own.column(6), own.column(0), pa.array(theta)], names=["q", "g", "x", "leaf", "theta"])

        looked = _streamed(here.unionByName(asked), look, "q long, g long, x array<double>, leaf long, theta double")
        lost = placed.filter("leaf < 0").select("q", "g", "x", "leaf", F.lit(float("inf")).alias("theta"))
        return cut_lineage(looked.unionByName(lost))

    def _visits(self, at_home: DataFrame, k: int) -> DataFrame:
        """(home, leaf, q): the leaves, but for its own, that a query's ball reaches."""
        tops, p, dims = self.tops, self.p, self.dims
        # per group: rows and radius of every cell; groups x top pivots numbers
        groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for cell, (n, radius) in self.cells.items():
            held, radii = groups.setdefault(cell // CELLS, (np.zeros(len(tops)), np.full(len(tops), -np.inf)))
            held[cell % CELLS], radii[cell % CELLS] = n, radius

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, g, theta = matrix(b.column(2), dims), b.column(1).to_numpy(), b.column(4).to_numpy()
                d = block_distances(x, tops, p)
                for own in np.unique(g).tolist():
                    if own not in groups:
                        continue
                    rows = np.flatnonzero(g == own)
                    held, radii = groups[own]
                    near = d[rows]
                    # so many rows lie within distance and radius of the nearest cells
                    reach = near + np.where(held > 0, radii, np.inf)
                    order = np.argsort(reach, axis=1)
                    few = (np.cumsum(held[order], axis=1) < k).sum(axis=1)
                    last = np.take_along_axis(reach, order, axis=1)[np.arange(len(rows)), np.minimum(few, len(tops) - 1)]
                    bound = np.where(few < len(tops), last, np.inf)
                    radius = np.minimum(theta[rows], bound)
                    radius = radius + slack(x[rows], tops, radius)
                    qi, ci = np.nonzero((near - np.where(held > 0, radii, 0.0) <= radius[:, None]) & (held > 0))
                    at = pa.array(rows[qi])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own * CELLS + ci), b.column(0).take(at), b.column(3).take(at), pa.array(radius[qi]), b.column(2).take(at)], names=["cell", "q", "leaf", "theta", "x"]
                    )

        asked = at_home.select("q", "g", "x", "leaf", "theta").mapInArrow(cells, "cell long, q long, leaf long, theta double, x array<double>")

        def leaves(pairs: Iterator) -> Iterator[pa.RecordBatch]:
            for balls, own in pairs:
                if balls is None:
                    continue
                x, home, theta = matrix(own.column(6), dims), own.column(4).to_numpy(), own.column(5).to_numpy()
                leaf = balls.column(0).to_numpy() * LEAVES + balls.column(4).to_numpy()
                v = matrix(balls.column(6), dims)
                gap = block_distances(x, v, p) - balls.column(5).to_numpy()[None, :]
                qi, li = np.nonzero((gap <= (theta + slack(x, v, theta))[:, None]) & (leaf[None, :] != home[:, None]))
                # without a leaf of its own a query is at home in its group
                home = np.where(home >= 0, home, -1 - own.column(0).to_numpy() // CELLS)
                yield pa.RecordBatch.from_arrays([pa.array(home[qi]), pa.array(leaf[li]), own.column(3).take(pa.array(qi))], names=["home", "leaf", "q"])

        balls = self.balls.select(*_row(F.col("cell"), 0, h=F.col("j"), r=F.col("radius")))
        queries = asked.select(*_row(F.col("cell"), 1, F.col("q"), F.col("leaf"), F.col("theta")))
        return _streamed(balls.unionByName(queries), leaves, "home long, leaf long, q long")

    def _met(self, at_home: DataFrame, visits: DataFrame, k: int, query_block: int) -> DataFrame:
        """(q, near): what the queries of every block find in the leaves that one of them visits."""
        p, dims, spark = self.p, self.dims, at_home.sparkSession
        asked = at_home.withColumn("home", F.when(F.col("leaf") >= 0, F.col("leaf")).otherwise(-1 - F.col("g")))
        counts = {r["home"]: r["n"] for r in asked.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}  # leaves
        size = min(max(query_block, -(-sum(counts.values()) // MOST_BLOCKS)), max(query_block, MOST_ROWS))
        homes, total = [], 0
        for home, n in sorted(counts.items()):
            homes.append((home, total, -(-n // size)))
            total += -(-n // size)
        numbered = F.broadcast(spark.createDataFrame(homes, "home long, first int, blocks int"))
        number = (F.col("first") + F.pmod(F.xxhash64("q"), F.col("blocks"))).cast("int").alias("block")
        wanted = visits.join(numbered, "home").select("leaf", number).distinct()
        own = numbered.filter("home >= 0").select(F.col("home").alias("leaf"), F.explode(F.expr("sequence(first, first + blocks - 1)")).alias("block"))
        blocks = broadcast_if_small(wanted.unionByName(own).groupBy("leaf").agg(F.collect_list("block").alias("blocks")))
        none = F.lit(None)
        there = asked.join(numbered, "home").select(number, F.lit(0).alias("side"), none.cast("long").alias("leaf"), "q", "theta", "x", none.cast("array<bigint>").alias("ids"))
        here = self.leaves.join(blocks, "leaf").select(
            F.explode("blocks").alias("block"), F.lit(1).alias("side"), "leaf", none.cast("long").alias("q"), none.cast("double").alias("theta"), "x", "ids"
        )

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, block = None, [], None
            for b in batches:
                if not b.num_rows:
                    continue
                number, leaf = b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
                other = b.column(1).to_numpy() > 0
                cut = np.flatnonzero((number[1:] != number[:-1]) | (other[1:] != other[:-1]) | (other[1:] & (leaf[1:] != leaf[:-1]))) + 1
                for i, j in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows]):
                    if now != number[i]:
                        yield from _results(block, held, k, p, dims)
                        now, held, block = number[i], [], None
                    own = b.slice(i, j - i)
                    if not other[i]:
                        held.append(own)
                    else:
                        block = _block(held, k, p, dims) if block is None else block
                        block.meet(matrix(own.column(5), dims), own.column(6))
            yield from _results(block, held, k, p, dims)

        tasks = max(1, min(total, MOST_TASKS))
        dealt = there.unionByName(here).repartitionById(tasks, F.pmod("block", F.lit(tasks))).sortWithinPartitions("block", "side", "leaf")
        return dealt.mapInArrow(meet, "q long, near array<struct<distance:double,neighbor_id:bigint>>")
