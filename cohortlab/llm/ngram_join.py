"""Exact self-join of documents on the Jaccard similarity of their word shingles, by pigeonhole on a partitioned universe.

Two sets of sizes r >= s with similarity t or more differ in at most H = floor((1 - t) / (1 + t) (r + s)) elements. The
universe of shingle hashes is cut into m segments by a second hash; m depends on the size band, so that partners use the same cut.
Of any H + 1 segments of a set, a partner agrees on at least one. So documents are indexed by the contents of their segments, and
by those of the lower band where a smaller partner may lie.

* Allocation by cost: in bands of small sets (WITH_DELETIONS and below) exact segments of one or two shingles would select badly for
  the same price, so these take half as many segments and index the one-deletion neighbourhood of each: a segment then
  covers two differences. In larger bands segments are exact, and there are a few more than H + 1 of them, so a document can do
  without its dearest: empty segments are left out if enough others remain, and so are those with contents that many
  documents share.
* Equal sets are one class from the start. Classes sharing a segment are candidates: all pairs in a small group; in a large one every
  class with the group's smallest class only.
* Candidates that share too few segments for any similarity are dropped: a class agrees with a partner on all but H of its own.
* The others are verified exactly on whole sets (64-bit shingle hashes), fetched for candidate documents alone; first
  each class's best pair, then pairs that would still join two components.
* A large group whose classes all ended in one component is done. A class that cannot do without its other large groups is cut anew, as
  finely as can be, into single shingles, among classes of this kind: it lacks at most a fifth of its shingles in
  a partner, so if more of them are rare, a partner shares a rare one. What is left are classes made almost wholly of
  shingles that many share; among themselves these are counted once more. Those with the same frequent shingles, their core, are linked as a star around the one with fewest others,
  and two of them at most stand for the core (see ``_leaders``). These meet by the rarest fifth of their shingles (see ``_rarest``):
  first with the group's class of fewest rare shingles, then across the components that are left. As they have no rare shingle in common, the numbers of their
  frequent ones bound the intersection, and only pairs that may be similar by that are listed (see ``_may_be_similar``). So no link that matters for a component is
  lost, and near copies that many changes keep apart cost no pairs.

Defined results: NULL texts and texts without words have an empty set, size 0, and are linked with nothing; fewer words than a
shingle make one shingle; repeated rows are in one class; a component's id is its smallest document id, NULL ids last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .exact_dedup import filter_bits
from .scratch import Scratch, released_shuffles
from .words import LOWER, column_bytes, distinct, mix, runs, shingles, words

WIDTH = 5
#: Least similarity as a fraction NUM / DEN: 100 * intersection >= 80 * union.
NUM, DEN = 4, 5
#: Size bands grow by this factor; it must be 1 / similarity at least, so partners lie in the same or neighbouring bands.
GROWTH = 1.6
WITH_DELETIONS = 40
#: Groups of more classes are handled by their smallest class first; the same for groups by single shingles.
SMALL, SMALL_BY_SHINGLE = 6, 16
#: Bits of the filter on candidate documents: 32 MB at most are broadcast; beyond, more documents pass it.
FILTER_BITS = 1 << 28


class Bands(NamedTuple):
    low: np.ndarray
    high: np.ndarray
    segments: np.ndarray
    deletions: np.ndarray


def differences(r: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The most elements in which similar sets of these sizes can differ."""
    return ((DEN - NUM) * (r + s)) // (DEN + NUM)


def size_bands(most: int = 1 << 40) -> Bands:
    low = [1]
    while low[-1] < most:
        low.append(max(low[-1] + 1, int(low[-1] * GROWTH)))
    low = np.array(low, np.int64)
    high = np.append(low[1:] - 1, np.iinfo(np.int64).max // 16)
    need = differences(high, high * DEN // NUM) + 1
    deletions = high <= WITH_DELETIONS
    return Bands(low, high, np.where(deletions, (need + 1) // 2, need + need // 8 + 1), deletions)


BANDS = size_bands()


class Sets(NamedTuple):
    """Distinct shingle hashes of rows, concatenated; offsets of the rows."""

    flat: np.ndarray
    offsets: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)


def sets_of(column: pa.Array) -> Iterator[tuple[int, int, Sets]]:
    """(first row, last row, sets) for runs of rows of bounded size."""
    data, offsets = column_bytes(column)
    for a, b in runs(offsets):
        w = words(LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a])
        yield a, b, Sets(*distinct(*shingles(w, b - a, WIDTH), b - a))


def digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def class_keys(digests: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """A 63-bit key of a class: 47 bits of the digest and the size, 65535 standing for all larger ones.

    Different sets with one key are told apart by their digests when they are verified.
    """
    head = np.array([int.from_bytes(d[:6], "little") >> 1 for d in digests], np.int64)
    return head << 16 | np.minimum(sizes, 65535)


def plan(sizes: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(band, segments, units needed) of each size in its own band or the one below; 0 segments where no partner can lie there."""
    band = np.searchsorted(BANDS.low, sizes, "right") - 1 - lower
    ok = (sizes > 0) & (band >= 0)
    band = np.maximum(band, 0)
    high = BANDS.high[band]
    if lower:
        ok &= high >= -(-sizes * NUM // DEN)
        partner = np.minimum(high, sizes)
    else:
        partner = sizes * DEN // NUM
    return band, np.where(ok, BANDS.segments[band], 0), differences(sizes, partner) + 1


def signatures(s: Sets, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature, spare): what a row is indexed by in its own band or the one below, and how many it can do without."""
    sizes = s.sizes
    band, m, need = plan(sizes, lower)
    base = np.concatenate([[0], np.cumsum(m)])
    row = np.repeat(np.arange(len(sizes)), sizes)
    used = m[row] > 0
    row, h = row[used], s.flat[used]
    at = base[row] + (mix(h ^ np.uint64(0x5851F42D4C957F2D)) % m[row].astype(np.uint64)).astype(np.int64)
    # contents of a segment: two sums of 26 bits and the count, exact in floats, and easy to take one element from
    x1, x2 = (h & np.uint64((1 << 26) - 1)).astype(float), ((h >> np.uint64(26)) & np.uint64((1 << 26) - 1)).astype(float)
    s1, s2, n = (np.bincount(at, w, minlength=base[-1]) for w in (x1, x2, np.ones(len(at))))
    owner = np.repeat(np.arange(len(sizes)), m)
    place = mix(band[owner].astype(np.uint64) << np.uint64(40) | (np.arange(base[-1]) - base[owner]).astype(np.uint64))

    def key(a: np.ndarray, b: np.ndarray, count: np.ndarray, where: np.ndarray) -> np.ndarray:
        return mix(mix(a.astype(np.uint64) + (count.astype(np.uint64) << np.uint64(44))) + b.astype(np.uint64)) ^ where

    full = np.bincount(owner[n > 0], minlength=len(sizes))
    spare = full - need
    deletions = BANDS.deletions[band]
    # empty segments only where the others do not suffice; with deletions every segment counts
    take = (n > 0) | (spare < 0)[owner] | deletions[owner]
    out_row, out = [owner[take]], [key(s1, s2, n, place)[take]]
    less = deletions[row]
    if less.any():
        g = at[less]
        out_row.append(row[less])
        out.append(key(s1[g] - x1[less], s2[g] - x2[less], n[g] - 1, place[g]))
    return np.concatenate(out_row), np.concatenate(out), np.where(deletions, -1, spare)


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, n, digest, node, spare0, spare1) of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, s in sets_of(b.column(1)):
                keys = [digest(s.flat[i:j]) for i, j in zip(s.offsets[:-1], s.offsets[1:], strict=True)]
                spare = [signatures(s, lower)[2] for lower in (False, True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, last - first), pa.array(s.sizes), pa.array(keys, pa.binary()), pa.array(class_keys(keys, s.sizes)), pa.array(spare[0]), pa.array(spare[1])],
                    names=["_id", "n", "digest", "node", "spare0", "spare1"],
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        each, f"_id {id_type}, n bigint, digest binary, node bigint, spare0 bigint, spare1 bigint"
    )


#: Classes a task remembers, so that copies are indexed once per task.
REMEMBERED = 200_000
LOWER_BAND = np.int64(-(1 << 63))


def _index(docs: DataFrame, text_col: str) -> DataFrame:
    """(sig, node); the sign of node tells whether the signature is one of the lower band."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for _, _, s in sets_of(b.column(0)):
                nodes = class_keys([digest(s.flat[i:j]) for i, j in zip(s.offsets[:-1], s.offsets[1:], strict=True)], s.sizes)
                fresh = np.zeros(len(nodes), bool)
                for k, node in enumerate(nodes.tolist()):
                    if node not in seen:
                        fresh[k] = True
                        if len(seen) < REMEMBERED:
                            seen.add(node)
                for lower in (False, True):
                    row, sig, _ = signatures(s, lower)
                    keep = fresh[row]
                    node = nodes[row[keep]]
                    yield pa.RecordBatch.from_arrays([pa.array(sig[keep].view(np.int64)), pa.array(node | LOWER_BAND if lower else node)], names=["sig", "node"])

    return docs.select(F.col(text_col).alias("_text")).mapInArrow(each, "sig bigint, node bigint")


def _may_match(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sizes in two keys allow the similarity."""
    x, y = a & 0xFFFF, b & 0xFFFF
    low, high = np.minimum(x, y), np.maximum(x, y)
    return (a != b) & ((high == 65535) | (low * DEN >= high * NUM))


#: Rows summed up before they leave a task.
SUMMED = 1 << 20
SALTS = (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n, x1, x2): in how many small groups a pair of classes meets; b is -1 for how many large ones a class is in.

    x1 and x2 are a digest of the signatures, whatever their order: two hashes of each, combined bit by bit.
    """
    held: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        rows = np.concatenate(held) if held else np.zeros((0, 3), np.int64)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        first = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])) if len(rows) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(rows)))
        sig = np.ascontiguousarray(rows[:, 2]).view(np.uint64)
        digests = [np.where(rows[first, 1] < 0, np.bitwise_xor.reduceat(mix(sig ^ np.uint64(salt)), first).view(np.int64), 0) if len(first) else np.zeros(0, np.int64) for salt in SALTS]
        return pa.RecordBatch.from_arrays([pa.array(rows[first, 0]), pa.array(rows[first, 1]), pa.array(n), *map(pa.array, digests)], names=["a", "b", "n", "x1", "x2"])

    for b in batches:
        sig, node, hub, large = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        held.append(np.column_stack([np.where(large, node, np.minimum(node, hub)), np.where(large, -1, np.maximum(node, hub)), sig]))
        if sum(map(len, held)) >= SUMMED:
            yield out()
            held.clear()
    yield out()


def _grouped(index: DataFrame, small: int = SMALL, summed: bool = False) -> DataFrame:
    """(sig, node, hub, large): candidates of every group, from rows sorted by signature; or their ``_sums``.

    In small groups hub runs over all classes before; in large ones it is the first. Memory: a batch and the last ``small`` classes.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        state: dict = {"sig": None, "first": None, "n": 0, "last": None}

        def out(sig: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
            # sig ascends, and node within it; a group that may go on is left for later unless it is long already
            plain = node & ~LOWER_BAND
            start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            size = np.diff(np.append(start, len(sig)))
            begin = np.repeat(start, size)
            large = np.repeat(size > small, size)
            hub = plain[begin]
            pairs = [(sig[large], node[large], hub[large], np.ones(int(large.sum()), bool))]
            for gap in range(1, small):
                k = np.flatnonzero(~large[gap:] & (sig[gap:] == sig[:-gap])) + gap
                k = k[_may_match(plain[k], plain[k - gap])]
                pairs.append((sig[k], node[k], plain[k - gap], np.zeros(len(k), bool)))
            cols = [np.concatenate(x) for x in zip(*pairs, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["sig", "node", "hub", "large"])

        for b in batches:
            sig = np.concatenate([left[0], b.column(0).to_numpy()])
            node = np.concatenate([left[1], b.column(1).to_numpy()])
            if not len(sig):
                continue
            # repeats, also of the group that goes on from before
            again = np.zeros(len(sig), bool)
            again[1:] = (sig[1:] == sig[:-1]) & (node[1:] == node[:-1])
            sig, node = sig[~again], node[~again]
            if state["sig"] is not None:  # a long group goes on: its rows need only its first class
                more = (sig == state["sig"]) & (node != state["last"])
                own = sig == state["sig"]
                if own.any():
                    k = int(more.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(sig[more]), pa.array(node[more]), pa.array(np.full(k, state["first"])), pa.array(np.ones(k, bool))], names=["sig", "node", "hub", "large"]
                    )
                    state["last"] = node[own][-1]
                    sig, node = sig[~own], node[~own]
                if not len(sig):
                    left = (sig, node)
                    continue
                state["sig"] = None
            cut = int(np.searchsorted(sig, sig[-1]))
            if cut:
                yield from out(sig[:cut], node[:cut])
            left = (sig[cut:], node[cut:])
            if len(left[0]) > small:
                yield from out(*left)
                state.update(sig=left[0][-1], first=left[1][0] & ~LOWER_BAND, last=left[1][-1])
                left = (sig[:0], node[:0])
        if len(left[0]):
            yield from out(*left)

    n = index.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = index.repartition(int(n), "sig").sortWithinPartitions("sig", "node")
    if summed:
        made = ordered.mapInArrow(lambda batches: _sums(each(batches)), "a bigint, b bigint, n bigint, x1 bigint, x2 bigint")
        return made.groupBy("a", "b").agg(F.sum("n").alias("n"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    return ordered.mapInArrow(each, "sig bigint, node bigint, hub bigint, large boolean")


def _wanted_bits(nodes: DataFrame) -> tuple[bytes, int]:
    """A filter on class keys: one bit per key, at bits of its digest; FILTER_BITS / 8 bytes at most."""
    size = min(FILTER_BITS, filter_bits(nodes.count()))
    parts = (
        nodes.select((F.shiftright("node", 16).bitwiseAND(F.lit(size - 1)) + 1).alias("h"))
        .groupBy(F.expr("bitmap_bucket_number(h)").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("bits")).collect()
    )
    whole = bytearray(size // 8)
    for p in parts:
        at = (p["bucket"] - 1) * 4096
        whole[at : at + 4096] = p["bits"]
    return bytes(whole), size


def _sets(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(node, digest, own): the sets of the classes whose key is ``wanted`` (and of few others), each once."""
    bits, size = _wanted_bits(wanted)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        table = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            for _, _, s in sets_of(b.column(0)):
                keys = [digest(s.flat[i:j]) for i, j in zip(s.offsets[:-1], s.offsets[1:], strict=True)]
                nodes, out = class_keys(keys, s.sizes), []
                at = (nodes >> 16) & (size - 1)
                for k in np.flatnonzero(((table[at >> 3] >> (at & 7)) & 1) & (s.sizes > 0)).tolist():
                    if keys[k] not in seen:
                        if len(seen) < REMEMBERED:
                            seen.add(keys[k])
                        out.append((nodes[k], keys[k], s.flat[s.offsets[k] : s.offsets[k + 1]].tobytes()))
                node, d, own = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(d, pa.binary()), pa.array(own, pa.binary())], names=["node", "digest", "own"])

    made = docs.select(F.col(text_col).alias("_text")).mapInArrow(each, "node bigint, digest binary, own binary")
    return made.dropDuplicates(["digest"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, da, db, common, together) of the pairs of class keys: sizes of intersection and union, exactly."""
    left = sets.select(F.col("node").alias("a"), F.col("digest").alias("da"), F.col("own").alias("own_a"))
    right = sets.select(F.col("node").alias("b"), F.col("digest").alias("db"), F.col("own").alias("own_b"))
    met = pairs.join(right, "b").join(left, "a").filter("da != db").select("a", "b", "da", "db", "own_a", "own_b")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            common, together = [], []
            for x, y in zip(b.column(4), b.column(5), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                n = int((both[1:] == both[:-1]).sum())
                common.append(n)
                together.append(len(both) - n)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(common, pa.int64()), pa.array(together, pa.int64())], names=["a", "b", "da", "db", "common", "together"])

    return met.mapInArrow(each, "a bigint, b bigint, da binary, db binary, common bigint, together bigint")


LINKED = f"common * {DEN} >= together * {NUM}"


def _plain(name: str):
    return F.col(name).bitwiseAND(F.lit((1 << 63) - 1))


def _spare(narrow: DataFrame) -> DataFrame:
    """(node, spare0, spare1): segments a class can do without, in its own band and the one below."""
    return narrow.groupBy("node").agg(F.min("spare0").alias("spare0"), F.min("spare1").alias("spare1"))


def _own_spare(signed: str):
    return F.when(F.col(signed) < 0, F.col("spare1")).otherwise(F.col("spare0"))


def _candidates(groups: DataFrame, narrow: DataFrame) -> DataFrame:
    """(a, b, shared): pairs that share enough segments to be similar.

    A class agrees with a partner on all but H of its segments, that is on more than it has to spare. It shares those with it in
    small groups, which list all pairs, or in large ones, of which there are only so many.
    """
    sized = [_plain(c).bitwiseAND(F.lit(0xFFFF)) for c in ("node", "hub")]
    may = (F.greatest(*sized) == 65535) | (F.least(*sized) * DEN >= F.greatest(*sized) * NUM)
    pairs = groups.filter(_plain("node") != F.col("hub")).filter(may).groupBy("node", "hub").agg(F.count_if(~F.col("large")).alias("small"), F.count(F.lit(1)).alias("shared"))
    large = groups.filter("large").groupBy("node").agg(F.count(F.lit(1)).alias("in_large"))
    met = pairs.join(large, "node", "left").withColumn("plain", _plain("node")).join(_spare(narrow).withColumnRenamed("node", "plain"), "plain")
    enough = F.col("small") + F.coalesce("in_large", F.lit(0)) > _own_spare("node")
    return met.filter(enough).groupBy(F.least("plain", "hub").alias("a"), F.greatest("plain", "hub").alias("b")).agg(F.max("shared").alias("shared"))


def _roots(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(digest, root): the component of every class that has a link."""
    return scratch.keep(components(found.select("da", "db"), scratch).select(F.col("node").alias("digest"), "root"))


def _linked(pairs: DataFrame, every: DataFrame, sets: DataFrame, doubled: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(links, roots) that connect what ``pairs`` connect: each class's best pair is verified first, then pairs across components."""
    best = pairs.select(F.explode(F.array("a", "b")).alias("one"), "a", "b", "shared").groupBy("one").agg(F.max(F.struct("shared", "a", "b")).alias("best"))
    first = scratch.keep(best.select("best.a", "best.b").unionByName(doubled).distinct())
    found = scratch.keep(_verified(first, sets).filter(LINKED).select("da", "db"))
    roots = _roots(found, scratch)
    # by key; a key that stands for several sets is in no component for this purpose
    known = every.join(roots, "digest", "left").groupBy("node").agg(F.max("root").alias("root"), F.count(F.lit(1)).alias("sets")).filter("sets = 1 and root is not null").select("node", "root")
    rest = scratch.keep(
        pairs.select("a", "b").join(first, ["a", "b"], "left_anti")
        .join(known.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(known.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
        .filter("ra is null or rb is null or ra != rb").select("a", "b")
    )
    needed = rest.select(F.col("a").alias("node")).unionByName(rest.select(F.col("b").alias("node"))).distinct()
    more = scratch.keep(_verified(rest, sets.join(needed, "node", "left_semi")).filter(LINKED).select("da", "db"))
    scratch.drop(first, rest)
    if more.isEmpty():
        return found, roots
    found = found.unionByName(more)
    return found, _roots(found, scratch)


def _by_shingle(sets: DataFrame, narrow: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(pairs that share enough single shingles, classes with too few rare shingles to be found by them).

    The latter as (node, x1, x2, frequent, rare, n): the digest and number of their frequent shingles, which are their core, how many they have besides, and in all.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(1)]
            node = np.repeat(b.column(0).to_numpy(), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own) if own else np.zeros(0, np.int64)), pa.array(node, pa.int64())], names=["sig", "node"])

    sums = scratch.keep(_grouped(sets.select("node", "own").mapInArrow(each, "sig bigint, node bigint"), SMALL_BY_SHINGLE, summed=True))
    # a key may stand for several sets: then the smallest size and all its frequent shingles count, which only finds more
    sizes = narrow.groupBy("node").agg(F.min("n").alias("n"))
    frequent = sums.filter("b = -1").select(F.col("a").alias("node"), F.col("n").alias("frequent"), "x1", "x2")
    doubled = sets.groupBy("node").agg(F.count(F.lit(1)).alias("held"))
    crowd = sizes.join(doubled, "node").join(frequent, "node", "left").fillna(0, ["frequent", "x1", "x2"])
    rare = F.col("n") - F.col("frequent")
    # a key of several sets has no core that others share
    alone = F.col("held") > 1
    core = [F.when(alone, F.col("node")).otherwise(F.col("x1")).alias("x1"), F.when(alone, F.lit(-1)).otherwise(F.col("x2")).alias("x2")]
    crowded = crowd.filter(rare <= F.floor(F.col("n") * (DEN - NUM) / DEN)).select("node", *core, "frequent", F.greatest(rare, F.lit(0)).alias("rare"), "n")
    pairs = sums.filter("b >= 0").select("a", "b", F.col("n").alias("small"))
    of = {s: crowd.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("frequent").alias(f"f_{s}")) for s in ("a", "b")}
    met = pairs.join(of["a"], "a").join(of["b"], "b")
    # sets with similarity t have t / (1 + t) of their sizes in common
    enough = (F.col("small") + F.least("f_a", "f_b")) * (NUM + DEN) >= (F.col("n_a") + F.col("n_b")) * NUM
    return met.filter(enough).select("a", "b"), crowded


CORE = ["x1", "x2", "frequent"]


def _core_links(crowded: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(da, db): classes of one core that are similar to its leader, the one with fewest other shingles.

    With a core of f shingles in common and r and s others, none of them shared, two classes are similar if r + s is f (1 - t) / t
    or less. Then both are similar to the leader, so all links of this kind in a core are a star.
    """
    named = crowded.join(sets.select("node", "digest"), "node")
    leaders = scratch.keep(named.groupBy(*CORE).agg(F.min(F.struct("rare", "node", "digest")).alias("first")))
    met = named.join(leaders, CORE).filter("x2 != -1 and node != first.node")
    return met.filter((F.col("rare") + F.col("first.rare")) * NUM <= F.col("frequent") * (DEN - NUM)).select(F.col("digest").alias("da"), F.col("first.digest").alias("db"))


def _leaders(crowded: DataFrame, own: DataFrame, scratch: Scratch) -> DataFrame:
    """The classes that stand for their cores: the one with fewest other shingles, and the first of those outside its component.

    If two classes of different components are similar and share frequent shingles only, so are two of these: fewer others
    make a class more similar to any other. A core that is still in several components comes up again in the next round.
    """
    placed = scratch.keep(crowded.join(own.groupBy("node").agg(F.min("root").alias("root")), "node"))
    first = scratch.keep(placed.groupBy(*CORE).agg(F.min(F.struct("rare", "node", "root")).alias("first")))
    second = placed.join(first, CORE).filter("root != first.root").groupBy(*CORE).agg(F.min(F.struct("rare", "node")).alias("second"))
    return first.select(F.col("first.node").alias("node")).unionByName(second.select(F.col("second.node").alias("node"))).distinct()


def _across(docs: DataFrame, text_col: str, groups: DataFrame, narrow: DataFrame, every: DataFrame, roots: DataFrame, known: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Links across components within large groups, beyond those to a group's first class; None if there can't be any."""
    own = every.join(roots, "digest", "left").select("node", F.coalesce("root", "digest").alias("root"))
    members = scratch.keep(groups.select("sig", F.col("node").alias("signed"), _plain("node").alias("node")).distinct().join(own, "node"))
    mixed = members.groupBy("sig").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 != r2").select("sig")
    in_mixed = scratch.keep(members.join(mixed, "sig"))
    scratch.drop(members)
    # a class that can do without all its mixed groups is found by its other segments
    dear = (
        in_mixed.select("sig", "signed", "node").distinct().groupBy("signed", "node").agg(F.count(F.lit(1)).alias("dear")).join(_spare(narrow), "node")
        .filter(F.col("dear") > F.greatest(F.lit(0), _own_spare("signed"))).select("signed")
    )
    members = scratch.keep(in_mixed.join(dear, "signed").select("sig", "node", "root").distinct())
    scratch.drop(in_mixed)
    if members.isEmpty():
        return None
    sets = scratch.keep(_sets(docs, members.select("node").distinct(), text_col))
    by_shingle, crowded = _by_shingle(sets, narrow, scratch)
    # counted again among themselves, fewer shingles are frequent
    sets_of_crowd = scratch.keep(sets.join(crowded.select("node"), "node", "left_semi"))
    again, crowded = _by_shingle(sets_of_crowd, narrow, scratch)
    crowded = scratch.keep(crowded)
    by_shingle = by_shingle.unionByName(again).distinct()
    found = scratch.keep(_verified(by_shingle, sets).filter(LINKED).select("da", "db").unionByName(_core_links(crowded, sets_of_crowd, scratch)))
    scratch.drop(sets)
    if crowded.isEmpty():
        return found
    sets = scratch.keep(sets_of_crowd.join(crowded.select("node"), "node", "left_semi"))
    scratch.drop(sets_of_crowd)
    members = scratch.keep(_rarest(sets, scratch).join(crowded.select("node", "n", "frequent", "rare"), "node"))
    tried = None
    while True:
        roots = _roots(known.unionByName(found), scratch)
        own = every.join(roots, "digest", "left").select("node", F.coalesce("root", "digest").alias("root"))
        leading = scratch.keep(_leaders(crowded, own, scratch))
        placed = scratch.keep(members.join(leading, "node", "left_semi").join(own, "node"))
        pairs = scratch.keep(_to_centres(placed) if tried is None else _between(placed).join(tried, ["a", "b"], "left_anti"))
        needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        more = scratch.keep(_verified(pairs, sets.join(needed, "node", "left_semi")).filter(LINKED).select("da", "db"))
        scratch.drop(placed, leading, roots)
        if tried is not None and more.isEmpty():
            return found
        tried = pairs if tried is None else scratch.keep(tried.unionByName(pairs))
        found = scratch.keep(found.unionByName(more))


def _rarest(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(sig, node): the shingles by which ``sets`` find each other, of each set the rarest fifth and one more.

    Similar sets lack at most a fifth of their own shingles in each other. So whatever the order of all shingles, the first that both hold is
    among so many of either; with the rarest first, the shingles that most sets hold make no groups.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(2)]
            n = np.array([len(x) for x in own], np.int64)
            row = np.repeat(np.arange(len(own)), n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(own) if own else n), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(n[row])], names=["sig", "node", "digest", "n"]
            )

    held = scratch.keep(sets.select("node", "digest", "own").mapInArrow(each, "sig bigint, node bigint, digest binary, n bigint"))
    often = held.groupBy("sig").agg(F.count(F.lit(1)).alias("often"))
    order = Window.partitionBy("digest").orderBy("often", "sig")
    first = held.join(often, "sig").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= F.floor(F.col("n") * (DEN - NUM) / DEN) + 1)
    return first.filter("often > 1").select("sig", "node").distinct()


def _may_be_similar(n: str, frequent: str, other_n: str, other_frequent: str):
    """Whether two classes without a rare shingle in common may be similar: they share no more than the fewer frequent ones.

    Given the least size and most frequent shingles of several classes, whether one of them may be.
    """
    return F.least(frequent, other_frequent) * (NUM + DEN) >= (F.col(n) + F.col(other_n)) * NUM


def _to_centres(members: DataFrame) -> DataFrame:
    """(a, b): of the members (sig, node, n, frequent, rare, root) of groups, each with the group's class of fewest rare shingles.

    That one is likeliest to be similar to others: what it joins needs no pairs afterwards.
    """
    first = members.groupBy("sig").agg(F.min(F.struct("rare", "node", "root", "n", "frequent")).alias("first"))
    first = first.select("sig", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("node", "root", "n", "frequent")])
    met = members.join(first, "sig").filter((F.col("root") != F.col("first_root")) & _may_be_similar("n", "frequent", "first_n", "first_frequent"))
    return met.filter("node != first_node").select(F.least("node", "first_node").alias("a"), F.greatest("node", "first_node").alias("b")).distinct()


def _between(members: DataFrame) -> DataFrame:
    """(a, b): pairs across components among the members (sig, node, n, frequent, rare, root) of groups that may be similar.

    A class meets a component only if one of its classes there may be similar, and each pair is met from one side alone.
    """
    parts = members.groupBy("sig", F.col("root").alias("other")).agg(F.min("n").alias("least_n"), F.max("frequent").alias("most_frequent"))
    near = members.join(parts, "sig").filter((F.col("root") < F.col("other")) & _may_be_similar("n", "frequent", "least_n", "most_frequent"))
    others = members.select("sig", F.col("root").alias("other"), F.col("node").alias("y"), F.col("n").alias("n_y"), F.col("frequent").alias("frequent_y"))
    met = near.select("sig", "other", "node", "n", "frequent").join(others, ["sig", "other"]).filter((F.col("node") != F.col("y")) & _may_be_similar("n", "frequent", "n_y", "frequent_y"))
    return met.select(F.least("node", "y").alias("a"), F.greatest("node", "y").alias("b")).distinct()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, n_shingles, component_id) of every row of ``docs``."""
    with released_shuffles(docs.sparkSession):
        return _similar_groups(docs, id_col, text_col, Scratch(docs.sparkSession))


def _similar_groups(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    narrow = scratch.keep(_narrow(docs, id_col, text_col))
    groups = scratch.keep(_grouped(_index(docs, text_col)))
    # different sets under one key
    doubled = narrow.filter("n > 0").groupBy("node").agg(F.min("digest").alias("d1"), F.max("digest").alias("d2")).filter("d1 != d2").select(F.col("node").alias("a"), F.col("node").alias("b"))
    pairs = scratch.keep(_candidates(groups, narrow))
    large = scratch.keep(groups.filter("large"))
    scratch.drop(groups)
    wanted = scratch.keep(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).unionByName(doubled.select("a")).distinct().withColumnRenamed("a", "node"))
    sets = scratch.keep(_sets(docs, wanted, text_col))
    every = scratch.keep(narrow.filter("n > 0").select("node", "digest").distinct())
    found, roots = _linked(pairs, every, sets, doubled, scratch)
    scratch.drop(pairs, sets, wanted)
    more = _across(docs, text_col, large, narrow, every, roots, found, scratch)
    if more is not None and not more.isEmpty():
        roots = _roots(found.unionByName(more), scratch)
    least = narrow.filter("n > 0").groupBy("digest").agg(F.min("_id").alias("least")).join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    of = least.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = narrow.join(least.join(of, "root").select("digest", "component_id"), "digest", "left")
    return joined.select("_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "_id").alias("component_id"))
