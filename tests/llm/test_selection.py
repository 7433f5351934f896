"""Importance resampling and centroid clustering against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlab.llm import centroids, resampling

FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# ---- importance resampling

def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def runs_of(text, longest):
    w = FEATURE.findall(lower(text))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def resampled(rows, target, longest=1, buckets=10_000, seed=2024, share=(10, 100), least=20):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for f in runs_of(t, longest)[1]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = counts(x for _, x in rows), counts(target)
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (S + buckets) / ((a + 1) * (T + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, x in rows:
        n_words, f = runs_of(x, longest)
        weight = sum(gain[zlib.crc32(y.encode()) % buckets] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n_words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: share[0] * len(able) // share[1]])}
    return [(r[0], r[2], r[3], r[4], ranks.get(id(r))) for r in out]


def some_texts(n):
    random.seed(5)
    vocabulary = ["the", "Of", "und", "straße", "漢字", "x1", "a" * 60, "tea", "7"] + [f"w{k}" for k in range(40)]
    return [(k, " ".join(random.choices(vocabulary, k=random.randint(0, 60))).replace("w1 ", "w1-")) for k in range(n)]


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_as_by_brute_force(spark, longest):
    rows = some_texts(400)
    rows += [(1000 + k, rows[7][1]) for k in range(150)]  # copies differ by their noise alone
    target = [x for _, x in rows[:15]] + [None, ""]
    frame = spark.createDataFrame(random.sample(rows, len(rows)), "doc_id long, text string").repartition(5)
    wanted = spark.createDataFrame([(x,) for x in target], "text string")
    got = resampling.resample(frame, wanted, longest=longest)
    assert got.columns == ["_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(resampled(rows, target, longest))


def test_resampling_cuts_ties_by_id_and_repeated_rows_by_number(spark):
    few = [(5, "a b c")] * 7 + [(None, "a b c")] * 3 + [(2, "a b c")] * 2
    for share in [(k, 12) for k in range(13)]:
        got = resampling.resample(spark.createDataFrame(few, "doc_id long, text string"), spark.createDataFrame([], "text string"), share=share, least_words=1).collect()
        ranks = sorted(r["rank"] for r in got if r["rank"])
        assert ranks == list(range(1, share[0] + 1))
        want = sorted(x[4] for x in resampled(few, [], share=share, least=1) if x[4])
        assert ranks == want
        drawn = sorted(((r["score"], r["_id"]) for r in got if r["rank"]), key=str)
        assert drawn == sorted(((x[3], x[0]) for x in resampled(few, [], share=share, least=1) if x[4]), key=str)


def test_equal_scores_are_cut_by_id(spark):
    rows = spark.range(1000).select(F.col("id").alias("_id"), (F.col("id") % 3).alias("score")).withColumn("row", F.monotonically_increasing_id())
    for wanted in (1, 333, 334, 500, 667, 999, 1000):
        got = [tuple(r) for r in resampling.ranked(rows.filter(resampling.draw(rows, wanted)), 4).select("score", "_id", "rank").collect()]
        want = sorted(((k % 3, k) for k in range(1000)), key=lambda r: (-r[0], r[1]))[:wanted]
        assert sorted(got, key=lambda r: r[2]) == [(s, i, n + 1) for n, (s, i) in enumerate(want)]
    assert rows.filter(resampling.draw(rows, 0)).count() == 0


def test_resampling_odd_rows(spark, odd, odd_rows):
    target = spark.createDataFrame([("a b c",)], "text string")
    got = resampling.resample(odd, target, least_words=1, share=(1, 2)).collect()
    want = resampled(odd_rows, ["a b c"], least=1, share=(1, 2))
    # equal rows are ranked in any order
    assert sorted((str(tuple(r)[:4]) for r in got)) == sorted(str(x[:4]) for x in want)
    assert sorted((r["rank"], str(r["_id"]), r["score"]) for r in got if r["rank"]) == sorted((x[4], str(x[0]), x[3]) for x in want if x[4])
    assert resampling.resample(odd.limit(0), target).count() == 0
    assert resampling.resample(odd, target.limit(0)).count() == len(odd_rows)


def test_crc_of_arrays():
    pieces = [b"", b"a", b"abc", "straße".encode(), b"x" * 39, b"x" * 40, b"x" * 41, b"y" * 3000]
    data = np.frombuffer(b"".join(pieces), np.uint8)
    end = np.cumsum([len(p) for p in pieces])
    start = end - [len(p) for p in pieces]
    for before in (0, zlib.crc32(b"before ")):
        got = resampling.crc_after(np.full(len(pieces), before, np.uint32), data, start, end)
        assert got.tolist() == [zlib.crc32(p, before) for p in pieces]


# ---- centroid clustering

def clustered(rows, k=16, rounds=3, seed=1, dims=64, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    now = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in now]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        at = assign()
        for c in range(len(now)):
            own = [v for (_, v), (own_c, _) in zip(kept, at) if own_c == c]
            if own:
                now[c] = [sum(col) // len(own) for col in zip(*own)]
    at = assign()
    within = [sum(d for c, d in at if c == x) for x in range(len(now))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return [(i, c, d, within[c], sum(within), sha[c]) for (i, _), (c, d) in zip(kept, at)]


def vectors(n, dims, hot=0):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(5, dims))
    rows = [(k, [float(np.float32(x)) for x in middle[k % 5] + rng.normal(size=dims) * 0.3]) for k in range(n)]
    return rows + [(n + k, rows[0][1]) for k in range(hot)]


def bad(dims):
    return [(9001, None), (9002, []), (9003, [0.5] * (dims + 1)), (9004, [None] + [0.5] * (dims - 1)), (9005, [float("nan")] + [0.5] * (dims - 1)),
            (9006, [0.5] * (dims - 1) + [float("-inf")])]


@pytest.mark.parametrize("dims,k,kind", [(64, 16, "float"), (3, 4, "double"), (2, 7, "float")])
def test_clusters_as_by_brute_force(spark, dims, k, kind):
    rows = vectors(300, dims, hot=150) + bad(dims) + [(7, [0.25] * dims), (7, [0.25] * dims), (None, [-0.25] * dims)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, distance int").repartition(4)
    got = centroids.cluster(frame, k=k, dims=dims)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, clustered(rows, k=k, dims=dims)))


def test_few_vectors_empty_clusters_and_empty_tables(spark):
    rows = [(k, [0.0, 0.0]) for k in range(6)] + [(10, [3.0, 4.0])]  # ties: equal centroids, all but the first stay empty
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = centroids.cluster(frame, k=20, dims=2)
    assert sorted(map(tuple, got.collect())) == sorted(clustered(rows, k=20, dims=2))
    for none in (frame.limit(0), spark.createDataFrame(bad(2), "vec_id long, embedding array<double>")):
        empty = centroids.cluster(none, dims=2)
        assert empty.count() == 0 and empty.columns == got.columns


def test_huge_components_are_clipped(spark):
    rows = [(k, [float(k), 0.0]) for k in range(5)] + [(5, [1e30, 0.0]), (6, [-3e38, 1.0])]
    got = {r["_id"]: r for r in centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, dims=2).collect()}
    assert len(got) == 7 and all(r["distance"] >= 0 for r in got.values())
    assert got[5]["cluster"] != got[6]["cluster"]


def test_tournament_names_the_nearest_with_ties_to_the_smaller():
    rng = np.random.default_rng(8)
    c, x = rng.integers(-3, 4, (9, 4)), rng.integers(-3, 4, (4000, 4))
    t = centroids.Tournament(c)
    every = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (t.nearest(x) == every.argmin(axis=1)).all() and (t.distances(x, t.nearest(x)) == every.min(axis=1)).all()
    assert centroids.integers(pa.array([[0.5, -0.01], None, [1.0]]), 2, 64.0)[1].tolist() == [[32, -1]]
