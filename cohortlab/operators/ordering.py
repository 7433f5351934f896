"""Ranks, running sums and order statistics that never sort everything in one task.

A window without partition keys sends all rows to one task. Here the order is cut into buckets
first: bucket totals (a small table) give each bucket its offset, and the window runs inside a
bucket only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_key
from ..session import counted_broadcast, cut_lineage

HASH_BUCKETS = 4096


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join where NULL keys meet NULL keys; the key columns of ``left`` are kept."""
    renamed = reduce(lambda d, k: d.withColumnRenamed(k, f"_r_{k}"), keys, right)
    cond = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    )
    return left.join(renamed, cond).drop(*[f"_r_{k}" for k in keys])


def running_sums(
    df: DataFrame,
    keys: list[str],
    bucket: str,
    order: list[Column],
    sums: dict[str, str],
    descending: bool = False,
) -> DataFrame:
    """Inclusive running sum of each ``sums`` source column, per ``keys``, along bucket then order.

    ``bucket`` must be monotone in ``order``; with ``descending`` the buckets run downwards.
    """
    totals = df.groupBy(*keys, bucket).agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    step = F.col(bucket).desc() if descending else F.col(bucket).asc()
    before = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy(step)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *keys,
        bucket,
        *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums],
    )
    inside = (
        Window.partitionBy(*keys, bucket)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    # the offsets are worked out once; while they fit a broadcast, the window's shuffle is the only one
    windowed = df.select("*", *[F.sum(c).over(inside).alias(f"_w_{o}") for o, c in sums.items()])
    joined = _null_safe(windowed, counted_broadcast(offsets), [*keys, bucket])
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_o_{o}") + F.col(f"_w_{o}")).alias(o) for o in sums],
    )


def rank_by_hash(
    df: DataFrame,
    part: list[str],
    seed=42,
    id_col: str = "row_id",
    out: str = "rank",
    buckets: int = HASH_BUCKETS,
) -> DataFrame:
    """Row number 1..n per ``part`` in hash order (ties by id), spread over ``buckets`` windows."""
    return counts_by_hash(df, part, {out: F.lit(1)}, seed, id_col, buckets)


def counts_by_hash(df: DataFrame, part: list[str], counted: dict[str, Column], seed=42, id_col: str = "row_id", buckets: int = HASH_BUCKETS) -> DataFrame:
    """Adds, per name, the running sum of a whole number per ``part`` in hash order; with 0 and 1 the rank among the rows that have 1."""
    keyed = df.withColumn("_hk", hash_key(seed, id_col)).withColumns({f"_one_{o}": c.cast("bigint") for o, c in counted.items()})
    bucketed = keyed.withColumn("_bkt", F.shiftright("_hk", 52 - (buckets.bit_length() - 1)))
    order = [F.col("_hk"), F.col(id_col)]
    sums = {o: f"_one_{o}" for o in counted}
    return running_sums(bucketed, part, "_bkt", order, sums).drop("_hk", "_bkt", *sums.values())


def value_buckets(df: DataFrame, col: str, n: int = 256, out: str = "_bkt") -> DataFrame:
    """Number ``n`` value ranges holding about equally many rows; equal values share a range.

    The edges are ``n - 1`` doubles on the driver. Any edges give right results downstream; good
    ones only balance the work.
    """
    edges = df.approxQuantile(col, [i / n for i in range(1, n)], 1.0 / (4 * n))
    splits = [float("-inf"), *sorted(set(edges)), float("inf")]
    return Bucketizer(splits=splits, inputCol=col, outputCol=out, handleInvalid="keep").transform(df)


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], eps: float = 0.001) -> DataFrame:
    """Exact interpolated quantiles ``(feature, prob, value)`` of many columns.

    A rank sketch brackets every quantile first (its rank error is bounded by ``eps``). Then one scan
    counts the rows below each bracket, and one keeps the values inside: about ``6 * eps`` of them are
    shuffled instead of all. A bracket that missed would show in the counts and raise. The driver sees
    a few numbers per column and quantile. NaN counts as missing; a column without values has NULL quantiles.
    """
    df = df.selectExpr(*[f"nanvl(CAST(`{c}` AS DOUBLE), CAST(NULL AS DOUBLE)) AS `{c}`" for c in cols])
    counts = df.selectExpr(*[f"count(`{c}`) AS _{i}" for i, c in enumerate(cols)]).first()
    pad = [3 * eps + 2 / max(n, 1) for n in counts]
    asks = sorted({min(max(q + s * w, 0.0), 1.0) for q in probs for w in pad for s in (-1, 1)})
    sketch = [dict(zip(asks, got)) for got in df.approxQuantile(cols, asks, eps)]
    inf, cells = float("inf"), []
    for i, c in enumerate(cols):
        for q in probs if counts[i] else []:
            a, b = q - pad[i], q + pad[i]
            cells.append((c, float(q), sketch[i][a] if a > 0 else -inf, sketch[i][b] if b < 1 else inf, float((counts[i] - 1) * q)))
    num = [(f"CAST(`{c}` AS DOUBLE)", f"double('{float(lo)}')", f"double('{float(hi)}')") for c, _, lo, hi, _ in cells]
    below = df.selectExpr(*[f"count_if({x} < {lo}) AS _{i}" for i, (x, lo, _) in enumerate(num)]).first()
    structs = ", ".join(f"struct({i} AS cell, {x} AS x, {lo} AS lo, {hi} AS hi)" for i, (x, lo, hi) in enumerate(num))
    inside = df.where(" OR ".join(f"{x} BETWEEN {lo} AND {hi}" for x, lo, hi in num)).selectExpr(
        f"inline(filter(array({structs}), s -> s.x BETWEEN s.lo AND s.hi))"
    )
    spread = "IF(abs(lo) < double('inf') AND abs(hi) < double('inf') AND lo < hi, floor((x - lo) / (hi - lo) * 255), 0)"
    counted = inside.selectExpr("cell", f"CAST({spread} AS INT) AS _bkt", "x").groupBy("cell", "_bkt", "x").agg(F.count(F.lit(1)).alias("cnt"))
    ranked = running_sums(cut_lineage(counted), ["cell"], "_bkt", [F.col("x")], {"cum": "cnt"})
    table = df.sparkSession.createDataFrame(
        [(i, c, q, pos, pos - below[i]) for i, (c, q, _, _, pos) in enumerate(cells)],
        "cell int, feature string, prob double, pos double, r double",
    )

    def at(r: str) -> str:
        return f"max(CASE WHEN cum - cnt <= {r} AND {r} < cum THEN x END)"

    picked = table.join(ranked, "cell", "left").groupBy("feature", "prob", "pos").agg(
        F.expr(at("floor(r)")).alias("a"), F.expr(at("ceil(r)")).alias("b")
    )
    found = picked.selectExpr("feature", "prob", "coalesce(a + (b - a) * (pos - floor(pos)), CAST(raise_error('quantile bracket missed') AS DOUBLE)) AS value")
    empty = [(c, float(q), None) for i, c in enumerate(cols) if not counts[i] for q in probs]
    return found.unionByName(df.sparkSession.createDataFrame(empty, found.schema)) if empty else found
