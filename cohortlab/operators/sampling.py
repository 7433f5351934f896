"""Holdouts and folds by hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import digest, hash_key, poisson_weight
from ..session import broadcast_if_small
from .ordering import HASH_BUCKETS, counts_by_hash, rank_by_hash


def class_quotas(df: DataFrame, label: str, test_size: float) -> DataFrame:
    """Test rows per class: floors of the exact shares, the rest by largest remainder.

    One row per class; the total is ceil(test_size * n).
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    everything = Window.partitionBy(F.lit(0))
    shared = (
        counts.withColumn("n_all", F.sum("n_class").over(everything))
        .withColumn("n_test", F.ceil(F.col("n_all") * F.lit(test_size)))
        .withColumn("share", F.col("n_class") * F.col("n_test") / F.col("n_all"))
        .withColumn("base", F.floor("share"))
        .withColumn("left", F.col("n_test") - F.sum("base").over(everything))
    )
    by_rest = everything.orderBy((F.col("share") - F.col("base")).desc(), F.col(label))
    return shared.select(
        label,
        (F.col("base") + (F.row_number().over(by_rest) <= F.col("left")).cast("long")).alias("quota"),
    )


def _below_quota(df: DataFrame, part: list[str], quotas: DataFrame, seed, id_col: str) -> DataFrame:
    """Add ``part`` = test for the first ``quota`` rows per ``part`` columns in hash order, else train.

    No row is moved: bucket counts show in which hash bucket the quota runs out, the rows of that
    bucket alone (one in 4096) are ranked to find the last test row, and every row is compared with it.
    """
    shift = 52 - (HASH_BUCKETS.bit_length() - 1)
    slim = df.select(*part, id_col).withColumn("_hk", hash_key(seed, id_col)).withColumn("_bkt", F.shiftright("_hk", shift))
    upto = Window.partitionBy(*(part or [F.lit(0)])).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, 0)
    counts = slim.groupBy(*part, "_bkt").agg(F.count(F.lit(1)).alias("n")).withColumn("cum", F.sum("n").over(upto))
    quotas = quotas.filter(F.col("quota") > 0)
    joined = counts.join(quotas, part) if part else counts.withColumn("quota", quotas.select("quota").scalar())
    edge = joined.filter((F.col("cum") >= F.col("quota")) & (F.col("cum") - F.col("n") < F.col("quota")))
    edge = broadcast_if_small(edge.select(*part, "_bkt", (F.col("quota") - F.col("cum") + F.col("n")).alias("_need")))
    order = Window.partitionBy(*(part or [F.lit(0)])).orderBy("_hk", id_col)
    ranked = slim.join(edge, [*part, "_bkt"]).withColumn("_r", F.row_number().over(order))
    last = ranked.filter(F.col("_r") == F.col("_need")).select(*part, F.struct(F.col("_hk"), F.col(id_col).alias("_id")).alias("_last"))
    mine = F.struct(hash_key(seed, id_col).alias("_hk"), F.col(id_col).alias("_id"))
    if part:
        out = df.join(broadcast_if_small(last), part, "left")
    else:
        out = df.withColumn("_last", last.select("_last").scalar())
    return out.withColumn("part", F.when(mine <= F.col("_last"), "test").otherwise("train")).drop("_last")


def stratified_split(df: DataFrame, label: str = "label", test_size: float = 0.2, seed=42, id_col: str = "row_id") -> DataFrame:
    """Add ``part`` = train/test keeping class shares. Rows without a label are left out."""
    known = df.filter(F.col(label).isNotNull())
    quotas = broadcast_if_small(class_quotas(known, label, test_size))
    return _below_quota(known, [label], quotas, seed, id_col)


def random_split(df: DataFrame, test_size: float = 0.2, seed=42, id_col: str = "row_id") -> DataFrame:
    """Add ``part`` = train/test; exactly ceil(test_size * n) test rows."""
    quota = df.agg(F.ceil(F.count(F.lit(1)) * F.lit(test_size)).alias("quota"))
    return _below_quota(df, [], quota, seed, id_col)


def stratified_kfold(df: DataFrame, label: str = "label", k: int = 5, seed=42, id_col: str = "row_id", out: str = "fold") -> DataFrame:
    """Add a fold number 0..k-1, spread evenly inside each class."""
    ranked = rank_by_hash(df.filter(F.col(label).isNotNull()), [label], seed, id_col, "_rank")
    return ranked.withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def kfold(df: DataFrame, k: int = 5, seed=42, id_col: str = "row_id", out: str = "fold") -> DataFrame:
    """Add a fold number 0..k-1; fold sizes differ by at most one."""
    ranked = rank_by_hash(df, [], seed, id_col, "_rank")
    return ranked.withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def nested_folds(df: DataFrame, k_out: int = 5, k_in: int = 3, label: str | None = "label", seed=42, id_col: str = "row_id") -> DataFrame:
    """One row per (outer fold, training row of it) with the inner fold, drawn afresh per outer fold."""
    if label is None:
        folded = kfold(df, k_out, seed, id_col, "_own")
    else:
        folded = stratified_kfold(df, label, k_out, seed, id_col, "_own")
    outer = folded.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(k_out - 1))))
    train = outer.filter(F.col("outer_fold") != F.col("_own")).drop("_own")
    keys = ["outer_fold"] + ([label] if label else [])
    ranked = rank_by_hash(train, keys, f"{seed}-inner", id_col, "_rank")
    return ranked.withColumn("inner_fold", ((F.col("_rank") - 1) % k_in).cast("int")).drop("_rank")


def nested_columns(df: DataFrame, k_out: int = 5, k_in: int = 3, label: str | None = "label", seed=42, id_col: str = "row_id") -> DataFrame:
    """Adds ``outer_fold`` and, per outer fold f, ``inner_<f>``: the inner fold of its training rows, NULL for its own.

    The folds are those of ``nested_folds``, side by side: one shuffle ranks the rows for all outer folds.
    """
    folded = kfold(df, k_out, seed, id_col, "outer_fold") if label is None else stratified_kfold(df, label, k_out, seed, id_col, "outer_fold")
    inside = {f"inner_{f}": (F.col("outer_fold") != f).cast("int") for f in range(k_out)}
    ranked = counts_by_hash(folded, [label] if label else [], inside, f"{seed}-inner", id_col)
    return ranked.withColumns({f"inner_{f}": F.when(F.col("outer_fold") != f, (F.col(f"inner_{f}") - 1) % k_in).cast("int") for f in range(k_out)})


def bootstrap_weights(df: DataFrame, replicates: int, seed=42, id_col: str = "row_id") -> DataFrame:
    """Long form ``(id, replicate, w)`` of Poisson(1) bootstrap weights; zero weights are left out.

    Four replicates share one digest. Metrics should use the aggregated forms in
    ``functions.bootstrap``, which never materialise this table.
    """
    blocks = (replicates + 3) // 4
    hexes = df.select(id_col, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))
    hexes = hexes.withColumn("_h", digest(seed, "_b", id_col))
    draws = F.array(*[
        F.struct(
            (F.col("_b") * 4 + i).alias("replicate"),
            poisson_weight(f"substring(_h, {1 + 8 * i}, 8)").alias("w"),
        )
        for i in range(4)
    ])
    return (
        hexes.select(id_col, F.inline(draws))
        .filter((F.col("w") > 0) & (F.col("replicate") < replicates))
    )


def concat_train_test(train: DataFrame, test: DataFrame) -> DataFrame:
    """Stack both parts; ``part`` tells where a row came from."""
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
