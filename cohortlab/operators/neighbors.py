"""Exact k-nearest-neighbour join and the oversampling built on it.

No cross join: rows lie in the leaves of a pivot tree (``pivot_tree``), and a query visits only leaves within its own search radius.
Of all it sees, a query keeps the k nearest. Copies of a vector are folded into one row first, so a vector that holds a third of the
table costs as much as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform
from ..session import cut_lineage
from .ordering import rank_by_hash
from .pivot_tree import QUERY_BLOCK, PivotTree


def _fold_copies(df: DataFrame, group: list[str], vec: str, id_col: str, keep: int) -> DataFrame:
    """One row per distinct vector with its ``keep`` smallest ids (cut map-side before the shuffle)."""
    w = Window.partitionBy(*group, vec).orderBy(id_col)
    first = df.select(*group, vec, id_col).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep)
    return first.groupBy(*group, vec).agg(F.array_sort(F.collect_list(id_col)).alias("ids"))


def _group_number(base: DataFrame, group: list[str]) -> Column:
    """The number of a row's group; groups have few values."""
    if not group:
        return F.lit(0)
    name = F.concat_ws("|", *[F.col(g).cast("string") for g in group])
    names = sorted(r[0] for r in base.select(name).distinct().collect())
    return F.element_at(F.create_map(*[v for i, n in enumerate(names) for v in (F.lit(n), F.lit(i))]), name)


def knn_join(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    p: int = 2,
    vec: str = "features",
    id_col: str = "row_id",
    group: list[str] = (),
    exclude_self: bool = False,
    rows_per_leaf: int | None = None,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The k nearest base rows of every query row: ``(id, neighbor_id, distance, rank)``.

    ``vec`` is an array of doubles, ``p`` 1 or 2, ties go to the smaller id. ``group`` columns
    (integers, few values) must be equal on both sides. Exact for any data.
    """
    group = list(group)
    keep = k + 1 if exclude_self else k
    # both are read several times below: keep them as files
    s_all = cut_lineage(_fold_copies(base, group, vec, id_col, keep))
    first = s_all.select(F.size(vec).alias("n")).first()
    if first is None:
        return queries.sparkSession.createDataFrame([], f"{id_col} long, neighbor_id long, distance double, rank int")
    number, x = _group_number(s_all, group), F.col(vec).cast("array<double>").alias("x")
    tree = PivotTree(s_all.select(number.alias("g"), x, F.col("ids").cast("array<bigint>").alias("ids")), first["n"], p, rows_per_leaf)
    # one id stands for all queries with the same vector
    if queries is base:
        q_all = s_all.select(*group, vec, F.col("ids")[0].alias("_q"))
        found = tree.nearest(None, keep, query_block)
    else:
        q_all = cut_lineage(queries.groupBy(*group, vec).agg(F.min(id_col).alias("_q")))
        asked = q_all.select(number.alias("g"), x, F.col("_q").cast("long").alias("q"))
        found = tree.nearest(asked.filter("g is not null"), keep, query_block)

    # back to rows: at most ``keep`` neighbours per distinct vector
    named = q_all.select(*group, vec, F.col("_q").alias("q")).join(found, "q").drop("q")
    rows = queries.select(id_col, *group, vec).join(named, [*group, vec]).select(id_col, "near")
    near = F.filter("near", lambda s: s["neighbor_id"] != F.col(id_col)) if exclude_self else F.col("near")
    return rows.select(id_col, F.posexplode(F.slice(near, 1, k)).alias("_i", "_s")).select(
        id_col, F.col("_s.neighbor_id").alias("neighbor_id"), F.col("_s.distance").alias("distance"), (F.col("_i") + 1).alias("rank")
    )


def smote(df: DataFrame, label: str = "label", k: int = 5, seed=42, vec: str = "features", id_col: str = "row_id", **join_options) -> DataFrame:
    """Synthetic rows ``(synthetic_id, label, base_id, neighbor_id, features)`` that fill every class up
    to the largest one: x + u (x' - x) with x' among the k nearest rows of the same class.

    Base row, neighbour and u are hash draws, so the result does not depend on the partitioning.
    """
    spark = df.sparkSession
    # one row per class
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    top = max(sizes.values())
    minor = df.filter(F.col(label).isin([c for c, n in sizes.items() if n < top])).select(id_col, label, vec)
    draws = None
    for c, n in sorted(sizes.items()):
        if n < top:
            one = spark.range(top - n).select(F.lit(c).cast("long").alias(label), F.col("id").alias("draw"), F.lit(n).alias("_n"))
            draws = one if draws is None else draws.unionByName(one)
    if draws is None:
        raise ValueError("all classes have the same size")
    draws = draws.select(
        label, "draw",
        (F.floor(hash_uniform(f"{seed}-base", label, "draw") * F.col("_n")) + 1).alias("rank"),
        hash_uniform(f"{seed}-nn", label, "draw").alias("_pick"),
        hash_uniform(f"{seed}-u", label, "draw").alias("u"),
    )
    by_class = minor.withColumn(label, F.col(label).cast("long"))
    ranked = rank_by_hash(by_class, [label], seed, id_col)
    near = knn_join(by_class, by_class, k, 2, vec, id_col, [label], exclude_self=True, **join_options)
    packed = near.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("rank", "neighbor_id"))).alias("near"))
    based = draws.join(ranked, [label, "rank"]).join(packed, id_col)
    pick = F.col("near")[F.floor(F.col("_pick") * F.size("near")).cast("int")]["neighbor_id"]
    based = based.select(label, "draw", "u", F.col(id_col).alias("base_id"), pick.alias("neighbor_id"), F.col(vec).alias("_x"))
    other = minor.select(F.col(id_col).alias("neighbor_id"), F.col(vec).alias("_y"))
    u = F.col("u")
    return based.join(other, "neighbor_id").select(
        F.concat_ws("-", F.lit("s"), label, "draw").alias("synthetic_id"), label, "base_id", "neighbor_id",
        F.zip_with("_x", "_y", lambda a, b: a + u * (b - a)).alias(vec),
    )


def smote_fill(df: DataFrame, label: str = "label", vec: str = "features", id_col: str = "row_id", **options) -> DataFrame:
    """The rows of ``df`` and the synthetic ones, as (row_key, label, features)."""
    made = smote(df, label, vec=vec, id_col=id_col, **options)
    own = df.select(F.col(id_col).cast("string").alias("row_key"), F.col(label).cast("long").alias(label), vec)
    return own.unionByName(made.select(F.col("synthetic_id").alias("row_key"), label, vec))
