"""k-nearest-neighbour classification from one neighbour table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.neighbors import knn_join
from ..session import cut_lineage
from .base import argmax, class_count, features_array


def neighbour_votes(near: DataFrame, labels: DataFrame | None, ks: list[int], weightings: list[str], id_col: str = "row_id") -> DataFrame:
    """``(id, k, weighting, label, vote)`` for every k and weighting from one table of max(ks) neighbours.

    Under distance weights a row with neighbours at distance 0 listens to those only. Without ``labels`` the
    table itself says the neighbours' labels.
    """
    named = near if labels is None else near.join(labels.select(F.col(id_col).alias("neighbor_id"), "label"), "neighbor_id")
    first = Window.partitionBy(id_col)
    named = named.withColumn("_hit", F.min("distance").over(first) == 0)
    inverse = F.when(F.col("_hit"), (F.col("distance") == 0).cast("double")).otherwise(1 / F.nullif("distance", F.lit(0.0)))
    options = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("weighting")) for k in ks for w in weightings])
    spread = named.select(id_col, "label", "rank", inverse.alias("_inv"), F.inline(options)).filter(F.col("rank") <= F.col("k"))
    vote = F.when(F.col("weighting") == "uniform", F.lit(1.0)).otherwise(F.col("_inv"))
    return spread.groupBy(id_col, "k", "weighting", "label").agg(F.sum(vote).alias("vote"))


def predict_votes(votes: DataFrame, id_col: str = "row_id") -> DataFrame:
    """The class with most votes, the lower one on ties."""
    return votes.groupBy(id_col, "k", "weighting").agg(F.max_by("label", F.struct(F.col("vote"), -F.col("label"))).alias("prediction"))


def power(params: dict) -> int:
    """The Minkowski power that a candidate's metric stands for."""
    return {"euclidean": 2, "manhattan": 1}.get(params.get("metric", "minkowski"), int(params.get("p", 2)))


def neighbours_outside(df: DataFrame, fold_col: str, n_folds: int, k: int, p: int, id_col: str = "row_id") -> DataFrame:
    """``(id, rank, distance, label, own_label, fold)``: the k nearest rows of other folds, for every row, with their labels.

    One join over all rows looks a little further than k; neighbours of the row's own fold are left out. Rows with fewer than k
    left look twice as far, until they have k or have seen every row.
    """
    slim = df.select(id_col, features_array(df).alias("features"))
    names = df.select(id_col, "label", F.col(fold_col).alias("fold"))
    total = slim.count()
    far = -(-k * n_folds // max(n_folds - 1, 1)) + 8
    asked, done = slim, None
    while True:
        far = min(far, total)
        near = knn_join(asked, slim, far, p, id_col=id_col, exclude_self=True)
        own = names.select(id_col, F.col("label").alias("own_label"), "fold")
        other = names.select(F.col(id_col).alias("neighbor_id"), "label", F.col("fold").alias("_fold"))
        known = cut_lineage(near.join(other, "neighbor_id").join(own, id_col).filter("_fold != fold").withColumn(
            "rank", F.row_number().over(Window.partitionBy(id_col).orderBy("distance", "neighbor_id"))
        ).filter(F.col("rank") <= k).drop("_fold"))
        enough = known.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k).select(id_col)
        last = far >= total
        part = known if last else known.join(enough, id_col, "left_semi")
        done = part if done is None else done.unionByName(part)
        if last:
            return done
        asked = cut_lineage(asked.join(enough, id_col, "left_anti"))
        if asked.isEmpty():
            return done
        far *= 2


def knn_fold_scores(df: DataFrame, fold_col: str, n_folds: int, options: list[dict], id_col: str = "row_id") -> list[dict]:
    """(param_id, fold, score): the accuracy of every candidate on every fold, from one neighbour table per Minkowski power."""
    asked = [(power(o), int(o.get("n_neighbors", 5)), o.get("weights", "uniform")) for o in options]
    found: dict[tuple, float] = {}
    for p in sorted({a[0] for a in asked}):
        ks, weightings = sorted({a[1] for a in asked if a[0] == p}), sorted({a[2] for a in asked if a[0] == p})
        near = cut_lineage(neighbours_outside(df, fold_col, n_folds, max(ks), p, id_col))
        pred = predict_votes(neighbour_votes(near, None, ks, weightings, id_col), id_col)
        own = near.filter("rank = 1").select(id_col, "own_label", "fold")
        hit = F.avg((F.col("prediction") == F.col("own_label")).cast("double"))
        for r in pred.join(own, id_col).groupBy("k", "weighting", "fold").agg(hit.alias("score")).collect():
            found[p, r["k"], r["weighting"], r["fold"]] = r["score"]
    return [
        {"param_id": i, "fold": f, "score": found[(*a, f)]} for i, a in enumerate(asked) for f in range(n_folds) if (*a, f) in found
    ]


class KnnModel:
    """Keeps the training rows as a table; scoring is a neighbour join."""

    def __init__(self, train: DataFrame, params: dict, n_classes: int, id_col: str) -> None:
        self.train, self.params, self.k, self.id_col = train, params, n_classes, id_col

    def members(self) -> tuple:
        return {"params": self.params, "k": self.k, "id_col": self.id_col}, [self.train]

    @classmethod
    def of(cls, state, members):
        return cls(members[0], state["params"], state["k"], state["id_col"])

    def transform(self, df: DataFrame) -> DataFrame:
        n = int(self.params.get("n_neighbors", 5))
        p = power(self.params)
        weighting = self.params.get("weights", "uniform")
        slim = df.select(self.id_col, features_array(df).alias("features"))
        base = self.train.select(self.id_col, features_array(self.train).alias("features"))
        near = knn_join(slim, base, n, p, id_col=self.id_col)
        votes = neighbour_votes(near, self.train, [n], [weighting], self.id_col)
        packed = votes.groupBy(self.id_col).agg(F.map_from_entries(F.collect_list(F.struct(F.col("label").cast("int"), "vote"))).alias("_m"), F.sum("vote").alias("_t"))
        share = F.array(*[F.coalesce(F.col("_m")[c], F.lit(0.0)) / F.col("_t") for c in range(self.k)])
        out = df.join(packed, self.id_col).withColumn("probability", share).drop("_m", "_t")
        return out.withColumn("prediction", argmax(F.col("probability")))


def fit_knn(train: DataFrame, params: dict, id_col: str = "row_id") -> KnnModel:
    return KnnModel(train, params, class_count(train), id_col)
