"""Tree models as node tables, and their leaves as boxes."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path

#: Nodes handed to the tasks at once; a larger tree goes alone.
CHUNK_NODES = 200_000


def tree_nodes(spark: SparkSession, model) -> DataFrame:
    """``(tree, id, left, right, feature, threshold, cover, value)`` from the saved form of a model.

    ``value`` is what the node adds to the model output: class shares over the number of trees for
    forests, tree weight times value for boosted trees.
    """
    path = fresh_path(spark, "nodes")
    model.write().overwrite().save(path)
    saved = spark.read.parquet(f"{path}/data")
    if "nodeData" in saved.columns:
        saved = saved.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        saved = saved.withColumn("tree", F.lit(0))
    weights = list(getattr(model, "treeWeights", [1.0]))
    boosted = "GBT" in type(model).__name__
    scale = F.lit(1.0) if boosted else F.lit(1.0 / max(len(weights), 1))
    w = F.array(*[F.lit(float(v)) for v in weights])[F.col("tree")] * scale
    stats = F.col("impurityStats")
    total = F.aggregate(stats, F.lit(0.0), lambda a, v: a + v)
    classify = "Classif" in type(model).__name__ and not boosted
    value = F.transform(stats, lambda v: v / total * w) if classify else F.array(F.col("prediction") * w)
    cover = total if classify else stats[0]
    return saved.select(
        "tree", "id", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        cover.alias("cover"), value.alias("value"),
    )


@dataclass
class Leaf:
    """A leaf: the features its path splits on, the box (low, high] and the training share of each."""

    feature: list[int]
    low: list[float]
    high: list[float]
    zero: list[float]
    value: np.ndarray


def tree_groups(nodes: DataFrame, most: int = CHUNK_NODES) -> list[list[int]]:
    """The trees of a model in groups of about ``most`` nodes."""
    groups, held = [[]], 0
    for r in nodes.groupBy("tree").count().orderBy("tree").collect():
        if groups[-1] and held + r["count"] > most:
            groups.append([])
            held = 0
        groups[-1].append(r["tree"])
        held += r["count"]
    return groups


def leaf_paths(nodes: DataFrame) -> list[Leaf]:
    """All leaves of the trees in a node table."""
    by_tree: dict[int, dict[int, object]] = {}
    for r in nodes.collect():
        by_tree.setdefault(r["tree"], {})[r["id"]] = r
    leaves = []
    for tree in by_tree.values():
        stack = [(0, {})]
        while stack:
            i, box = stack.pop()
            node = tree[i]
            if node["left"] < 0:
                items = sorted(box.items())
                leaves.append(Leaf([f for f, _ in items], [b[0] for _, b in items], [b[1] for _, b in items],
                                   [b[2] for _, b in items], np.array(node["value"])))
                continue
            f, t = node["feature"], node["threshold"]
            lo, hi, z = box.get(f, (-np.inf, np.inf, 1.0))
            stack.append((node["left"], {**box, f: (lo, min(hi, t), z * tree[node["left"]]["cover"] / node["cover"])}))
            stack.append((node["right"], {**box, f: (max(lo, t), hi, z * tree[node["right"]]["cover"] / node["cover"])}))
    return leaves


class Packed(NamedTuple):
    """Trees as arrays over all their nodes; children are positions in the arrays, -1 at leaves."""

    roots: np.ndarray
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    cover: np.ndarray
    value: np.ndarray


def packed(nodes: DataFrame) -> Packed:
    """The node table of some trees as arrays on the driver; its size follows the model."""
    rows = nodes.orderBy("tree", "id").collect()
    tree, ident = np.array([r["tree"] for r in rows]), np.array([r["id"] for r in rows])
    at = {k: i for i, k in enumerate(zip(tree.tolist(), ident.tolist()))}
    child = {side: np.array([at[r["tree"], r[side]] if r[side] >= 0 else -1 for r in rows]) for side in ("left", "right")}
    feature = np.array([r["feature"] if r["feature"] is not None else -1 for r in rows])
    threshold = np.array([r["threshold"] if r["threshold"] is not None else 0.0 for r in rows], dtype=float)
    cover, value = np.array([r["cover"] for r in rows], dtype=float), np.array([r["value"] for r in rows], dtype=float)
    return Packed(np.flatnonzero(ident == 0), child["left"], child["right"], feature, threshold, cover, value)


def packed_scorer(trees: Packed):
    """Batch scorer of the model output: all rows step down a tree together."""

    def predict(x: np.ndarray) -> np.ndarray:
        out, every = np.zeros((len(x), trees.value.shape[1])), np.arange(len(x))
        for root in trees.roots:
            at = np.full(len(x), root)
            while (inner := trees.left[at] >= 0).any():
                rows = every[inner]
                node = at[rows]
                at[rows] = np.where(x[rows, trees.feature[node]] <= trees.threshold[node], trees.left[node], trees.right[node])
            out += trees.value[at]
        return out

    return predict


def leaf_scorer(leaves: list[Leaf]):
    """Batch scorer of the model output from its leaves."""

    def predict(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(leaves[0].value)))
        for leaf in leaves:
            inside = np.ones(len(x), dtype=bool)
            for f, lo, hi in zip(leaf.feature, leaf.low, leaf.high):
                inside &= (x[:, f] > lo) & (x[:, f] <= hi)
            out[inside] += leaf.value
        return out

    return predict
