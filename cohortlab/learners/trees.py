"""Trees, forests and boosted trees of Spark ML; bagging and adaptive boosting around its trees."""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.hashing import digest, poisson_weight
from ..session import delete_folder, fresh_path
from .base import argmax, class_count, with_weights, without_summary

MAX_DEPTH = 30  # the deepest tree Spark ML grows; stands for "no limit"


def _shape(params: dict, default_depth: int | None = None) -> dict:
    depth = params.get("max_depth", default_depth)
    leaf = int(params.get("min_samples_leaf", params.get("min_child_weight", 1)))
    # a node is split only with enough rows for two halves of min_samples_split
    floor = int(params.get("min_samples_split", 2)) // 2
    return {
        "maxDepth": MAX_DEPTH if depth is None else int(depth), "minInstancesPerNode": max(leaf, floor, 1),
        "seed": int(params.get("seed", 42)), "maxBins": int(params.get("max_bins", 64)), "maxMemoryInMB": 512,
    }


def _subset(value) -> str:
    if value is None or value == 1.0:
        return "all"
    return value if isinstance(value, str) else str(float(value))


def _fit(est, train: DataFrame, params: dict):
    df, weight = with_weights(train, params.get("class_weight"))
    return without_summary((est.setWeightCol(weight) if weight else est).fit(df))


def fit_tree_classifier(train: DataFrame, params: dict):
    return _fit(RandomForestClassifier(
        numTrees=1, bootstrap=False, impurity=params.get("criterion", "gini"),
        featureSubsetStrategy=_subset(params.get("max_features")), **_shape(params)), train, params)


def fit_forest_classifier(train: DataFrame, params: dict):
    return _fit(RandomForestClassifier(
        numTrees=int(params.get("n_estimators", 100)), bootstrap=bool(params.get("bootstrap", True)),
        featureSubsetStrategy=_subset(params.get("max_features", "sqrt")), **_shape(params)), train, params)


def fit_tree_regressor(train: DataFrame, params: dict):
    return RandomForestRegressor(
        numTrees=1, bootstrap=False, featureSubsetStrategy=_subset(params.get("max_features")), **_shape(params)).fit(train)


def fit_forest_regressor(train: DataFrame, params: dict):
    return RandomForestRegressor(
        numTrees=int(params.get("n_estimators", 100)), bootstrap=bool(params.get("bootstrap", True)),
        featureSubsetStrategy=_subset(params.get("max_features")), **_shape(params)).fit(train)


def _boosting(params: dict) -> dict:
    return {
        "maxIter": int(params.get("n_estimators", 100)), "stepSize": float(params.get("learning_rate", 0.3)),
        "subsamplingRate": float(params.get("subsample", 1.0)), "minInfoGain": float(params.get("gamma", 0.0)),
        "featureSubsetStrategy": _subset(params.get("colsample_bytree")), "checkpointInterval": 10, **_shape(params, 6),
    }


class OneVsRestModel:
    """Class probabilities from one margin per class: logistic of twice the margin, normalised."""

    def __init__(self, models: list) -> None:
        self.models = models

    def members(self) -> tuple:
        return None, self.models

    @classmethod
    def of(cls, state, members):
        return cls(members)

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c, m in enumerate(self.models):
            m = m.copy().setRawPredictionCol(f"_raw{c}").setProbabilityCol("").setPredictionCol("")
            out = m.transform(out)
        share = [1 / (1 + F.exp(-2 * vector_to_array(f"_raw{c}")[1])) for c in range(len(self.models))]
        out = out.withColumn("_p", F.array(*share)).drop(*[f"_raw{c}" for c in range(len(self.models))])
        total = F.aggregate("_p", F.lit(0.0), lambda a, v: a + v)
        out = out.withColumn("probability", F.transform("_p", lambda v: v / total))
        return out.withColumn("prediction", argmax(F.col("probability"))).drop("_p")


def fit_gbt_classifier(train: DataFrame, params: dict):
    """Boosted trees; more than two classes as one model per class against the rest."""
    est = GBTClassifier(**_boosting(params))
    pos = float(params.get("scale_pos_weight", 1))
    k = class_count(train)
    if k > 2:
        return OneVsRestModel(OneVsRest(classifier=est, parallelism=min(k, 4)).fit(train).models)
    if pos != 1:
        return est.setWeightCol("weight").fit(train.withColumn("weight", F.when(F.col("label") == 1, pos).otherwise(1.0)))
    return est.fit(train)


def fit_gbt_regressor(train: DataFrame, params: dict):
    return GBTRegressor(**_boosting(params)).fit(train)


class BaggedTrees:
    """Mean of trees that each saw hash-drawn rows and columns."""

    def __init__(self, trees: list[tuple[list[int], object]]) -> None:
        self.trees = trees

    def members(self) -> tuple:
        return [list(c) for c, _ in self.trees], [t for _, t in self.trees]

    @classmethod
    def of(cls, state, members):
        return cls(list(zip(state, members)))

    def transform(self, df: DataFrame) -> DataFrame:
        out, names = df, []
        for i, (cols, tree) in enumerate(self.trees):
            out = VectorSlicer(inputCol="features", outputCol=f"_f{i}", indices=cols).transform(out)
            out = tree.copy().setFeaturesCol(f"_f{i}").setPredictionCol(f"_y{i}").transform(out)
            names.append(f"_y{i}")
        mean = sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)
        return out.withColumn("prediction", mean).drop(*names, *[f"_f{i}" for i in range(len(names))])


def fit_bagging_regressor(train: DataFrame, params: dict, id_col: str = "row_id") -> BaggedTrees:
    """Each tree gets Poisson row weights thinned to ``max_samples`` and a share of the columns."""
    seed, n = int(params.get("seed", 42)), int(params.get("n_estimators", 10))
    width = len(train.select(F.col("features")).first()[0])
    n_cols = max(1, round(float(params.get("max_features", 1.0)) * width))
    share = float(params.get("max_samples", 1.0))
    base = train

    def one(i: int):
        import hashlib

        order = sorted(range(width), key=lambda j: hashlib.md5(f"{seed}|{i}|{j}".encode()).hexdigest())
        cols = sorted(order[:n_cols])
        hashed = base.withColumn("_h", digest(f"{seed}-{i}", id_col))
        keep = F.substring("_h", 9, 8) < F.lit(format(min(int(share * 2**32), 2**32 - 1), "08x"))
        drawn = hashed.withColumn("weight", poisson_weight("substring(_h, 1, 8)")).filter(keep & (F.col("weight") > 0)).drop("_h")
        sliced = VectorSlicer(inputCol="features", outputCol="_f", indices=cols).transform(drawn)
        tree = DecisionTreeRegressor(featuresCol="_f", weightCol="weight", **_shape(params)).fit(sliced)
        return cols, tree

    with ThreadPool(min(4, n)) as pool:
        members = pool.map(one, range(n))
    return BaggedTrees(members)


class BoostedVote:
    """SAMME vote: each tree adds its weight to the class it names."""

    def __init__(self, trees: list, alphas: list[float], n_classes: int) -> None:
        self.trees, self.alphas, self.k = trees, alphas, n_classes

    def members(self) -> tuple:
        return {"alphas": self.alphas, "k": self.k}, self.trees

    @classmethod
    def of(cls, state, members):
        return cls(members, state["alphas"], state["k"])

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for i, t in enumerate(self.trees):
            out = t.copy().setPredictionCol(f"_y{i}").setRawPredictionCol("").setProbabilityCol("").transform(out)
        total = float(sum(self.alphas))
        votes = []
        for c in range(self.k):
            v = F.lit(0.0)
            for i, a in enumerate(self.alphas):
                v = v + F.when(F.col(f"_y{i}") == c, F.lit(float(a))).otherwise(F.lit(0.0 if self.k == 1 else -a / (self.k - 1)))
            votes.append(F.exp(v / total / max(self.k - 1, 1)))
        out = out.withColumn("_e", F.array(*votes))
        norm = F.aggregate("_e", F.lit(0.0), lambda a, v: a + v)
        out = out.withColumn("probability", F.transform("_e", lambda v: v / norm))
        return out.withColumn("prediction", argmax(F.col("probability"))).drop("_e", *[f"_y{i}" for i in range(len(self.trees))])


def samme_sums(label: str = "label", prediction: str = "prediction", weight: str = "weight") -> list[Column]:
    """What ``samme_round`` has to know of all rows."""
    miss = (F.col(label) != F.col(prediction)).cast("double")
    return [F.sum(F.col(weight) * miss).alias("missed"), F.sum(weight).alias("all")]


def samme_round(df: DataFrame, n_classes: int, rate: float, label: str = "label", prediction: str = "prediction", weight: str = "weight", normalise: bool = False, sums: dict | None = None) -> tuple[DataFrame, float, float]:
    """One reweighting: (rows with the new weight, error, alpha). ``normalise`` divides by the sum before, so weights stay in range.

    ``sums`` are those of ``samme_sums`` where they are known already.
    """
    miss = (F.col(label) != F.col(prediction)).cast("double")
    s = sums or df.agg(*samme_sums(label, prediction, weight)).first().asDict()
    err = s["missed"] / s["all"]
    if err <= 0 or err >= 1 - 1.0 / n_classes:
        return df, err, 1.0 if err <= 0 else 0.0
    alpha = rate * (math.log((1 - err) / err) + math.log(n_classes - 1))
    return df.withColumn(weight, F.col(weight) / F.lit(s["all"] if normalise else 1.0) * F.exp(F.lit(alpha) * miss)), err, alpha


class RoundTable:
    """Rows of a boosting round as a table in the shared folder; the one before goes once the next stands.

    The plan of a round begins at one table, however many rounds there were: weights come from the last tree alone, a lost
    executor's work is read again from there. The sums of a round are taken while its table is written, not read from it.
    """

    def __init__(self, spark) -> None:
        self.spark, self.path = spark, None

    def __enter__(self) -> RoundTable:
        return self

    def __exit__(self, *_) -> None:
        if self.path is not None:
            delete_folder(self.spark, self.path)

    def write(self, rows: DataFrame) -> DataFrame:
        before, path = self.path, fresh_path(self.spark, "round")
        rows.write.parquet(path)
        self.path = path
        if before is not None:
            delete_folder(self.spark, before)
        return self.spark.read.schema(rows.schema).parquet(path)


def fit_adaboost_classifier(train: DataFrame, params: dict) -> BoostedVote:
    """SAMME boosting of shallow trees, with the weights of a round in a table of their own."""
    with RoundTable(train.sparkSession) as table:
        return _boost_classes(train, params, table)


def _boost_classes(train: DataFrame, params: dict, table: RoundTable) -> BoostedVote:
    k, rate = class_count(train), float(params.get("learning_rate", 1.0))
    rows = table.write(train.select("features", "label", F.lit(1.0).alias("weight")))
    depth = params.get("max_depth") or 1
    trees, alphas = [], []
    for _ in range(int(params.get("n_estimators", 50))):
        tree = DecisionTreeClassifier(weightCol="weight", **_shape({**params, "max_depth": depth})).fit(rows)
        seen = Observation()
        scored = table.write(tree.transform(rows).select("features", "label", "weight", "prediction").observe(seen, *samme_sums()))
        rows, err, alpha = samme_round(scored, k, rate, normalise=True, sums=seen.get)
        if alpha <= 0:
            break
        trees.append(tree)
        alphas.append(alpha)
        if err <= 0:
            break
        rows = rows.drop("prediction")
    if not trees:
        raise ValueError("the first tree is not better than chance")
    return BoostedVote(trees, alphas, k)


class WeightedMedianTrees:
    """AdaBoost.R2 output: the median of the trees' values under their weights."""

    def __init__(self, trees: list, weights: list[float]) -> None:
        self.trees, self.weights = trees, weights

    def members(self) -> tuple:
        return self.weights, self.trees

    @classmethod
    def of(cls, state, members):
        return cls(members, state)

    def transform(self, df: DataFrame) -> DataFrame:
        out, pairs = df, []
        for i, (t, w) in enumerate(zip(self.trees, self.weights)):
            out = t.copy().setPredictionCol(f"_y{i}").transform(out)
            pairs.append(F.struct(F.col(f"_y{i}").alias("y"), F.lit(float(w)).alias("w")))
        out = out.withColumn("_s", F.array_sort(F.array(*pairs)))
        zero = F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("double").alias("y"))
        half = F.lit(0.5 * float(sum(self.weights)))
        hit = F.aggregate("_s", zero, lambda a, s: F.struct(
            (a["cum"] + s["w"]).alias("cum"),
            F.when(a["y"].isNull() & (a["cum"] + s["w"] >= half), s["y"]).otherwise(a["y"]).alias("y")))
        return out.withColumn("prediction", hit["y"]).drop("_s", *[f"_y{i}" for i in range(len(self.trees))])


def r2_sums(label: str = "label", prediction: str = "prediction", weight: str = "weight") -> list[Column]:
    """What ``r2_round`` has to know of all rows."""
    e = F.abs(F.col(label) - F.col(prediction))
    return [F.max(e).alias("worst"), F.sum(F.col(weight) * e).alias("lost"), F.sum(weight).alias("all")]


def r2_round(df: DataFrame, rate: float, label: str = "label", prediction: str = "prediction", weight: str = "weight", normalise: bool = False, sums: dict | None = None) -> tuple[DataFrame, float, float]:
    """One AdaBoost.R2 reweighting with linear loss: (rows, mean loss, beta). ``sums`` are those of ``r2_sums`` where they are known already."""
    s = sums or df.agg(*r2_sums(label, prediction, weight)).first().asDict()
    if not s["worst"]:
        return df, 0.0, 0.0
    loss = F.abs(F.col(label) - F.col(prediction)) / F.lit(float(s["worst"]))
    mean = s["lost"] / s["worst"] / s["all"]
    if mean >= 0.5:
        return df, mean, 1.0
    beta = mean / (1 - mean)
    return df.withColumn(weight, F.col(weight) / F.lit(s["all"] if normalise else 1.0) * F.pow(F.lit(beta), F.lit(rate) * (1 - loss))), mean, beta


def fit_adaboost_regressor(train: DataFrame, params: dict) -> WeightedMedianTrees:
    """AdaBoost.R2 (Drucker 1997) on trees of depth 3, with weights in place of resampling, kept as for classes."""
    with RoundTable(train.sparkSession) as table:
        return _boost_values(train, params, table)


def _boost_values(train: DataFrame, params: dict, table: RoundTable) -> WeightedMedianTrees:
    rate = float(params.get("learning_rate", 1.0))
    rows = table.write(train.select("features", "label", F.lit(1.0).alias("weight")))
    trees, weights = [], []
    for _ in range(int(params.get("n_estimators", 50))):
        tree = DecisionTreeRegressor(weightCol="weight", **_shape({**params, "max_depth": params.get("max_depth") or 3})).fit(rows)
        seen = Observation()
        scored = table.write(tree.transform(rows).observe(seen, *r2_sums()))
        rows, mean, beta = r2_round(scored, rate, normalise=True, sums=seen.get)
        if mean >= 0.5 and trees:
            break
        trees.append(tree)
        weights.append(1.0 if beta in (0.0, 1.0) else rate * math.log(1 / beta))
        if mean <= 0 or mean >= 0.5:
            break
        rows = rows.drop("prediction")
    return WeightedMedianTrees(trees, weights)
