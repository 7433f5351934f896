"""What all learners share.

``fit_<name>(train, params)`` reads ``features`` (vector) and ``label`` and returns a model whose
``transform`` adds ``prediction``, and ``probability`` for classifiers. Learners Spark ML lacks are
fitted from grouped aggregations; their model is a small set of parameters (``ParamModel``).
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXPRESSION_TERMS = 512


def features_array(df: DataFrame, col: str = "features") -> Column:
    return vector_to_array(col) if isinstance(df.schema[col].dataType, VectorUDT) else F.col(col)


def probability_array(df: DataFrame) -> DataFrame:
    """``probability`` as an array whatever model made it."""
    if "probability" in df.columns and isinstance(df.schema["probability"].dataType, VectorUDT):
        return df.withColumn("probability", vector_to_array("probability"))
    return df


def score(model, df: DataFrame) -> DataFrame:
    """``model.transform`` under the common contract, without Spark ML's raw columns."""
    return probability_array(model.transform(df)).drop("rawPrediction")


def without_summary(model):
    """The fitted model alone. The training summary of a two-class model holds the session, and once an ``Observation`` was used
    in it (boosting does) Spark cannot send such a model to the tasks that score.
    """
    if model.hasSummary:
        model._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
    return model


def with_weights(train: DataFrame, class_weight: str | None, label: str = "label") -> tuple[DataFrame, str | None]:
    """Adds ``weight`` when classes are to be balanced."""
    if class_weight != "balanced":
        return train, None
    return balanced_weights(train, label), "weight"


def balanced_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """n / (K n_c) per row, from one aggregation looked up as a map with one entry per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    table = counts.agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(label).cast("int"), F.col("n")))).alias("m"),
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"),
    ).select(F.struct("m", "n", "k").alias("s")).scalar()
    t = F.col("_table")
    weighted = df.withColumn("_table", table).withColumn(out, t["n"] / (t["k"] * t["m"][F.col(label).cast("int")]))
    return weighted.drop("_table")


def class_count(train: DataFrame, label: str = "label") -> int:
    return int(train.agg(F.max(label)).first()[0]) + 1


def number(v: float) -> str:
    """A double as SQL text with all its digits."""
    return f"double('{float(v)!r}')"


def linear_text(x: str, w: np.ndarray, b: float) -> str:
    """SQL text of w . x + b for the array column ``x``; one text builds much faster than many calls."""
    return " + ".join([number(b), *[f"{number(v)} * {x}[{j}]" for j, v in enumerate(w)]])


def softmax_of(df: DataFrame, scores: list[str]) -> DataFrame:
    """Adds ``probability`` from the score texts, shifted by the largest score."""
    return (
        df.withColumn("_scores", F.expr(f"array({', '.join(scores)})"))
        .withColumn("_e", F.expr("transform(_scores, s -> exp(s - array_max(_scores)))"))
        .withColumn("probability", F.expr("transform(_e, v -> v / aggregate(_e, 0D, (a, b) -> a + b))"))
        .drop("_scores", "_e")
    )


def argmax(array: Column) -> Column:
    """Position of the largest value, the first one on ties."""
    return (F.array_position(array, F.array_max(array)) - 1).cast("double")


def batch_scorer(fn: Callable[[np.ndarray], np.ndarray], x: Column) -> Column:
    """Array column of ``fn`` over Arrow batches of feature rows."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(list(fn(np.stack(v.to_numpy())))) if len(v) else pd.Series([], dtype=object)

    return run(x)


class ParamModel:
    """A model that is a dict of numbers and arrays, saved as one Parquet row."""

    kinds: dict[str, type] = {}
    kind = ""

    def __init_subclass__(cls) -> None:
        ParamModel.kinds[cls.kind] = cls

    def __init__(self, **params) -> None:
        self.params = params

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def batch(self) -> Callable[[np.ndarray], np.ndarray]:
        """The model as a function of arrays: rows x features to rows x outputs, made of numbers alone."""
        raise NotImplementedError

    def linear_weights(self) -> np.ndarray | None:
        """Outputs x features of a linear model."""
        return None

    def save(self, path: str) -> None:
        text = json.dumps(self.params, default=lambda a: a.tolist())
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(self.kind, text)], "kind string, params string").write.mode("overwrite").parquet(f"{path}/params")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ParamModel:
        row = spark.read.parquet(f"{path}/params").first()
        return ParamModel.kinds[row["kind"]](**json.loads(row["params"]))


class LinearClassModel(ParamModel):
    """Softmax of K linear scores."""

    kind = "linear_classes"

    def transform(self, df: DataFrame) -> DataFrame:
        w, b = np.asarray(self.params["coef"]), np.asarray(self.params["intercept"])
        x = features_array(df)
        if w.size <= EXPRESSION_TERMS:
            out = softmax_of(df.withColumn("_x", x), [linear_text("_x", v, c) for v, c in zip(w, b)]).drop("_x")
        else:
            out = df.withColumn("probability", batch_scorer(self.batch(), x))
        return out.withColumn("prediction", argmax(F.col("probability")))

    def batch(self) -> Callable[[np.ndarray], np.ndarray]:
        w, b = np.asarray(self.params["coef"]), np.asarray(self.params["intercept"])

        def proba(v: np.ndarray) -> np.ndarray:
            s = v @ w.T + b
            e = np.exp(s - s.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)

        return proba

    def linear_weights(self) -> np.ndarray:
        return np.asarray(self.params["coef"])


class LinearValueModel(ParamModel):
    """One linear score as the prediction."""

    kind = "linear_value"

    def transform(self, df: DataFrame) -> DataFrame:
        w, b = np.asarray(self.params["coef"]), float(self.params["intercept"])
        x = features_array(df)
        if w.size <= EXPRESSION_TERMS:
            return df.withColumn("_x", x).withColumn("prediction", F.expr(linear_text("_x", w, b))).drop("_x")
        return df.withColumn("prediction", batch_scorer(self.batch(), x)[0])

    def batch(self) -> Callable[[np.ndarray], np.ndarray]:
        w, b = np.asarray(self.params["coef"]), float(self.params["intercept"])
        return lambda v: (v @ w + b)[:, None]

    def linear_weights(self) -> np.ndarray:
        return np.asarray(self.params["coef"])[None, :]
