"""Everything drawn from the long contribution table.

Columns: ``row_id, label, class, feature, feature_value, phi, base``. Each view is one or two grouped
aggregations, so compute the long table once, persist it, and derive all views.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small



def shap_classes(df: DataFrame, positive_class: int = 1, output: str = "margin") -> DataFrame:
    """Both classes of a binary explanation: phi for ``positive_class``, -phi for the other.

    ``positive_class=0`` gives the sign convention of plotting class 0 with +phi. The other base is -base for margins and
    1 - base where ``output`` is ``probability``.
    """
    opposite = -F.col("base") if output == "margin" else 1 - F.col("base")
    other = 1 - positive_class
    sides = F.array(
        F.struct(F.lit(positive_class).alias("class"), F.col("phi").alias("phi"), F.col("base").alias("base")),
        F.struct(F.lit(other).alias("class"), (-F.col("phi")).alias("phi"), opposite.alias("base")),
    )
    kept = [c for c in df.columns if c not in ("class", "phi", "base")]
    return df.select(*kept, F.inline(sides))


def _mean_abs(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.abs("phi")).alias("importance"))


def _top(df: DataFrame, n: int, part: list[str] = ()) -> DataFrame:
    w = Window.partitionBy(*(part or [F.lit(0)])).orderBy(F.desc("importance"), "feature")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def shap_summary_by_class(df: DataFrame, n: int = 5) -> DataFrame:
    """Mean |phi| per class and feature, the n largest of each class."""
    return _top(_mean_abs(df, ["class", "feature"]), n, ["class"])


def shap_summary_aggregated(df: DataFrame, n: int | None = None) -> DataFrame:
    """Mean |phi| over classes and rows. Every row has all classes, so one mean over both is the same."""
    total = _mean_abs(df, ["feature"])
    return _top(total, n) if n else total


def shap_importance_table(df: DataFrame, classes: list[int], names: list[str] | None = None) -> DataFrame:
    """Features x classes matrix of mean |phi|."""
    wide = df.groupBy("feature").pivot("class", classes).agg(F.avg(F.abs("phi")))
    names = names or [str(c) for c in classes]
    return wide.select("feature", *[F.col(f"`{c}`").alias(f"Class_{n}") for c, n in zip(classes, names)])


def shap_importance_regression(df: DataFrame, n: int = 15) -> DataFrame:
    """Mean |phi| per feature, the n largest."""
    return _top(_mean_abs(df, ["feature"]), n)


def shap_summary_regression(df: DataFrame, n: int = 5) -> DataFrame:
    """The points of the n most important features."""
    best = broadcast_if_small(_top(_mean_abs(df, ["feature"]), n).select("feature"))
    return df.join(best, "feature", "left_semi").select("row_id", "feature", "feature_value", "phi")


def shap_dependence(df: DataFrame, feature: str) -> DataFrame:
    """(value, phi) of one feature for each class."""
    return df.filter(F.col("feature") == feature).select("row_id", "class", "feature_value", "phi")


def shap_decision_paths(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Per row and class: cumulative output from the base over features by rising importance.

    ``df`` has a row's contributions as an array over ``features`` (``shap.linear_contributions``), or is a long table: then the arrays
    are gathered first. The running sums of a class are one cumulative sum per batch; only the means of |phi| are shuffled.
    """
    if features is None:
        features = sorted(r[0] for r in df.select("feature").distinct().collect())
        place = F.array_position(F.array(*map(F.lit, features)), F.col("feature"))
        held = F.array_sort(F.collect_list(F.struct(place.alias("place"), "phi")))
        df = df.groupBy("row_id", "class").agg(F.transform(held, lambda s: s["phi"]).alias("phi"), F.first("base").alias("base"))
    means = df.select("class", F.posexplode("phi").alias("_j", "_v")).groupBy("class", "_j").agg(F.avg(F.abs("_v")).alias("importance")).collect()
    # one number per class and feature
    order = {c: [j for _, _, j in sorted((m["importance"], features[m["_j"]], m["_j"]) for m in means if m["class"] == c)] for c in {m["class"] for m in means}}
    names = pa.array(features)

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = len(features)
        for b in batches:
            classes = b.column(1).to_numpy()
            phi = b.column(3).flatten().to_numpy().reshape(-1, p)
            base = b.column(2).to_numpy()
            for c in np.unique(classes).tolist():
                rows, by = np.flatnonzero(classes == c), np.array(order[c])
                output = base[rows, None] + np.cumsum(phi[rows][:, by], axis=1)
                again = pa.array(np.repeat(rows, p))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(again), b.column(1).take(again), names.take(pa.array(np.tile(by, len(rows)))), pa.array(np.tile(np.arange(1, p + 1), len(rows))), pa.array(output.ravel())],
                    names=["row_id", "class", "feature", "step", "output"],
                )

    kinds = {c: df.schema[c].dataType.simpleString() for c in ("row_id", "class")}
    slim = df.select("row_id", "class", F.col("base").cast("double").alias("base"), F.col("phi").cast("array<double>").alias("phi"))
    return slim.mapInArrow(paths, f"row_id {kinds['row_id']}, class {kinds['class']}, feature string, step bigint, output double")


def _of_class(df: DataFrame) -> DataFrame:
    return df.filter(F.col("label") == F.col("class"))


def _steps(means: DataFrame, part: list[str]) -> DataFrame:
    """Waterfall bars: features by falling |mean phi|, with where each bar starts and ends."""
    w = (
        Window.partitionBy(*(part or [F.lit(0)]))
        .orderBy(F.desc(F.abs("mean_phi")), "feature")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    end = F.col("mean_base") + F.sum("mean_phi").over(w)
    return means.withColumn("step", F.count(F.lit(1)).over(w)).withColumn("bar_end", end).withColumn(
        "bar_start", end - F.col("mean_phi")
    )


def shap_waterfall_by_class(df: DataFrame) -> DataFrame:
    """Mean phi, feature value and base over the rows of each class."""
    means = _of_class(df).groupBy("class", "feature").agg(
        F.avg("phi").alias("mean_phi"), F.avg("feature_value").alias("mean_value"), F.avg("base").alias("mean_base")
    )
    return _steps(means, ["class"])


def shap_waterfall_combined(df: DataFrame) -> DataFrame:
    """Sum over classes of the mean phi, with the classes' mean base."""
    per_class = _of_class(df).groupBy("class", "feature").agg(
        F.avg("phi").alias("m"), F.avg("feature_value").alias("v"), F.avg("base").alias("b")
    )
    means = per_class.groupBy("feature").agg(
        F.sum("m").alias("mean_phi"), F.avg("v").alias("mean_value"), F.avg("b").alias("mean_base")
    )
    return _steps(means, [])


def shap_waterfall_row(df: DataFrame, row_id: int) -> DataFrame:
    """Contributions of one row, largest first."""
    one = df.filter(F.col("row_id") == row_id).select(
        "class", "feature", "feature_value", F.col("phi").alias("mean_phi"), F.col("base").alias("mean_base")
    )
    steps = _steps(one, ["class"])
    return steps.select("class", "feature", "feature_value", F.col("mean_phi").alias("phi"), F.col("mean_base").alias("base"), "step", "bar_start", "bar_end")


def shap_beeswarm(df: DataFrame, n: int = 5) -> DataFrame:
    """Points of each class's own rows for that class's n most important features."""
    own = _of_class(df)
    best = broadcast_if_small(_top(_mean_abs(own, ["class", "feature"]), n, ["class"]).select("class", "feature"))
    return own.join(best, ["class", "feature"], "left_semi").select("row_id", "class", "feature", "feature_value", "phi")


def shap_bar_by_class(df: DataFrame, n: int | None = None) -> DataFrame:
    """Mean |phi| over the rows of each class."""
    bars = _mean_abs(_of_class(df), ["class", "feature"])
    return _top(bars, n, ["class"]) if n else bars


def shap_bar_stacked(df: DataFrame) -> DataFrame:
    """Feature x class bars of mean |phi| over the class's rows, stacked left to right, by falling total."""
    bars = shap_bar_by_class(df)
    left = Window.partitionBy("feature").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    return bars.select(
        "feature", "class", "importance",
        F.coalesce(F.sum("importance").over(left), F.lit(0.0)).alias("bar_left"),
        F.sum("importance").over(Window.partitionBy("feature")).alias("total"),
    )


def fold_importance(df: DataFrame) -> DataFrame:
    """Mean importance per feature over folds, from (fold, feature, importance)."""
    return df.groupBy("feature").agg(F.avg("importance").alias("mean_importance")).orderBy(F.desc("mean_importance"), "feature")


def top_importance(df: DataFrame, n: int = 20) -> DataFrame:
    """The n largest importances of (feature, importance)."""
    return df.orderBy(F.desc("importance"), "feature").limit(n)
