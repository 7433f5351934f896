"""Model selection rules, voting and the tables around an ensemble."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small


def select_above_mean(summary: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Models whose mean metric is above the mean over models. ``summary``: (model, metric, mean, std)."""
    rows = summary.filter(F.col("metric") == metric)
    return rows.filter(F.col("mean") > rows.agg(F.avg("mean")).scalar()).select("model", "mean")


def select_topk(summary: DataFrame, k: int = 3, metric: str = "accuracy") -> DataFrame:
    """The k best by mean, then by smaller std, then by name."""
    return (
        summary.filter(F.col("metric") == metric)
        .orderBy(F.desc("mean"), F.asc("std"), "model")
        .limit(k)
        .select("model", "mean", "std")
    )


def select_weighted(summary: DataFrame, k: int = 3, metric: str = "accuracy") -> DataFrame:
    """As ``select_topk``, with the mean metric as voting weight."""
    return select_topk(summary, k, metric).select("model", F.col("mean").alias("weight"))


def select_below_mean_error(metrics: DataFrame, error: str = "mae") -> DataFrame:
    """Models with an error below the mean error. ``metrics``: one row per model."""
    return metrics.filter(F.col(error) < metrics.agg(F.avg(error)).scalar()).select("model", error)


def select_top_n_error(metrics: DataFrame, n: int = 3, error: str = "mae") -> DataFrame:
    return metrics.orderBy(F.asc(error), "model").limit(n).select("model", error)


def select_topk_r2(metrics: DataFrame, k: int = 3) -> DataFrame:
    return metrics.orderBy(F.desc("r2"), "model").limit(k).select("model", "r2")


def load_selected(selected: DataFrame, store: DataFrame, strict: bool = True) -> DataFrame:
    """Stored models that were selected. With ``strict`` a missing one fails the job, else it is left out."""
    stored = store.withColumn("_there", F.lit(True))
    joined = selected.select("model").join(stored, "model", "left")
    if not strict:
        return joined.filter("_there").drop("_there")
    lost = F.raise_error(F.concat(F.lit("no stored model for "), F.col("model"))).cast("boolean")
    return joined.filter(F.coalesce(F.col("_there"), lost)).drop("_there")


def missing_selected(selected: DataFrame, store: DataFrame) -> DataFrame:
    """Selected models that are not stored."""
    return selected.select("model").join(store.select("model"), "model", "left_anti")


def soft_vote(long_proba: DataFrame, weights: DataFrame | None = None, id_col: str = "row_id", n_classes: int | None = None) -> DataFrame:
    """(Weighted) mean of class probabilities per row; ties go to the lowest class.

    ``long_proba``: (row, model, probability array of K numbers). The classes are summed side by side,
    so a row meets the one shuffle once per model, after map-side sums.
    """
    w, df = F.lit(1.0), long_proba
    if weights is not None:
        df, w = df.join(broadcast_if_small(weights.select("model", "weight")), "model"), F.col("weight")
    if n_classes is None:
        first = df.select(F.size("probability").alias("k")).first()
        n_classes = first["k"] if first else 0
    p = F.col("probability")
    sums = [F.sum(w * p[k]) / F.sum(w) for k in range(n_classes)]
    voted = df.groupBy(id_col).agg(F.array(*sums).alias("probability"))
    return voted.select(id_col, (F.array_position("probability", F.array_max("probability")) - 1).cast("int").alias("prediction"), "probability")


def mean_vote(long_pred: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Mean of the members' predictions per row."""
    return long_pred.groupBy(id_col).agg(F.avg("prediction").alias("prediction"))


def selected_models_table(selected: DataFrame) -> DataFrame:
    return selected.select(F.col("model").alias("selected_model"))


def merge_ensemble_metrics(base: DataFrame, ensemble: DataFrame) -> DataFrame:
    """Base metrics without any former ensemble row, plus the new one."""
    return base.filter(F.col("model") != "Ensemble").unionByName(ensemble)


def predict_all(models: dict, df: DataFrame, keep: list[str] = ("row_id", "label"), skip_failed: bool = True) -> DataFrame:
    """Long table of every model's predictions; a model that cannot be applied is skipped."""
    out = None
    for name, model in models.items():
        try:
            one = model.transform(df).select(*keep, F.lit(name).alias("model"), F.col("prediction").cast("double").alias("prediction"))
        except Exception:  # noqa: BLE001 - analysis errors of one model must not stop the others
            if not skip_failed:
                raise
            continue
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no model could predict")
    return out
