"""The tables behind the report charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report_metric_comparison(long: DataFrame, metrics: list[str]) -> DataFrame:
    """Models x metrics from (model, metric, value)."""
    return long.groupBy("model").pivot("metric", metrics).agg(F.first("value"))


def report_accuracy(wide: DataFrame) -> DataFrame:
    """Accuracy per model with its bar label."""
    return wide.select("model", "accuracy", F.format_string("%.2f", "accuracy").alias("bar_label"))


def report_mae(wide: DataFrame) -> DataFrame:
    """MAE per model; RMSE beside it under its own name."""
    return wide.select("model", "mae", "rmse").orderBy("mae", "model")


def report_r2(wide: DataFrame) -> DataFrame:
    return wide.select("model", "r2").orderBy(F.desc("r2"), "model")


def report_top_models(wide: DataFrame, n: int = 4) -> DataFrame:
    """The n best models by R2 with all their metrics."""
    return wide.orderBy(F.desc("r2"), "model").limit(n)
