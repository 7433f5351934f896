"""Model files and the bookkeeping of finished tasks."""

from __future__ import annotations

import json

from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession

from .tables import exists


def save_model(model, path: str) -> None:
    """Save a fitted Spark ML model, one of this package's parameter-table models, or a model made of several."""
    if hasattr(model, "write"):
        model.write().overwrite().save(path)
    elif hasattr(model, "members"):
        save_parts(model, path)
    else:
        model.save(path)


def save_parts(model, path: str) -> None:
    """A composite: its own numbers in one row, its members (models, None or tables) in folders."""
    spark = SparkSession.getActiveSession()
    state, members = model.members()
    kinds = []
    for i, m in enumerate(members):
        kinds.append("none" if m is None else "table" if isinstance(m, DataFrame) else "model")
        if kinds[-1] == "table":
            m.write.mode("overwrite").parquet(f"{path}/members/{i}")
        elif kinds[-1] == "model":
            save_model(m, f"{path}/members/{i}")
    row = (type(model).__name__, json.dumps(state), ",".join(kinds))
    spark.createDataFrame([row], "kind string, state string, members string").write.mode("overwrite").parquet(f"{path}/composite")


def load_model(spark: SparkSession, path: str):
    """Load a saved model; a path without one is an error."""
    from ..learners import COMPOSITES
    from ..learners.base import ParamModel

    if not exists(spark, path):
        raise FileNotFoundError(f"no model at {path}")
    if exists(spark, f"{path}/params"):
        return ParamModel.load(spark, path)
    if exists(spark, f"{path}/composite"):
        row = spark.read.parquet(f"{path}/composite").first()
        members = [
            None if kind == "none" else spark.read.parquet(f"{path}/members/{i}") if kind == "table" else load_model(spark, f"{path}/members/{i}")
            for i, kind in enumerate(row["members"].split(","))
        ]
        return COMPOSITES[row["kind"]].of(json.loads(row["state"]), members)
    return DefaultParamsReader.loadParamsInstance(path, spark)


def resume_pending(planned: DataFrame, done_models: DataFrame, done_results: DataFrame, keys: list[str], both: bool = True) -> DataFrame:
    """Planned tasks still to do. Done means a model and (with ``both``) a result exist."""
    done = done_models.select(*keys)
    if both:
        done = done.join(done_results.select(*keys), keys, "left_semi")
    return planned.join(done, keys, "left_anti")
