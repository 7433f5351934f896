"""Reading cohorts and writing stage outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store it names."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_cohort(spark: SparkSession, path: str, sheet: str | None = None, schema: StructType | str | None = None) -> DataFrame:
    """A Parquet table; a named sheet is a sub-folder or ``<sheet>.parquet`` of ``path``."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if sheet is None:
        return reader.parquet(path)
    base = path.rstrip("/")
    named = f"{base}/{sheet}.parquet"
    return reader.parquet(named if exists(spark, named) else f"{base}/{sheet}")


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header and declared types (no inference pass)."""
    return spark.read.option("header", True).schema(schema).csv(path)


def write_stage(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] = ()) -> None:
    """Overwrite one stage output."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


write_metrics = write_stage


def predictions_wide(long: DataFrame, models: list[str]) -> DataFrame:
    """One row per test row: the actual value and one ``Pred_<model>`` column per model."""
    wide = long.groupBy("row_id", "label").pivot("model", models).agg(F.first("prediction"))
    return wide.select(
        "row_id", F.col("label").alias("actual"), *[F.col(f"`{m}`").alias(f"Pred_{m}") for m in models]
    )


def append_selection_log(selected: DataFrame, path: str, combo: str, subset: str) -> None:
    """Append one row: combination, subset and the comma-joined model names in selection order."""
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "model"))), lambda s: s["model"]), ", ")
    selected.agg(names.alias("selected_models")).select(
        F.lit(combo).alias("feature_combination"), F.lit(subset).alias("subset"), "selected_models"
    ).write.mode("append").parquet(path)
