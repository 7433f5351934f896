"""Table profiles: shape, value counts, class shares, preview, distinct values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile_shape(df: DataFrame) -> DataFrame:
    """One row: number of rows and of columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count per value, most frequent first; NULLs are left out."""
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(F.col(col).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value")
    )


def class_distribution(stages: dict[str, DataFrame], label: str = "label") -> DataFrame:
    """Rows per class at each named stage of a preparation."""
    tagged = [d.select(F.lit(s).alias("stage"), F.col(label).alias("label")) for s, d in stages.items()]
    return reduce(DataFrame.unionByName, tagged).groupBy("stage", "label").agg(F.count(F.lit(1)).alias("n"))


def preview(df: DataFrame, n: int = 5, by: str = "row_id") -> DataFrame:
    """First ``n`` rows in the order of ``by``."""
    return df.orderBy(by).limit(n)


def distinct_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value) pairs that occur; NULL counts as a value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols])
    return df.select(F.inline(pairs)).distinct()
