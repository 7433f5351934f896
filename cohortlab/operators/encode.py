"""Projections, label encodings and cohort filters."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Class pairs per comparison, class 0 first.
COMPARISONS = {"CN_vs_MCI": (0, 1), "CN_vs_AD": (0, 2), "MCI_vs_AD": (1, 2)}

# Display names per comparison.
CLASS_NAMES = {
    "CN_vs_MCI": ["CN", "MCI"],
    "CN_vs_AD": ["CN", "AD"],
    "MCI_vs_AD": ["MCI", "AD"],
    "CN_MCI_AD": ["CN", "MCI", "AD"],
}

# Text to class number.
SEX = {"F": 0, "M": 1}
MARITAL = {"Never married": 0, "Married": 1, "Widowed": 2, "Divorced": 3, "Unknown": 4}
STATUS_CLASSIFICATION = {"CN": 0, "MCI": 1, "ADD": 2}
STATUS_REGRESSION = {"CN": 0, "MCI": 1, "AD": 2}
AMYLOID = {"A-": 0, "A+": 1}


def lookup(col: str | Column, mapping: dict) -> Column:
    """Value of a literal map; a key it lacks gives NULL."""
    entries = ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in mapping.items())
    key = F.col(col) if isinstance(col, str) else col
    return F.expr(f"map({entries})")[key]


def sql_literal(v: object) -> str:
    """A Python value as SQL text; one expression of text is far cheaper to build than many calls."""
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, float):
        return f"double('{v!r}')"
    return str(v)


def drop_columns(df: DataFrame, cols: list[str], strict: bool = True) -> DataFrame:
    """Drop columns; with ``strict`` a missing one is an error."""
    missing = [c for c in cols if c not in df.columns]
    if strict and missing:
        raise ValueError(f"columns not found: {missing}")
    return df.drop(*cols)


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def encode_labels(df: DataFrame, rules: dict[str, tuple[str, dict]]) -> DataFrame:
    """Add each target column right after its source; unmapped text becomes NULL."""
    out = []
    for c in df.columns:
        out.append(F.col(f"`{c}`"))
        if c in rules:
            name, mapping = rules[c]
            out.append(lookup(F.col(f"`{c}`"), mapping).alias(name))
    return df.select(*out)


def unmapped_counts(df: DataFrame, rules: dict[str, tuple[str, dict]]) -> DataFrame:
    """Rows whose source has a value that the map does not know, per source column."""
    pairs = F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            (F.col(f"`{c}`").isNotNull() & lookup(F.col(f"`{c}`"), m).isNull()).cast("long").alias("bad"),
        )
        for c, (_, m) in rules.items()
    ])
    return df.select(F.inline(pairs)).groupBy("column").agg(F.sum("bad").alias("n_unmapped"))


def drop_other_target(df: DataFrame, target: str, targets: tuple[str, str] = ("RG_le", "DX_le"), subject: str = "PTID") -> DataFrame:
    """Drop the subject id and the target that is not used."""
    return drop_columns(df, [subject, *[t for t in targets if t != target]])


def select_features(df: DataFrame, features: list[str], target: str, id_col: str = "row_id") -> DataFrame:
    """Row id, one combination's features, and the target."""
    return df.select(id_col, *[F.col(f"`{f}`") for f in features], target)


def binary_cohort(df: DataFrame, comparison: str, label: str = "label") -> DataFrame:
    """Keep two classes, recoded to 0 and 1. A NULL label falls out."""
    zero, one = COMPARISONS[comparison]
    kept = df.filter(F.col(label).isin(zero, one))
    return kept.withColumn(label, F.when(F.col(label) == one, 1).otherwise(0))


def three_class_cohort(df: DataFrame, label: str = "label", drop_null: bool = False) -> DataFrame:
    """All three classes; NULL labels stay unless ``drop_null``."""
    return df.filter(F.col(label).isNotNull()) if drop_null else df


def target_not_null(df: DataFrame, target: str = "label") -> DataFrame:
    return df.filter(F.col(target).isNotNull() & ~F.isnan(target))


def target_nonzero(df: DataFrame, target: str = "label") -> DataFrame:
    return target_not_null(df, target).filter(F.col(target) != 0)


def split_xy(df: DataFrame, label: str = "label", id_col: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Features and target as two tables that share the row id."""
    return df.drop(label), df.select(id_col, label)


def validate_xy(x_train: DataFrame, y_train: DataFrame, x_test: DataFrame, y_test: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Violations ``(part, problem, n)``; an empty table means the four parts fit together."""
    spark = x_train.sparkSession
    found = []
    for part, x, y in [("train", x_train, y_train), ("test", x_test, y_test)]:
        for problem, a, b in [("x without y", x, y), ("y without x", y, x)]:
            lost = a.select(id_col).join(b.select(id_col), id_col, "left_anti")
            found.append(lost.agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), F.lit(problem).alias("problem"), "n"))
    width = abs(len(x_train.columns) - len(x_test.columns))
    if width:
        found.append(spark.range(1).select(F.lit("both").alias("part"), F.lit("widths differ").alias("problem"), F.lit(width).cast("long").alias("n")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.filter(F.col("n") > 0)


def decode_classes(df: DataFrame, comparison: str, label: str = "label", out: str = "class_name") -> DataFrame:
    """Class number to display name."""
    return df.withColumn(out, lookup(F.col(label), dict(enumerate(CLASS_NAMES[comparison]))))


def assemble_features(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """Scalar columns to one vector column; a NULL or NaN is an error."""
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="error").transform(df)
