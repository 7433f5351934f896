"""Classification and regression metrics as grouped aggregations.

Label metrics read a confusion table (at most K x K rows per group), so the data is scanned once and
combined map-side. Rank metrics group by score first and take running sums per value range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running_sums, value_buckets
from ..session import cut_lineage

LABEL_METRICS = ["accuracy", "balanced_accuracy", "mcc", "precision_weighted", "recall_weighted", "f1_weighted"]


def confusion(df: DataFrame, keys: list[str] = (), label: str = "label", prediction: str = "prediction", weight: Column | None = None) -> DataFrame:
    """Counts (or weight sums) of label x prediction per ``keys``."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(*keys, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(n.alias("n"))


def label_metrics(cm: DataFrame, keys: list[str] = ()) -> DataFrame:
    """All six label metrics per ``keys`` as fractions; unused ones are pruned by the optimiser."""
    keys = list(keys)
    n = F.col("n").cast("double")
    hit = F.col("label") == F.col("prediction")
    zero = F.lit(0.0)
    sides = F.array(
        F.struct(F.col("label").alias("cls"), n.alias("t"), zero.alias("p"), F.when(hit, n).otherwise(zero).alias("tp")),
        F.struct(F.col("prediction").cast(cm.schema["label"].dataType).alias("cls"), zero.alias("t"), n.alias("p"), zero.alias("tp")),
    )
    per_class = (
        cm.select(*keys, F.inline(sides))
        .groupBy(*keys, "cls")
        .agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("tp").alias("tp"))
    )
    t, p, tp = F.col("t"), F.col("p"), F.col("tp")
    prec = F.when(p > 0, tp / p).otherwise(zero)
    f1 = F.when(t + p > 0, 2 * tp / (t + p)).otherwise(zero)
    sums = per_class.groupBy(*keys).agg(
        F.sum(t).alias("s"),
        F.sum(tp).alias("c"),
        F.avg(F.when(t > 0, tp / t)).alias("bacc"),
        F.sum(t * p).alias("tp_cross"),
        F.sum(p * p).alias("pp"),
        F.sum(t * t).alias("tt"),
        F.sum(t * prec).alias("wprec"),
        F.sum(t * f1).alias("wf1"),
    )
    s, c = F.col("s"), F.col("c")
    root = F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))
    return sums.select(
        *keys,
        (c / s).alias("accuracy"),
        F.col("bacc").alias("balanced_accuracy"),
        F.when(root == 0, zero).otherwise((c * s - F.col("tp_cross")) / root).alias("mcc"),
        (F.col("wprec") / s).alias("precision_weighted"),
        (c / s).alias("recall_weighted"),
        (F.col("wf1") / s).alias("f1_weighted"),
    )


def _one(name: str):
    def metric(cm: DataFrame, keys: list[str] = ()) -> DataFrame:
        return label_metrics(cm, keys).select(*keys, (F.col(name) * 100).alias(name))

    metric.__name__ = name
    metric.__doc__ = f"{name} x 100 per ``keys`` from a confusion table."
    return metric


accuracy = _one("accuracy")
balanced_accuracy = _one("balanced_accuracy")
mcc = _one("mcc")
precision_weighted = _one("precision_weighted")
recall_weighted = _one("recall_weighted")
f1_weighted = _one("f1_weighted")


def _score_table(df: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """One row per distinct score: positives and negatives, with the value range it lies in."""
    pos = positive.cast("long")
    # the offsets and the running sums both read this: the scores are worked out once
    return cut_lineage(
        value_buckets(df.withColumn("_pos", pos).withColumn("_score", F.col(score).cast("double")), "_score")
        .groupBy(*keys, "_bkt", "_score")
        .agg(F.sum("_pos").alias("pos"), F.sum(1 - F.col("_pos")).alias("neg"))
    )


def auc_binary(df: DataFrame, score: str = "score", label: str = "label", keys: list[str] = (), positive: Column | None = None) -> DataFrame:
    """Area under the ROC curve, ties at mid-rank; NULL when a group has one class only."""
    keys = list(keys)
    table = _score_table(df, keys, score, positive if positive is not None else F.col(label) == 1)
    run = running_sums(table, keys, "_bkt", [F.col("_score")], {"cum_neg": "neg"})
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    wins = F.sum(pos * (F.col("cum_neg") - neg / 2))
    pairs = F.sum(pos) * F.sum(neg)
    return run.groupBy(*keys).agg(
        F.when(pairs > 0, wins / pairs).alias("auc"), F.sum("pos").alias("n_pos")
    )


def auc_ovr_weighted(df: DataFrame, probability: str = "probability", label: str = "label", keys: list[str] = ()) -> DataFrame:
    """One-vs-rest AUC per class, averaged with the class sizes as weights."""
    keys = list(keys)
    # the outer form: the plain one is preceded by a filter on the array, which works it out twice
    long = df.select(*keys, label, F.posexplode_outer(probability).alias("cls", "score")).filter(F.col("cls").isNotNull())
    per_class = auc_binary(long, "score", label, [*keys, "cls"], F.col(label) == F.col("cls"))
    # a class without positives has weight 0, as in the averaged form
    return per_class.groupBy(*keys).agg(
        (F.sum(F.when(F.col("n_pos") > 0, F.col("auc") * F.col("n_pos"))) / F.sum("n_pos")).alias("auc")
    )


def label_binarize(df: DataFrame, k: int, label: str = "label", out: str = "indicator") -> DataFrame:
    """Class number to an array of K indicators."""
    return df.withColumn(
        out,
        F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: (F.col(label) == c).cast("int")),
    )


def roc_curve(df: DataFrame, score: str = "score", label: str = "label", keys: list[str] = ()) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, from the highest down."""
    keys = list(keys)
    table = _score_table(df, keys, score, F.col(label) == 1)
    run = running_sums(table, keys, "_bkt", [F.col("_score").desc()], {"tp": "pos", "fp": "neg"}, descending=True)
    totals = table.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    if keys:
        run = run.join(totals, keys)
        n_pos, n_neg = F.col("_p"), F.col("_n")
    else:
        run = run.withColumn("_both", totals.select(F.struct("_p", "_n").alias("s")).scalar())
        n_pos, n_neg = F.col("_both._p"), F.col("_both._n")
    return run.select(
        *keys,
        F.col("_score").alias("threshold"),
        (F.col("fp") / n_neg).alias("fpr"),
        (F.col("tp") / n_pos).alias("tpr"),
    )


def regression_sums(df: DataFrame, keys: list[str] = (), label: str = "label", prediction: str = "prediction", weight: Column | None = None) -> DataFrame:
    """Per ``keys``: n, sum of |e|, e^2 and the total sum of squares around the mean."""
    y, e = F.col(label), F.col(label) - F.col(prediction)
    if weight is None:
        n, tss = F.count(F.lit(1)).cast("double"), F.var_pop(y) * F.count(F.lit(1))
        ae, rss = F.sum(F.abs(e)), F.sum(e * e)
    else:
        n = F.sum(weight)
        ae, rss = F.sum(weight * F.abs(e)), F.sum(weight * e * e)
        tss = F.sum(weight * y * y) - F.sum(weight * y) * F.sum(weight * y) / F.sum(weight)
    return df.groupBy(*keys).agg(n.alias("n"), ae.alias("ae"), rss.alias("rss"), tss.alias("tss"))


def regression_scores(sums: DataFrame, keys: list[str], p: int) -> DataFrame:
    """The six regression metrics from ``regression_sums``; ``p`` counts the fitted parameters."""
    n, rss = F.col("n"), F.col("rss")
    fit = n * F.log(rss / n)
    return sums.select(
        *keys,
        (F.col("ae") / n).alias("mae"),
        (rss / n).alias("mse"),
        F.sqrt(rss / n).alias("rmse"),
        (1 - rss / F.col("tss")).alias("r2"),
        (fit + 2 * p).alias("aic"),
        (fit + p * F.log(n)).alias("bic"),
    )


def regression_metrics(df: DataFrame, keys: list[str] = (), p: int = 2, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """MAE, MSE, RMSE, R2, AIC and BIC per ``keys`` in one aggregation."""
    return regression_scores(regression_sums(df, keys, label, prediction), list(keys), p)


def _reg(name: str):
    def metric(df: DataFrame, keys: list[str] = (), p: int = 2) -> DataFrame:
        return regression_metrics(df, keys, p).select(*keys, name)

    metric.__name__ = name
    metric.__doc__ = f"{name} per ``keys``."
    return metric


mae, mse, rmse, r2, aic, bic = (_reg(m) for m in ["mae", "mse", "rmse", "r2", "aic", "bic"])


def evaluate_regressors(long_predictions: DataFrame, n_features: int) -> DataFrame:
    """All six metrics for every model of a long prediction table."""
    return regression_metrics(long_predictions, ["model"], n_features + 1)


def to_long(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Wide metric columns to (keys, metric, value)."""
    return df.unpivot(list(keys), metrics, "metric", "value")


def summarize_with_ci(long: DataFrame, keys: list[str] = ("model", "metric"), population: bool = False, skip_null: bool = False) -> DataFrame:
    """Mean, std and 2.5 / 97.5 percentiles of ``value`` per ``keys``.

    A NULL among the values makes the percentiles NULL, unless ``skip_null``.
    """
    std = F.stddev_pop("value") if population else F.stddev_samp("value")
    whole = F.lit(True) if skip_null else F.count("value") == F.count(F.lit(1))

    def pct(q: float) -> Column:
        return F.when(whole, F.percentile("value", q))

    return long.groupBy(*keys).agg(
        F.avg("value").alias("mean"),
        std.alias("std"),
        pct(0.025).alias("ci_lower"),
        pct(0.975).alias("ci_upper"),
    )


def evaluate_single_prediction(df: DataFrame, probability: str = "probability", n_classes: int = 2, model: str = "Ensemble") -> DataFrame:
    """One summary row per metric for a single prediction column; std is NULL, all values x 100."""
    wide = label_metrics(confusion(df))
    if n_classes == 2:
        auc = auc_binary(df.withColumn("_s", F.element_at(probability, 2)), "_s").select("auc").scalar()
    else:
        auc = auc_ovr_weighted(df, probability).scalar()
    wide = wide.withColumn("auc", auc)
    long = to_long(wide.withColumn("model", F.lit(model)), ["model"], [*LABEL_METRICS, "auc"])
    return summarize_with_ci(long.withColumn("value", F.col("value") * 100))
