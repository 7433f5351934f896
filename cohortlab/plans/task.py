"""A whole training task: nested search, stored models, selection, voting, intervals, report sheet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as m
from ..functions.bootstrap import bootstrap_classification, bootstrap_regression
from ..learners.base import score
from ..operators.ensemble import load_selected, mean_vote, predict_all, select_topk, soft_vote
from ..operators.sampling import kfold, stratified_kfold
from ..sources.books import write_report_sheet
from ..session import delete_folder
from ..sources.models import load_model, resume_pending, save_model
from .search import Fit, finished_models, grid_search, nested_cv_classify, nested_cv_regress, nested_table


def _names(spark, names) -> DataFrame:
    return spark.createDataFrame([(n,) for n in sorted(names)], "model string")


def training_task(
    train: DataFrame, test: DataFrame, learners: dict[str, Fit], grids: dict[str, dict], path: str, book: str, sheet: str, classify: bool = True,
    n_classes: int = 2, n_features: int = 1, top: int = 3, outer: int = 5, inner: int = 3, n_iter: int = 10, replicates: int = 1000, seed: int = 42,
) -> DataFrame:
    """Metrics of the ensemble on ``test`` with bootstrap intervals, also written as one sheet of ``book``.

    Below ``path`` a learner has its fold results, its model (searched and refitted on all of ``train``) and a mark once both are
    written. A rerun fits only learners without a mark, and of these only candidates and folds whose scores are not stored yet. The ``top`` learners by accuracy (R2) vote: mean probabilities, or mean values.
    """
    spark = train.sparkSession
    results, marks = f"{path}/results", f"{path}/done"
    pending = resume_pending(_names(spark, learners), _names(spark, finished_models(spark, marks)), _names(spark, finished_models(spark, results)), ["model"])
    names = sorted(r["model"] for r in pending.collect())
    nested = nested_table(train, outer, inner, classify, seed) if names else None
    folded = (stratified_kfold(train, "label", inner, seed) if classify else kfold(train, inner, seed)).persist() if names else None
    for name in names:
        fit, options = learners[name], {"n_iter": n_iter, "seed": seed, "jobs": f"{path}/jobs/{name}", "folded": nested}
        if classify:
            folds = nested_cv_classify(train, fit, grids[name], outer, inner, n_classes, **options)
        else:
            folds = nested_cv_regress(train, fit, grids[name], n_features, outer, inner, **options)
        folds.write.mode("overwrite").parquet(f"{results}/model={name}")
        model, _, _, _ = grid_search(folded, fit, grids[name], "fold", inner, "accuracy" if classify else "r2", "random", n_iter, seed)
        save_model(model, f"{path}/models/{name}")
        _names(spark, [name]).write.mode("overwrite").parquet(f"{marks}/model={name}")
        delete_folder(spark, f"{path}/jobs/{name}")
    for kept in (nested, folded):
        if kept is not None:
            kept.unpersist()
    summary = m.summarize_with_ci(spark.read.option("basePath", results).parquet(*[f"{results}/model={n}" for n in learners]))
    selected = load_selected(select_topk(summary, top, "accuracy" if classify else "r2"), _names(spark, finished_models(spark, marks)))
    models = {r["model"]: load_model(spark, f"{path}/models/{r['model']}") for r in selected.collect()}
    labels = test.select("row_id", "label")
    if classify:
        votes = [score(model, test).select("row_id", F.lit(name).alias("model"), "probability") for name, model in models.items()]
        voted = soft_vote(reduce(DataFrame.unionByName, votes), n_classes=n_classes).join(labels, "row_id")
        report = bootstrap_classification(voted, replicates, seed, n_classes=n_classes)
    else:
        voted = mean_vote(predict_all(models, test)).join(labels, "row_id")
        report = bootstrap_regression(voted, replicates, seed, p=n_features + 1)
    write_report_sheet(report, book, sheet)
    return report
