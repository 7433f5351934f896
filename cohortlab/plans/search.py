"""Grid search and nested cross-validation on fold columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as m
from ..learners import MANY, SCORES
from ..learners.base import score
from ..learners.shared import shared_predictions, shared_scores
from ..operators.sampling import nested_columns
from ..session import cut_lineage, delete_folder
from .grids import candidates, sample_candidates
from .jobs import finished_folders, job_name, stored

Fit = Callable[[DataFrame, dict], object]


CANDIDATES_PER_JOB = 16


def fold_models(df: DataFrame, fit: Fit, options: list[dict], fold_col: str, n_folds: int, parallelism: int = 4) -> list[list]:
    """models[candidate][fold], each fitted without its fold.

    Learners with shared statistics need one pass for all of them; the others are fitted side by side.
    """
    if fit in MANY:
        return MANY[fit](df, fold_col, n_folds, options)
    parts = [df.filter(F.col(fold_col) != f) for f in range(n_folds)]
    with ThreadPool(parallelism) as pool:
        flat = pool.map(lambda t: fit(parts[t[1]], options[t[0]]), [(i, f) for i in range(len(options)) for f in range(n_folds)])
    return [flat[i * n_folds:(i + 1) * n_folds] for i in range(len(options))]


def out_of_fold(df: DataFrame, models: list, fold_col: str) -> DataFrame:
    """Predictions of each fold's rows by the model fitted without them."""
    parts = [
        score(m_, df.filter(F.col(fold_col) == f)).select("label", fold_col, F.col("prediction").cast("double").alias("prediction"))
        for f, m_ in enumerate(models)
    ]
    return reduce(DataFrame.unionByName, parts)


def fold_scores(pred: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """(keys, score) with accuracy or R2."""
    if metric == "accuracy":
        return pred.groupBy(*keys).agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("score"))
    return m.regression_metrics(pred, keys).select(*keys, F.col("r2").alias("score"))


def candidate_list(grid: dict[str, list], method: str = "grid", n_iter: int = 10, seed: int = 42) -> list[dict]:
    if method == "grid":
        return candidates(grid)
    if method == "random":
        return sample_candidates(grid, n_iter, seed)
    raise ValueError("method must be 'grid' or 'random'")


def grid_scores(df: DataFrame, fit: Fit, options: list[dict], fold_col: str, n_folds: int, metric: str, parallelism: int = 4, jobs: str | None = None) -> list[dict]:
    """(param_id, fold, score) of every candidate; many candidates are scored in one job.

    With ``jobs``, a folder, a candidate's fit and score on a fold are a job of their own, whose score is stored there and not made again by a rerun;
    learners that fit all candidates from one pass have one job for all.
    """
    if jobs is not None:
        return _stored_scores(df, fit, options, fold_col, n_folds, metric, parallelism, jobs)
    if fit in SCORES and metric == "accuracy":
        return SCORES[fit](df, fold_col, n_folds, options)
    models = fold_models(df, fit, options, fold_col, n_folds, parallelism)
    if fit in MANY:
        return shared_scores(df, [fold_col], [models], metric)[0]
    out = []
    for at in range(0, len(options), CANDIDATES_PER_JOB):
        tagged = [
            out_of_fold(df, models[i], fold_col).withColumn("param_id", F.lit(i)) for i in range(at, min(at + CANDIDATES_PER_JOB, len(options)))
        ]
        rows = fold_scores(reduce(DataFrame.unionByName, tagged), ["param_id", fold_col], metric).collect()
        out += [{"param_id": r["param_id"], "fold": r[fold_col], "score": r["score"]} for r in rows]
    return sorted(out, key=lambda r: (r["param_id"], r["fold"]))


def _stored_scores(df: DataFrame, fit: Fit, options: list[dict], fold_col: str, n_folds: int, metric: str, parallelism: int, jobs: str) -> list[dict]:
    spark, schema = df.sparkSession, "param_id int, fold int, score double"

    def one(i: int, f: int) -> DataFrame:
        model = fit(df.filter(F.col(fold_col) != f), options[i])
        pred = score(model, df.filter(F.col(fold_col) == f)).select("label", F.col("prediction").cast("double").alias("prediction"))
        return fold_scores(pred.withColumn("param_id", F.lit(i)).withColumn("fold", F.lit(f)), ["param_id", "fold"], metric)

    def every() -> DataFrame:
        rows = grid_scores(df, fit, options, fold_col, n_folds, metric, parallelism)
        return spark.createDataFrame([(r["param_id"], r["fold"], r["score"]) for r in rows], schema)

    if fit in MANY or fit in SCORES:
        todo = {job_name(options, n_folds, metric): every}
    else:
        todo = {job_name(i, options[i], f, n_folds, metric): partial(one, i, f) for i in range(len(options)) for f in range(n_folds)}
    rows = stored(spark, jobs, todo, parallelism, pool=jobs).select("param_id", "fold", "score").collect()
    return sorted((r.asDict() for r in rows), key=lambda r: (r["param_id"], r["fold"]))


def best_of(scores: list[dict]) -> tuple[int, float]:
    """Candidate number with the highest mean score, the first on ties."""
    by_id: dict[int, list[float]] = {}
    for s in scores:
        by_id.setdefault(s["param_id"], []).append(s["score"])
    means = {i: sum(v) / len(v) for i, v in by_id.items()}
    best = max(means, key=lambda i: (means[i], -i))
    return best, means[best]


def grid_search(df: DataFrame, fit: Fit, grid: dict[str, list], fold_col: str = "fold", n_folds: int = 3, metric: str = "accuracy",
                method: str = "grid", n_iter: int = 10, seed: int = 42, parallelism: int = 4):
    """(model refitted on all rows, best parameters, best mean score, scores per candidate and fold)."""
    options = candidate_list(grid, method, n_iter, seed)
    scores = grid_scores(df, fit, options, fold_col, n_folds, metric, parallelism)
    i, value = best_of(scores)
    return fit(df, options[i]), options[i], value, scores


def _fold_predictions(train: DataFrame, folded: DataFrame, fit: Fit, params: dict, f: int) -> DataFrame:
    scored = score(fit(train, params), folded.filter(F.col("outer_fold") == f))
    names = ["row_id", "label", F.col("outer_fold").alias("fold"), F.col("prediction").cast("double").alias("prediction")]
    return scored.select(*names, *[c for c in ("probability",) if c in scored.columns])


def nested_table(df: DataFrame, outer: int = 5, inner: int = 3, classify: bool = True, seed: int = 42) -> DataFrame:
    """The rows with all outer and inner folds of a nested search, kept in memory; learners that are searched alike share it."""
    return nested_columns(df, outer, inner, "label" if classify else None, seed).persist()


def nested_predictions(df: DataFrame, fit: Fit, grid: dict[str, list], outer: int = 5, inner: int = 3, classify: bool = True,
                       method: str = "random", n_iter: int = 10, seed: int = 42, parallelism: int = 4,
                       jobs: str | None = None, folded: DataFrame | None = None) -> tuple[DataFrame, list[dict]]:
    """Predictions for every row by the model whose parameters were searched without its outer fold.

    With ``jobs``, a folder, scores of candidates and predictions of outer folds are stored there, and a rerun goes on after the last one stored.
    ``folded`` is the ``nested_table`` of the same arguments, if there is one already.
    """
    metric = "accuracy" if classify else "r2"
    table = nested_table(df, outer, inner, classify, seed) if folded is None else folded
    options = candidate_list(grid, method, n_iter, seed)
    if fit in MANY:
        pred, chosen = _shared_search(table, MANY[fit], options, outer, inner, classify, metric, jobs)
        # predictions that are stored as a job are read from there
        pred = cut_lineage(pred) if jobs is None else pred
    else:
        parts, chosen = [], []
        for f in range(outer):
            train = table.filter(F.col("outer_fold") != f).withColumn("inner_fold", F.col(f"inner_{f}"))
            own = None if jobs is None else f"{jobs}/outer={f}"
            scores = grid_scores(train, fit, options, "inner_fold", inner, metric, parallelism, None if own is None else f"{own}/scores")
            best, value = best_of(scores)
            chosen.append({"fold": f, "params": options[best], "score": value})
            predict = partial(_fold_predictions, train, table, fit, options[best], f)
            name = job_name(options, best, inner, metric)
            parts.append(predict() if own is None else stored(df.sparkSession, f"{own}/predictions", {name: predict}, 1, pool=own, files=None))
        # several metrics read the predictions: score the rows once
        pred = cut_lineage(reduce(DataFrame.unionByName, parts))
    if folded is None:
        table.unpersist()
    return pred, chosen


def _shared_search(table: DataFrame, many, options: list[dict], outer: int, inner: int, classify: bool, metric: str, jobs: str | None) -> tuple[DataFrame, list[dict]]:
    """As ``nested_predictions`` for a learner with shared statistics: a pass for all fits, one for all scores, one for all predictions."""
    spark, inside = table.sparkSession, [f"inner_{f}" for f in range(outer)]
    fits = cache(lambda: many.nested(table, inside, inner, options))

    def every() -> DataFrame:
        scores = shared_scores(table, inside, [models for models, _ in fits()], metric)
        return spark.createDataFrame([(o, r["param_id"], r["fold"], r["score"]) for o, rows in enumerate(scores) for r in rows], "outer int, param_id int, fold int, score double")

    kept = every() if jobs is None else stored(spark, f"{jobs}/scores", {job_name(options, outer, inner, metric): every}, 1, pool=jobs)
    scores = sorted((r.asDict() for r in kept.collect()), key=lambda r: (r["outer"], r["param_id"], r["fold"]))
    picked = [best_of([r for r in scores if r["outer"] == o]) for o in range(outer)]
    chosen = [{"fold": o, "params": options[best], "score": value} for o, (best, value) in enumerate(picked)]

    def predict() -> DataFrame:
        return shared_predictions(table, "outer_fold", [whole[best] for (_, whole), (best, _) in zip(fits(), picked)], classify)

    if jobs is None:
        return predict(), chosen
    name = job_name(options, [best for best, _ in picked], outer, inner, metric)
    return stored(spark, f"{jobs}/predictions", {name: predict}, 1, pool=jobs, files=None), chosen


def nested_cv_classify(df: DataFrame, fit: Fit, grid: dict[str, list], outer: int = 5, inner: int = 3, n_classes: int = 2, **options) -> DataFrame:
    """``(fold, metric, value)`` x 100: six label metrics and the AUC of each outer fold."""
    pred, _ = nested_predictions(df, fit, grid, outer, inner, True, **options)
    return classification_folds(pred, n_classes)


def classification_folds(pred: DataFrame, n_classes: int) -> DataFrame:
    pred = pred.withColumn("prediction", F.col("prediction").cast("int"))
    wide = m.label_metrics(m.confusion(pred, ["fold"]), ["fold"])
    if n_classes == 2:
        auc = m.auc_binary(pred.withColumn("_s", F.col("probability")[1]), "_s", keys=["fold"]).select("fold", "auc")
    else:
        auc = m.auc_ovr_weighted(pred, keys=["fold"])
    long = m.to_long(wide.join(auc, "fold"), ["fold"], [*m.LABEL_METRICS, "auc"])
    return long.withColumn("value", F.col("value") * 100)


def nested_cv_regress(df: DataFrame, fit: Fit, grid: dict[str, list], n_features: int, outer: int = 5, inner: int = 3, **options) -> DataFrame:
    """``(fold, metric, value)``: six regression metrics of each outer fold."""
    pred, _ = nested_predictions(df, fit, grid, outer, inner, False, **options)
    wide = m.regression_metrics(pred, ["fold"], n_features + 1)
    return m.to_long(wide, ["fold"], ["mae", "mse", "rmse", "r2", "aic", "bic"])


def run_all_models(df: DataFrame, learners: dict[str, Fit], grids: dict[str, dict], path: str, n_classes: int = 2, n_features: int = 1,
                   classify: bool = True, **options) -> DataFrame:
    """Nested CV of every learner that has no result below ``path`` yet, then the summary of all.

    Results are one Parquet folder per model; until it is written, those of the model's fits and folds are kept below ``path/jobs``. An
    interrupted run goes on after the last fit that was stored.
    """
    spark = df.sparkSession
    done = finished_models(spark, path)
    todo = {name: fit for name, fit in learners.items() if name not in done}
    shared = {k: options[k] for k in ("outer", "inner", "seed") if k in options}
    folded = nested_table(df, classify=classify, **shared) if todo else None
    for name, fit in todo.items():
        jobs = f"{path}/jobs/{name}"
        if classify:
            folds = nested_cv_classify(df, fit, grids[name], n_classes=n_classes, jobs=jobs, folded=folded, **options)
        else:
            folds = nested_cv_regress(df, fit, grids[name], n_features, jobs=jobs, folded=folded, **options)
        folds.write.mode("overwrite").parquet(f"{path}/model={name}")
        delete_folder(spark, jobs)
    if folded is not None:
        folded.unpersist()
    results = spark.read.option("basePath", path).parquet(*[f"{path}/model={n}" for n in learners])
    return m.summarize_with_ci(results)


def finished_models(spark, path: str) -> set[str]:
    """Models whose result folder was written completely."""
    return finished_folders(spark, path, "model=")
