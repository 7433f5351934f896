import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortlab import learners as L
from cohortlab.learners.shared import shared_scores
from cohortlab.operators.sampling import nested_columns, nested_folds
from cohortlab.plans import search
from cohortlab.plans.grids import REGRESSOR_GRIDS
from cohortlab.registry import QUERIES


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, [float(i % 7), float(i % 5)], int(i % 7 > 3), 2.0 * (i % 7) + (i % 5) + (i % 11) * 0.1) for i in range(200)]
    return spark.createDataFrame(data, "row_id long, features array<double>, cls int, y double").withColumn("features", array_to_vector("features")).cache()


@pytest.mark.parametrize("label", [None, "cls"])
def test_folds_side_by_side_are_those_of_nested_folds(rows, label):
    long = {(r["row_id"], r["outer_fold"]): r["inner_fold"] for r in nested_folds(rows, 4, 3, label).collect()}
    got = {(r["row_id"], f): r[f"inner_{f}"] for r in nested_columns(rows, 4, 3, label).collect() for f in range(4) if r["outer_fold"] != f}
    assert got == long


@pytest.mark.parametrize("name,options", [("Ridge", [{"alpha": 0.1}, {"alpha": 50.0}]), ("LDA", [{"shrinkage": "auto"}, {"shrinkage": 0.5}]), ("NB", [{}])])
def test_one_pass_scores_are_those_of_fits_on_filtered_rows(rows, name, options):
    classify = name != "Ridge"
    fit, metric = (L.CLASSIFIERS if classify else L.REGRESSORS)[name], "accuracy" if classify else "r2"
    df = nested_columns(rows.withColumn("label", F.col("cls" if classify else "y")), 2, 2, "label" if classify else None)
    models = [m for m, _ in L.MANY[fit].nested(df, ["inner_0", "inner_1"], 2, options)]
    for j, scores in enumerate(shared_scores(df, ["inner_0", "inner_1"], models, metric)):
        assert len(scores) == 2 * len(options)
        for s in scores:
            f, col = s["fold"], f"inner_{j}"
            pred = fit(df.filter(F.col(col) != f), options[s["param_id"]]).transform(df.filter(F.col(col) == f)).withColumn("k", F.lit(0))
            assert search.fold_scores(pred, ["k"], metric).first()["score"] == pytest.approx(s["score"], abs=1e-8)


def test_nested_search_of_shared_fits_takes_few_jobs(spark, rows):
    spark.sparkContext.setJobGroup("nested", "nested search")
    try:
        pred, chosen = search.nested_predictions(rows.withColumn("label", F.col("y")), L.REGRESSORS["Ridge"], {"alpha": [0.1, 1.0, 10.0]}, 5, 3, False)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("nested"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert pred.count() == 200 and [c["fold"] for c in chosen] == list(range(5))
    assert jobs <= 40  # 115 when every outer fold had passes of its own


def test_all_regressors_are_searched_with_whole_grids(spark, data_dir, monkeypatch):
    asked = {}
    monkeypatch.setattr(search, "run_all_models", lambda df, learners, grids, path, **options: asked.update(learners=learners, grids=grids, options=options))
    QUERIES["run_all_models_regress"](spark, data_dir)
    assert set(asked["learners"]) == set(L.REGRESSORS) and len(L.REGRESSORS) == 12  # 4 of them before
    fitted = [len(search.candidate_list(grid, asked["options"].get("method", "random"), asked["options"].get("n_iter", 10))) for grid in asked["grids"].values()]
    assert sum(fitted) == 1634  # 24 before


def test_whole_grids_are_searched_to_the_summary(spark, data_dir, monkeypatch):
    names, seen, every = ["LR", "Ridge", "Lasso", "ElasticNet"], [], search.candidate_list
    monkeypatch.setattr(L, "REGRESSORS", {n: L.REGRESSORS[n] for n in names})
    monkeypatch.setattr(search, "candidate_list", lambda *a: seen.append(every(*a)) or seen[-1])
    rows = QUERIES["run_all_models_regress"](spark, data_dir).collect()
    assert [len(s) for s in seen] == [2, 6, 6, 16] and len(rows) == 24  # 10 for ElasticNet before
    assert seen == [every(REGRESSOR_GRIDS[n]) for n in names]
