import pytest

from cohortlab import learners as L
from cohortlab.plans.task import training_task
from cohortlab.sources.books import read_report_sheet


@pytest.mark.parametrize("classify", [True, False])
def test_task_from_search_to_report(spark, tmp_path, classify):
    from pyspark.ml.functions import array_to_vector

    rows = [(i, [float(i % 7), float(i % 5)], float(i % 7 > 3) if classify else 2.0 * (i % 7) + (i % 5) + (i % 11) * 0.1) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>, label double").withColumn("features", array_to_vector("features"))
    train, test = df.filter("row_id % 4 > 0"), df.filter("row_id % 4 = 0")
    every = L.CLASSIFIERS if classify else L.REGRESSORS
    grids = {"NB": {"var_smoothing": [1e-9, 1e-3]}, "LDA": {"shrinkage": [0.0, 0.5]}} if classify else {"LR": {"fit_intercept": [True]}, "Ridge": {"alpha": [0.01, 1.0]}}
    fits = []

    def counted(name):
        def fit(data, params):
            fits.append(name)
            return every[name](data, params)

        return fit

    learners = {n: counted(n) for n in grids}
    args = (train, test, learners, grids, f"{tmp_path}/task", f"{tmp_path}/book", "one", classify)
    options = {"n_features": 2, "top": 2, "outer": 3, "inner": 2, "n_iter": 2, "replicates": 50}
    first = sorted(map(tuple, training_task(*args, **options).collect()))
    assert len(first) == (7 if classify else 6) and set(fits) == set(grids)
    best = {r[0]: r[1] for r in first}
    assert best["accuracy"] > 90 if classify else best["r2"] > 0.9
    sheet = read_report_sheet(spark, f"{tmp_path}/book", "one")
    assert sorted(map(tuple, sheet.select("metric", "mean", "std", "ci_lower", "ci_upper").collect())) == first
    n = len(fits)
    again = sorted(map(tuple, training_task(*args, **options).collect()))
    assert len(fits) == n and again == first
