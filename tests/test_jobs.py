import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortlab import learners as L
from cohortlab.plans.jobs import finished_folders, stored
from cohortlab.plans.search import nested_predictions, run_all_models
from cohortlab.sources.tables import exists


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, [float(i % 7), float(i % 5)], 2.0 * (i % 7) + (i % 5) + (i % 11) * 0.1) for i in range(120)]
    return spark.createDataFrame(data, "row_id long, features array<double>, label double").withColumn("features", array_to_vector("features")).cache()


class Killed(Exception):
    pass


def counting(fit, end=None):
    """(fit that notes its parameters and gives up after ``end`` fits, notes)."""
    notes = []

    def counted(data, params):
        if end is not None and len(notes) >= end:
            raise Killed
        notes.append(params["alpha"])
        return fit(data, params)

    return counted, notes


def test_a_killed_run_goes_on_at_the_job(spark, rows, tmp_path):
    grid = {"alpha": [0.01, 1.0, 100.0]}
    options = {"outer": 2, "inner": 2, "parallelism": 1, "n_iter": 3}
    whole, every = counting(L.REGRESSORS["Ridge"])
    wanted = sorted(map(tuple, run_all_models(rows, {"Ridge": whole}, {"Ridge": grid}, f"{tmp_path}/whole", classify=False, **options).collect()))
    assert len(every) == 2 * (3 * 2 + 1)
    path, cut = f"{tmp_path}/cut", 9
    killed, before = counting(L.REGRESSORS["Ridge"], cut)
    with pytest.raises(Killed):
        run_all_models(rows, {"Ridge": killed}, {"Ridge": grid}, path, classify=False, **options)
    assert exists(spark, f"{path}/jobs/Ridge")
    again, after = counting(L.REGRESSORS["Ridge"])
    got = sorted(map(tuple, run_all_models(rows, {"Ridge": again}, {"Ridge": grid}, path, classify=False, **options).collect()))
    assert got == wanted and len(before) == cut and len(after) == len(every) - cut
    assert not exists(spark, f"{path}/jobs/Ridge")
    third, none = counting(L.REGRESSORS["Ridge"])
    assert sorted(map(tuple, run_all_models(rows, {"Ridge": third}, {"Ridge": grid}, path, classify=False, **options).collect())) == wanted and not none


def test_jobs_choose_as_a_run_without_them(spark, rows, tmp_path):
    grid, options = {"alpha": [0.01, 100.0]}, {"outer": 2, "inner": 2, "classify": False, "method": "grid"}
    fit = L.REGRESSORS["Ridge"]  # fits all candidates from one pass
    one, chosen = nested_predictions(rows, fit, grid, **options)
    two, stored_choice = nested_predictions(rows, fit, grid, jobs=f"{tmp_path}/jobs", **options)
    assert [c["params"] for c in chosen] == [c["params"] for c in stored_choice]
    near = one.join(two.select("row_id", F.col("prediction").alias("other")), "row_id").filter("abs(prediction - other) < 1e-9")
    assert near.count() == rows.count() == two.count()


def test_half_written_jobs_run_again_and_other_parameters_are_other_jobs(spark, tmp_path):
    path, ran = f"{tmp_path}/jobs", []

    def job(n):
        def run():
            ran.append(n)
            return spark.range(n)

        return run

    assert stored(spark, path, {"a": job(2), "b": job(3)}).count() == 5
    (tmp_path / "jobs" / "job-b" / "_SUCCESS").unlink()
    assert finished_folders(spark, path, "job-") == {"a"}
    assert stored(spark, path, {"a": job(2), "b": job(3), "c": job(4)}, parallelism=1).count() == 9
    assert sorted(ran) == [2, 3, 3, 4]
    with pytest.raises(ValueError):
        stored(spark, path, {})
