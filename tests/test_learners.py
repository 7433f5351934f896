import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortlab import learners as L
from cohortlab.functions import metrics as m
from cohortlab.learners import trees
from cohortlab.learners.base import balanced_weights, score
from cohortlab.learners.kernel import kernel_rows, nystroem_features
from cohortlab.learners.stats import sufficient_stats
from cohortlab.plans import search
from cohortlab.session import fresh_path
from cohortlab.sources.models import load_model, save_model
from cohortlab.sources.tables import exists


def frame(spark, x, y):
    rows = [(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id long, x array<double>, label double").select(
        "row_id", array_to_vector("x").alias("features"), "label").repartition(4).persist()


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    x = rng.random((1200, 3))
    u = rng.random(1200)
    return x, 2 * x[:, 0] - x[:, 1] + 0.2 * u, 3 * x[:, 0] - 2 * x[:, 1] + 0.3 * u


@pytest.fixture(scope="module")
def two(spark, data):
    return frame(spark, data[0], (data[1] > 0.6).astype(int))


@pytest.fixture(scope="module")
def three(spark, data):
    return frame(spark, data[0], np.digitize(data[1], [0.3, 0.9]))


@pytest.fixture(scope="module")
def value(spark, data):
    return frame(spark, data[0], data[2])


SMALL = {
    "RF": {"n_estimators": 8, "max_depth": 5}, "AdaB": {"n_estimators": 8, "max_depth": 2}, "XGB": {"n_estimators": 6, "max_depth": 3},
    "Bagging": {"n_estimators": 4, "max_depth": 6}, "DT": {"max_depth": 6}, "MLP": {"hidden_layer_sizes": [12], "learning_rate_init": 0.01, "batch_size": 8, "max_iter": 12},
    "LDA": {"shrinkage": "auto"}, "LR-SGD": {"max_iter": 12, "eta0": 0.3, "class_weight": "balanced"}, "SVM": {"C": 10, "landmarks": 20, "max_iter": 15},
    "SVR": {"max_iter": 12, "landmarks": 20, "C": 10}, "GPR": {"alpha": 0.01, "landmarks": 20, "n_restarts_optimizer": 1}, "Lasso": {"alpha": 0.001},
    "ElasticNet": {"alpha": 0.001}, "KNN": {"n_neighbors": 7, "weights": "distance"},
}
# trees and boosting of a few rounds, and independence between features, get a lower floor
FLOOR = {"AdaB": 0.8, "NB": 0.8, "KNN": 0.85}


@pytest.mark.parametrize("name", list(L.CLASSIFIERS))
@pytest.mark.parametrize("classes", [2, 3])
def test_classifier_quality_and_contract(two, three, name, classes):
    df = two if classes == 2 else three
    train, test = df.filter("row_id % 4 > 0"), df.filter("row_id % 4 = 0")
    scored = score(L.CLASSIFIERS[name](train, SMALL.get(name, {})), test).select("label", "prediction", "probability").collect()
    assert len(scored) == 300
    p = np.array([r["probability"] for r in scored])
    assert p.shape == (300, classes) and np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    acc = np.mean([r["label"] == r["prediction"] for r in scored])
    assert acc >= FLOOR.get(name, 0.9) - (0.1 if classes == 3 else 0), acc


@pytest.mark.parametrize("name", list(L.REGRESSORS))
def test_regressor_quality(value, name):
    train, test = value.filter("row_id % 4 > 0"), value.filter("row_id % 4 = 0")
    r2 = m.regression_metrics(L.REGRESSORS[name](train, SMALL.get(name, {})).transform(test)).first()["r2"]
    assert r2 >= (0.75 if name in ("AdaB", "XGB", "RF") else 0.9), r2


def centred(data):
    x, _, y = data
    return x - x.mean(axis=0), y - y.mean()


def test_ridge_solves_the_normal_equations(value, data):
    xc, yc = centred(data)
    want = np.linalg.solve(xc.T @ xc + 5 * np.eye(3), xc.T @ yc)
    assert L.fit_ridge(value, {"alpha": 5}).coefficients.toArray() == pytest.approx(want, abs=1e-9)


def test_ridge_by_hand(spark):
    df = frame(spark, [[1], [2], [3]], [2, 4, 5])
    r = L.fit_ridge(df, {"alpha": 1})
    assert (r.coefficients[0], r.intercept) == pytest.approx((1.0, 1.666667), abs=1e-6)
    o = L.fit_ols(df, {})
    assert (o.coefficients[0], o.intercept) == pytest.approx((1.5, 0.666667), abs=1e-6)


def test_elastic_net_meets_its_optimality_conditions(value, data):
    xc, yc = centred(data)
    for alpha, ratio in ((0.05, 1.0), (0.05, 0.4)):
        w = L.fit_elasticnet(value, {"alpha": alpha, "l1_ratio": ratio}).coefficients.toArray()
        g = xc.T @ (yc - xc @ w) / len(yc) - alpha * (1 - ratio) * w
        for j in range(3):
            if abs(w[j]) > 1e-9:
                assert g[j] == pytest.approx(alpha * ratio * np.sign(w[j]), abs=1e-5)
            else:
                assert abs(g[j]) <= alpha * ratio + 1e-6


def test_logreg_gradient_vanishes(two, data):
    x = data[0]
    y = (data[1] > 0.6).astype(float)
    model = L.fit_logreg(two, {"C": 0.5, "tol": 1e-10, "max_iter": 300})
    w = model.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ w + model.intercept)))
    assert 0.5 * x.T @ (p - y) + w == pytest.approx(np.zeros(3), abs=1e-2)


def test_lda_matches_its_formula(three, data):
    x = data[0]
    y = np.digitize(data[1], [0.3, 0.9])
    prior = np.bincount(y) / len(y)
    mu = np.stack([x[y == c].mean(axis=0) for c in range(3)])
    cov = sum(p * np.cov(x[y == c].T, bias=True) for c, p in enumerate(prior))
    want = np.linalg.solve(cov, mu.T).T
    got = L.fit_lda(three, {"shrinkage": 0.0}).params
    assert got["coef"] == pytest.approx(want, rel=1e-6)
    assert got["intercept"] == pytest.approx(-0.5 * (mu * want).sum(axis=1) + np.log(prior), rel=1e-6)


def test_lda_auto_shrinkage_formula(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (60, 4)) * [1, 2, 3, 4]
    y = np.repeat([0, 1], 30)

    def lw(a):
        n, p = a.shape
        s = a.T @ a / n
        mu = np.trace(s) / p
        d2 = ((s - mu * np.eye(p)) ** 2).sum()
        b2 = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in a) / n**2, d2)
        return (1 - b2 / d2) * s + b2 / d2 * mu * np.eye(p)

    cov = 0
    for c in (0, 1):
        a = x[y == c] - x[y == c].mean(axis=0)
        sd = a.std(axis=0)
        cov = cov + 0.5 * np.outer(sd, sd) * lw(a / sd)
    mu = np.stack([x[y == c].mean(axis=0) for c in (0, 1)])
    assert L.fit_lda(frame(spark, x, y), {"shrinkage": "auto"}).params["coef"] == pytest.approx(np.linalg.solve(cov, mu.T).T, rel=1e-6)


def test_gaussian_nb_by_hand(spark):
    got = L.fit_gaussian_nb(frame(spark, [[1], [3], [5], [9]], [0, 0, 1, 1]), {"var_smoothing": 0.1}).params
    assert np.ravel(got["mean"]) == pytest.approx([2, 7])
    assert np.ravel(got["var"]) == pytest.approx([1.875, 4.875])


def test_moments_keep_digits_far_from_zero(spark):
    x = np.array([[1e8 + 1], [1e8 + 3], [1e8 + 5], [1e8 + 9]])
    got = L.fit_gaussian_nb(frame(spark, x, [0, 0, 1, 1]), {"var_smoothing": 0}).params
    assert np.ravel(got["var"]) == pytest.approx([1, 4], rel=1e-6)


def test_boosting_rounds_by_hand(spark):
    df = spark.createDataFrame([(0, 0)] * 4 + [(1, 0)], "label int, prediction int").withColumn("weight", F.lit(0.2))
    new, err, alpha = trees.samme_round(df, 3, 1.0)
    assert (err, alpha) == pytest.approx((0.2, 2.079442), abs=1e-6)
    assert new.filter("label = 1").first()["weight"] == pytest.approx(1.6)
    reg = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 4.0)], "label double, prediction double").withColumn("weight", F.lit(1.0))
    new, mean, beta = trees.r2_round(reg, 1.0)
    assert (mean, beta) == pytest.approx((1 / 3, 0.5))
    assert sorted(r["weight"] for r in new.collect()) == pytest.approx([0.5, 0.5, 1.0])


def test_weighted_median(spark):
    class Const:
        def __init__(self, v):
            self.v = v

        def copy(self):
            return self

        def setPredictionCol(self, c):
            self.c = c
            return self

        def transform(self, df):
            return df.withColumn(self.c, F.lit(self.v))

    model = trees.WeightedMedianTrees([Const(5.0), Const(1.0), Const(3.0)], [1.0, 0.5, 0.7])
    assert model.transform(spark.range(1)).first()["prediction"] == 3.0


def test_balanced_weights_and_stats(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 3.0), (1, 4.0)], "label int, x double")
    w = {r["label"]: r["weight"] for r in balanced_weights(df).collect()}
    assert w == pytest.approx({0: 4 / 6, 1: 2.0})
    wide = df.select("label", *[(F.col("x") + i).alias(f"c{i}") for i in range(14)])
    a = {(r["i"], r["j"]): r["value"] for r in sufficient_stats(wide, [], [f"c{i}" for i in range(14)]).collect()}
    x = np.array([[1, *[v + i for i in range(14)]] for v in (1, 2, 3, 4)], dtype=float)
    g = x.T @ x
    assert all(v == pytest.approx(g[i, j]) for (i, j), v in a.items()) and len(a) == 15 * 16 // 2


def test_nystroem_is_exact_with_all_rows_as_landmarks(spark):
    x = np.random.default_rng(1).random((25, 2))
    df = frame(spark, x, np.zeros(25))
    f = np.array([r["features"].toArray() for r in nystroem_features(df, "rbf", 25, gamma=3.0).transform(df).orderBy("row_id").collect()])
    assert f @ f.T == pytest.approx(kernel_rows(x, x, "rbf", gamma=3.0), abs=1e-5)


def test_shared_statistics_give_the_same_models(value, three):
    folded = value.withColumn("fold", (F.col("row_id") % 3).cast("int"))
    for fit, options in ((L.fit_ridge, [{"alpha": 1}, {"alpha": 50}]), (L.fit_elasticnet, [{"alpha": 0.05, "l1_ratio": 0.5}]), (L.fit_ols, [{"fit_intercept": False}, {}])):
        many = L.MANY[fit](folded, "fold", 3, options)
        for o, models in zip(options, many):
            one = fit(folded.filter("fold <> 1"), o)
            assert models[1].params["coef"] == pytest.approx(one.coefficients.toArray(), abs=1e-5)
            assert models[1].params["intercept"] == pytest.approx(one.intercept, abs=1e-5)
    folded = three.withColumn("fold", (F.col("row_id") % 3).cast("int"))
    for fit, o in ((L.fit_gaussian_nb, {"var_smoothing": 0.01}), (L.fit_lda, {"shrinkage": 0.3})):
        a, b = L.MANY[fit](folded, "fold", 3, [o])[0][2].params, fit(folded.filter("fold <> 2"), o).params
        for k in a:
            assert np.asarray(a[k]) == pytest.approx(np.asarray(b[k]), rel=1e-7)


def test_search_and_nested_cv(spark, three, value):
    df = three.withColumn("fold", (F.col("row_id") % 3).cast("int"))
    model, params, best, scores = search.grid_search(df, L.fit_gaussian_nb, {"var_smoothing": [100.0, 1e-9]})
    assert params == {"var_smoothing": 1e-9} and len(scores) == 6 and best > 0.7
    tree, params, _, scores = search.grid_search(df, L.fit_tree_classifier, {"max_depth": [1, 5]})
    assert params == {"max_depth": 5}
    with pytest.raises(ValueError):
        search.candidate_list({}, "best")
    path = fresh_path(spark, "nested")
    calls = []

    def counted(train, params):
        calls.append(params)
        return L.fit_gaussian_nb(train, params)

    options = {"outer": 2, "inner": 2, "n_classes": 3}
    first = search.run_all_models(three, {"NB": counted}, {"NB": {"var_smoothing": [1e-9, 1e-3]}}, path, **options)
    n = len(calls)
    again = search.run_all_models(three, {"NB": counted}, {"NB": {"var_smoothing": [1e-9, 1e-3]}}, path, **options)
    assert n == 2 * (2 * 2 + 1) and len(calls) == n
    assert {r["metric"] for r in again.collect()} == {*m.LABEL_METRICS, "auc"}
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))
    folds = search.nested_cv_regress(value, L.fit_ridge, {"alpha": [0.1, 1000.0]}, 3, 3, 2)
    assert min(r["value"] for r in folds.collect() if r["metric"] == "r2") > 0.9


def test_models_survive_saving(spark, three):
    for fit, o in ((L.fit_gaussian_nb, {}), (L.fit_lda, {}), (L.fit_mlp_classifier, SMALL["MLP"]), (L.fit_forest_classifier, SMALL["RF"])):
        model, path = fit(three, o), fresh_path(spark, "model")
        save_model(model, path)
        a = score(model, three).select("row_id", "prediction").orderBy("row_id").collect()
        assert a == score(load_model(spark, path), three).select("row_id", "prediction").orderBy("row_id").collect()


# ---- models that are made of several, partitions, absent classes ----------------------------------

@pytest.mark.parametrize("name,params,classify", [
    ("XGB", {"n_estimators": 2, "max_depth": 2}, True), ("AdaB", {"n_estimators": 2, "max_depth": 2}, True), ("KNN", {"n_neighbors": 3}, True),
    ("SVM", {"landmarks": 8, "max_iter": 5}, True), ("Bagging", {"n_estimators": 2, "max_depth": 3}, False), ("AdaB", {"n_estimators": 2}, False),
    ("SVR", {"landmarks": 8, "max_iter": 2}, False), ("GPR", {"alpha": 0.1, "landmarks": 8}, False),
])
def test_composite_models_come_back(spark, tmp_path, name, params, classify):
    from cohortlab.sources.models import load_model, save_model

    rows = [(i, [float(i % 7), float(i % 5), float(i % 3)], float(i % 3 if classify else i % 7)) for i in range(240)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>, label double").withColumn("features", array_to_vector("features"))
    model = (L.CLASSIFIERS if classify else L.REGRESSORS)[name](df, params)
    save_model(model, f"{tmp_path}/m")
    again = load_model(spark, f"{tmp_path}/m")
    a, b = ({r["row_id"]: r["prediction"] for r in m.transform(df).select("row_id", "prediction").collect()} for m in (model, again))
    assert a == b


@pytest.mark.parametrize("name,params", [("LR-SGD", {"max_iter": 4}), ("MLP", {"max_iter": 3, "hidden_layer_sizes": [4]})])
def test_fits_do_not_depend_on_partitions(spark, monkeypatch, name, params):
    from cohortlab.learners import gradient

    monkeypatch.setattr(gradient, "SHARD_ROWS", 50)
    rows = [(i, [float(i % 7) - 3, float(i % 5) - 2], float(i % 3 > 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>, label double").withColumn("features", array_to_vector("features"))
    fits = []
    for n in (1, 4, 40):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        model = L.CLASSIFIERS[name](df.repartition(n), params)
        fits.append(np.ravel(model.params["coef" if name == "LR-SGD" else "theta"]))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert np.allclose(fits[0], fits[1], atol=1e-9) and np.allclose(fits[0], fits[2], atol=1e-9)


def test_max_iter_means_passes(spark):
    rows = [(i, [float(i % 7) - 3, float(i % 5) - 2], float((i * 7) % 11 > 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>, label double").withColumn("features", array_to_vector("features"))
    options = {"tol": -1e9, "n_iter_no_change": 10_000, "learning_rate": "constant", "eta0": 0.01}  # no early stop
    few, many = (np.ravel(L.CLASSIFIERS["LR-SGD"](df, {**options, "max_iter": n}).params["coef"]) for n in (22, 40))
    assert not np.allclose(few, many)


@pytest.mark.parametrize("name", ["NB", "LDA"])
def test_absent_class_numbers_keep_their_place(spark, name):
    rows = [(i, [float(i % 2) * 4 + (i % 5) * 0.1, float(i % 3)], 2.0 * (i % 2)) for i in range(100)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>, label double").withColumn("features", array_to_vector("features"))
    got = score(L.CLASSIFIERS[name](df, {}), df).select("label", "prediction", "probability").collect()
    assert all(r["label"] == r["prediction"] and len(r["probability"]) == 3 and r["probability"][1] == 0 for r in got)


def test_neighbour_table_scores_equal_those_of_separate_fits(spark):
    rng = np.random.default_rng(12)
    rows = [(i, int(rng.integers(0, 3)), [float(v) for v in np.round(rng.normal(i % 4, 1, 2), 1)], i % 3) for i in range(150)]
    rows += [(200 + i, 1, rows[0][2], 0) for i in range(60)]  # the nearest rows are all of one fold: these look further
    df = spark.createDataFrame(rows, "row_id long, label int, features array<double>, fold int").repartition(3).persist()
    options = [{"n_neighbors": k, "weights": w, "metric": m} for k in (1, 7) for w in ("uniform", "distance") for m in ("euclidean", "manhattan")]
    got = {(s["param_id"], s["fold"]): s["score"] for s in search.grid_scores(df, L.fit_knn, options, "fold", 3, "accuracy")}
    for i, o in enumerate(options):
        for f in range(3):
            scored = L.fit_knn(df.filter(F.col("fold") != f), o).transform(df.filter(F.col("fold") == f))
            assert got[i, f] == pytest.approx(scored.select(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]), (o, f)
    df.unpersist()


@pytest.mark.parametrize("regress", [False, True])
def test_boosting_starts_each_round_from_one_table(spark, regress, monkeypatch):
    rows = [(i, [float(i % 13), float(i * 7 % 11)], i % 13 * 1.5 + i * 7 % 11 if regress else float((i % 13) * 2 > i * 7 % 11)) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>, label double").withColumn("features", array_to_vector("features"))
    paths, widest, write = [], [], trees.RoundTable.write

    def noted(self, frame):
        out = write(self, frame)
        paths.append(self.path)
        widest.append(len(frame._jdf.queryExecution().optimizedPlan().toString()))
        return out

    monkeypatch.setattr(trees.RoundTable, "write", noted)
    fit = (L.REGRESSORS if regress else L.CLASSIFIERS)["AdaB"]
    model = fit(df, {"n_estimators": 12, "max_depth": 1, "learning_rate": 0.5})
    trees_, weights = model.members()[1], model.weights if regress else model.alphas
    assert len(trees_) == 12 == len(paths) - 1 and not any(exists(spark, p) for p in paths)
    assert max(widest[2:]) < 1.2 * widest[2]  # plans do not grow with the rounds
    # the same rounds by hand: weights from every tree's values, with numbers held in memory
    x = df.select("features", "label").toPandas()
    y, w = x["label"].to_numpy(), np.ones(len(x))
    for tree, weight in zip(trees_, weights, strict=True):
        got = np.array([tree.predict(v) for v in x["features"]])
        if regress:
            loss = np.abs(y - got) / np.abs(y - got).max()
            mean = (w * loss).sum() / w.sum()
            assert weight == pytest.approx(0.5 * np.log((1 - mean) / mean))
            w = w / w.sum() * (mean / (1 - mean)) ** (0.5 * (1 - loss))
        else:
            err = (w * (y != got)).sum() / w.sum()
            assert weight == pytest.approx(0.5 * np.log((1 - err) / err))
            w = w / w.sum() * np.exp(weight * (y != got))
