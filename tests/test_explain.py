import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab import learners as L
from cohortlab.explain import shap, views
from cohortlab.explain.lime import lime, quartile_bins
from cohortlab.explain.scorers import batch_form, explain_model, model_importances
from cohortlab.learners.base import score
from cohortlab.explain.nodes import leaf_paths, leaf_scorer, packed, packed_scorer, tree_nodes
from tests.test_learners import data, frame, three, two, value  # noqa: F401


def phi_of(df, cls=0):
    out = {}
    for r in df.filter(F.col("class") == cls).collect():
        out.setdefault(r["row_id"], {})[r["feature"]] = r["phi"]
    return out


def test_linear_by_hand(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 1.0), (2, 0, 3.0, 2.0), (3, 0, 5.0, 6.0)], "row_id long, label int, a double, b double")
    long = shap.shap_linear(df, ["a", "b"], [[2, -1]], [0.5])
    assert {i: (p["a"], p["b"]) for i, p in phi_of(long).items()} == {1: (-4, 2), 2: (0, 1), 3: (4, -3)}
    assert {r["base"] for r in long.collect()} == {3.5}
    imp = {r["feature"]: r["importance"] for r in views.shap_importance_regression(long).collect()}
    assert imp == pytest.approx({"a": 8 / 3, "b": 2.0})
    last = views.shap_decision_paths(long).filter("step = 2").collect()
    assert {r["row_id"]: r["output"] for r in last} == pytest.approx({1: 1.5, 2: 4.5, 3: 4.5})
    fall = views.shap_waterfall_row(long, 1).orderBy("step").collect()
    assert [(r["feature"], r["bar_start"], r["bar_end"]) for r in fall] == [("a", 3.5, -0.5), ("b", -0.5, 1.5)]
    two_sided = views.shap_classes(long.withColumn("class", F.lit(1)))
    assert phi_of(two_sided, 0)[1] == {"a": 4, "b": -2}


def tree_game(leaves, x, mask):
    """Path-dependent expectation with the unmasked features averaged by training shares."""
    out = 0
    for leaf in leaves:
        w = 1.0
        for f, lo, hi, z in zip(leaf.feature, leaf.low, leaf.high, leaf.zero):
            w *= float(lo < x[f] <= hi) if mask[f] else z
        out = out + w * leaf.value
    return out


def brute_shapley(value, p):
    phi = [0] * p
    for j in range(p):
        others = [i for i in range(p) if i != j]
        for s in range(p):
            for c in itertools.combinations(others, s):
                mask = np.zeros(p, bool)
                mask[list(c)] = True
                with_j = mask.copy()
                with_j[j] = True
                phi[j] = phi[j] + math.factorial(s) * math.factorial(p - s - 1) / math.factorial(p) * (value(with_j) - value(mask))
    return phi


@pytest.mark.parametrize("kind", ["forest", "gbt", "tree_regressor"])
def test_tree_contributions_are_shapley_values(spark, three, value, kind, data):
    if kind == "forest":
        model, df = L.fit_forest_classifier(three, {"n_estimators": 3, "max_depth": 4, "max_features": 1.0}), three
    elif kind == "gbt":
        model, df = L.fit_gbt_regressor(value, {"n_estimators": 3, "max_depth": 3}), value
    else:
        model, df = L.fit_tree_regressor(value, {"max_depth": 5}), value
    few = df.filter("row_id < 12")
    long = shap.shap_tree(few, model, ["a", "b", "c"])
    leaves = leaf_paths(tree_nodes(spark, model))
    x = data[0]
    for cls in range(len(leaves[0].value)):
        got = phi_of(long, cls)
        for i in range(12):
            want = brute_shapley(lambda mk: tree_game(leaves, x[i], mk)[cls], 3)
            assert [got[i][f] for f in "abc"] == pytest.approx(want, abs=1e-9)
    out = model.transform(few).select("row_id", "prediction", *(["probability"] if kind == "forest" else [])).collect()
    sums = {(r["row_id"], r["class"]): r["s"] for r in long.groupBy("row_id", "class").agg((F.sum("phi") + F.first("base")).alias("s")).collect()}
    for r in out:
        wanted = r["probability"].toArray() if kind == "forest" else [r["prediction"]]
        for c, v in enumerate(wanted):
            assert sums[r["row_id"], c] == pytest.approx(v, abs=1e-9)
    assert np.allclose(leaf_scorer(leaves)(x), packed_scorer(packed(tree_nodes(spark, model)))(x), atol=1e-12)


def test_deep_forest_adds_up(spark, three, data):
    model = L.fit_forest_classifier(three, {"n_estimators": 50, "max_depth": 6})
    trees = packed(tree_nodes(spark, model))
    phi = shap.tree_contributions(data[0], trees, 3)
    whole = phi.sum(axis=2) + shap.expected_value(trees)
    assert np.abs(whole - packed_scorer(trees)(data[0])).max() < 1e-9
    scored = {r["row_id"]: r["probability"].toArray() for r in model.transform(three).collect()}
    assert max(np.abs(whole[i] - scored[i]).max() for i in scored) < 1e-9


def test_kernel_and_permutation_on_a_product(spark, data):
    def predict(x):
        return np.column_stack([x[:, 0] * x[:, 1] + x[:, 2], np.maximum(x[:, 0], x[:, 2])])

    df = frame(spark, data[0][:40], np.zeros(40))
    centres, weights = data[0][100:104], np.array([0.1, 0.2, 0.3, 0.4])
    exact = {}
    for i in range(40):
        def v(mask, i=i):
            return weights @ predict(np.where(mask, data[0][i], centres))

        exact[i] = np.array(brute_shapley(v, 3))
    for cls in (0, 1):
        kern = phi_of(shap.shap_kernel(df, predict, centres, weights, ["a", "b", "c"]), cls)
        perm = phi_of(shap.shap_permutation(df, predict, centres, weights, ["a", "b", "c"], permutations=200), cls)
        for i in range(40):
            assert [kern[i][f] for f in "abc"] == pytest.approx(exact[i][:, cls], abs=1e-9)
            assert [perm[i][f] for f in "abc"] == pytest.approx(exact[i][:, cls], abs=0.02)
            assert sum(perm[i].values()) == pytest.approx(sum(kern[i].values()), abs=1e-9)


def test_kernel_with_many_features_is_exact_for_linear_models(spark):
    rng = np.random.default_rng(4)
    x, w = rng.random((6, 14)), rng.normal(0, 1, 14)
    df = frame(spark, x, np.zeros(6))
    names = [f"f{j}" for j in range(14)]
    got = phi_of(shap.shap_kernel(df, lambda a: a @ w, x[:2], np.array([0.5, 0.5]), names, samples=400))
    for i in range(6):
        assert [got[i][n] for n in names] == pytest.approx(w * (x[i] - x[:2].mean(axis=0)), abs=1e-6)


def test_background_centres(two):
    rows = shap.kmeans_centres(two, 5).collect()
    assert len(rows) == 5 and sum(r["weight"] for r in rows) == pytest.approx(1.0)


def test_stacked_bars_and_waterfalls(spark):
    rows = [(i, i % 2, c, f, 1.0, v * (1 if i % 2 == c else 9), 0.5) for i in range(4) for c in (0, 1) for f, v in (("a", 2.0), ("b", -1.0))]
    df = spark.createDataFrame(rows, "row_id long, label int, class int, feature string, feature_value double, phi double, base double")
    bars = {(r["feature"], r["class"]): (r["importance"], r["bar_left"], r["total"]) for r in views.shap_bar_stacked(df).collect()}
    assert bars[("a", 1)] == (2.0, 2.0, 4.0) and bars[("b", 0)] == (1.0, 0.0, 2.0)
    fall = views.shap_waterfall_by_class(df).filter("class = 0").orderBy("step").collect()
    assert [(r["feature"], r["bar_start"], r["bar_end"]) for r in fall] == [("a", 0.5, 2.5), ("b", 2.5, 1.5)]
    total = views.shap_waterfall_combined(df).orderBy("step").collect()
    assert [(r["feature"], r["mean_phi"]) for r in total] == [("a", 4.0), ("b", -2.0)]
    assert views.shap_beeswarm(df, 1).count() == 4


def test_lime_points_the_right_way(value, two):
    # y = 3 a - 2 b + 0 c
    test = value.filter("row_id < 30")
    got = lime(test, value, L.fit_ols(value, {}), ["a", "b", "c"], 20, "prediction", samples=3000).collect()
    by_row = {}
    for r in got:
        by_row.setdefault(r["row_id"], {})[r["feature"]] = r
    assert len(by_row) == 30 and all(len(v) == 3 for v in by_row.values())
    high = [v for v in by_row.values() if v["a"]["condition"].startswith("a >")]
    low = [v for v in by_row.values() if v["a"]["condition"].startswith("a <=")]
    assert high and low
    assert min(v["a"]["weight"] for v in high) > 0.5 > -0.5 > max(v["a"]["weight"] for v in low)
    assert max(abs(v["c"]["weight"]) for v in by_row.values()) < 0.1
    picked = lime(two.filter("row_id < 10"), two, L.fit_lda(two, {}), ["a", "b", "c"], 2, samples=1000)
    assert {r["n"] for r in picked.groupBy("row_id").agg(F.count("*").alias("n")).collect()} == {2}
    assert "c" not in {r["feature"] for r in picked.collect()}


def test_quartile_bins_match_numpy(value, data):
    bins = quartile_bins(value, ["a", "b", "c"])
    for j in range(3):
        q = np.quantile(data[0][:, j], [0.25, 0.5, 0.75])
        assert bins.edges[j] == pytest.approx(q, abs=1e-12)
        assert sum(s[0] for s in bins.stats[j].values()) == 1200


def test_linear_contributions_at_full_width(spark):
    import time

    import numpy as np

    p, k = 631, 3
    rng = np.random.default_rng(1)
    names = [f"f{j}" for j in range(p)]
    base = spark.range(2000)
    df = base.select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("label"), *[((F.col("id") * (j + 3)) % 17).cast("double").alias(n) for j, n in enumerate(names)])
    coef, icept = rng.normal(size=(k, p)), rng.normal(size=k)
    began = time.time()
    arrays = shap.linear_contributions(df, names, coef.tolist(), icept.tolist())
    first = arrays.filter("row_id = 5").orderBy("class").collect()
    x = np.array([[(i * (j + 3)) % 17 for j in range(p)] for i in range(2000)], float)
    for c in range(k):
        assert np.allclose(first[c]["phi"], coef[c] * (x[5] - x.mean(axis=0))) and np.isclose(first[c]["base"], icept[c] + coef[c] @ x.mean(axis=0))
    assert views.shap_decision_paths(arrays, names).filter(f"step = {p}").count() == 2000 * k
    assert time.time() - began < 60


SMALL = {"n_estimators": 3, "max_depth": 3, "max_iter": 20, "landmarks": 8, "hidden_layer_sizes": [4], "kernel": "rbf", "n_restarts_optimizer": 0}


@pytest.mark.parametrize("name", [n for n in L.CLASSIFIERS if n != "KNN"])
def test_batch_forms_score_as_classifiers_do(spark, three, two, data, name):
    for df in (three, two):
        model = L.CLASSIFIERS[name](df, {k: v for k, v in SMALL.items() if k != "kernel" or name == "SVM"})
        got = batch_form(model)(data[0])
        want = {r["row_id"]: r["probability"] for r in score(model, df).select("row_id", "probability").collect()}
        assert np.abs(np.array([want[i] for i in range(len(got))]) - got).max() < 1e-9


@pytest.mark.parametrize("name", list(L.REGRESSORS))
def test_batch_forms_score_as_regressors_do(spark, value, data, name):
    model = L.REGRESSORS[name](value, SMALL)
    got = batch_form(model)(data[0])
    want = {r["row_id"]: r["prediction"] for r in model.transform(value).select("row_id", "prediction").collect()}
    assert got.shape[1] == 1 and np.abs(np.array([want[i] for i in range(len(got))]) - got[:, 0]).max() < 1e-9


def test_fitted_models_are_explained(spark, two, data):
    model = L.fit_gaussian_nb(two, {})
    few = two.filter("row_id < 6")
    centres, weights = shap.kmeans_background(two, 4)
    kern = phi_of(shap.shap_kernel(few, batch_form(model), centres, weights, ["a", "b", "c"]), 1)
    predict = batch_form(model)
    for i in range(6):
        want = brute_shapley(lambda m, i=i: weights @ predict(np.where(m, data[0][i], centres))[:, 1], 3)
        assert [kern[i][f] for f in "abc"] == pytest.approx(want, abs=1e-9)
    long = explain_model(few, model, ["a", "b", "c"], two, 4, "permutation")
    assert long.count() == 6 * 2 * 3


def test_importances_of_fitted_models(spark, two, value):
    for name, fit in {**L.CLASSIFIERS, **L.REGRESSORS}.items():
        if name in ("RF", "DT", "XGB", "AdaB", "Bagging", "LogR", "LDA", "LR", "Ridge"):
            model = fit(value if fit in L.REGRESSORS.values() else two, SMALL)
            rows = model_importances(spark, {name: [model]}, ["a", "b", "c"]).collect()
            assert [r["feature"] for r in rows] == list("abc") and all(r["importance"] >= 0 for r in rows) and sum(r["importance"] for r in rows) > 0
    with pytest.raises(TypeError, match="no importances"):
        model_importances(spark, {"NB": [L.fit_gaussian_nb(two, {})]}, ["a", "b", "c"])
