import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.functions import bootstrap as bs
from cohortlab.functions import metrics as m


@pytest.fixture(scope="module")
def three(spark):
    rows = list(zip(map(int, "0000111222"), map(int, "0012110220")))
    return spark.createDataFrame(rows, "label int, prediction int")


def test_label_metrics_by_hand(three):
    cm = m.confusion(three)
    assert {(r["label"], r["prediction"]): r["n"] for r in cm.collect()} == {
        (0, 0): 2, (0, 1): 1, (0, 2): 1, (1, 0): 1, (1, 1): 2, (2, 0): 1, (2, 2): 2}
    r = m.label_metrics(cm).first()
    assert r["accuracy"] == pytest.approx(0.6)
    assert r["balanced_accuracy"] == pytest.approx(0.611111, abs=1e-6)
    assert r["mcc"] == pytest.approx(0.393939, abs=1e-6)
    assert [round(r[c], 9) for c in ("precision_weighted", "recall_weighted", "f1_weighted")] == [0.6, 0.6, 0.6]


def test_metrics_with_a_class_never_predicted_and_constant_labels(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "label int, prediction int")
    r = m.label_metrics(m.confusion(df)).first()
    assert r["mcc"] == 0.0
    assert r["precision_weighted"] == pytest.approx(1 / 9)
    one = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    assert m.mcc(m.confusion(one)).first()["mcc"] == 0.0


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 0, 1], [.1, .4, .4, .8, .8, .9])), "label int, score double")
    assert m.auc_binary(df).first()["auc"] == pytest.approx(0.777778, abs=1e-6)
    assert m.auc_binary(df.filter("label = 1")).first()["auc"] is None


def test_auc_matches_pairs_with_a_hot_score(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 3000)
    s = np.where(rng.random(3000) < 0.4, 0.5, np.round(rng.random(3000) + 0.2 * y, 3))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double").repartition(7)
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert m.auc_binary(df).first()["auc"] == pytest.approx(want, abs=1e-12)
    roc = sorted((r["fpr"], r["tpr"]) for r in m.roc_curve(df).collect())
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip([(0.0, 0.0), *roc], roc))
    assert area == pytest.approx(want, abs=1e-9)


def test_regression_metrics_by_hand(spark):
    df = spark.createDataFrame(list(zip([1., 2., 3., 4.], [1.5, 2., 2.5, 5.])), "label double, prediction double")
    r = m.regression_metrics(df, p=2).first()
    assert r["mae"] == 0.5 and r["mse"] == 0.375 and r["r2"] == pytest.approx(0.7)
    assert r["rmse"] == pytest.approx(0.612372, abs=1e-6)
    assert r["aic"] == pytest.approx(0.076683, abs=1e-6) and r["bic"] == pytest.approx(-1.150728, abs=1e-6)


def test_fold_summary(spark):
    df = spark.createDataFrame([("A", "acc", float(v)) for v in (80, 82, 84, 86, 88)] + [("A", "auc", 1.0), ("A", "auc", None)],
                               "model string, metric string, value double")
    got = {r["metric"]: r for r in m.summarize_with_ci(df).collect()}
    a = got["acc"]
    assert (a["mean"], round(a["std"], 6)) == (84.0, 3.162278)
    assert a["ci_lower"] == pytest.approx(80.2) and a["ci_upper"] == pytest.approx(87.8)
    assert got["auc"]["ci_lower"] is None and got["auc"]["mean"] == 1.0
    pop = m.summarize_with_ci(df.filter("metric = 'acc'"), population=True).first()
    assert pop["std"] == pytest.approx(2.828427, abs=1e-6)


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 2000)
    p = np.clip(0.3 + 0.4 * y + rng.normal(0, 0.25, 2000), 0.01, 0.99)
    rows = [(i, int(a), int(q > 0.5), [1 - float(q), float(q)]) for i, (a, q) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "row_id long, label int, prediction int, probability array<double>").repartition(5)


def test_bootstrap_is_centred_on_the_estimate(scored):
    got = {r["metric"]: r for r in bs.bootstrap_classification(scored, 400).collect()}
    acc = m.accuracy(m.confusion(scored)).first()["accuracy"]
    auc = m.auc_binary(scored.withColumn("score", F.col("probability")[1])).first()["auc"] * 100
    analytic = 100 * math.sqrt(acc / 100 * (1 - acc / 100) / 2000)
    assert got["accuracy"]["mean"] == pytest.approx(acc, abs=0.2)
    assert got["accuracy"]["std"] == pytest.approx(analytic, rel=0.2)
    assert got["auc"]["mean"] == pytest.approx(auc, abs=0.2)
    assert got["auc"]["ci_lower"] < auc < got["auc"]["ci_upper"]
    rows = m.accuracy(bs.bootstrap_confusion_rows(scored, 200), ["replicate"])
    assert rows.agg(F.avg("accuracy")).first()[0] == pytest.approx(acc, abs=0.3)


def test_bootstrap_auc_does_not_depend_on_partitions(spark, scored):
    def mean(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return bs.bootstrap_auc(scored, 300).agg(F.avg("auc"), F.stddev("auc")).first()

    a, b = mean(1), mean(16)
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert a[0] == pytest.approx(b[0], abs=0.002) and a[1] == pytest.approx(b[1], rel=0.25)


def test_bootstrap_regression(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(50, 10, 1500)
    rows = [(i, float(a), float(a + e)) for i, (a, e) in enumerate(zip(y, rng.normal(0, 3, 1500)))]
    df = spark.createDataFrame(rows, "row_id long, label double, prediction double")
    got = {r["metric"]: r for r in bs.bootstrap_regression(df, 200).collect()}
    want = m.regression_metrics(df).first()
    for k in ("mae", "mse", "rmse", "r2"):
        assert got[k]["mean"] == pytest.approx(want[k], rel=0.02)
        assert got[k]["ci_lower"] < want[k] < got[k]["ci_upper"]
