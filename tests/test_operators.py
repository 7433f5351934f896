import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import encode, ensemble, ordering, profile, sampling, scaling
from cohortlab.operators.neighbors import knn_join, smote, smote_fill
from cohortlab.operators.pivot_tree import PivotTree
from cohortlab.plans import catalog, grids
from cohortlab.sources import books, tables
from cohortlab.sources.models import load_model, resume_pending
from cohortlab.session import fresh_path


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_feature_catalog_widths(spark):
    n = {r["combo"]: r["count"] for r in catalog.feature_catalog(spark).groupBy("combo").count().collect()}
    assert n == {"1_MO": 28, "2_MS": 6, "3_GT": 594, "4_MO_MS": 33, "5_MO_MS_GT": 626, "6_DG_MO_MS_GT": 631}
    assert len(catalog.feature_sets()["clinical"]) == 12
    tasks = catalog.standard_tasks(spark)
    assert tasks.count() == 24
    assert {r["partition_value"] for r in tasks.collect()} == {"CN_AD", "CN_MCI", "MCI_AD", "CN_MCI_AD"}
    assert catalog.standard_tasks(spark, "regression").count() == 6


def test_grid_sizes(spark):
    size = {n: len(grids.candidates(g)) for n, g in grids.CLASSIFIER_GRIDS.items()}
    assert size == {"LogR": 252, "LR-SGD": 1296, "LDA": 18, "DT": 864, "RF": 384, "AdaB": 24, "XGB": 648, "SVM": 56, "KNN": 40, "NB": 20, "MLP": 28800}
    size = {n: len(grids.candidates(g)) for n, g in grids.REGRESSOR_GRIDS.items()}
    assert size["DT"] == 72 and size["RF"] == 324 and size["Bagging"] == 48 and size["MLP"] == 80
    assert size["GPR"] == 36 and size["SVR"] == 60
    table = grids.expand_grid(spark, {"a": [1, 2], "b": ["x", "y", "z"]})
    assert [(r["params"]["a"], r["params"]["b"]) for r in table.orderBy("param_id").collect()] == [
        ("1", "x"), ("1", "y"), ("1", "z"), ("2", "x"), ("2", "y"), ("2", "z")]
    drawn = {r["param_id"] for r in grids.sample_grid(table, 4).collect()}
    every = grids.candidates({"a": [1, 2], "b": ["x", "y", "z"]})
    assert [every[i - 1] for i in sorted(drawn)] == sorted(grids.sample_candidates({"a": [1, 2], "b": ["x", "y", "z"]}, 4), key=every.index)


def test_encoding(spark):
    df = spark.createDataFrame([(1, "CN", "F"), (2, "ADD", "M"), (3, None, "F")], "PTID int, DX string, Sex string")
    rules = {"DX": ("DX_le", encode.STATUS_REGRESSION), "Sex": ("Gender", encode.SEX)}
    out = encode.encode_labels(df, rules)
    assert out.columns == ["PTID", "DX", "DX_le", "Sex", "Gender"]
    assert [r["DX_le"] for r in out.orderBy("PTID").collect()] == [0, None, None]
    assert dict(rows(encode.unmapped_counts(df, rules), "column", "n_unmapped")) == {"DX": 1, "Sex": 0}
    with pytest.raises(ValueError):
        encode.drop_columns(df, ["nope"])
    assert encode.drop_columns(df, ["nope", "Sex"], strict=False).columns == ["PTID", "DX"]


def test_names_with_hyphens_and_quotes(spark):
    df = spark.createDataFrame([(1, 2.0, 4.0), (2, 4.0, 8.0)], "row_id int, `Left-Thalamus` double, label double")
    assert encode.select_features(df, ["Left-Thalamus"], "label").columns == ["row_id", "Left-Thalamus", "label"]
    assert rows(scaling.minmax_scale(df, df, ["Left-Thalamus"]), "row_id", "Left-Thalamus") == [(1, 0.0), (2, 1.0)]
    odd = spark.createDataFrame([("it's",)], "a string")
    assert odd.select(encode.lookup("a", {"it's": 7}).alias("v")).first()["v"] == 7


def test_cohorts_and_targets(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, None)], "row_id int, label int")
    assert rows(encode.binary_cohort(df, "CN_vs_AD"), "row_id", "label") == [(1, 0), (3, 1)]
    assert encode.three_class_cohort(df).count() == 4 and encode.three_class_cohort(df, drop_null=True).count() == 3
    t = spark.createDataFrame([(None,), (0.0,), (1.5,), (float("nan"),)], "label double")
    assert rows(encode.target_not_null(t), "label") == [(0.0,), (1.5,)]
    assert rows(encode.target_nonzero(t), "label") == [(1.5,)]
    x, y = encode.split_xy(df)
    assert encode.validate_xy(x, y, x, y).count() == 0
    bad = encode.validate_xy(x, y.filter("row_id < 3"), x, y)
    assert rows(bad, "part", "problem", "n") == [("train", "x without y", 2)]


def test_quota_by_hand(spark):
    df = spark.createDataFrame([(c,) for c, n in ((0, 7), (1, 6), (2, 4)) for _ in range(n)], "label int")
    assert rows(sampling.class_quotas(df, "label", 0.2), "label", "quota") == [(0, 2), (1, 1), (2, 1)]


def test_splits_and_folds(spark):
    # one class holds two thirds of the rows, a NULL label takes no part
    df = spark.range(3001).select(F.col("id").alias("row_id"), F.when(F.col("id") == 5, None).when(F.col("id") % 3 == 0, 1).otherwise(0).alias("label"))
    s = sampling.stratified_split(df)
    assert s.count() == 3000 and s.filter("part = 'test'").count() == 600
    assert sampling.random_split(df, 0.25).filter("part = 'test'").count() == 751
    f = sampling.stratified_kfold(df, k=5)
    assert {r["count"] for r in f.groupBy("label", "fold").count().collect() if r["label"] == 1} <= {200, 201}
    sizes = [r["count"] for r in sampling.kfold(df, 7).groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 3001
    n = sampling.nested_folds(df, 4, 3)
    assert n.count() == 3 * 3000
    assert n.groupBy("outer_fold", "row_id").count().filter("count > 1").count() == 0


def test_rank_does_not_depend_on_partitions_or_buckets(spark):
    df = spark.range(2000).select(F.col("id").alias("row_id"), (F.col("id") % 2).alias("g"))
    a = rows(ordering.rank_by_hash(df.repartition(1), ["g"]), "g", "row_id", "rank")
    b = rows(ordering.rank_by_hash(df.repartition(9), ["g"], buckets=16), "g", "row_id", "rank")
    assert a == b
    assert sorted(r[2] for r in a if r[0] == 0) == list(range(1, 1001))
    with_null = df.withColumn("g", F.when(F.col("g") == 1, 1))
    assert ordering.rank_by_hash(with_null, ["g"]).count() == 2000


@pytest.mark.parametrize("values", [
    np.random.default_rng(0).normal(0, 1, 5003),
    np.concatenate([np.full(2000, 3.25), np.random.default_rng(1).random(3001)]),
    np.arange(10.0), np.array([1.0]), np.full(50, 2.0), np.array([1.0, 2.0]),
])
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(float(v), float(-v) if i % 5 else None) for i, v in enumerate(values)], "a double, b double").repartition(4)
    probs = [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]
    got = {(r["feature"], r["prob"]): r["value"] for r in ordering.exact_quantiles(df, ["a", "b"], probs).collect()}
    for p in probs:
        assert got["a", p] == pytest.approx(np.quantile(values, p), abs=1e-12)
    other = np.array([-v for i, v in enumerate(values) if i % 5])
    if len(other):
        assert got["b", 0.25] == pytest.approx(np.quantile(other, 0.25), abs=1e-12)


def test_scalers(spark):
    train = spark.createDataFrame([(2.0, 5.0), (4.0, 5.0), (6.0, 5.0)], "x double, flat double")
    test = spark.createDataFrame([(8.0, 5.0)], "x double, flat double")
    assert rows(scaling.minmax_scale(train, train, ["x", "flat"]), "x", "flat") == [(0.0, 0.0), (0.5, 0.0), (1.0, 0.0)]
    assert rows(scaling.minmax_scale(test, train, ["x", "flat"]), "x") == [(1.5,)]
    z = [r[0] for r in rows(scaling.standard_scale(train, train, ["x", "flat"]), "x")]
    assert z == pytest.approx([-1.224745, 0, 1.224745], abs=1e-6)
    assert rows(scaling.standard_scale(test, train, ["x", "flat"]), "x")[0][0] == pytest.approx(2.449490, abs=1e-6)


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "a", "x")], "row_id int, s string, t string")
    assert rows(profile.profile_shape(df), "n_rows", "n_columns") == [(3, 3)]
    assert [tuple(r) for r in profile.value_counts(df, "s").collect()] == [("a", 2), ("b", 1)]
    assert {tuple(r) for r in profile.distinct_values(df, ["s", "t"]).collect()} == {("s", "a"), ("s", "b"), ("t", None), ("t", "x")}
    assert [r["row_id"] for r in profile.preview(df, 2).collect()] == [1, 2]


def brute(q, s, k, p, exclude):
    out = {}
    for i, a in q.items():
        d = []
        for j, b in s.items():
            if exclude and i == j:
                continue
            e = np.abs(np.array(a) - np.array(b))
            d.append((float(e.sum()) if p == 1 else float(np.sqrt((e * e).sum())), j))
        d.sort()
        out[i] = d[:k]
    return out


def check_knn(got, want):
    found = {}
    for r in got.collect():
        found.setdefault(r["row_id"], []).append((r["rank"], r["neighbor_id"], r["distance"]))
    assert set(found) == {i for i, v in want.items() if v}
    for i, d in want.items():
        mine = sorted(found.get(i, []))
        assert [m_[1] for m_ in mine] == [j for _, j in d], i
        assert [m_[2] for m_ in mine] == pytest.approx([x for x, _ in d], abs=1e-9)


@pytest.mark.parametrize("p", [1, 2])
def test_knn_join_is_exact_with_copies_and_clusters(spark, p):
    rng = np.random.default_rng(p)
    centres = rng.normal(0, 20, (6, 3))
    pts = [centres[i % 6] + rng.normal(0, 1, 3) for i in range(240)]
    pts += [pts[0]] * 120  # a third of all rows are one vector
    v = {i: [float(x) for x in a] for i, a in enumerate(pts)}
    df = spark.createDataFrame([(i, a) for i, a in v.items()], "row_id long, features array<double>").repartition(5)
    check_knn(knn_join(df, df, 4, p, exclude_self=True, rows_per_leaf=9, query_block=16), brute(v, v, 4, p, True))
    q = {1000 + i: [float(x) for x in rng.normal(0, 15, 3)] for i in range(40)}
    qdf = spark.createDataFrame([(i, a) for i, a in q.items()], "row_id long, features array<double>")
    check_knn(knn_join(qdf, df, 3, p, rows_per_leaf=17, query_block=8), brute(q, v, 3, p, False))


def test_queries_visit_as_few_leaves_when_clustered_rows_grow(spark):
    """What is shuffled per row does not grow with the rows: visits are the largest part of it."""
    per_row = []
    for n in (1500, 6000):
        rng = np.random.default_rng(5)
        centres = rng.normal(0, 30, (n // 100, 8))
        pts = [(i, [float(v) for v in centres[i % len(centres)] + rng.normal(0, 0.3, 8)]) for i in range(n)]
        df = spark.createDataFrame(pts, "row_id long, x array<double>").select(F.lit(0).alias("g"), "x", F.array("row_id").alias("ids"))
        tree = PivotTree(df, 8, 2, rows_per_leaf=50)
        per_row.append(tree._visits(tree._home(None, 6), 6).count() / n)
    assert per_row[1] < 1.3 * per_row[0] + 1 and per_row[1] < 12, per_row


def test_knn_join_with_fewer_rows_than_k(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "row_id long, features array<double>")
    assert rows(knn_join(df, df, 5, exclude_self=True), "row_id", "neighbor_id") == [(1, 2), (2, 1)]


def test_smote_fills_classes_between_neighbours(spark):
    rng = np.random.default_rng(3)
    data = [(i, 0 if i < 60 else 1 if i < 80 else 2, [float(x) for x in rng.normal(0, 1, 2)]) for i in range(92)]
    df = spark.createDataFrame(data, "row_id long, label int, features array<double>")
    made = smote(df, rows_per_leaf=8, query_block=8)
    assert {r["label"]: r["count"] for r in made.groupBy("label").count().collect()} == {1: 40, 2: 48}
    by_id = {i: (c, np.array(v)) for i, c, v in data}
    for r in made.collect():
        (c0, a), (c1, b), x = by_id[r["base_id"]], by_id[r["neighbor_id"]], np.array(r["features"])
        assert c0 == c1 == r["label"] and r["base_id"] != r["neighbor_id"]
        t = (x - a) @ (b - a) / ((b - a) @ (b - a))
        assert 0 <= t < 1 and np.allclose(a + t * (b - a), x)
    full = smote_fill(df, rows_per_leaf=8, query_block=8)
    assert {r["count"] for r in full.groupBy("label").count().collect()} == {60}


def test_selection_and_votes(spark):
    s = spark.createDataFrame([("A", "accuracy", 80.0, 1.0), ("B", "accuracy", 90.0, 2.0), ("C", "accuracy", 85.0, 1.0), ("D", "accuracy", 70.0, 1.0)],
                              "model string, metric string, mean double, std double")
    assert rows(ensemble.select_above_mean(s), "model") == [("B",), ("C",)]
    assert [r["model"] for r in ensemble.select_topk(s, 2).collect()] == ["B", "C"]
    store = spark.createDataFrame([("B", "x")], "model string, path string")
    assert rows(ensemble.missing_selected(ensemble.select_topk(s, 2), store), "model") == [("C",)]
    assert rows(ensemble.load_selected(ensemble.select_topk(s, 2), store, strict=False), "model") == [("B",)]
    with pytest.raises(Exception, match="no stored model for C"):
        ensemble.load_selected(ensemble.select_topk(s, 2), store).collect()
    p = spark.createDataFrame([
        (1, "a", [.6, .4]), (1, "b", [.3, .7]), (1, "c", [.9, .1]), (2, "a", [.2, .8]), (2, "b", [.45, .55]), (2, "c", [.1, .9]), (3, "a", [.5, .5])],
        "row_id int, model string, probability array<double>")
    got = {r["row_id"]: r for r in ensemble.soft_vote(p).collect()}
    assert got[1]["prediction"] == 0 and got[1]["probability"] == pytest.approx([.6, .4])
    assert got[2]["prediction"] == 1 and got[2]["probability"] == pytest.approx([.25, .75])
    assert got[3]["prediction"] == 0
    w = spark.createDataFrame([("a", .9), ("b", .8), ("c", .7)], "model string, weight double")
    assert {r["row_id"]: r for r in ensemble.soft_vote(p, w).collect()}[1]["probability"] == pytest.approx([.5875, .4125])


def test_report_books(spark):
    book = fresh_path(spark, "book")
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int")
    books.write_report_sheet(a, book, "one")
    books.write_report_sheet(b, book, "two")
    books.write_report_sheet(b, book, "one")
    assert rows(books.read_report_sheet(spark, book, "one"), "x") == [(2,), (3,)]
    assert rows(books.read_report_sheet(spark, book, "two"), "x") == [(2,), (3,)]
    books.write_report_book({"three": a}, book)
    assert books.read_report_sheet(spark, book, "one").count() == 0
    assert books.report_sheets(spark, book) == ["three"]


def test_a_crash_between_sheets_leaves_the_old_book_whole(spark, monkeypatch):
    book = fresh_path(spark, "book")
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int")
    books.write_report_book({"one": a, "two": b}, book)
    bad = b.withColumn("x", F.raise_error(F.lit("broken")))
    with pytest.raises(Exception, match="broken"):
        books.write_report_book({"one": b, "two": bad}, book)
    monkeypatch.setattr(books, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        books.write_report_sheet(b, book, "one")
    monkeypatch.undo()
    assert rows(books.read_report_sheet(spark, book, "one"), "x") == [(1,)] and rows(books.read_report_sheet(spark, book, "two"), "x") == [(2,), (3,)]
    # what the broken writes left behind goes with the next one
    books.write_report_sheet(b, book, "one")
    fs, path = books._folder(spark, book)
    assert sorted(f.getPath().getName()[:5] for f in fs.globStatus(path(f"{book}/*"))) == ["conte", "sheet", "sheet"]
    assert rows(books.read_report_sheet(spark, book, "one"), "x") == [(2,), (3,)] and books.report_sheets(spark, book) == ["one", "two"]


def test_sources(spark, data_dir):
    assert tables.read_cohort(spark, data_dir, "nation").count() == 25
    with pytest.raises(FileNotFoundError):
        load_model(spark, fresh_path(spark, "nothing"))
    plan = spark.createDataFrame([("a",), ("b",), ("c",)], "model string")
    done, res = plan.filter("model <> 'c'"), plan.filter("model = 'a'")
    assert rows(resume_pending(plan, done, res, ["model"]), "model") == [("b",), ("c",)]
    assert rows(resume_pending(plan, done, res, ["model"], both=False), "model") == [("c",)]


def test_split_takes_the_first_rows_in_hash_order(spark):
    df = spark.range(997).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("label"))
    ranked = {r["row_id"]: r["rank"] for r in ordering.rank_by_hash(df, ["label"]).collect()}
    quota = dict(rows(sampling.class_quotas(df, "label", 0.3), "label", "quota"))
    for r in sampling.stratified_split(df, test_size=0.3).collect():
        assert (r["part"] == "test") == (ranked[r["row_id"]] <= quota[r["label"]])
    assert sampling.random_split(df.limit(1)).collect()[0]["part"] == "test"
    rare = df.filter("label < 2 or row_id = 2")
    assert sampling.stratified_split(rare, test_size=0.2).filter("label = 2").first()["part"] == "train"


def test_quantiles_of_columns_with_missing_values(spark):
    rows = [(float(i), None, float("nan") if i % 2 else float(i)) for i in range(101)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["feature"], r["prob"]): r["value"] for r in ordering.exact_quantiles(df, ["a", "b", "c"], [0.25, 0.5]).collect()}
    assert got == {("a", 0.25): 25.0, ("a", 0.5): 50.0, ("b", 0.25): None, ("b", 0.5): None, ("c", 0.25): 25.0, ("c", 0.5): 50.0}


def test_sheets_keep_their_own_columns(spark, tmp_path):
    from cohortlab.sources.books import read_report_sheet, write_report_book

    book = f"{tmp_path}/book"
    write_report_book({"01": spark.createDataFrame([(1,)], "a int"), "b=c": spark.createDataFrame([("x",)], "b string")}, book)
    assert read_report_sheet(spark, book, "01").columns == ["a"] and read_report_sheet(spark, book, "b=c").collect()[0]["b"] == "x"
