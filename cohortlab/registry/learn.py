"""Learners, neighbour joins, searches and model-based explanations."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from .. import learners as L
from ..explain import shap, views
from ..explain.lime import lime
from ..explain.nodes import tree_nodes
from ..explain.scorers import explain_model, model_importances
from ..functions import metrics as m
from ..functions.hashing import hash_key
from ..learners import trees
from ..learners.base import balanced_weights, score
from ..learners.bayes import nb_stats
from ..learners.kernel import nystroem_features
from ..learners.knn import neighbour_votes, predict_votes
from ..learners.stats import sufficient_stats
from ..operators import encode, ensemble
from ..operators.neighbors import knn_join, smote
from ..operators.sampling import kfold, stratified_kfold, stratified_split
from ..operators.scaling import minmax_scale
from ..plans import search
from ..plans.grids import CLASSIFIER_GRIDS, REGRESSOR_GRIDS
from ..plans.task import training_task
from ..session import cut_lineage, fresh_path
from . import base as b
from .base import r_sql, register, rnd
from .evaluate import REG, cm_sql
from .prep import HK42

Z = ["z1", "z2"]


def cohort(spark, d, target: str):
    """Made cohort with ``features`` and ``label``; ``part`` splits it."""
    df = encode.assemble_features(b.made_cohort(spark, d).withColumn("label", F.col(target)), Z)
    return df.select("row_id", "features", "label", "part")


def parts(df):
    return df.filter("part = 'train'"), df.filter("part = 'test'")


def class_report(scored, name: str):
    """The six label metrics of scored rows, one row."""
    pred = scored.select("label", F.col("prediction").cast("int").alias("prediction"))
    out = m.label_metrics(m.confusion(pred)).select(F.lit(name).alias("model"), *[(F.col(c) * 100).alias(c) for c in m.LABEL_METRICS])
    return rnd(out, *m.LABEL_METRICS)


REPORT_SQL = "select model, " + ", ".join(r_sql(f"{c} * 100", c) for c in m.LABEL_METRICS) + " from lm"


# ---- the whole path ----------------------------------------------------------------------------

def nb_sql(x: list[str], model: str, smoothing: str = "1e-9::double") -> str:
    """Gaussian NB on table ``ts`` (part, label, x...), predictions on its test part in ``np``."""
    stats = ", ".join(f"avg({c}) as m_{c}, var_pop({c}) as v_{c}" for c in x)
    eps = "greatest(" + ", ".join(f"var_pop({c})" for c in x) + ")"
    dens = " + ".join(f"(-0.5::double * ln(2 * pi() * (v_{c} + e)) - ({c} - m_{c}) * ({c} - m_{c}) / (2 * (v_{c} + e)))" for c in x)
    return f"""
, nv as (select {smoothing} * {eps} as e, count(*) as n_all from ts where part = 'train'),
ns as (select label as cls, count(*) as n, {stats} from ts where part = 'train' group by 1),
nl as (select row_id, label, cls, ln(n / n_all) + {dens} as ll from ts, ns, nv where part = 'test'),
np as (select '{model}' as model, row_id, any_value(label) as label, arg_max(cls, ll) as prediction from nl group by row_id)
"""


PIPELINE_SQL = f"""
, hc as (select label3 as label, count(*) as n_class from lc group by 1),
q0 as (select *, sum(n_class) over () as n_all from hc),
q1 as (select *, ceil(n_all * 0.2::double) as n_test, n_class * ceil(n_all * 0.2::double) / n_all as share from q0),
q as (select label, floor(share) + (row_number() over (order by share - floor(share) desc, label) <= n_test - sum(floor(share)) over ())::int as quota from q1),
hr as (select row_id, label3 as label, z1, z2, row_number() over (partition by label3 order by {HK42}, row_id) as rank from lc),
hp as (select hr.*, case when rank <= quota then 'test' else 'train' end as part from hr join q using (label)),
mm as (select min(z1) as l1, max(z1) as h1, min(z2) as l2, max(z2) as h2 from hp where part = 'train'),
ts as (select row_id, label, part, (z1 - l1) / (h1 - l1) as x1, (z2 - l2) / (h2 - l2) as x2 from hp, mm)
""" + nb_sql(["x1", "x2"], "NB") + cm_sql("np") + REPORT_SQL


@register("holdout_pipeline", PIPELINE_SQL)
def _(spark, d):
    df = b.made_cohort(spark, d).select("row_id", *Z, F.col("label3").alias("label"))
    # read by the scaler, the fit and the scoring: worked out once
    split = cut_lineage(stratified_split(df))
    scaled = minmax_scale(split, split.filter("part = 'train'"), Z)
    train, test = parts(encode.assemble_features(scaled, Z))
    return class_report(score(L.fit_gaussian_nb(train, {}), test), "NB")


# ---- support -----------------------------------------------------------------------------------

_cells = [(i, j, x, y) for i, x in enumerate(["one", "x1", "x2", "x3"]) for j, y in enumerate(["one", "x1", "x2", "x3"]) if i <= j]


@register("sufficient_stats", ", ss as (select label, 1.0::double as one, v[1] as x1, v[2] as x2, v[3] as x3 from em) " + " union all ".join(
    f"select label, {i} as i, {j} as j, {r_sql(f'sum({x} * {y})', 'value', 4)} from ss group by 1" for i, j, x, y in _cells))
def _(spark, d):
    return rnd(sufficient_stats(b.wide_vectors(spark, d, 3), ["label"], ["x0", "x1", "x2"]), "value", digits=4)


@register("sufficient_stats_wide", f"""
, c as (select label, [1.0::double] || v as v from em),
p as (select label, i::int - 1 as i, j::int - 1 as j, v[i] * v[j] as value from c, range(1, {b.DIMS + 2}) a(i), range(1, {b.DIMS + 2}) g(j) where i <= j)
select label, i::int as i, j::int as j, {r_sql('sum(value)', 'value', 4)} from p group by 1, 2, 3""")
def _(spark, d):
    return rnd(sufficient_stats(b.wide_vectors(spark, d), ["label"], [f"x{j}" for j in range(b.DIMS)]), "value", digits=4)


@register("sample_weights_balanced", f"""
, c as (select label3 as label, count(*) as n from lc group by 1)
select row_id, label3 as label, {r_sql('(select sum(n) from c) / ((select count(*) from c) * n)', 'weight')} from lc join c on label3 = c.label""")
def _(spark, d):
    return rnd(balanced_weights(b.made_cohort(spark, d).select("row_id", F.col("label3").alias("label"))), "weight")


KNN_SQL = """
, pr as (select a.row_id, b.row_id as neighbor_id, list_distance(a.v, b.v) as distance from em a join em b on a.row_id <> b.row_id),
rk as (select *, row_number() over (partition by row_id order by distance, neighbor_id) as rank from pr)
"""


@register("knn_join", KNN_SQL + f"select row_id, neighbor_id, {r_sql('distance', 'distance')}, rank::int as rank from rk where rank <= 5")
def _(spark, d):
    v = b.vectors(spark, d)
    return rnd(knn_join(v, v, 5, exclude_self=True), "distance")


@register("smote", KNN_SQL.replace("a.row_id <> b.row_id", "a.row_id <> b.row_id and (a.label < 3) = (b.label < 3)") + f"""
, cl as (select row_id, v, (label < 3)::int as y from em),
n as (select y, count(*) as n from cl group by 1),
dr as (select y, n, unnest(range((select max(n) from n) - n)) as draw from n),
ch as (select y, draw, floor({b.u_sql('42-base', 'y', 'draw')} * n) + 1 as rank, floor({b.u_sql('42-nn', 'y', 'draw')} * 5) + 1 as pick, {b.u_sql('42-u', 'y', 'draw')} as u from dr),
ra as (select row_id, y, v, row_number() over (partition by y order by {HK42}, row_id) as rank from cl),
bs2 as (select ch.y, draw, u, pick, ra.row_id as base_id, ra.v as bv from ch join ra on ch.y = ra.y and ch.rank = ra.rank)
select 's-' || bs2.y || '-' || draw as synthetic_id, bs2.y::bigint as label, base_id, rk.neighbor_id,
  [floor((a[1] + u * (a[2] - a[1])) * 1e6 + 0.5::double) / 1e6 for a in list_zip(bv, em.v)] as features
from bs2 join rk on rk.row_id = base_id and rk.rank = pick join em on em.row_id = rk.neighbor_id""")
def _(spark, d):
    v = b.vectors(spark, d).withColumn("label", (F.col("label") < 3).cast("int"))
    return smote(v).withColumn("features", F.expr("transform(features, x -> floor(x * 1e6D + 0.5D) / 1e6D)"))


@register("kmeans_background")
def _(spark, d):
    from pyspark.ml.functions import array_to_vector

    v = b.vectors(spark, d).withColumn("features", array_to_vector("features"))
    return shap.kmeans_centres(v, 50)


@register("nystroem_features", f"""
, l as (select z1, z2, row_number() over (order by {b.hk_sql('42-landmark', 'row_id')}, row_id) as r from lc where part = 'train'),
p as (select a.z1 as a1, a.z2 as a2, b.z1 as b1, b.z2 as b2 from l a, l b where a.r = 1 and b.r = 2),
k as (select row_id, exp(-((z1 - a1) ^ 2 + (z2 - a2) ^ 2)) as k1, exp(-((z1 - b1) ^ 2 + (z2 - b2) ^ 2)) as k2, exp(-((a1 - b1) ^ 2 + (a2 - b2) ^ 2)) as c from lc, p)
select row_id, {r_sql('(k1 * k1 + k2 * k2 - 2 * c * k1 * k2) / (1 - c * c)', 'norm2')} from k""")
def _(spark, d):
    # with two landmarks the squared norm of the mapped row has a closed form
    df = cohort(spark, d, "label2")
    mapped = nystroem_features(parts(df)[0], "rbf", 2, gamma=1.0).transform(df).select("row_id", vector_to_array("features").alias("f"))
    return rnd(mapped.select("row_id", F.aggregate("f", F.lit(0.0), lambda a, x: a + x * x).alias("norm2")), "norm2")


# ---- classifiers -------------------------------------------------------------------------------

LOGIT_SQL = """
, ld as (select z1 as x, label2 as y from lc where part = 'train'),
nn as (select count(*) as n from ld),
it(i, b0, b1) as (select 0, 0.0::double, 0.0::double union all
  select i + 1, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) from (
    select i, b0, b1, sum(p - y) as g0, sum((p - y) * x) + b1 as g1, sum(p * (1 - p)) as h00, sum(p * (1 - p) * x) as h01, sum(p * (1 - p) * x * x) + 1 as h11
    from (select i, b0, b1, x, y, 1 / (1 + exp(-(b0 + b1 * x))) as p from it, ld where i < 12) t group by i, b0, b1) s)
"""


@register("clf_logreg", LOGIT_SQL + f"select {r_sql('b1', 'coef', 2)}, {r_sql('b0', 'intercept', 2)} from it where i = 12")
def _(spark, d):
    df = encode.assemble_features(b.made_cohort(spark, d).withColumn("label", F.col("label2")), ["z1"])
    model = L.fit_logreg(df.filter("part = 'train'"), {"C": 1.0, "penalty": "l2", "max_iter": 200, "tol": 1e-10})
    row = (float(model.coefficients[0]), float(model.intercept))
    # the fitted numbers, next to the rows they were fitted on
    return rnd(df.limit(1).select(F.lit(row[0]).alias("coef"), F.lit(row[1]).alias("intercept")), "coef", "intercept", digits=2)


LDA_SQL = """
, ls as (select label3 as cls, count(*) as n, avg(z1) as m1, avg(z2) as m2, var_pop(z1) as v1, var_pop(z2) as v2, covar_pop(z1, z2) as c12 from lc where part = 'train' group by 1),
lw as (select *, n / sum(n) over () as prior, 0.75::double * v1 + 0.25::double * (v1 + v2) / 2 as s1, 0.75::double * v2 + 0.25::double * (v1 + v2) / 2 as s2, 0.75::double * c12 as s12 from ls),
lp2 as (select sum(prior * s1) as s1, sum(prior * s2) as s2, sum(prior * s12) as s12 from lw),
lk as (select cls, prior, m1, m2, (p.s2 * m1 - p.s12 * m2) / (p.s1 * p.s2 - p.s12 * p.s12) as w1, (p.s1 * m2 - p.s12 * m1) / (p.s1 * p.s2 - p.s12 * p.s12) as w2 from lw, lp2 p),
lq as (select row_id, label3 as label, cls, z1 * w1 + z2 * w2 - 0.5::double * (m1 * w1 + m2 * w2) + ln(prior) as s from lc, lk where part = 'test'),
np as (select 'LDA' as model, row_id, any_value(label) as label, arg_max(cls, s) as prediction from lq group by row_id)
"""


@register("clf_lda", LDA_SQL + cm_sql("np") + REPORT_SQL)
def _(spark, d):
    train, test = parts(cohort(spark, d, "label3"))
    return class_report(score(L.fit_lda(train, {"shrinkage": 0.25}), test), "LDA")


@register("clf_gaussian_nb", ", ts as (select row_id, label3 as label, part, z1, z2 from lc)" + nb_sql(Z, "NB", "1e-3::double") + cm_sql("np") + REPORT_SQL)
def _(spark, d):
    train, test = parts(cohort(spark, d, "label3"))
    return class_report(score(L.fit_gaussian_nb(train, {"var_smoothing": 1e-3}), test), "NB")


@register("clf_gaussian_nb_stats", " union all ".join(
    f"select label3 as label, count(*) as n, '{c}' as feature, {r_sql(f'avg({c})', 'mean')}, {r_sql(f'var_pop({c})', 'var')} from lc group by 1" for c in Z))
def _(spark, d):
    return rnd(nb_stats(b.made_cohort(spark, d).withColumn("label", F.col("label3")), Z), "mean", "var")


KS = list(range(1, 21, 2))
_ks = ", ".join(f"({k})" for k in KS)
CLF_KNN_SQL = f"""
, y as (select row_id, v, (v[1] + 0.5::double * v[2] > 0)::int as label, {b.hk_sql('part', 'row_id')} % 5 = 0 as test from em),
pr as (select a.row_id, a.label as own, b.label, b.row_id as nid, list_distance(a.v, b.v) as d2, list_sum([abs(x[1] - x[2]) for x in list_zip(a.v, b.v)]) as d1
  from y a join y b on a.test and not b.test),
rk as (select 2 as p, row_id, own, label, d2 as d, row_number() over (partition by row_id order by d2, nid) as rank from pr
  union all select 1, row_id, own, label, d1, row_number() over (partition by row_id order by d1, nid) from pr),
vt as (select p, k, w, row_id, own, label, sum(case w when 'uniform' then 1 else 1 / d end) as vote
  from rk, (values {_ks}) ks(k), (values ('uniform'), ('distance')) ws(w) where rank <= k group by all),
pd as (select p, k, w, row_id, any_value(own) as own, arg_max(label, (vote, -label)) as prediction from vt group by p, k, w, row_id)
select p, k, w as weighting, {r_sql('avg((own = prediction)::int) * 100', 'accuracy')} from pd group by 1, 2, 3"""


@register("clf_knn", CLF_KNN_SQL)
def _(spark, d):
    v = b.vectors(spark, d).withColumn("label", (F.col("features")[0] + 0.5 * F.col("features")[1] > 0).cast("int"))
    v = v.withColumn("test", hash_key("part", "row_id") % 5 == 0)
    train, test = v.filter("not test"), v.filter("test")
    out = None
    # one neighbour table per metric serves all k and weightings
    for p in (1, 2):
        votes = neighbour_votes(knn_join(test, train, max(KS), p), train, KS, ["uniform", "distance"])
        pred = predict_votes(votes).join(test.select("row_id", "label"), "row_id")
        one = pred.groupBy("k", "weighting").agg((F.avg((F.col("label") == F.col("prediction")).cast("int")) * 100).alias("accuracy")).withColumn("p", F.lit(p))
        out = one if out is None else out.unionByName(one)
    return rnd(out.select("p", "k", "weighting", "accuracy"), "accuracy")


def _classifier(key: str, name: str, params: dict, target: str = "label3"):
    @register(key)
    def _(spark, d):
        df = cohort(spark, d, target).persist()
        train, test = parts(df)
        scored = score(L.CLASSIFIERS[name](train, params), test)
        return class_report(scored, name)


_classifier("clf_sgd_linear", "LR-SGD", {"loss": "modified_huber", "penalty": "elasticnet", "alpha": 1e-5, "eta0": 0.1, "max_iter": 200, "class_weight": "balanced"})
_classifier("clf_tree", "DT", {"max_depth": 8, "criterion": "entropy", "min_samples_leaf": 2})
_classifier("clf_forest", "RF", {"n_estimators": 50, "max_depth": 6, "class_weight": "balanced"})
_classifier("clf_adaboost", "AdaB", {"n_estimators": 50, "max_depth": 2, "learning_rate": 1.0})
_classifier("clf_gbt", "XGB", {"n_estimators": 50, "max_depth": 3, "learning_rate": 0.3})
_classifier("clf_svm", "SVM", {"C": 10, "kernel": "rbf", "landmarks": 40, "max_iter": 100}, "label3")
_classifier("clf_mlp", "MLP", {"hidden_layer_sizes": [16], "learning_rate_init": 0.01, "max_iter": 200})


@register("clf_adaboost_round", f"""
, s as (select model, sum((label <> prediction)::int)::double / count(*) as err from lp where model = 'RF' group by 1),
a as (select err, 0.5::double * (ln((1 - err) / err) + ln(2)) as alpha from s)
select lp.label, lp.prediction, {r_sql('any_value(err)', 'err')}, {r_sql('any_value(alpha)', 'alpha')}, {r_sql('sum(exp(alpha * (label <> prediction)::int))', 'weight', 4)}
from lp, a where model = 'RF' group by 1, 2""")
def _(spark, d):
    rows = b.long_predictions(spark, d).filter("model = 'RF'").withColumn("weight", F.lit(1.0))
    new, err, alpha = trees.samme_round(rows, 3, 0.5)
    sums = new.groupBy("label", "prediction").agg(F.lit(err).alias("err"), F.lit(alpha).alias("alpha"), F.sum("weight").alias("weight"))
    return rnd(rnd(sums, "err", "alpha"), "weight", digits=4)


# ---- regressors --------------------------------------------------------------------------------

GRAM_SQL = """
, gr as (select count(*)::double as n, avg(z1) as m1, avg(z2) as m2, avg(y) as my, var_pop(z1) * count(*) as s11, var_pop(z2) * count(*) as s22,
  covar_pop(z1, z2) * count(*) as s12, covar_pop(z1, y) * count(*) as t1, covar_pop(z2, y) * count(*) as t2 from lc where part = 'train')
"""


def _ridge_sql(alpha: str) -> str:
    return GRAM_SQL + f"""
, w as (select *, (t1 * (s22 + {alpha}) - t2 * s12) / ((s11 + {alpha}) * (s22 + {alpha}) - s12 * s12) as w1,
  (t2 * (s11 + {alpha}) - t1 * s12) / ((s11 + {alpha}) * (s22 + {alpha}) - s12 * s12) as w2 from gr)
"""


def _cd_sql(alpha: float, ratio: float) -> str:
    """Coordinate descent on the second moments."""
    l1, l2 = f"({alpha * ratio}::double * n)", f"({alpha * (1 - ratio)}::double * n)"

    def soft(v: str) -> str:
        return f"(sign({v}) * greatest(abs({v}) - {l1}, 0))"

    return GRAM_SQL + f"""
, cd(i, w1, w2) as (select 0, 0.0::double, 0.0::double union all
  select i + 1, v1, {soft('(t2 - s12 * v1)')} / (s22 + {l2}) from (
    select i, w2, n, s12, s22, t2, {soft('(t1 - s12 * w2)')} / (s11 + {l2}) as v1 from cd, gr where i < 60) s),
w as (select w1, w2, m1, m2, my from cd, gr where i = 60)
"""


def coef_sql(digits: int) -> str:
    return f"select {r_sql('w1', 'w1', digits)}, {r_sql('w2', 'w2', digits)}, {r_sql('my - w1 * m1 - w2 * m2', 'intercept', digits)} from w"


def _linear(key: str, name: str, params: dict, oracle: str, digits: int):
    @register(key, oracle + coef_sql(digits))
    def _(spark, d):
        df = cohort(spark, d, "y")
        model = L.REGRESSORS[name](df.filter("part = 'train'"), params)
        w = [float(v) for v in model.coefficients]
        out = df.limit(1).select(F.lit(w[0]).alias("w1"), F.lit(w[1]).alias("w2"), F.lit(float(model.intercept)).alias("intercept"))
        return rnd(out, "w1", "w2", "intercept", digits=digits)


_linear("reg_ols", "LR", {}, _ridge_sql("0"), 6)
_linear("reg_ridge", "Ridge", {"alpha": 10}, _ridge_sql("10"), 6)
_linear("reg_lasso", "Lasso", {"alpha": 0.01}, _cd_sql(0.01, 1.0), 4)
_linear("reg_elasticnet", "ElasticNet", {"alpha": 0.01, "l1_ratio": 0.5}, _cd_sql(0.01, 0.5), 4)


def _regressor(key: str, name: str, params: dict):
    @register(key)
    def _(spark, d):
        train, test = parts(cohort(spark, d, "y").persist())
        scored = L.REGRESSORS[name](train, params).transform(test)
        return rnd(m.regression_metrics(scored, p=3).select(F.lit(name).alias("model"), *REG), *REG)


_regressor("reg_tree", "DT", {"max_depth": 8})
_regressor("reg_forest", "RF", {"n_estimators": 50, "max_depth": 6})
_regressor("reg_adaboost", "AdaB", {"n_estimators": 50, "learning_rate": 0.5})
_regressor("reg_gbt", "XGB", {"n_estimators": 50, "max_depth": 3, "learning_rate": 0.3})
_regressor("reg_bagging", "Bagging", {"n_estimators": 50, "max_samples": 0.7, "max_features": 1.0, "max_depth": 8})
_regressor("reg_svr", "SVR", {"C": 10, "kernel": "rbf", "epsilon": 0.1, "landmarks": 40, "max_iter": 200})
_regressor("reg_gp", "GPR", {"kernel": "rbf", "alpha": 1e-2, "landmarks": 40, "n_restarts_optimizer": 0})
_regressor("reg_mlp", "MLP", {"hidden_layer_sizes": [16], "learning_rate_init": 0.01, "max_iter": 200})


@register("reg_adaboost_round", f"""
, e as (select *, abs(label - prediction) as ae from ep where model = 'RF'),
l as (select *, ae / max(ae) over () as loss from e), s as (select avg(loss) as mean_loss from l),
bb as (select mean_loss, mean_loss / (1 - mean_loss) as beta from s)
select {r_sql('any_value(mean_loss)', 'mean_loss')}, {r_sql('any_value(beta)', 'beta')}, {r_sql('sum(beta ^ (0.5::double * (1 - loss)))', 'weight', 3)} from l, bb""")
def _(spark, d):
    rows = b.event_predictions(spark, d).filter("model = 'RF'").withColumn("weight", F.lit(1.0))
    new, mean, beta = trees.r2_round(rows, 0.5)
    return rnd(rnd(new.agg(F.lit(mean).alias("mean_loss"), F.lit(beta).alias("beta"), F.sum("weight").alias("weight")), "mean_loss", "beta"), "weight", digits=3)


# ---- search ------------------------------------------------------------------------------------

@register("grid_search")
def _(spark, d):
    df = stratified_kfold(cohort(spark, d, "label3"), k=3).persist()
    _, params, _, scores = search.grid_search(df, L.fit_gaussian_nb, {"var_smoothing": [1e-9, 1e-3, 1e-1, 1.0]})
    out = spark.createDataFrame([(s["param_id"], s["fold"], float(s["score"]), str(params)) for s in scores], "param_id int, fold int, score double, best string")
    return out.orderBy("param_id", "fold")


KNN_FOLDS_SQL = f"""
, y as (select row_id, v, (v[1] + 0.5::double * v[2] > 0)::int as label, {b.hk_sql('fold', 'row_id')} % 3 as fold from em),
pr as (select a.row_id, a.fold, a.label as own, b.label, b.row_id as nid, list_distance(a.v, b.v) as d2, list_sum([abs(x[1] - x[2]) for x in list_zip(a.v, b.v)]) as d1
  from y a join y b on a.fold <> b.fold),
rk as (select 2 as p, fold, row_id, own, label, d2 as d, row_number() over (partition by row_id order by d2, nid) as rank from pr
  union all select 1, fold, row_id, own, label, d1, row_number() over (partition by row_id order by d1, nid) from pr),
vt as (select p, k, w, fold, row_id, own, label, sum(case w when 'uniform' then 1 else 1 / d end) as vote
  from rk, (values {_ks}) ks(k), (values ('uniform'), ('distance')) ws(w) where rank <= k group by all),
pd as (select p, k, w, fold, row_id, any_value(own) as own, arg_max(label, (vote, -label)) as prediction from vt group by p, k, w, fold, row_id),
ac as (select p, k, w, fold, avg((own = prediction)::int) as score from pd group by p, k, w, fold)
select m as metric, q as p, k as n_neighbors, w as weights, fold::int as fold, {r_sql('score', 'score')}
from ac, (values ('euclidean', 1, 2), ('euclidean', 2, 2), ('manhattan', 1, 1), ('manhattan', 2, 1), ('minkowski', 1, 1), ('minkowski', 2, 2)) ms(m, q, power) where power = ac.p"""


@register("grid_search_knn", KNN_FOLDS_SQL)
def _(spark, d):
    # all 120 candidates of the grid on three folds, from one neighbour table per power
    v = b.vectors(spark, d).withColumn("label", (F.col("features")[0] + 0.5 * F.col("features")[1] > 0).cast("int"))
    folded = v.withColumn("fold", (hash_key("fold", "row_id") % 3).cast("int"))
    grid = CLASSIFIER_GRIDS["KNN"]
    options = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    scores = search.grid_scores(folded, L.fit_knn, options, "fold", 3, "accuracy")
    rows = [(o["metric"], o["p"], o["n_neighbors"], o["weights"], s["fold"], s["score"]) for s in scores for o in [options[s["param_id"]]]]
    return rnd(spark.createDataFrame(rows, "metric string, p int, n_neighbors int, weights string, fold int, score double"), "score")


@register("nested_cv_classify")
def _(spark, d):
    grid = {"shrinkage": [0.0, 0.25, 0.5, 0.75, 1.0], "tol": [1e-4]}
    return search.nested_cv_classify(cohort(spark, d, "label3"), L.fit_lda, grid, 5, 3, 3, n_iter=10).orderBy("metric", "fold")


@register("nested_cv_regress")
def _(spark, d):
    return search.nested_cv_regress(cohort(spark, d, "y"), L.fit_ridge, {"alpha": [0.01, 1, 100]}, 2, 5, 3, n_iter=10).orderBy("metric", "fold")


@register("run_all_models")
def _(spark, d):
    df = cohort(spark, d, "label2").persist()
    learners = {n: L.CLASSIFIERS[n] for n in ("NB", "LDA")}
    grids = {"NB": {"var_smoothing": [1e-9, 1e-3]}, "LDA": {"shrinkage": [0.0, 0.5]}}
    path = fresh_path(spark, "nested")
    # the second call finds the first learner's results and goes on with the rest
    search.run_all_models(df, {"NB": learners["NB"]}, grids, path, outer=5, inner=3, n_iter=10)
    return search.run_all_models(df, learners, grids, path, outer=5, inner=3, n_iter=10)


@register("run_all_models_regress")
def _(spark, d):
    # every candidate of every grid; those of the linear learners share one pass over the rows, the others are fitted one by one
    return search.run_all_models(cohort(spark, d, "y"), L.REGRESSORS, REGRESSOR_GRIDS, fresh_path(spark, "nested"), n_features=2, classify=False, outer=5, inner=3, method="grid")


@register("training_task")
def _(spark, d):
    train, test = parts(cohort(spark, d, "label2"))
    learners, grids = {n: L.CLASSIFIERS[n] for n in ("NB", "LDA")}, {n: CLASSIFIER_GRIDS[n] for n in ("NB", "LDA")}
    return training_task(train, test, learners, grids, fresh_path(spark, "task"), fresh_path(spark, "book"), "task", n_features=2, top=2)


@register("predict_all", f"""
, c as (select regr_slope(y, z1) as w, regr_intercept(y, z1) as b, sum(z1 * y) / sum(z1 * z1) as w0 from lc where part = 'train')
select row_id, 'LR' as model, {r_sql('w * z1 + b', 'prediction')} from lc, c where part = 'test'
union all select row_id, 'LR0', {r_sql('w0 * z1', 'prediction')} from lc, c where part = 'test'""")
def _(spark, d):
    df = encode.assemble_features(b.made_cohort(spark, d).withColumn("label", F.col("y")), ["z1"])
    train, test = parts(df)
    models = {"LR": L.fit_ols(train, {}), "LR0": L.fit_ols(train, {"fit_intercept": False}), "broken": L.fit_ols(train.withColumnRenamed("features", "other").withColumn("features", F.col("other")), {}).copy().setFeaturesCol("nowhere")}
    return rnd(ensemble.predict_all(models, test, ["row_id"]), "prediction")


# ---- model-based explanations ------------------------------------------------------------------

def _linear_scorer(x: np.ndarray) -> np.ndarray:
    return x @ np.array(b.SHAP_COEF).T + np.array(b.SHAP_INTERCEPT)


def _status_background(df):
    """Weighted background: the mean row of each class."""
    rows = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f) for f in b.SHAP_FEATURES]).collect()
    n = np.array([r["n"] for r in rows], dtype=float)
    return np.array([[r[f] for f in b.SHAP_FEATURES] for r in rows]), n / n.sum()


SL_SQL = f"select row_id, label, class, feature, feature_value, {r_sql('phi', 'phi')}, {r_sql('base', 'base')} from sl"


def _sampled(spark, d, explain):
    df = b.shap_features(spark, d).withColumn("features", F.array(*b.SHAP_FEATURES))
    return rnd(explain(df, _linear_scorer, *_status_background(df), b.SHAP_FEATURES), "phi", "base")


@register("shap_kernel", SL_SQL)
def _(spark, d):
    # a linear scorer has known contributions: those of shap_linear
    return _sampled(spark, d, shap.shap_kernel)


@register("shap_permutation", SL_SQL)
def _(spark, d):
    return _sampled(spark, d, lambda *a: shap.shap_permutation(*a, permutations=10))


@register("shap_kernel_model", f"""
, w as (select regr_r2(y, z1) as unused, count(*)::double as n, avg(z1) as m1, avg(z2) as m2, avg(y) as my, var_pop(z1) as s11, var_pop(z2) as s22, covar_pop(z1, z2) as s12,
  covar_pop(z1, y) as t1, covar_pop(z2, y) as t2 from lc where part = 'train'),
c as (select m1, m2, my, (t1 * s22 - t2 * s12) / (s11 * s22 - s12 * s12) as w1, (t2 * s11 - t1 * s12) / (s11 * s22 - s12 * s12) as w2 from w)
select row_id, 0 as class, 'z1' as feature, {r_sql('z1', 'feature_value')}, {r_sql('w1 * (z1 - m1)', 'phi')}, {r_sql('my', 'base')} from lc, c where part = 'test'
union all select row_id, 0, 'z2', {r_sql('z2', 'feature_value')}, {r_sql('w2 * (z2 - m2)', 'phi')}, {r_sql('my', 'base')} from lc, c where part = 'test'""")
def _(spark, d):
    # a fitted model against weighted centres of its training rows; their mean is that of the rows, so least squares has known contributions
    train, test = parts(cohort(spark, d, "y"))
    long = explain_model(test, L.fit_ols(train, {}), Z, train)
    return rnd(long.drop("label"), "feature_value", "phi", "base")


MODEL_FOLDS_SQL = f"""
, f as (select *, {b.hk_sql('fold', 'row_id')} % 5 as fold from lc),
g as (select k as fold, var_pop(z1) as s11, var_pop(z2) as s22, covar_pop(z1, z2) as s12, covar_pop(z1, y) as t1, covar_pop(z2, y) as t2 from f, range(5) r(k) where fold <> k group by k),
i as (select fold, 'z1' as feature, abs((t1 * s22 - t2 * s12) / (s11 * s22 - s12 * s12)) as importance from g
  union all select fold, 'z2', abs((t2 * s11 - t1 * s12) / (s11 * s22 - s12 * s12)) from g)"""


def _fold_models(spark, d):
    folded = cohort(spark, d, "y").withColumn("fold", (hash_key("fold", "row_id") % 5).cast("int"))
    return model_importances(spark, {"LR": search.fold_models(folded, L.fit_ols, [{}], "fold", 5)[0]}, Z)


@register("model_importances", MODEL_FOLDS_SQL + f" select 'LR' as model, fold::int as fold, feature, {r_sql('importance', 'importance')} from i")
def _(spark, d):
    return rnd(_fold_models(spark, d), "importance")


@register("fold_importance_model", MODEL_FOLDS_SQL + f" select feature, {r_sql('avg(importance)', 'mean_importance')} from i group by 1")
def _(spark, d):
    return rnd(views.fold_importance(_fold_models(spark, d)), "mean_importance")


@register("top_feature_importance_model")
def _(spark, d):
    model = L.fit_forest_classifier(parts(cohort(spark, d, "label3"))[0], {"n_estimators": 50, "max_depth": 6, "class_weight": "balanced"})
    return views.top_importance(model_importances(spark, {"RF": [model]}, Z).select("feature", "importance"), 2)


@register("shap_tree")
def _(spark, d):
    df = cohort(spark, d, "label3").persist()
    model = L.fit_forest_classifier(df.filter("part = 'train'"), {"n_estimators": 50, "max_depth": 6, "class_weight": "balanced"})
    return rnd(shap.shap_tree(df, model, Z), "phi", "base", digits=9)


@register("tree_nodes")
def _(spark, d):
    model = L.fit_tree_classifier(cohort(spark, d, "label3"), {"max_depth": 4})
    return tree_nodes(spark, model)


@register("lime_classify")
def _(spark, d):
    df = cohort(spark, d, "label3").persist()
    train, test = parts(df)
    return lime(test, train, L.fit_lda(train, {}), Z, 5)


@register("lime_regress")
def _(spark, d):
    df = cohort(spark, d, "y").persist()
    train, test = parts(df)
    return lime(test, train, L.fit_ols(train, {}), Z, 20, "prediction")
