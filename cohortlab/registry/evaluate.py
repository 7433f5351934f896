"""Grids, metrics, bootstrap, selection, voting, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bootstrap as bs
from ..functions import metrics as m
from ..operators import ensemble, reports
from ..plans import grids
from . import base as b
from .base import r_sql, register, rnd
from .prep import poisson_sql

# ---- grids -------------------------------------------------------------------------------------

# the kernel widths follow the data: 1 / (p * variance) and 1 / p
GRID_SQL = """
, g as (select [(1 / (2 * var_pop(z1)))::varchar, '0.5'] as gammas from lc),
e as (select c, k, gamma, ci, ki, gi from g, (values (0, '0.1'), (1, '1'), (2, '10')) a(ci, c),
  (values (0, 'rbf'), (1, 'poly')) b(ki, k), (select unnest(gammas) as gamma, generate_subscripts(gammas, 1) as gi from g) c),
n as (select row_number() over (order by ci, ki, gi) as param_id, c, k, floor(gamma::double * 1e6 + 0.5::double) / 1e6 as gamma from e)
"""


def _gamma_grid(spark, d):
    gammas = b.made_cohort(spark, d).agg(F.array(1 / (2 * F.var_pop("z1")), F.lit(0.5)).alias("gammas"))
    return grids.expand_grid(spark, {"C": ["0.1", "1", "10"], "kernel": ["rbf", "poly"], "gamma": F.col("gammas")}, gammas)


def _flat(df):
    p = F.col("params")
    return df.select(F.col("param_id").cast("long").alias("param_id"), p["C"].alias("c"), p["kernel"].alias("k"), (F.floor(p["gamma"].cast("double") * 1e6 + 0.5) / 1e6).alias("gamma"))


@register("expand_grid", GRID_SQL + "select param_id, c, k, gamma from n")
def _(spark, d):
    return _flat(_gamma_grid(spark, d))


@register("sample_grid", GRID_SQL + f"select param_id, c, k, gamma from n order by {b.hk_sql('42', 'param_id')}, param_id limit 5")
def _(spark, d):
    return _flat(grids.sample_grid(_gamma_grid(spark, d), 5))


@register("best_candidate", f"""
, s as (select length(model) as param_id, fold, avg((label = prediction)::int) as score from lp group by 1, 2),
a as (select param_id, avg(score) as mean_score from s group by 1)
select param_id::int as param_id, {r_sql('mean_score', 'mean_score')} from a order by a.mean_score desc, a.param_id limit 1""")
def _(spark, d):
    s = b.long_predictions(spark, d).groupBy(F.length("model").alias("param_id"), "fold").agg(
        F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("score"))
    return rnd(grids.best_candidate(s), "mean_score")


# ---- label metrics -----------------------------------------------------------------------------

def cm_sql(source: str) -> str:
    """Label metrics of ``source`` (model, label, prediction) as a chain of tables ending in ``lm``."""
    return f"""
, cm as (select model, label, prediction, count(*)::double as n from {source} group by all),
k as (select model, cls, sum(t) as t, sum(p) as p, sum(tp) as tp from (
  select model, label as cls, n as t, 0 as p, case when label = prediction then n else 0 end as tp from cm
  union all select model, prediction, 0, n, 0 from cm) group by all),
w as (select model, sum(t) as s, sum(tp) as c, avg(tp / t) as bacc, sum(t * p) as tc, sum(p * p) as pp, sum(t * t) as tt,
  sum(t * case when p > 0 then tp / p else 0 end) as wp, sum(t * 2 * tp / (t + p)) as wf from k group by 1),
lm as (select model, c / s as accuracy, bacc as balanced_accuracy, (c * s - tc) / sqrt((s * s - pp) * (s * s - tt)) as mcc,
  wp / s as precision_weighted, c / s as recall_weighted, wf / s as f1_weighted from w)
"""


CM_SQL = cm_sql("lp")


@register("confusion_matrix", "select model, fold, label, prediction, count(*) as n from lp group by all")
def _(spark, d):
    return m.confusion(b.long_predictions(spark, d), ["model", "fold"])


def _label_metric(name, fn):
    @register(name, CM_SQL + f"select model, {r_sql(f'{name} * 100', name)} from lm")
    def _(spark, d):
        return rnd(fn(m.confusion(b.long_predictions(spark, d), ["model"]), ["model"]), name)


for _name in m.LABEL_METRICS:
    _label_metric(_name, getattr(m, _name))


# ---- rank metrics ------------------------------------------------------------------------------

def auc_sql(source: str, keys: str, positive: str, score: str) -> str:
    """Rank AUC as a chain of tables ending in ``auc``."""
    return f"""
, g as (select {keys}, {score} as score, sum(({positive})::int)::double as pos, sum((not ({positive}))::int)::double as neg from {source} group by all),
c as (select *, sum(neg) over (partition by {keys} order by score) as cum from g),
auc as (select {keys}, sum(pos) as n_pos, sum(pos * (cum - neg / 2)) / (sum(pos) * sum(neg)) as auc from c group by all)
"""


@register("auc_binary", auc_sql("bs", "model, fold", "label = 1", "score") + f"select model, fold, {r_sql('auc', 'auc')} from auc")
def _(spark, d):
    return rnd(m.auc_binary(b.binary_scores(spark, d), keys=["model", "fold"]).select("model", "fold", "auc"), "auc")


OVR_SQL = ", px as (select model, label, k::int as cls, probability[k + 1] as score from pp, range(3) t(k))" + auc_sql(
    "px", "model, cls", "label = cls", "score"
)


@register("auc_ovr_weighted", OVR_SQL + f"select model, {r_sql('sum(auc * n_pos) / sum(n_pos)', 'auc')} from auc group by 1")
def _(spark, d):
    return rnd(m.auc_ovr_weighted(b.long_predictions(spark, d), keys=["model"]), "auc")


@register("label_binarize", "select row_id, [(label = 0)::int, (label = 1)::int, (label = 2)::int] as indicator from oc")
def _(spark, d):
    return m.label_binarize(b.orders_cohort(spark, d), 3).select("row_id", "indicator")


@register("roc_curve", f"""
, g as (select model, score, sum(label)::double as pos, sum(1 - label)::double as neg from bs group by all)
select model, score as threshold,
  {r_sql('sum(neg) over (partition by model order by score desc) / sum(neg) over (partition by model)', 'fpr')},
  {r_sql('sum(pos) over (partition by model order by score desc) / sum(pos) over (partition by model)', 'tpr')} from g""")
def _(spark, d):
    return rnd(m.roc_curve(b.binary_scores(spark, d), keys=["model"]), "fpr", "tpr")


# ---- regression metrics ------------------------------------------------------------------------

P = 3
REG_SQL = f"""
, z as (select model, count(*)::double as n, sum(abs(label - prediction)) as ae, sum((label - prediction) ^ 2) as rss,
  var_pop(label) * count(*) as tss from ep group by 1),
rm as (select model, ae / n as mae, rss / n as mse, sqrt(rss / n) as rmse, 1 - rss / tss as r2,
  n * ln(rss / n) + 2 * {P} as aic, n * ln(rss / n) + {P} * ln(n) as bic from z)
"""
REG = ["mae", "mse", "rmse", "r2", "aic", "bic"]


def _reg_metric(name, fn):
    @register(name, REG_SQL + f"select model, {r_sql(name, name, 5)} from rm")
    def _(spark, d):
        return rnd(fn(b.event_predictions(spark, d), ["model"], P), name, digits=5)


for _name in REG:
    _reg_metric(_name, getattr(m, _name))


@register("evaluate_regressors", REG_SQL + "select model, " + ", ".join(r_sql(c, c, 5) for c in REG) + " from rm")
def _(spark, d):
    return rnd(m.evaluate_regressors(b.event_predictions(spark, d), P - 1), *REG, digits=5)


# ---- summaries and bootstrap -------------------------------------------------------------------

FOLD_SQL = """
, fa as (select model, fold, avg((label = prediction)::int) * 100 as acc from lp group by all),
fe as (select model, fold, avg(abs(label - prediction)) as mae from ep group by all),
fm as (select model, fold, 'accuracy' as metric, acc as value from fa
  union all select model, fold, 'mae', case when fold = 3 and model = 'NB' then null else mae end from fe),
su as (select model, metric, avg(value) as mean, stddev_samp(value) as std,
  case when count(value) = count(*) then quantile_cont(value, 0.025) end as ci_lower,
  case when count(value) = count(*) then quantile_cont(value, 0.975) end as ci_upper from fm group by all)
"""
SUMMARY = ["mean", "std", "ci_lower", "ci_upper"]


def fold_metrics(spark, d):
    acc = b.long_predictions(spark, d).groupBy("model", "fold").agg((F.avg((F.col("label") == F.col("prediction")).cast("int")) * 100).alias("value"))
    mae = b.event_predictions(spark, d).groupBy("model", "fold").agg(F.avg(F.abs(F.col("label") - F.col("prediction"))).alias("value"))
    holed = F.when(~((F.col("fold") == 3) & (F.col("model") == "NB")), F.col("value"))
    return acc.select("model", "fold", F.lit("accuracy").alias("metric"), "value").unionByName(
        mae.select("model", "fold", F.lit("mae").alias("metric"), holed.alias("value")))


def summary(spark, d):
    return m.summarize_with_ci(fold_metrics(spark, d))


@register("summarize_with_ci", FOLD_SQL + "select model, metric, " + ", ".join(r_sql(c, c) for c in SUMMARY) + " from su")
def _(spark, d):
    return rnd(summary(spark, d), *SUMMARY)


@register("evaluate_single_prediction", CM_SQL + OVR_SQL + f"""
, e as (select 'accuracy' as metric, accuracy as v from lm where model = 'RF' union all select 'balanced_accuracy', balanced_accuracy from lm where model = 'RF'
  union all select 'mcc', mcc from lm where model = 'RF' union all select 'precision_weighted', precision_weighted from lm where model = 'RF'
  union all select 'recall_weighted', recall_weighted from lm where model = 'RF' union all select 'f1_weighted', f1_weighted from lm where model = 'RF'
  union all select 'auc', sum(auc * n_pos) / sum(n_pos) from auc where model = 'RF')
select 'Ensemble' as model, metric, {r_sql('v * 100', 'mean')}, cast(null as double) as std, {r_sql('v * 100', 'ci_lower')}, {r_sql('v * 100', 'ci_upper')} from e""")
def _(spark, d):
    one = b.long_predictions(spark, d).filter("model = 'RF'")
    return rnd(m.evaluate_single_prediction(one, n_classes=3), *SUMMARY)


@register("bootstrap_classify")
def _(spark, d):
    one = b.long_predictions(spark, d).filter("model = 'RF'")
    return bs.bootstrap_classification(one, 1000, 42, n_classes=3)


_BLOCKS = 250

def _draws(keys: str, sums: str) -> str:
    return " union all ".join(
        f"select b * 4 + {i} as replicate, {keys} {sums.replace('{w}', poisson_sql(f'substr(h, {1 + 8 * i}, 8)'))} from h group by all"
        for i in range(4)
    )


@register("bootstrap_classify_rows", f"""
, h as (select *, md5('42|' || b || '|' || row_id) as h from (select row_id, label, prediction from lp where model = 'RF') t, (select b::int as b from range({_BLOCKS}) t(b)) u)
, cw as ({_draws('label, prediction,', 'sum({w}) as n')})
, a as (select replicate, sum(case when label = prediction then n else 0 end) / sum(n) as acc from cw group by 1)
select {r_sql('avg(acc) * 100', 'mean')}, {r_sql('stddev_pop(acc) * 100', 'std')}, {r_sql('quantile_cont(acc, 0.025) * 100', 'ci_lower')},
  {r_sql('quantile_cont(acc, 0.975) * 100', 'ci_upper')} from a""")
def _(spark, d):
    cells = bs.bootstrap_confusion_rows(b.long_predictions(spark, d).filter("model = 'RF'"), 4 * _BLOCKS)
    acc = m.accuracy(cells, ["replicate"]).select(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"))
    return rnd(m.summarize_with_ci(acc, ["metric"], population=True).drop("metric"), *SUMMARY)


_reg_long = " union all ".join(f"select replicate, '{c}' as metric, {c} as value from rb" for c in REG)


@register("bootstrap_regress", f"""
, src as (select row_id, label, prediction from ep where model = 'RF')
, mu as (select avg(label) as mu from src)
, h as (select *, label - mu as y, md5('42|' || b || '|' || row_id) as h from src, mu, (select b::int as b from range({_BLOCKS}) t(b)) u)
, s4 as ({_draws('', 'sum({w}) as n, sum({w} * abs(label - prediction)) as ae, sum({w} * (label - prediction) ^ 2) as rss, sum({w} * y) as sy, sum({w} * y * y) as yy')})
, rb as (select replicate, ae / n as mae, rss / n as mse, sqrt(rss / n) as rmse, 1 - rss / (yy - sy * sy / n) as r2,
  n * ln(rss / n) + 4 as aic, n * ln(rss / n) + 2 * ln(n) as bic from s4)
, rl as ({_reg_long})
select metric, {r_sql('avg(value)', 'mean', 4)}, {r_sql('stddev_pop(value)', 'std', 4)}, {r_sql('quantile_cont(value, 0.025)', 'ci_lower', 4)},
  {r_sql('quantile_cont(value, 0.975)', 'ci_upper', 4)} from rl group by 1""")
def _(spark, d):
    one = b.event_predictions(spark, d).filter("model = 'RF'")
    return rnd(bs.bootstrap_regression(one, 4 * _BLOCKS), *SUMMARY, digits=4)


# ---- selection and ensembles -------------------------------------------------------------------

def metric_table(spark, d):
    return m.evaluate_regressors(b.event_predictions(spark, d), P - 1)


@register("select_above_mean", FOLD_SQL + f"select model, {r_sql('mean', 'mean')} from su where metric = 'accuracy' and mean > (select avg(mean) from su where metric = 'accuracy')")
def _(spark, d):
    return rnd(ensemble.select_above_mean(summary(spark, d)), "mean")


@register("select_topk", FOLD_SQL + f", t as (select * from su where metric = 'accuracy' order by mean desc, std, model limit 3) select model, {r_sql('mean', 'mean')}, {r_sql('std', 'std')} from t")
def _(spark, d):
    return rnd(ensemble.select_topk(summary(spark, d)), "mean", "std")


@register("select_weighted", FOLD_SQL + f", t as (select * from su where metric = 'accuracy' order by mean desc, std, model limit 3) select model, {r_sql('mean', 'weight')} from t")
def _(spark, d):
    return rnd(ensemble.select_weighted(summary(spark, d)), "weight")


@register("select_below_mean_error", REG_SQL + f"select model, {r_sql('mae', 'mae')} from rm where mae < (select avg(mae) from rm)")
def _(spark, d):
    return rnd(ensemble.select_below_mean_error(metric_table(spark, d)), "mae")


@register("select_top_n_error", REG_SQL + f", t as (select * from rm order by mae, model limit 3) select model, {r_sql('mae', 'mae')} from t")
def _(spark, d):
    return rnd(ensemble.select_top_n_error(metric_table(spark, d)), "mae")


@register("select_topk_r2", REG_SQL + f", t as (select * from rm order by r2 desc, model limit 3) select model, {r_sql('r2', 'r2')} from t")
def _(spark, d):
    return rnd(ensemble.select_topk_r2(metric_table(spark, d)), "r2")


@register("load_selected", FOLD_SQL + """
, t as (select * from su where metric = 'accuracy' order by mean desc, std, model limit 3),
st as (select model, count(*) as n_rows from ep group by 1) select model, n_rows from st where model in (select model from t)""")
def _(spark, d):
    store = b.event_predictions(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"))
    return ensemble.load_selected(ensemble.select_topk(summary(spark, d)), store)


@register("load_selected_missing", FOLD_SQL + """
, t as (select * from su where metric = 'accuracy' order by mean desc, std, model limit 3)
select model from t where model not in (select model from ep where length(model) < 4)""")
def _(spark, d):
    store = b.event_predictions(spark, d).filter(F.length("model") < 4).select("model").distinct()
    return ensemble.missing_selected(ensemble.select_topk(summary(spark, d)), store)


_vote_sql = """
, wt as (select model, {w} as weight from fa group by 1),
v as (select row_id, k::int as cls, sum(weight * probability[k + 1]) / sum(weight) as p from pp join wt using (model), range(3) t(k) group by all),
o as (select *, row_number() over (partition by row_id order by p desc, cls) as pos from v)
select o.row_id, o.cls as prediction, [floor(x * 1e6 + 0.5::double) / 1e6 for x in q.ps] as probability from o
join (select row_id, list(p order by cls) as ps from v group by 1) q using (row_id) where pos = 1"""


def _rounded_vote(df):
    return df.selectExpr("row_id", "prediction", "transform(probability, x -> floor(x * 1e6D + 0.5D) / 1e6D) AS probability")


@register("soft_vote", FOLD_SQL + _vote_sql.format(w="1.0::double"))
def _(spark, d):
    return _rounded_vote(ensemble.soft_vote(b.long_predictions(spark, d)))


@register("soft_vote_weighted", FOLD_SQL + _vote_sql.format(w="avg(acc)"))
def _(spark, d):
    pred = b.long_predictions(spark, d)
    weights = summary(spark, d).filter("metric = 'accuracy'").select("model", F.col("mean").alias("weight"))
    return _rounded_vote(ensemble.soft_vote(pred, weights))


@register("mean_vote", f"select row_id, {r_sql('avg(prediction)', 'prediction')} from ep group by 1")
def _(spark, d):
    return rnd(ensemble.mean_vote(b.event_predictions(spark, d)), "prediction")


@register("selected_models_table", FOLD_SQL + "select model as selected_model from su where metric = 'accuracy' order by mean desc, std, model limit 3")
def _(spark, d):
    return ensemble.selected_models_table(ensemble.select_topk(summary(spark, d)))


@register("merge_ensemble_metrics", REG_SQL + f"""
, v as (select row_id, any_value(label) as label, avg(prediction) as prediction from ep group by 1)
select model, {r_sql('mae', 'mae')} from rm union all select 'Ensemble', {r_sql('avg(abs(label - prediction))', 'mae')} from v""")
def _(spark, d):
    pred = b.event_predictions(spark, d)
    voted = pred.groupBy("row_id").agg(F.first("label").alias("label"), F.avg("prediction").alias("prediction"))
    base = m.mae(pred, ["model"])
    old = base.limit(1).withColumn("model", F.lit("Ensemble"))
    new = m.mae(voted.withColumn("model", F.lit("Ensemble")), ["model"])
    return rnd(ensemble.merge_ensemble_metrics(base.unionByName(old), new), "mae")


# ---- reports -----------------------------------------------------------------------------------

@register("report_metric_comparison", FOLD_SQL + f"""select model, {r_sql("max(case when metric = 'accuracy' then mean end)", 'accuracy')},
  {r_sql("max(case when metric = 'mae' then mean end)", 'mae')} from su group by 1""")
def _(spark, d):
    long = summary(spark, d).select("model", "metric", F.col("mean").alias("value"))
    return rnd(reports.report_metric_comparison(long, ["accuracy", "mae"]), "accuracy", "mae")


@register("report_accuracy", FOLD_SQL + f"select model, {r_sql('mean', 'accuracy')}, printf('%.2f', mean) as bar_label from su where metric = 'accuracy'")
def _(spark, d):
    wide = summary(spark, d).filter("metric = 'accuracy'").select("model", F.col("mean").alias("accuracy"))
    return rnd(reports.report_accuracy(wide), "accuracy")


@register("report_mae", REG_SQL + f"select model, {r_sql('mae', 'mae')}, {r_sql('rmse', 'rmse')} from rm")
def _(spark, d):
    return rnd(reports.report_mae(metric_table(spark, d)), "mae", "rmse")


@register("report_r2", REG_SQL + f"select model, {r_sql('r2', 'r2')} from rm")
def _(spark, d):
    return rnd(reports.report_r2(metric_table(spark, d)), "r2")


@register("report_top_models", REG_SQL + ", t as (select * from rm order by r2 desc, model limit 4) select model, " + ", ".join(r_sql(c, c, 5) for c in REG) + " from t")
def _(spark, d):
    return rnd(reports.report_top_models(metric_table(spark, d)), *REG, digits=5)
