"""Contribution views and importances over the linear contribution table of all orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..explain import views
from ..operators.ordering import exact_quantiles
from . import base as b
from .base import r_sql, register, rnd


@register("shap_linear", f"select row_id, label, class, feature, feature_value, {r_sql('phi', 'phi')}, {r_sql('base', 'base')} from sl")
def _(spark, d):
    return rnd(b.shap_long(spark, d), "phi", "base")


@register("shap_class_views", f"""
select row_id, feature, 1 as class, {r_sql('phi', 'phi')}, {r_sql('base', 'base')} from sl where class = 1
union all select row_id, feature, 0, {r_sql('-phi', 'phi')}, {r_sql('-base', 'base')} from sl where class = 1""")
def _(spark, d):
    one = b.shap_long(spark, d).filter("class = 1").select("row_id", "feature", "class", "phi", "base")
    return rnd(views.shap_classes(one), "phi", "base")


TOP = "row_number() over (partition by {p} order by importance desc, feature)"
CF = ", i as (select class, feature, avg(abs(phi)) as importance from sl group by all)"
OWN = ", i as (select class, feature, avg(abs(phi)) as importance from sl where label = class group by all)"
FE = ", i as (select feature, avg(abs(phi)) as importance from sl group by all)"


def _ranked(pre: str, p: str, n: int, cols: str) -> str:
    return pre + f", t as (select *, {TOP.format(p=p)} as rank from i) select {cols}, {r_sql('importance', 'importance')}, rank::int as rank from t where rank <= {n}"


@register("shap_summary_by_class", _ranked(CF, "class", 3, "class, feature"))
def _(spark, d):
    return rnd(views.shap_summary_by_class(b.shap_long(spark, d), 3), "importance")


@register("shap_summary_aggregated", FE + f" select feature, {r_sql('importance', 'importance')} from i")
def _(spark, d):
    return rnd(views.shap_summary_aggregated(b.shap_long(spark, d)), "importance")


@register("shap_importance_table", CF + " select feature, " + ", ".join(r_sql(f"max(case when class = {c} then importance end)", f"Class_{n}") for c, n in enumerate(["CN", "MCI", "AD"])) + " from i group by 1")
def _(spark, d):
    names = ["CN", "MCI", "AD"]
    return rnd(views.shap_importance_table(b.shap_long(spark, d), [0, 1, 2], names), *[f"Class_{n}" for n in names])


@register("shap_importance_regression", _ranked(FE.replace("from sl", "from sl where class = 0"), "1", 15, "feature"))
def _(spark, d):
    return rnd(views.shap_importance_regression(b.shap_long(spark, d).filter("class = 0")), "importance")


@register("shap_summary_regression", FE.replace("from sl", "from sl where class = 0") + f"""
select row_id, feature, feature_value, {r_sql('phi', 'phi')} from sl where class = 0 and feature in (select feature from i order by importance desc, feature limit 2)""")
def _(spark, d):
    return rnd(views.shap_summary_regression(b.shap_long(spark, d).filter("class = 0"), 2), "phi")


@register("shap_dependence", f"select row_id, class, feature_value, {r_sql('phi', 'phi')} from sl where feature = 'balance'")
def _(spark, d):
    return rnd(views.shap_dependence(b.shap_long(spark, d), "balance"), "phi")


@register("shap_decision_paths", CF + f"""
select row_id, class, feature, count(*) over w as step, {r_sql('base + sum(phi) over w', 'output', 9)} from sl join i using (class, feature)
window w as (partition by row_id, class order by importance, feature rows between unbounded preceding and current row)""")
def _(spark, d):
    return rnd(views.shap_decision_paths(b.shap_arrays(spark, d), b.SHAP_FEATURES), "output", digits=9)


MEANS = ", m as (select class, feature, avg(phi) as mean_phi, avg(feature_value) as mean_value, avg(base) as mean_base from sl where label = class group by all)"


def _waterfall(source: str, part: str, cols: str) -> str:
    return f"""
, st as (select *, count(*) over w as step, mean_base + sum(mean_phi) over w as bar_end from {source}
  window w as ({part} order by abs(mean_phi) desc, feature rows between unbounded preceding and current row))
select {cols}, {r_sql('mean_phi', 'mean_phi')}, {r_sql('mean_value', 'mean_value')}, {r_sql('mean_base', 'mean_base')}, step,
  {r_sql('bar_end', 'bar_end')}, {r_sql('bar_end - mean_phi', 'bar_start')} from st"""


STEPS = ["mean_phi", "mean_value", "mean_base", "bar_end", "bar_start"]


@register("shap_waterfall_by_class", MEANS + _waterfall("m", "partition by class", "class, feature"))
def _(spark, d):
    return rnd(views.shap_waterfall_by_class(b.shap_long(spark, d)), *STEPS)


@register("shap_waterfall_combined", MEANS + """
, m2 as (select feature, sum(mean_phi) as mean_phi, avg(mean_value) as mean_value, avg(mean_base) as mean_base from m group by 1)""" + _waterfall("m2", "", "feature"))
def _(spark, d):
    return rnd(views.shap_waterfall_combined(b.shap_long(spark, d)), *STEPS)


@register("shap_waterfall_row", f"""
, st as (select *, count(*) over w as step, base + sum(phi) over w as bar_end from sl where row_id = 7
  window w as (partition by class order by abs(phi) desc, feature rows between unbounded preceding and current row))
select class, feature, feature_value, {r_sql('phi', 'phi')}, {r_sql('base', 'base')}, step, {r_sql('bar_end - phi', 'bar_start')}, {r_sql('bar_end', 'bar_end')} from st""")
def _(spark, d):
    return rnd(views.shap_waterfall_row(b.shap_long(spark, d), 7), "phi", "base", "bar_start", "bar_end")


@register("shap_beeswarm", OWN + f""", t as (select *, {TOP.format(p='class')} as rank from i)
select row_id, class, feature, feature_value, {r_sql('phi', 'phi')} from sl join t using (class, feature) where label = class and rank <= 2""")
def _(spark, d):
    return rnd(views.shap_beeswarm(b.shap_long(spark, d), 2), "phi")


@register("shap_bar_by_class", OWN + f" select class, feature, {r_sql('importance', 'importance')} from i")
def _(spark, d):
    return rnd(views.shap_bar_by_class(b.shap_long(spark, d)), "importance")


@register("shap_bar_stacked", OWN + f"""
select feature, class, {r_sql('importance', 'importance')}, {r_sql('sum(importance) over (partition by feature order by class) - importance', 'bar_left')},
  {r_sql('sum(importance) over (partition by feature)', 'total')} from i""")
def _(spark, d):
    return rnd(views.shap_bar_stacked(b.shap_long(spark, d)), "importance", "bar_left", "total")


CORR = ", f as (select fold, unnest(['z1', 'z2']) as feature, unnest([abs(corr(z1, y)), abs(corr(z2, y))]) as importance from (select *, (" + b.hk_sql(
    "fold", "row_id") + " % 5)::int as fold from lc) t group by fold)"


def fold_correlations(spark, d):
    """(fold, feature, importance) with the absolute correlation with the target as importance."""
    from ..functions.hashing import hash_key

    lc = b.made_cohort(spark, d).withColumn("fold", (hash_key("fold", "row_id") % 5).cast("int"))
    wide = lc.groupBy("fold").agg(*[F.abs(F.corr(z, "y")).alias(z) for z in ("z1", "z2")])
    return wide.unpivot(["fold"], ["z1", "z2"], "feature", "importance")


@register("fold_importance", CORR + f" select feature, {r_sql('avg(importance)', 'mean_importance')} from f group by 1")
def _(spark, d):
    return rnd(views.fold_importance(fold_correlations(spark, d)), "mean_importance")


@register("top_feature_importance", FE + f", t as (select * from i order by importance desc, feature limit 3) select feature, {r_sql('importance', 'importance')} from t")
def _(spark, d):
    return rnd(views.top_importance(views.shap_summary_aggregated(b.shap_long(spark, d)), 3), "importance")


QCOLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("quartile_discretize", " union all ".join(
    f"select '{c}' as feature, {q}::double as prob, {r_sql(f'quantile_cont({c}, {q})', 'value')} from lineitem" for c in QCOLS for q in (0.25, 0.5, 0.75)), raw=True)
def _(spark, d):
    return rnd(exact_quantiles(b.table(spark, d, "lineitem"), QCOLS, [0.25, 0.5, 0.75]), "value")
