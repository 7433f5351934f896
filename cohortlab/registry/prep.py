"""Sources and sinks, profiling, projection, encoding, splits, folds, scaling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.hashing import POISSON_CUT, poisson_steps
from ..operators import encode, profile, sampling, scaling
from ..operators.ordering import rank_by_hash
from ..plans import catalog
from ..session import fresh_path
from ..sources import books, tables
from ..sources.models import load_model, resume_pending, save_model
from . import base as b
from .base import hk_sql, r_sql, register, rnd, table

HK42 = hk_sql("42", "row_id")


def poisson_sql(hex8: str) -> str:
    return "case " + " ".join(f"when {hex8} < '{s}' then {k}" for s, k in poisson_steps()) + f" else {POISSON_CUT} end::double"


# ---- sources and sinks -------------------------------------------------------------------------

@register("read_cohort", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders", raw=True)
def _(spark, d):
    return tables.read_cohort(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@register("read_csv", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer", raw=True)
def _(spark, d):
    path = fresh_path(spark, "csv")
    tables.write_stage(table(spark, d, "customer"), path, "csv")
    return tables.read_csv(spark, path, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@register("write_stage", "select row_id, status, z1, z2, part from lc")
def _(spark, d):
    path = fresh_path(spark, "stage")
    tables.write_stage(b.made_cohort(spark, d).select("row_id", "status", "z1", "z2", "part"), path, partition_by=["part"])
    return tables.read_cohort(spark, path)


@register("write_report_sheet", """
select 'new' as source, status as name, count(*) as n from oc group by 2
union all select 'old', priority_text, count(*) from oc group by 2""")
def _(spark, d):
    book = fresh_path(spark, "book")
    oc = b.orders_cohort(spark, d)

    def counts(col, tag):
        return oc.groupBy(F.col(col).alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("tag", F.lit(tag))

    books.write_report_sheet(counts("segment_text", "replaced"), book, "by_status")
    books.write_report_sheet(counts("priority_text", "old"), book, "by_priority")
    books.write_report_sheet(counts("status", "new"), book, "by_status")
    both = books.read_report_sheet(spark, book, "by_status").unionByName(books.read_report_sheet(spark, book, "by_priority"))
    return both.select(F.col("tag").alias("source"), "name", "n")


@register("write_report_book", """
select 'a' as sheet, status as name, count(*) as n, cast(null as double) as avg_price from oc group by 2
union all select 'b', priority_text, count(*), round(avg(price), 4) from oc group by 2""")
def _(spark, d):
    book = fresh_path(spark, "book")
    oc = b.orders_cohort(spark, d)
    old = oc.groupBy(F.col("segment_text").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    one = oc.groupBy(F.col("status").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    two = oc.groupBy(F.col("priority_text").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("price"), 4).alias("avg_price"))
    books.write_report_book({"old": old}, book)
    books.write_report_book({"a": one, "b": two}, book)
    sheets = [books.read_report_sheet(spark, book, s).withColumn("sheet", F.lit(s)) for s in books.report_sheets(spark, book)]
    return reduce(lambda a, c: a.unionByName(c, allowMissingColumns=True), sheets).select("sheet", "name", "n", "avg_price")


@register("read_report_sheet", "select status as name, count(*) as n from oc group by 1")
def _(spark, d):
    book = fresh_path(spark, "book")
    oc = b.orders_cohort(spark, d)
    books.write_report_book({c: oc.groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n")) for c in ["status", "priority_text"]}, book)
    return books.read_report_sheet(spark, book, "status")


@register("append_selection_log", """
, m as (select 1 as run, model, avg((label = prediction)::int) as acc from lp group by 2
  union all select 2, model, avg((label = prediction)::int) from lp where label < 2 group by 2),
r as (select *, row_number() over (partition by run order by acc desc, model) as pos from m)
select '1_MO' as feature_combination, case run when 1 then 'all' else 'binary' end as subset,
  string_agg(model, ', ' order by pos) as selected_models from r where pos <= 3 group by 1, 2""")
def _(spark, d):
    path = fresh_path(spark, "log")
    for name, rows in [("all", b.long_predictions(spark, d)), ("binary", b.long_predictions(spark, d).filter("label < 2"))]:
        acc = rows.groupBy("model").agg(F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("acc"))
        best = acc.orderBy(F.desc("acc"), "model").limit(3).select("model", (-F.col("acc")).alias("pos"))
        tables.append_selection_log(best, path, "1_MO", name)
    return spark.read.parquet(path)


_wide = ", ".join(f"max(case when model = '{m}' then prediction end) as \"Pred_{m}\"" for m in b.MODELS)


@register("write_predictions", f"select row_id, label as actual, {_wide} from lp group by 1, 2")
def _(spark, d):
    path = fresh_path(spark, "predictions")
    tables.write_stage(tables.predictions_wide(b.long_predictions(spark, d), b.MODELS), path)
    return spark.read.parquet(path)


@register("write_metrics", f"select model, {r_sql('avg(abs(label - prediction))', 'mae')} from ep group by 1")
def _(spark, d):
    path = fresh_path(spark, "metrics")
    tables.write_metrics(rnd(b.event_predictions(spark, d).groupBy("model").agg(F.avg(F.abs(F.col("label") - F.col("prediction"))).alias("mae")), "mae"), path)
    return spark.read.parquet(path)


@register("model_store")
def _(spark, d):
    from ..learners.bayes import fit_gaussian_nb
    from ..learners.linear import fit_logreg

    path = fresh_path(spark, "models")
    df = encode.assemble_features(b.made_cohort(spark, d).withColumn("label", F.col("label2")), ["z1", "z2"])
    train = df.filter("part = 'train'")
    out = None
    for name, fit in [("LogR", fit_logreg), ("NB", fit_gaussian_nb)]:
        model = fit(train, {})
        save_model(model, f"{path}/{name}")
        before = model.transform(df).select("row_id", F.col("prediction").alias("before"))
        after = load_model(spark, f"{path}/{name}").transform(df).select("row_id", F.col("prediction").alias("after"))
        one = before.join(after, "row_id").groupBy(F.lit(name).alias("model")).agg(
            F.count(F.lit(1)).alias("n"), F.sum((F.col("before") != F.col("after")).cast("int")).alias("n_changed")
        )
        out = one if out is None else out.unionByName(one)
    return out


@register("resume_pending", """
select distinct o_custkey % 50 as task, o_orderpriority as model from orders
except select o_custkey % 50, o_orderpriority from orders where o_totalprice > 480000
  and (o_custkey % 50, o_orderpriority) in (select (o_custkey % 50, o_orderpriority) from orders where o_totalprice < 20000)""", raw=True)
def _(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("task"), F.col("o_orderpriority").alias("model"), "o_totalprice")
    keys = ["task", "model"]
    return resume_pending(o.select(keys).distinct(), o.filter("o_totalprice > 480000"), o.filter("o_totalprice < 20000"), keys)


@register("task_plan", """
select c.combo, k.comparison, replace(k.comparison, 'vs_', '') as partition_value
from (select distinct c_mktsegment as combo from customer) c
cross join (select a.s || '_vs_' || b.s as comparison from (select distinct o_orderstatus as s from orders) a
  join (select distinct o_orderstatus as s from orders) b on a.s < b.s) k""", raw=True)
def _(spark, d):
    combos = table(spark, d, "customer").select(F.col("c_mktsegment").alias("combo")).distinct()
    # the classes found in the data, sorted: a handful of names, paired inside one array
    found = table(spark, d, "orders").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("found"))
    f = F.col("found")
    pairs = F.transform(f, lambda a: F.transform(F.filter(f, lambda x: x > a), lambda x: F.concat(a, F.lit("_vs_"), x)))
    return catalog.task_plan(combos, found.select(F.flatten(pairs)).scalar())


# ---- profiling ---------------------------------------------------------------------------------

@register("profile_shape", "select count(*) as n_rows, 11 as n_columns from lineitem", raw=True)
def _(spark, d):
    return profile.profile_shape(table(spark, d, "lineitem"))


@register("value_counts", "select target as value, count(*) as n from et where target is not null group by 1")
def _(spark, d):
    return profile.value_counts(b.event_targets(spark, d), "target")


@register("class_distribution", """
select 'before' as stage, label, count(*) as n from oc group by 2
union all select 'after', (label = 2)::int, count(*) from oc where label in (0, 2) group by 2""")
def _(spark, d):
    oc = b.orders_cohort(spark, d)
    return profile.class_distribution({"before": oc, "after": encode.binary_cohort(oc, "CN_vs_AD")})


@register("preview", "select row_id, status, price from oc order by row_id limit 5")
def _(spark, d):
    return profile.preview(b.orders_cohort(spark, d).select("row_id", "status", "price"))


@register("distinct_values", """
, e as (select nullif(event_type, 'error') as event_type, case when target is null then null else (target = 0)::varchar end as is_zero from et)
select distinct 'event_type' as "column", event_type as value from e
union all select distinct 'is_zero', is_zero from e""")
def _(spark, d):
    e = b.event_targets(spark, d).select(F.expr("nullif(event_type, 'error')").alias("event_type"), (F.col("target") == 0).alias("is_zero"))
    return profile.distinct_values(e, ["event_type", "is_zero"])


# ---- projection, encoding, filters -------------------------------------------------------------

@register("drop_columns", "select l_orderkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag from lineitem", raw=True)
def _(spark, d):
    return encode.drop_columns(table(spark, d, "lineitem"), ["l_suppkey", "l_linenumber", "l_linestatus", "l_shipdate"])


@register("rename_columns", "select p_partkey as row_id, p_size as \"Education_level\", p_retailprice from part", raw=True)
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return encode.rename_columns(p, {"p_partkey": "row_id", "p_size": "Education_level"})


ENCODE_RULES = {"status": ("DX_le", {"F": 0, "O": 1}), "priority_text": ("priority", b.PRIORITY)}


@register("encode_labels", f"""select row_id, status, case status when 'F' then 0 when 'O' then 1 end as "DX_le",
  priority_text, {b.case_sql('priority_text', b.PRIORITY)} as priority from oc""")
def _(spark, d):
    return encode.encode_labels(b.orders_cohort(spark, d).select("row_id", "status", "priority_text"), ENCODE_RULES)


@register("encode_unmapped", """
select 'status' as "column", sum((status not in ('F', 'O'))::int)::bigint as n_unmapped from oc
union all select 'priority_text', 0::bigint""")
def _(spark, d):
    return encode.unmapped_counts(b.orders_cohort(spark, d), ENCODE_RULES)


@register("drop_other_target", "select z1, z2, label2 from lc")
def _(spark, d):
    return encode.drop_other_target(b.made_cohort(spark, d).select("row_id", "z1", "z2", "label2", "label3"), "label2", ("label2", "label3"), "row_id")


@register("select_features", "select row_id, z2, label3 from lc")
def _(spark, d):
    return encode.select_features(b.made_cohort(spark, d), ["z2"], "label3")


COMBOS = {"1_MO": ["value"], "2_MS": ["value", "target"], "6_ALL": ["event_type", "value", "target"]}
_cat = " union all ".join(
    f"select '{c}' as combo, {i} as ord, '{f}' as feature, count({f}) as n_values from et" for c, fs in COMBOS.items() for i, f in enumerate(fs)
)


@register("feature_catalog", _cat)
def _(spark, d):
    return catalog.catalog_coverage(b.event_targets(spark, d), COMBOS)


@register("binary_cohort", "select row_id, (label = 2)::int as label, price from oc where label in (1, 2)")
def _(spark, d):
    return encode.binary_cohort(b.orders_cohort(spark, d).select("row_id", "label", "price"), "MCI_vs_AD")


@register("three_class_cohort", "select row_id, case status when 'F' then 0 when 'O' then 1 end as label from oc where status in ('F', 'O')")
def _(spark, d):
    oc = b.orders_cohort(spark, d).select("row_id", encode.lookup("status", {"F": 0, "O": 1}).alias("label"))
    return encode.three_class_cohort(oc, drop_null=True)


@register("target_not_null", "select row_id, target from et where target is not null")
def _(spark, d):
    return encode.target_not_null(b.event_targets(spark, d).select("row_id", "target"), "target")


@register("target_nonzero", "select row_id, target from et where target is not null and target <> 0")
def _(spark, d):
    return encode.target_nonzero(b.event_targets(spark, d).select("row_id", "target"), "target")


@register("split_xy", "select row_id, z1, z2, y from lc")
def _(spark, d):
    x, y = encode.split_xy(b.made_cohort(spark, d).select("row_id", "z1", "z2", "y"), "y")
    return x.join(y, "row_id")


@register("validate_xy", """
select 'test' as part, 'x without y' as problem, count(*) as n from lc where part = 'test' and label3 = 2
union all select 'train', 'y without x', count(*) from lc where part = 'train' and label3 = 0""")
def _(spark, d):
    x, y = encode.split_xy(b.made_cohort(spark, d).select("row_id", "z1", "part", "label3"), "label3")
    y = y.join(x.select("row_id", "part"), "row_id")
    keep_x = x.join(y.filter("label3 = 0 and part = 'train'").select("row_id"), "row_id", "left_anti")
    return encode.validate_xy(
        keep_x.filter("part = 'train'"), y.filter("part = 'train'"), x.filter("part = 'test'"), y.filter("part = 'test' and label3 < 2")
    )


@register("decode_classes", "select row_id, case label3 when 0 then 'CN' when 1 then 'MCI' when 2 then 'AD' end as class_name from lc")
def _(spark, d):
    return encode.decode_classes(b.made_cohort(spark, d), "CN_MCI_AD", "label3").select("row_id", "class_name")


@register("assemble_features", "select row_id, [z1, z2, y] as features from lc")
def _(spark, d):
    from pyspark.ml.functions import vector_to_array

    df = encode.assemble_features(b.made_cohort(spark, d), ["z1", "z2", "y"])
    return df.select("row_id", vector_to_array("features").alias("features"))


# ---- splits, folds, resampling, scaling --------------------------------------------------------

_rank_label = f"row_number() over (partition by label order by {HK42}, row_id)"
_rank_all = f"row_number() over (order by {HK42}, row_id)"


@register("rank_by_hash", f"select row_id, label, {_rank_label} as rank from oc")
def _(spark, d):
    return rank_by_hash(b.orders_cohort(spark, d).select("row_id", "label"), ["label"])


@register("stratified_split", f"""
, c as (select label, count(*) as n_class from oc group by 1),
q0 as (select *, sum(n_class) over () as n_all from c),
q1 as (select *, ceil(n_all * 0.2::double) as n_test from q0),
q2 as (select *, n_class * n_test / n_all as share from q1),
q as (select label, floor(share) + (row_number() over (order by share - floor(share) desc, label)
  <= n_test - sum(floor(share)) over ())::int as quota from q2),
r as (select row_id, label, {_rank_label} as rank from oc)
select row_id, label, case when rank <= quota then 'test' else 'train' end as part from r join q using (label)""")
def _(spark, d):
    return sampling.stratified_split(b.orders_cohort(spark, d).select("row_id", "label"))


@register("random_split", f"""
, n as (select ceil(count(*) * 0.2::double) as n_test from oc)
select row_id, case when {_rank_all} <= n_test then 'test' else 'train' end as part from oc, n""")
def _(spark, d):
    return sampling.random_split(b.orders_cohort(spark, d).select("row_id"))


@register("stratified_kfold", f"select row_id, label, (({_rank_label} - 1) % 5)::int as fold from oc")
def _(spark, d):
    return sampling.stratified_kfold(b.orders_cohort(spark, d).select("row_id", "label"))


@register("kfold", f"select row_id, (({_rank_all} - 1) % 5)::int as fold from oc")
def _(spark, d):
    return sampling.kfold(b.orders_cohort(spark, d).select("row_id"))


@register("nested_folds", f"""
, f as (select row_id, label, (({_rank_label} - 1) % 5)::int as own from oc),
o as (select row_id, label, k::int as outer_fold from f, range(5) t(k) where k <> own)
select row_id, label, outer_fold, ((row_number() over (partition by outer_fold, label
  order by {hk_sql('42-inner', 'row_id')}, row_id) - 1) % 3)::int as inner_fold from o""")
def _(spark, d):
    return sampling.nested_folds(b.orders_cohort(spark, d).select("row_id", "label"))


@register("concat_train_test", "select row_id, z1, part from lc")
def _(spark, d):
    lc = b.made_cohort(spark, d)
    return sampling.concat_train_test(*[lc.filter(F.col("part") == p).select("row_id", "z1") for p in ("train", "test")])


@register("minmax_scale", """
, s as (select min(z1) as l1, max(z1) as h1, min(z2) as l2, max(z2) as h2 from lc where part = 'train')
select row_id, (z1 - l1) / (h1 - l1) as z1, (z2 - l2) / (h2 - l2) as z2, 0.0::double as flat from lc, s""")
def _(spark, d):
    lc = b.made_cohort(spark, d).select("row_id", "z1", "z2", F.lit(5.0).alias("flat"), "part")
    return scaling.minmax_scale(lc, lc.filter("part = 'train'"), ["z1", "z2", "flat"]).drop("part")


@register("standard_scale", f"""
, s as (select avg(z1) as m1, stddev_pop(z1) as d1, avg(z2) as m2, stddev_pop(z2) as d2 from lc where part = 'train')
select row_id, {r_sql('(z1 - m1) / d1', 'z1')}, {r_sql('(z2 - m2) / d2', 'z2')}, 0.0::double as flat from lc, s""")
def _(spark, d):
    lc = b.made_cohort(spark, d).select("row_id", "z1", "z2", F.lit(5.0).alias("flat"), "part")
    return rnd(scaling.standard_scale(lc, lc.filter("part = 'train'"), ["z1", "z2", "flat"]).drop("part"), "z1", "z2")


_pw = " union all ".join(f"select row_id, b * 4 + {i} as replicate, {poisson_sql(f'substr(h, {1 + 8 * i}, 8)')} as w from h" for i in range(4))


@register("bootstrap_resample", f"""
, h as (select row_id, b::int as b, md5('42|' || b || '|' || row_id) as h from oc, range(3) t(b)),
w as ({_pw}) select row_id, replicate, w from w where w > 0 and replicate < 10""")
def _(spark, d):
    return sampling.bootstrap_weights(b.orders_cohort(spark, d), 10)
