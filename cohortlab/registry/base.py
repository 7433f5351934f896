"""Registration of queries with their DuckDB counterparts, and the tables they share.

The given labels carry no signal, so targets, predictions and scores are derived from the tables by
the same md5 expressions on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..explain.shap import linear_contributions, shap_linear
from ..sources.tables import read_cohort

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODELS = ["LogR", "LDA", "RF", "KNN", "NB"]
STATUS = {"F": 0, "O": 1, "P": 2}
PRIORITY = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3, "5-LOW": 4}
SEGMENT = {"AUTOMOBILE": 0, "BUILDING": 1, "FURNITURE": 2, "HOUSEHOLD": 3, "MACHINERY": 4}
SHAP_FEATURES = ["price", "balance", "priority", "segment"]
SHAP_COEF = [[0.8, -0.5, 0.1, 0.05], [-0.3, 0.7, -0.2, 0.1], [-0.5, -0.2, 0.1, -0.15]]
SHAP_INTERCEPT = [0.1, -0.2, 0.3]
DIMS = 64


def hk_sql(seed: str, *ids: str) -> str:
    key = " || '|' || ".join(ids)
    return f"('0x'||substr(md5('{seed}|' || {key}),1,13))::bigint"


def u_sql(seed: str, *ids: str) -> str:
    return f"({hk_sql(seed, *ids)} / 4503599627370496.0::double)"


def slice_sql(k: int) -> str:
    """Uniform from eight hex digits of the digest ``h``."""
    return f"(('0x'||substr(h, {1 + 8 * k}, 8))::bigint / 4294967296.0::double)"


def case_sql(col: str, mapping: dict) -> str:
    return f"case {col} " + " ".join(f"when '{k}' then {v}" for k, v in mapping.items()) + " end"


_values = ", ".join(f"('{m}')" for m in MODELS)
_shap_rows = []
for _c, _w in enumerate(SHAP_COEF):
    _base = " + ".join([f"{SHAP_INTERCEPT[_c]}::double"] + [f"{w}::double * m_{f}" for f, w in zip(SHAP_FEATURES, _w)])
    for _f, _wj in zip(SHAP_FEATURES, _w):
        _shap_rows.append(
            f"select row_id, label, {_c} as class, '{_f}' as feature, {_f} as feature_value, "
            f"{_wj}::double * ({_f} - m_{_f}) as phi, {_base} as base from sf, sm"
        )

CTES = f"""with recursive
oc as (select o_orderkey as row_id, o_orderstatus as status, o_orderpriority as priority_text,
  c_mktsegment as segment_text, o_totalprice as price, c_acctbal as balance,
  {case_sql('o_orderstatus', STATUS)} as label
  from orders join customer on o_custkey = c_custkey),
lc0 as (select row_id, status, price / 500000.0::double as z1, (balance + 1000) / 11000.0::double as z2,
  {u_sql('noise', 'row_id')} as u from oc),
lc as (select row_id, status, z1, z2, 3 * z1 - 2 * z2 + u as y,
  (2 * z1 - z2 + 0.3::double * u > 0.65::double)::int as label2,
  case when 2 * z1 - z2 + 0.3::double * u < 0.3::double then 0 when 2 * z1 - z2 + 0.3::double * u < 1.0::double then 1 else 2 end as label3,
  case when {hk_sql('part', 'row_id')} % 5 = 0 then 'test' else 'train' end as part from lc0),
models as (select * from (values {_values}) t(model)),
lh as (select row_id, label, model, md5('p|' || model || '|' || row_id) as h from oc cross join models),
lp as (select row_id, model, label, ({hk_sql('fold', 'row_id')} % 5)::int as fold,
  case when {slice_sql(3)} < (5 + length(model)) / 10.0::double then label else (label + 1) % 3 end as prediction,
  {slice_sql(0)} as a, {slice_sql(1)} as b, {slice_sql(2)} as c from lh),
pp as (select row_id, model, label, fold, prediction,
  [(a + (label = 0)::int) / (a + b + c + 1), (b + (label = 1)::int) / (a + b + c + 1), (c + (label = 2)::int) / (a + b + c + 1)] as probability from lp),
bs as (select row_id, model, fold, (label = 2)::int as label, round(({u_sql('s', 'model', 'row_id')} + (label = 2)::int * 0.5::double) / 1.5::double, 3) as score from lp),
ep as (select event_id as row_id, model, ({hk_sql('fold', 'event_id')} % 5)::int as fold, value as label,
  value * (0.8::double + 0.1::double * length(model) * {u_sql('e', 'model', 'event_id')}) as prediction from events cross join models),
et as (select event_id as row_id, event_type, value,
  case when event_id % 7 = 0 then null when event_id % 11 = 0 then 0 else value - 50 end as target from events),
em as (select vec_id as row_id, embedding::double[] as v, label from embeddings),
sf as (select row_id, label, price / 100000.0::double as price, balance / 1000.0::double as balance,
  ({case_sql('priority_text', PRIORITY)})::double as priority, ({case_sql('segment_text', SEGMENT)})::double as segment from oc),
sm as (select {', '.join(f'avg({f}) as m_{f}' for f in SHAP_FEATURES)} from sf),
sl as ({' union all '.join(_shap_rows)})
"""


def sql(body: str) -> str:
    """The shared tables followed by ``body`` (a select, or more tables starting with a comma)."""
    return CTES + body


def register(name: str, oracle: str | None = None, raw: bool = False):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle if raw else sql(oracle)
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_cohort(spark, d, name)


def _map(col: str, mapping: dict) -> str:
    entries = ", ".join(f"'{k}', {v}" for k, v in mapping.items())
    return f"map({entries})[{col}]"


def _hk(seed: str, *ids: str) -> str:
    """SQL text of ``hash_key``."""
    return f"CAST(conv(substring(md5(concat_ws('|', '{seed}', {', '.join(f'CAST({i} AS STRING)' for i in ids)})), 1, 13), 16, 10) AS BIGINT)"


def _u(seed: str, *ids: str) -> str:
    """SQL text of ``hash_uniform``."""
    return f"({_hk(seed, *ids)} / 4503599627370496D)"


def orders_cohort(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").selectExpr(
        "o_orderkey AS row_id", "o_custkey", "o_orderstatus AS status", "o_orderpriority AS priority_text", "o_totalprice AS price"
    )
    c = table(spark, d, "customer").selectExpr("c_custkey AS o_custkey", "c_mktsegment AS segment_text", "c_acctbal AS balance")
    return o.join(c, "o_custkey").selectExpr(
        "row_id", "status", "priority_text", "segment_text", "price", "balance", f"{_map('status', STATUS)} AS label"
    )


def made_cohort(spark: SparkSession, d: str) -> DataFrame:
    """Two features with a known effect on two class labels and a numeric target."""
    base = orders_cohort(spark, d).selectExpr(
        "row_id", "status", "price / 500000D AS z1", "(balance + 1000) / 11000D AS z2", f"{_u('noise', 'row_id')} AS u"
    )
    s = "(2 * z1 - z2 + 0.3D * u)"
    return base.selectExpr(
        "row_id", "status", "z1", "z2", "3 * z1 - 2 * z2 + u AS y", f"CAST({s} > 0.65D AS INT) AS label2",
        f"CASE WHEN {s} < 0.3D THEN 0 WHEN {s} < 1D THEN 1 ELSE 2 END AS label3",
        f"IF({_hk('part', 'row_id')} % 5 = 0, 'test', 'train') AS part",
    )


_MODELS = "explode(array(" + ", ".join(f"'{m}'" for m in MODELS) + ")) AS model"


def _slice(k: int) -> str:
    return f"(CAST(conv(substring(h, {1 + 8 * k}, 8), 16, 10) AS BIGINT) / 4294967296D)"


def long_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Class predictions and probabilities of five made-up models on every order."""
    df = orders_cohort(spark, d).selectExpr("row_id", "label", _MODELS, f"CAST({_hk('fold', 'row_id')} % 5 AS INT) AS fold")
    raw = df.selectExpr("*", "md5(concat_ws('|', 'p', model, CAST(row_id AS STRING))) AS h")
    raw = raw.selectExpr("*", *[f"{_slice(k)} AS q{k}" for k in range(4)])
    share = ", ".join(f"(q{k} + CAST(label = {k} AS INT)) / (q0 + q1 + q2 + 1)" for k in range(3))
    return raw.selectExpr(
        "row_id", "model", "label", "fold",
        "IF(q3 < (5 + length(model)) / 10D, label, (label + 1) % 3) AS prediction",
        f"array({share}) AS probability",
    )


def binary_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores with many ties for the last class against the rest."""
    df = orders_cohort(spark, d).selectExpr("row_id", "CAST(label = 2 AS INT) AS label", _MODELS)
    return df.selectExpr(
        "row_id", "model", f"CAST({_hk('fold', 'row_id')} % 5 AS INT) AS fold", "label",
        f"round(({_u('s', 'model', 'row_id')} + label * 0.5D) / 1.5D, 3) AS score",
    )


def event_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Numeric predictions of five made-up models on every event."""
    df = table(spark, d, "events").selectExpr("event_id AS row_id", "value AS label", _MODELS)
    return df.selectExpr(
        "row_id", "model", f"CAST({_hk('fold', 'row_id')} % 5 AS INT) AS fold", "label",
        f"label * (0.8D + 0.1D * length(model) * {_u('e', 'model', 'row_id')}) AS prediction",
    )


def event_targets(spark: SparkSession, d: str) -> DataFrame:
    """A target with NULLs and zeros."""
    return table(spark, d, "events").selectExpr(
        "event_id AS row_id", "event_type", "value",
        "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 0D ELSE value - 50 END AS target",
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"), "label"
    )


def wide_vectors(spark: SparkSession, d: str, dims: int = DIMS) -> DataFrame:
    return vectors(spark, d).selectExpr("row_id", "label", *[f"features[{j}] AS x{j}" for j in range(dims)])


def shap_features(spark: SparkSession, d: str) -> DataFrame:
    return orders_cohort(spark, d).selectExpr(
        "row_id", "label", "price / 100000D AS price", "balance / 1000D AS balance",
        f"CAST({_map('priority_text', PRIORITY)} AS DOUBLE) AS priority", f"CAST({_map('segment_text', SEGMENT)} AS DOUBLE) AS segment",
    )


def shap_arrays(spark: SparkSession, d: str) -> DataFrame:
    return linear_contributions(shap_features(spark, d), SHAP_FEATURES, SHAP_COEF, SHAP_INTERCEPT)


def shap_long(spark: SparkSession, d: str) -> DataFrame:
    df = shap_features(spark, d)
    return shap_linear(df, SHAP_FEATURES, SHAP_COEF, SHAP_INTERCEPT)


def rnd(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round columns for comparison, by plain arithmetic: cheap, and the same in any engine."""
    return df.selectExpr(*[
        f"floor(`{c}` * 1e{digits}D + 0.5D) / 1e{digits}D AS `{c}`" if c in cols else f"`{c}`" for c in df.columns
    ])


def r_sql(expr: str, name: str, digits: int = 6) -> str:
    return f'floor(({expr}) * 1e{digits} + 0.5::double) / 1e{digits} as "{name}"'
