"""Feature scaling with statistics of the training part only.

The statistics are one struct from a scalar subquery: one aggregation over the training rows, and a
projection over the rest, without a join. The struct is bound to a column once: every mention of a
subquery would be planned by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def _apply(df: DataFrame, train: DataFrame, stats: list[str], new: dict[str, str]) -> DataFrame:
    """Bind the aggregates of ``train`` as the struct ``_s`` and replace the named columns."""
    bound = df.withColumn("_s", train.selectExpr(f"struct({', '.join(stats)}) AS s").scalar())
    return bound.selectExpr(*[f"{new[c]} AS `{c}`" if c in new else f"`{c}`" for c in df.columns])


def minmax_scale(df: DataFrame, train: DataFrame, cols: list[str]) -> DataFrame:
    """(x - min) / (max - min) with the training range; a constant column gives 0."""
    stats, new = [], {}
    for i, c in enumerate(cols):
        stats += [f"min(`{c}`) AS lo_{i}", f"max(`{c}`) AS hi_{i}"]
        span = f"if(_s.hi_{i} = _s.lo_{i}, 1D, _s.hi_{i} - _s.lo_{i})"
        new[c] = f"(`{c}` - _s.lo_{i}) / {span}"
    return _apply(df, train, stats, new)


def standard_scale(df: DataFrame, train: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / population std of the training part; zero std divides by 1."""
    stats, new = [], {}
    for i, c in enumerate(cols):
        stats += [f"avg(`{c}`) AS mu_{i}", f"stddev_pop(`{c}`) AS sd_{i}"]
        new[c] = f"(`{c}` - _s.mu_{i}) / if(_s.sd_{i} = 0, 1D, _s.sd_{i})"
    return _apply(df, train, stats, new)
