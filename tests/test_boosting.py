import os

import pytest
from pyspark.sql import Observation

from cohortlab.learners import trees


@pytest.mark.parametrize("sums, again", [(trees.samme_sums, lambda df, s: trees.samme_round(df, 3, 0.5, sums=s)), (trees.r2_sums, lambda df, s: trees.r2_round(df, 0.5, sums=s))])
def test_sums_of_a_round_are_taken_while_its_table_is_written(spark, sums, again):
    rows = [(float(i % 3), float(i % 3 if i % 4 else (i + 1) % 3), 0.5 + i % 7) for i in range(200)] + [(None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "label double, prediction double, weight double").repartition(5)
    with trees.RoundTable(spark) as table:
        watch = Observation()
        kept, seen = table.write(df.observe(watch, *sums())), watch.get
        want = df.agg(*sums()).first().asDict()
        assert seen == pytest.approx(want, rel=1e-12)
        first, err, factor = again(kept, seen)
        second, err_again, factor_again = again(kept, None)
        assert (err, factor) == pytest.approx((err_again, factor_again), rel=1e-12)
        key = lambda r: (str(r["label"]), r["prediction"], r["weight"] or 0)
        for a, b in zip(sorted(first.collect(), key=key), sorted(second.collect(), key=key), strict=True):
            assert (a["weight"] or 0) == pytest.approx(b["weight"] or 0, rel=1e-9)
        path = table.path
        table.write(df)
        assert not os.path.exists(path)
