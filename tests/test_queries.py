"""Every registered query that has a SQL counterpart must give the same rows (smallest data)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from compare import compare, connect  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402


@pytest.fixture(scope="module")
def con(data_dir):
    return connect(data_dir)


@pytest.mark.parametrize("name", [n for n in queries() if n in oracle_sql()])
def test_against_sql(spark, con, data_dir, name):
    result = compare(queries()[name](spark, data_dir), con, oracle_sql()[name])
    assert result.startswith("ok"), result


def test_entry(spark):
    assert entry(spark).count() == 1
