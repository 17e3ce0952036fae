"""Every registered query with an oracle equals DuckDB's answer, exactly."""

from __future__ import annotations

import pytest
from compare import compare, duck
from conftest import FOLDER

from gradelake.plans.registry import oracle_queries, spark_queries


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(oracle_queries()))
def test_matches_oracle(spark, con, name):
    problems, _ = compare(spark, con, FOLDER, spark_queries()[name], oracle_queries()[name])
    assert not problems


def test_entry_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["level", "invariant", "doc_id", "n", "pct", "passes"]
    assert df.filter("level = 'overall'").count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
