"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import pytest

from quillspan.plans.catalog import ORACLES, QUERIES
from tests.oracle import mismatch


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert mismatch(spark, sf_dir, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)
