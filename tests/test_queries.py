"""Every registered query of the engine runs; those with SQL give the same rows as DuckDB."""

from __future__ import annotations

import pytest

import __spark_entry__
from osteon import queries as base

QUERIES, SQL = base.queries(), base.oracle_sql()
SLOW = {"a5_estimate_background", "i7_icp_batch", "w21_nlm_denoise", "w18_interest_points", "w5_gaussian_smooth"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(agree, name):
    agree(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert len(df.columns) == len({c.lower() for c in df.columns})
    df.limit(5).collect()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES)
