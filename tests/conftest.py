"""One local session for all tests, and DuckDB over the same tables."""

from __future__ import annotations

import os
import sys
import tempfile

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    s = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", scratch).config("spark.checkpoint.dir", f"{scratch}/checkpoints").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows_of(frame):
    """Rows of a pandas frame as sorted tuples, columns by name and numbers rounded."""
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        if isinstance(v, str) or hasattr(v, "isoformat"):
            return str(v)
        try:
            return round(float(v), 6) + 0.0
        except (TypeError, ValueError):
            return str(v)

    cols = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in r) for r in frame[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def agree(spark, sf_dir, duck):
    def check(query, sql):
        mine, other = query(spark, sf_dir).toPandas(), duck.execute(sql).df()
        assert sorted(mine.columns) == sorted(other.columns)
        assert rows_of(mine) == rows_of(other)

    return check
