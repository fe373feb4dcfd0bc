"""Cutting the lineage of iterative operators with tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Written tables of more rows are never sent to all tasks: Spark would judge them by the size of their compressed files.
MOST_BROADCAST = 20_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; where none is set, a local session takes a temporary folder and a cluster's is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="osteon-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back; what is joined with over MOST_BROADCAST rows of it is sorted and merged, not broadcast."""
    spark = df.sparkSession
    path = shared_path(spark, "table")
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out if seen.get.get("rows", MOST_BROADCAST + 1) <= MOST_BROADCAST else out.hint("merge")
