"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's bound on the bytes of an Arrow batch, its default, and the bound that holds instead.
BATCH_SETTING, WIDE_BATCHES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 2 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def crc(c: Column) -> Column:
    """crc32 of a value written as text; null counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops input columns that an operator is about to write, in any case of letters."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def set_aside(df: DataFrame, *names: str) -> DataFrame:
    """df with its columns of these names, in any case of letters, under other names: see put_back."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`").alias(f"__own_{c}" if c.lower() in taken else c) for c in df.columns])


def put_back(df: DataFrame, columns: list[str], *names: str) -> DataFrame:
    """The columns that df had before set_aside, and no others."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`__own_{c}`").alias(c) if c.lower() in taken else F.col(f"`{c}`") for c in columns])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="osteon-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def in_batches(df: DataFrame, work, schema) -> DataFrame:
    """mapInArrow with batches of bounded bytes; a bound that the session already has stays."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING) == WIDE_BATCHES:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(work, schema)


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads it back."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage and keeps the partitions as they are, which a table on disk would not."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
