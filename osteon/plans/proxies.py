"""The engine's tables, derived from the tables that the queries are run on.

Dense volumes are 4x4x4 cubes of `embeddings`; sparse ones come from `lineitem`; subjects from `customer`,
edits from `orders`, job and access events from `events`, points and landmarks from `embeddings`.
Each table has the SQL that yields the same rows, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = ("elastic", "mask", "crop", "smooth", "aligned")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_id, z, y, x, v (0 to 255) and cohort of 4x4x4 volumes."""
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("scan_id"), F.col("label").cast("long").alias("cohort"), F.posexplode("embedding").alias("i", "e"))
    v = F.least(F.greatest(F.rint((F.col("e").cast("double") + 1) * 127.5), F.lit(0.0)), F.lit(255.0)).cast("int")
    return cells.select("scan_id", "cohort", F.floor(F.col("i") / 16).cast("int").alias("z"), (F.floor(F.col("i") / 4) % 4).cast("int").alias("y"), (F.col("i") % 4).cast("int").alias("x"), v.alias("v"))


def sparse_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_id, z, y, x, v (a double) of thinly filled volumes."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("scan_id"), F.col("l_linenumber").cast("int").alias("z"), (F.col("l_partkey") % 32).cast("int").alias("y"), (F.col("l_orderkey") % 32).cast("int").alias("x")).agg(F.avg("l_quantity").alias("v"))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_id, name, faulty, flag, linked_to, is_mesh, voxelized, voxel_size, threshold, elastic_to, dims."""
    c = table(spark, sf_dir, "customer")
    member = F.col("c_custkey") % 10 == 0
    main = F.min(F.when(member, F.col("c_custkey"))).over(W.partitionBy("c_nationkey"))
    return c.select(
        F.col("c_custkey").alias("scan_id"), F.col("c_name").alias("name"), (F.col("c_acctbal") < 0).alias("faulty"), (F.col("c_mktsegment") == "BUILDING").alias("flag"),
        F.when(member, main).alias("linked_to"), (F.col("c_custkey") % 7 == 0).alias("is_mesh"), (F.col("c_custkey") % 14 == 0).alias("voxelized"),
        (0.01 + (F.col("c_custkey") % 5) * 0.005).alias("voxel_size"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_custkey") % 200).cast("int").alias("threshold"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("atlas")).alias("elastic_to"), (F.col("c_custkey") % 2 + 4).cast("int").alias("dim"),
    )


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_id, edit_number, kind, has_mask of each subject's chain of edits."""
    o = table(spark, sf_dir, "orders")
    number = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.substring("o_orderpriority", 1, 1).cast("int"))
    return o.select(F.col("o_custkey").alias("scan_id"), number.cast("int").alias("edit_number"), kind.alias("kind"), (F.col("o_orderkey") % 4 == 0).alias("has_mask"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event (start or end), id, ts, tool, status, progress: every event starts a job; those of value over 10 end it."""
    e = table(spark, sf_dir, "events").withColumn("value", F.coalesce("value", F.lit(0.0)))
    start = e.select(F.lit("start").alias("event"), F.col("event_id").cast("string").alias("id"), F.col("ts"), F.col("event_type").alias("tool"), F.lit(None).cast("string").alias("status"), "user_id")
    end = e.where("value > 10").select(F.lit("end").alias("event"), F.col("event_id").cast("string").alias("id"), F.expr("ts + make_dt_interval(0, 0, 0, floor(value))").alias("ts"), F.col("event_type").alias("tool"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"), "user_id")
    return start.unionByName(end)


def points(spark: SparkSession, sf_dir: str, scale: float = 10.0) -> DataFrame:
    """id, cohort, x, y, z: the first three components of each vector."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda k: (F.col("embedding")[k].cast("double") * scale)
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("cohort"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


#: The same tables in SQL.
SQL = {
    "dense": """dense AS (SELECT scan_id, cohort, (i // 16)::INT AS z, (i // 4 % 4)::INT AS y, (i % 4)::INT AS x,
        least(greatest(round_even((e::DOUBLE + 1) * 127.5, 0), 0), 255)::INT AS v
        FROM (SELECT vec_id AS scan_id, label::BIGINT AS cohort, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS e FROM embeddings))""",
    "sparse": """sparse AS (SELECT l_suppkey AS scan_id, l_linenumber::INT AS z, (l_partkey % 32)::INT AS y, (l_orderkey % 32)::INT AS x,
        avg(l_quantity) AS v FROM lineitem GROUP BY ALL)""",
    "scans": """scans AS (SELECT c_custkey AS scan_id, c_name AS name, c_acctbal < 0 AS faulty, c_mktsegment = 'BUILDING' AS flag,
        CASE WHEN c_custkey % 10 = 0 THEN min(CASE WHEN c_custkey % 10 = 0 THEN c_custkey END) OVER (PARTITION BY c_nationkey) END AS linked_to,
        c_custkey % 7 = 0 AS is_mesh, c_custkey % 14 = 0 AS voxelized, 0.01::DOUBLE + (c_custkey % 5) * 0.005::DOUBLE AS voxel_size,
        CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 200 END::INT AS threshold, CASE WHEN c_custkey % 3 = 0 THEN 'atlas' END AS elastic_to,
        (c_custkey % 2 + 4)::INT AS dim FROM customer)""",
    "edits": """edits AS (SELECT o_custkey AS scan_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1)::INT AS edit_number,
        ['elastic', 'mask', 'crop', 'smooth', 'aligned'][substr(o_orderpriority, 1, 1)::INT] AS kind, o_orderkey % 4 = 0 AS has_mask FROM orders)""",
    "job_events": """job_events AS (
        SELECT 'start' AS event, event_id::VARCHAR AS id, ts, event_type AS tool, NULL::VARCHAR AS status, user_id FROM events
        UNION ALL SELECT 'end', event_id::VARCHAR, ts + to_seconds(floor(value)::BIGINT), event_type, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END, user_id
        FROM events WHERE coalesce(value, 0) > 10)""",
    "points": """points AS (SELECT vec_id AS id, label::BIGINT AS cohort, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z FROM embeddings)""",
}


def with_tables(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
