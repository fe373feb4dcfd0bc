"""Mixing sources to target weights.

Each source gets a share of a token budget in proportion to its weight, but no more than `most` times
its own tokens; what a capped source leaves over goes to the others by weight. A document of a source
with repetition rate r is emitted floor(r) times, and once more if a hash of its content, read as a
number from 0 to 1, is below the fraction of r. Nothing is random, so reruns agree.

Null texts have size 0; null sources are one source, ordered last; repeated rows take the same decision;
input columns named as the added ones are replaced. A source without tokens gets target 0 and rate 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import put_back, read, set_aside, without

WEIGHTS, BUDGET, MOST, SEED = (3, 1, 2), 1.5, 2.0, "mix-1"
#: Sources that are broadcast to the documents; more of them are joined by a shuffle.
BROADCAST_SOURCES = 100_000
TOKEN = r"[^\x20\x09-\x0D]+"
ADDED = ("size", "source_size", "target", "rate", "copies")


def source_targets(docs: DataFrame, weights=WEIGHTS, budget=BUDGET, most=MOST) -> DataFrame:
    """One row per source: source, source_size, weight, target. docs has source and size.

    Filling up to the caps is one running sum: sources in order of cap per weight are capped as long
    as the level that would share the rest evenly reaches their cap.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))
    sized = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(most))
    filled = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    total = F.sum("source_size").over(everything) * float(budget)
    capped_before = F.coalesce(F.sum("cap").over(filled.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(filled.rowsBetween(W.currentRow, W.unboundedFollowing))
    level = (total - capped_before) / weight_left
    at = F.row_number().over(filled)
    leveled = sized.select("*", level.alias("level"), at.alias("at"), (level * F.col("weight") <= F.col("cap")).alias("fits"))
    ends = leveled.select("*", F.min(F.when(F.col("fits"), F.col("at"))).over(everything).alias("end"))
    shared = F.max(F.when(F.col("at") == F.col("end"), F.col("level"))).over(everything)
    capped = F.col("end").isNull() | (F.col("at") < F.col("end"))
    return ends.select("source", "source_size", "weight", F.when(capped, F.col("cap")).otherwise(shared * F.col("weight")).alias("target"))


def unit_hash(seed: str, *columns: Column) -> Column:
    """A number from 0 to 1 of 52 bits of md5, the same in any engine."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mixing_plan(docs: DataFrame, weights=WEIGHTS, budget=BUDGET, most=MOST, seed=SEED) -> DataFrame:
    """docs with size, source_size, target, rate and copies: how often the mix takes each."""
    count = F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long")
    base = without(docs, *ADDED)
    sizes = docs.select("source", count.alias("size"))
    targets = source_targets(sizes, weights, budget, most)
    targets = targets.select(F.col("source").alias("__source"), "source_size", "target")
    if docs.select("source").distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    joined = base.withColumn("size", count).join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    draw = unit_hash(seed, F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    whole = F.floor("rate")
    return joined.withColumn("rate", rate).withColumn("copies", (whole + (draw < F.col("rate") - whole).cast("long")).cast("long"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as the plan says, with its columns only."""
    planned = mixing_plan(set_aside(docs, *ADDED), **options)
    emitted = planned.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return put_back(emitted, docs.columns, *ADDED)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing_plan(read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(text, '')) AS m FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM per),
fill AS (
  SELECT 0 AS step, NULL::DOUBLE AS was, (SELECT 1.5::DOUBLE * sum(source_size) / sum(weight) FROM ranked) AS level
  UNION ALL
  SELECT step + 1, level,
         (SELECT (1.5::DOUBLE * sum(source_size) - sum(CASE WHEN f.level * weight > cap THEN cap ELSE 0 END))
                 / nullif(sum(CASE WHEN f.level * weight > cap THEN 0 ELSE weight END), 0) FROM ranked)
  FROM fill f WHERE step < 1000 AND level IS NOT NULL AND (was IS NULL OR level > was)),
lev AS (SELECT arg_max(level, step) AS level FROM fill WHERE level IS NOT NULL),
targets AS (SELECT source, source_size, least(cap, level * weight) AS target FROM ranked, lev),
drawn AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || m), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + (draw < rate - floor(rate))::INT))::BIGINT AS taken,
       (floor(rate) + (draw < rate - floor(rate))::INT)::BIGINT AS copies
FROM drawn
"""
