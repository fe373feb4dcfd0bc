"""A corpus pipeline of five stages, each a call of one operator of osteon.llm.

Language identification drops documents whose language it can't tell; of each group of near-duplicates one
document stays; documents that hold a benchmark window are dropped; sources are mixed to their target weights;
and the mix is dealt into shuffled shards. Every stage but the last returns the columns of documents.

Texts that are null, empty or without a letter have no language, so the first stage drops them. Of rows of one
component the one of the lowest doc_id stays, null last; rows without words stay all. Stages go by rows, so rows that
repeat a doc_id with another text are documents of their own. A null source is a source. Texts are read whole.
Further columns pass through the first four stages; the last one replaces shard and slot. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from osteon.llm import decontaminate, jaccard_join, langid, mixing, sharding
from osteon.llm.common import read, written

#: A document stays if its language's mean probability is at least this.
SURE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs, F.lit(True))
    found = langid.identify(docs, model, ("__lang", "__sure"))
    return found.where((F.col("__lang") != "und") & (F.col("__sure") >= SURE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("sharding", shard),
]

#: Language identification is a trained model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
