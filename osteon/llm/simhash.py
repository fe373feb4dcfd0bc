"""SimHash fingerprints, and all pairs of them within a Hamming radius by permuted block tables.

A text's terms are its words and its pairs of adjacent words (split at white space, A-Z lower-cased).
A word weighs the root of its count, a pair twice that, so that frequent function words do not decide.
Each term's 64-bit hash votes with its weight: for a bit that is set, against one that is not; the bits
with positive votes are the fingerprint. Likeness is the cosine that the share of equal bits estimates, at
least 0. Two texts without terms have fingerprint 0 and likeness 1.

`near_pairs` cuts fingerprints into `blocks` blocks; within radius r some blocks - r of them are equal, so
a table for each choice of blocks - r blocks, keyed by those, finds every pair. Equal fingerprints are one
class, joined through one representative.

`search` answers queries with the same tables: which classes lie within the radius of each query's fingerprint. The
query takes as queries every row whose doc_id is divisible by 50, against all rows.

Null texts count as empty; equal texts have equal fingerprints; rows with equal doc_id are ordered by
text; null doc_ids come last. Empty tables give empty results. Input columns named as added ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, partitions, read, without, written
from .words import STEPS, Run, mix, runs

BITS, RADIUS, BLOCKS, QUERY_EVERY = 64, 3, 6, 50
#: Keys of queries that are broadcast to those of the classes; more of them are joined by a shuffle.
BROADCAST_KEYS = 500_000
PAIR_WEIGHT = 2.0
WAVE = 1 << 18


def votes(run: Run) -> np.ndarray:
    """Signed sums of each row's weighted terms, by bit."""
    count = np.diff(run.ptr)
    row = run.row_of()
    same = np.flatnonzero(row[1:] == row[:-1])
    pairs = mix(run.hash[same] * STEPS[0] + run.hash[same + 1] * STEPS[1] + STEPS[2]) if len(same) else np.zeros(0, np.uint64)
    out = np.zeros((run.rows, BITS), np.float32)
    for hashes, rows, weight in ((run.hash, row, 1.0), (pairs, row[same], PAIR_WEIGHT)):
        ends = np.searchsorted(rows, np.arange(run.rows + 1))
        for lo_row, hi_row in waves(ends):
            lo, hi = ends[lo_row], ends[hi_row]
            own, of = hashes[lo:hi], rows[lo:hi]
            order = np.lexsort((own, of))
            own, of = own[order], of[order]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (of[1:] != of[:-1])
            at = np.flatnonzero(new)
            if not len(at):
                continue
            times = np.diff(np.append(at, len(own)))
            signs = np.unpackbits(own[at].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            signs = (2 * signs - 1) * (weight * np.sqrt(times)).astype(np.float32)[:, None]
            first = np.flatnonzero(np.append(True, of[at][1:] != of[at][:-1]))
            out[of[at][first]] += np.add.reduceat(signs, first, axis=0)
    out[count == 0] = 0
    return out


def waves(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of about WAVE terms."""
    lo, n = 0, len(ends) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(ends, ends[lo] + WAVE, side="right")) - 1))
        yield lo, hi
        lo = hi


def fingerprints(texts: pa.Array) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit numbers."""
    out = np.zeros(len(texts), np.uint64)
    for run in runs(texts):
        bits = np.packbits(votes(run) > 0, axis=1)
        out[run.first : run.first + run.rows] = np.ascontiguousarray(bits).view("<u8").reshape(-1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    apart = np.bitwise_count(a ^ b).astype(np.float64)
    return np.maximum(np.cos(np.pi * apart / BITS), 0.0)


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """docs with fingerprint, as a signed long."""
    base = without(docs, "fingerprint")
    schema = T.StructType([*base.schema.fields, T.StructField("fingerprint", T.LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = fingerprints(batch.column(batch.schema.get_field_index("text"))).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(f)], names=schema.names)

    return in_batches(base, add, schema)


def classes_of(prints: DataFrame) -> DataFrame:
    """fingerprint, doc_id of its lowest row, and rows of each class of equal fingerprints."""
    return prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"))


def in_tables(classes: DataFrame, radius: int, blocks: int) -> DataFrame:
    """table, key and fingerprint: each class once in every permuted table."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    tables = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(masks[i] for i in chosen)
        tables.append(F.struct(F.lit(k).alias("table"), F.col("fingerprint").bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask)).alias("key")))
    return classes.select("fingerprint", F.explode(F.array(*tables)).alias("t")).select("t.table", "t.key", "fingerprint")


def search(queries: DataFrame, classes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """query, near and distance: the classes whose fingerprint is at most radius bits from the query's, itself included."""
    asked = written(in_tables(queries.select("fingerprint").distinct(), radius, blocks).withColumnRenamed("fingerprint", "query"))
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_KEYS else asked
    apart = F.bit_count(F.col("query").bitwiseXOR(F.col("fingerprint")))
    found = in_tables(classes, radius, blocks).join(asked, ["table", "key"]).where(apart <= radius)
    return found.select("query", F.col("fingerprint").alias("near"), apart.alias("distance")).distinct()


def near_pairs(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> tuple[DataFrame, DataFrame]:
    """Classes, and pairs a < b of classes at most radius bits apart."""
    classes = classes_of(prints)
    keyed = in_tables(classes, radius, blocks)
    other = keyed.withColumnRenamed("fingerprint", "b")
    found = keyed.withColumnRenamed("fingerprint", "a").join(other, ["table", "key"]).where("a < b")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return classes, found.select("a", "b", apart.alias("distance")).where(F.col("distance") <= radius).distinct()


def halves(text: str, following: str) -> str:
    """text, its last half replaced by the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id and text dealt into ranges of doc_id; the first row of a range is also the last of the one before.

    Bounds are quantiles of doc_id; sent says that a row is the one lent by the next range.
    """
    ids = docs.where("doc_id IS NOT NULL").select("doc_id")
    bounds = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else None
    bounds = sorted(set(bounds or []))
    array = F.array(*[F.lit(int(b)) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    part = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(F.size(F.filter(array, lambda b: b < F.col("doc_id"))))
    firsts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), part.alias("part")).groupBy("part").agg(F.min(F.struct("doc_id", "h")).alias("first")).orderBy("part").collect()
    lent = [(r["first"]["doc_id"], r["first"]["h"], firsts[(i - 1) % len(firsts)]["part"], i == 0) for i, r in enumerate(firsts)]
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).withColumn("part", part)
    borders = docs.sparkSession.createDataFrame(lent, "id long, hash long, to_part int, wraps boolean")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("hash"))
    lent_rows = rows.join(F.broadcast(borders), same).dropDuplicates(["to_part"]).select("doc_id", "text", "h", F.col("to_part").alias("part"), F.lit(True).alias("sent"))
    return rows.withColumn("sent", F.lit(False)).unionByName(lent_rows)


QUERY = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row of a part but the lent one: fingerprints of it and of its edited text, and likenesses."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        held = table.slice(table.num_rows - 1)
        yield from compared(table)


def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
    for at in range(0, table.num_rows - 1, 1000):
        ids, texts, parts, sent = (table.column(k).slice(at, 1001).to_pylist() for k in ("doc_id", "text", "part", "sent"))
        texts = [t or "" for t in texts]
        edited = [halves(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        own = fingerprints(pa.array(texts, pa.large_string()))
        new = fingerprints(pa.array(edited, pa.large_string()))
        keep = [i for i in range(len(edited)) if not sent[i] and parts[i] == parts[i + 1]]
        near, then = likeness(own[:-1], new), likeness(own[:-1], own[1:])
        yield pa.RecordBatch.from_arrays([
            pa.array([ids[i] for i in keep], pa.int64()), pa.array([len(texts[i]) for i in keep], pa.int64()),
            pa.array([hashlib.sha256(edited[i].encode()).hexdigest() for i in keep], pa.string()),
            pa.array([f"{int(own[i]):016x}" for i in keep], pa.string()), pa.array([f"{int(new[i]):016x}" for i in keep], pa.string()),
            pa.array(near[keep], pa.float64()), pa.array(then[keep], pa.float64()),
        ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = partitions(spark)
    dealt = in_order(read(spark, sf_dir, "documents").select("doc_id", "text"), parts).repartition(parts, "part")
    ordered = dealt.sortWithinPartitions("part", "sent", F.col("doc_id").asc_nulls_last(), "h", "text")
    rows = written(in_batches(ordered.select("doc_id", "text", "part", "sent"), compare_next, QUERY))
    asks = F.coalesce(F.col("doc_id") % QUERY_EVERY == 0, F.lit(False))
    number = F.conv("fingerprint", 16, -10).cast("long")  # of 64 bits, signed
    prints = rows.select("doc_id", number.alias("fingerprint"), asks.alias("asks"))
    classes = classes_of(prints)
    found = search(prints.where("asks"), classes).join(classes.select(F.col("fingerprint").alias("near"), "rows"), "near")
    counts = found.groupBy("query").agg((F.sum("rows") - 1).alias("near_rows"), F.count("*").alias("near_classes"))
    asking = rows.where(asks).withColumn("query", number).join(counts, "query", "left").drop("query")
    return asking.unionByName(rows.where(~asks), allowMissingColumns=True)
