"""Benchmark decontamination as a prefix-filtered set join.

Items become windows of ten consecutive words, an item of fewer words being one window. A window is the
ordered set of its two-word shingles (a lone word is its own). Shingles are ordered by rarity: the number
of documents that hold them, counted over the whole corpus. A document holds a window only if it holds
all of its shingles, so the necessary prefix is one shingle, the rarest. Each place of a prefix shingle in
a document gives the one place where its window could lie; windows that would begin before the text or end
after it are out (position and length bounds), and the rest is verified word by word.

Windows are dealt into blocks of at most `block_windows`; a block's index is what the tasks get, and each
block is one more pass without a shuffle, so any number of items works in bounded memory.

Null and empty texts have no words and no hits. Null item_ids count as one item named ''. Repeated items
count once. Empty tables give no hits. Input columns named as the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, in_batches, put_back, read, set_aside, without
from .words import WORD, hash_of, runs, shingles

WINDOW, BLOCK_WINDOWS = 10, 200_000
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RANGE = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ADDED = [T.StructField("n_words", T.LongType()), T.StructField("hit_ranges", RANGE), T.StructField("items", T.ArrayType(T.StringType()))]


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows as space-joined words, with the items that have them."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(WORDS), F.lit(0))
    split = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("words")).where(F.size("words") > 0)
    first = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    placed = split.withColumn("at", F.explode(first))
    window = F.array_join(F.slice("words", F.col("at"), F.lit(size)), " ")
    return placed.groupBy(window.alias("window")).agg(F.sort_array(F.collect_set("item")).alias("items"))


class Index:
    """A block of windows, and where the rarest shingle of each lies in it."""

    def __init__(self, rows: list) -> None:
        self.words = [tuple(r.window.encode().split(b" ")) for r in rows]
        self.items = [tuple(r["items"]) for r in rows]
        self.grams: dict[int, int] = {}
        self.of = [self.hashes(w) for w in self.words]
        for hashes in self.of:
            for h in hashes:
                self.grams.setdefault(h, len(self.grams))
        self.sorted = np.array(sorted(self.grams), dtype=np.uint64)

    @staticmethod
    def hashes(words: tuple) -> list[int]:
        text = pa.array([b" ".join(words).decode()])
        return [int(x) for x in pair_hashes(next(runs(text, WORD)))[0]] if len(words) > 1 else [hash_of(words[0])]

    def order(self, frequency: dict[int, int]) -> None:
        """Picks each window's rarest shingle, ties by hash."""
        self.places: dict[int, list[tuple[int, int]]] = {}
        for i, hashes in enumerate(self.of):
            at = min(range(len(hashes)), key=lambda k: (frequency.get(hashes[k], 0), hashes[k], k))
            self.places.setdefault(hashes[at], []).append((i, at))
        self.prefix = np.array(sorted(self.places), dtype=np.uint64)
        self.lone = np.array(sorted(h for h, v in self.places.items() if any(len(self.words[i]) == 1 for i, _ in v)), dtype=np.uint64)


def pair_hashes(run) -> tuple[np.ndarray, np.ndarray]:
    return shingles(run, 2)


def found_in(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of values that are among wanted, which is sorted; a table of bits rules out most at once."""
    if not len(wanted) or not len(values):
        return np.zeros(0, np.int64)
    mask = np.uint64((1 << 20) - 1)
    bits = np.zeros(1 << 20, dtype=bool)
    bits[(wanted & mask).astype(np.int64)] = True
    maybe = np.flatnonzero(bits[(values & mask).astype(np.int64)])
    at = np.minimum(np.searchsorted(wanted, values[maybe]), len(wanted) - 1)
    return maybe[wanted[at] == values[maybe]]


def count_shingles(docs: DataFrame, index: Index) -> dict[int, int]:
    """In how many documents each shingle of the block occurs."""
    wanted = index.sorted

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for run in runs(batch.column(0), WORD):
                grams, ptr = pair_hashes(run)
                for values, row in ((grams, np.repeat(np.arange(run.rows), np.diff(ptr))), (run.hash, run.row_of())):
                    at = found_in(values, wanted)
                    pairs = np.unique(row[at].astype(np.int64) * len(wanted) + np.searchsorted(wanted, values[at]))
                    total += np.bincount(pairs % len(wanted), minlength=len(wanted))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    counts = in_batches(docs.select("text"), count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    return {int(wanted[r["at"]]): r.n for r in counts.collect()} if len(wanted) else {}


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def join_run(run, index: Index) -> dict[int, tuple[list, set]]:
    """Verified ranges and items of the rows of a run that have any."""
    grams, gptr = pair_hashes(run)
    out: dict[int, tuple[list, set]] = {}
    for values, ptr, lone in ((grams, gptr, False), (run.hash, run.ptr, True)):
        at = found_in(values, index.lone if lone else index.prefix)
        rows = np.searchsorted(ptr, at, side="right") - 1
        for p, row in zip(at.tolist(), rows.tolist(), strict=True):
            begin, end = int(run.ptr[row]), int(run.ptr[row + 1])
            for i, offset in index.places[int(values[p])]:
                words = index.words[i]
                if (len(words) == 1) != lone:
                    continue
                start = begin + p - int(ptr[row]) - offset
                if start < begin or start + len(words) > end:
                    continue
                if all(run.word(start + k) == w for k, w in enumerate(words)):
                    ranges, items = out.setdefault(row, ([], set()))
                    ranges.append((start - begin, start - begin + len(words)))
                    items.update(index.items[i])
    return out


def find_leaks(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs with n_words, hit_ranges (half-open word ranges inside some window) and items (sorted)."""
    base = without(docs, *[f.name for f in ADDED])
    windows = item_windows(items, size)
    blocks = max(1, -(-windows.count() // block_windows))
    schema = T.StructType([*base.schema.fields, *ADDED])
    out = base.withColumns({f.name: F.lit(None).cast(f.dataType) for f in ADDED})
    for block in range(blocks):
        index = Index(windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).collect())
        index.order(count_shingles(base, index))
        out = in_batches(out, join_with(docs.sparkSession.sparkContext.broadcast(index), schema), schema)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold no window, with their columns only."""
    names = [f.name for f in ADDED]
    clean = find_leaks(set_aside(docs, *names), items, **options).where(F.size("hit_ranges") == 0)
    return put_back(clean, docs.columns, *names)


def join_with(index, schema: T.StructType):
    n = len(schema) - len(ADDED)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, before = batch.schema.get_field_index("text"), batch.columns[n:]
            counts, found = [], {}
            for run in runs(batch.column(text), WORD):
                counts += np.diff(run.ptr).tolist()
                found.update({run.first + k: v for k, v in join_run(run, index.value).items()})
            ranges, names = before[1].to_pylist(), before[2].to_pylist()
            ranges = [[(x["start"], x["end"]) for x in r or []] for r in ranges]
            names = [v or [] for v in names]
            for row, (more, items) in found.items():
                ranges[row], names[row] = merge(ranges[row] + more), sorted(items.union(names[row]))
            made = [pa.array(counts, before[0].type), pa.array([[{"start": a, "end": b} for a, b in r] for r in ranges], before[1].type), pa.array(names, before[2].type)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], schema=batch.schema)

    return join


def hit_words():
    return F.aggregate("hit_ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return leaks.select("doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.size("hit_ranges") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
hits AS (SELECT rid, item_id, i, p.n FROM places p JOIN wins USING (n, win)),
words AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM hits) GROUP BY rid),
ids AS (
  SELECT rid, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN ids USING (rid)
"""
