"""N-gram Jaccard join with set-relation skipping: exact components of documents at Jaccard >= 0.9.

A document's set is its distinct 3-word shingles (64-bit hashes). Equal sets are one set from the start.
Shingles are ordered by a frequency sketch of the whole corpus (2^20 cells, so its size is fixed) and then
by hash; linked sets share a shingle among the first n - ceil(0.9 n) + 1 of each, their prefixes, and only
those are indexed. An index list is divided into blocks of sizes: a set looks into the blocks that its
size lets it match, and a pair is skipped when the positions of the shared shingle leave too little behind it.

Relations between sets spare the rest. In each round a set is compared with a few others only, drawn from its
index lists by hashes of the round; a set that is linked to one of them takes over its answers, that is, its
component, and no pair inside a component is compared any more, nor a list that holds one component only. Rounds take
partners that share many shingles of the prefix, more of them in the second round. Then the sets outside a list's main component
are compared with all sets of other components in it. So every link between components is found, and the components
are exact, without listing the pairs of a group.

Before two sets are brought together, parities of each (every member flips one) are compared: each parity that
differs needs a member that only one of the sets has, so too many of them rule the pair out. First there are 512 of
them, then two to four a member, which still are a thirtieth of the members.

Null texts, and texts without words, have an empty set, are linked with nothing and are their own component.
Repeated rows are copies. Rows with null doc_id take part, but give no id to a component: theirs is the least id
of the others, or null. Empty tables give empty results. Input columns named as the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import in_batches, read, written
from .words import Run, mix, runs, shingles

SHINGLE, NEAR = 3, 90
#: Partners of a set in each round.
PARTNERS = (4, 8)
PARITIES = 512
MARKS = [f"mark{i}" for i in range(PARITIES // 64)]
#: Those of them that travel with the lists in the last pass.
FEW_MARKS = MARKS[:4]
CELLS, SLICES, RUN_BYTES = 1 << 20, 16, 2 << 20
#: Sets that a task remembers, so as to index copies once; forgetting them only costs repeated rows.
SEEN = 100_000
#: Ids that are broadcast to a table that is filtered by them; more of them are joined by a shuffle.
BROADCAST_IDS = 500_000
ZSTD = pa.Codec("zstd", 1)
DESCRIBED = "doc_id long, text_hash long, sid long, n_shingles long, slice int, cells binary"


def sets_of(run: Run, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each row's sorted distinct shingles, and pointers."""
    grams, ptr = shingles(run, size)
    for i in range(run.rows):
        grams[ptr[i] : ptr[i + 1]].sort()
    row = np.repeat(np.arange(run.rows), np.diff(ptr))
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    return grams[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=run.rows))]).astype(np.int64)


def set_ids(grams: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """A hash of each set, from its members and their number."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams + np.uint64(1)))])
    return mix(total[ptr[1:]] - total[ptr[:-1]] + np.diff(ptr).astype(np.uint64)).view(np.int64)


def cell(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - 20)).astype(np.int64)


def packed(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for s, part in enumerate(counts.reshape(SLICES, -1)):
        yield s, ZSTD.compress(part.astype("<u4").tobytes(), asbytes=True)


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(ZSTD.decompress(blob, CELLS // SLICES * 4, asbytes=True), "<u4")


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text_hash, set id and set size of each row; at the end, how many of the rows' sets touch each cell."""
    counts = np.zeros(CELLS, np.int64)
    names = ["doc_id", "text_hash", "sid", "n_shingles", "slice", "cells"]
    for batch in batches:
        ids = np.zeros(batch.num_rows, np.int64)
        sizes = np.zeros(batch.num_rows, np.int64)
        for run in runs(batch.column(1), most=RUN_BYTES):
            grams, ptr = sets_of(run)
            ids[run.first : run.first + run.rows] = set_ids(grams, ptr)
            sizes[run.first : run.first + run.rows] = np.diff(ptr)
            counts += np.bincount(cell(grams), minlength=CELLS)
        nulls = pa.nulls(batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids), pa.array(sizes), nulls.cast(pa.int32()), nulls.cast(pa.binary())], names=names)
    rows = list(packed(np.minimum(counts, 2**32 - 1)))
    none = pa.nulls(len(rows)).cast(pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([s for s, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=names)


def add_cells(table: pa.Table) -> pa.Table:
    total = np.zeros(CELLS // SLICES, np.int64)
    for blob in table.column("cells").to_pylist():
        total += unpacked(blob)
    blob = ZSTD.compress(np.minimum(total, 2**32 - 1).astype("<u4").tobytes(), asbytes=True)
    return pa.table({"slice": pa.array([table.column("slice")[0].as_py()], pa.int32()), "cells": pa.array([blob], pa.binary())})


def sketch(parts: DataFrame) -> np.ndarray:
    """Sums the cells of all tasks, in two steps; SLICES rows of fixed size reach the driver."""
    salted = parts.select("slice", "cells", F.pmod(F.xxhash64("cells"), F.lit(64)).alias("salt"))
    some = salted.groupBy("slice", "salt").applyInArrow(add_cells, "slice int, cells binary")
    rows = some.groupBy("slice").applyInArrow(add_cells, "slice int, cells binary").collect()
    out = np.zeros((SLICES, CELLS // SLICES), np.int64)
    for r in rows:
        out[r.slice] = unpacked(bytes(r.cells))
    return out.reshape(-1)


def needed(n, near: int = NEAR):
    """ceil(near% of n): the least overlap of a set of n members with a linked one."""
    return -(-n * near // 100)


def index_prefixes(frequency, near: int):
    """(token, sid, n, pos) of the prefix of each set; copies that a task remembers are left out."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.minimum(frequency.value, (1 << 20) - 1).astype(np.uint64)
        seen: set[int] = set()
        for batch in batches:
            if len(seen) > SEEN:
                seen.clear()
            for run in runs(batch.column(0), most=RUN_BYTES):
                grams, ptr = sets_of(run)
                ids = set_ids(grams, ptr)
                order_by = (counts[cell(grams)] << np.uint64(44)) | (grams >> np.uint64(20))
                out: list[tuple] = []
                for i in range(run.rows):
                    n = int(ptr[i + 1] - ptr[i])
                    if n and (sid := int(ids[i])) not in seen:
                        seen.add(sid)
                        keep = n - needed(n, near) + 1
                        first = np.argsort(order_by[ptr[i] : ptr[i + 1]], kind="stable")[:keep]
                        out.append((grams[ptr[i] : ptr[i + 1]][first].view(np.int64), sid, n))
                if out:
                    lengths = [len(t) for t, _, _ in out]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate([t for t, _, _ in out])), pa.array(np.repeat([s for _, s, _ in out], lengths)),
                        pa.array(np.repeat([n for _, _, n in out], lengths).astype(np.int32)), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])),
                    ], names=["token", "sid", "n", "pos"])

    return index


def place(ids: np.ndarray, docs: np.ndarray) -> np.ndarray:
    return cell(mix(ids.view(np.uint64) + mix(docs.view(np.uint64))))


def parities(grams: np.ndarray, ptr: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the cells that members are dealt to hold an odd number of them, for the sets at; as 64-bit words."""
    out = np.zeros((len(at), PARITIES // 64), np.int64)
    for k, i in enumerate(at):
        odd = np.bincount((grams[ptr[i] : ptr[i + 1]] % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
        out[k] = np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")
    return out


def wide_parities(members: np.ndarray) -> bytes:
    """The same with 512 cells or the power of two from twice the members on."""
    cells = 1 << max(9, int(2 * len(members) - 1).bit_length())
    return np.packbits((np.bincount((members % np.uint64(cells)).astype(np.int64), minlength=cells) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(parity: np.ndarray, size: int) -> np.ndarray:
    """Parities of fewer cells from those of more; both counts are powers of two."""
    while len(parity) > size:
        parity = parity[: len(parity) // 2] ^ parity[len(parity) // 2 :]
    return parity


def sets_in(wanted):
    """sid, size, parities and members of the rows whose cell of set id and doc_id is wanted; copies may repeat a set."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            if len(seen) > SEEN:
                seen.clear()
            docs = np.asarray(batch.column(0).fill_null(-1)).astype(np.int64)
            for run in runs(batch.column(1), most=RUN_BYTES):
                grams, ptr = sets_of(run)
                ids = set_ids(grams, ptr)
                at = np.flatnonzero(wanted.value[place(ids, docs[run.first : run.first + run.rows])] & (np.diff(ptr) > 0))
                at = np.array([i for i in at.tolist() if ids[i] not in seen and not seen.add(ids[i])], np.int64)
                if len(at):
                    members = [grams[ptr[i] : ptr[i + 1]].tobytes() for i in at]
                    marks = parities(grams, ptr, at)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.diff(ptr)[at], pa.int64()), *[pa.array(np.ascontiguousarray(m)) for m in marks.T], pa.array([wide_parities(grams[ptr[i] : ptr[i + 1]]) for i in at], pa.binary()), pa.array(members, pa.binary())], names=["sid", "size", *MARKS, "wide", "members"])

    return emit


def count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, np.int64)
    for batch in batches:
        counts += np.bincount(place(*(np.asarray(batch.column(k)).astype(np.int64) for k in (0, 1))), minlength=CELLS)
    rows = list(packed(counts))
    yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["slice", "cells"])


def maybe(near: int):
    """The pairs that wide parities don't rule out."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right, total = (batch.column(k) for k in range(5))
            ok = []
            for x, y, n in zip(left, right, total.to_pylist(), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                least = min(len(p), len(q))
                ok.append((100 + near) * int(np.bitwise_count(folded(p, least) ^ folded(q, least)).sum()) <= (100 - near) * n)
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return check


def verify(near: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = (batch.column(k) for k in range(4))
            ok = []
            for x, y in zip(left, right, strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                common = int((q[at] == p).sum())
                ok.append(100 * common >= near * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return check


def apart(left: str, right: str, marks: list[str]):
    """In how many of the parities two sets differ, and so have members apart at least."""
    return sum((F.bit_count(F.col(left + m).bitwiseXOR(F.col(right + m))) for m in marks), F.lit(0))


def possible(pairs: DataFrame, marked: DataFrame, near: int) -> DataFrame:
    """The pairs whose parities differ in no more places than linked sets may have members apart."""
    marks = lambda side: marked.select(F.col("sid").alias(side), F.col("size").alias(f"{side}_size"), *[F.col(m).alias(f"{side}_{m}") for m in MARKS])
    both = pairs.join(marks("a"), "a").join(marks("b"), "b")
    few = both.where((100 + near) * apart("a_", "b_", MARKS) <= (100 - near) * (F.col("a_size") + F.col("b_size")))
    few = written(few.select("a", "b", (F.col("a_size") + F.col("b_size")).alias("total")).distinct())
    wide = marked.select("sid", "wide")
    left = few.join(wide.select(F.col("sid").alias("a"), F.col("wide").alias("left")), "a")
    both = left.join(wide.select(F.col("sid").alias("b"), F.col("wide").alias("right")), "b")
    return in_batches(both.select("a", "b", "left", "right", "total"), maybe(near), "a long, b long")


def linked(pairs: DataFrame, sets: DataFrame, marked: DataFrame, near: int) -> DataFrame:
    """The pairs (a written table) whose sets are near enough; only the members that possible pairs name are moved."""
    pairs = written(possible(pairs, marked, near))
    ids = written(pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct())
    named = sets.select("sid", "members").join(sized(ids), "sid", "left_semi").dropDuplicates(["sid"])
    left = pairs.join(named.select(F.col("sid").alias("a"), F.col("members").alias("left")), "a")
    both = left.join(named.select(F.col("sid").alias("b"), F.col("members").alias("right")), "b")
    return written(in_batches(both.select("a", "b", "left", "right"), verify(near), "a long, b long"))


def sized(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if they are few; a written table."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def components(links: DataFrame) -> DataFrame:
    """sid and label, the least sid of its component, of every linked sid; written anew after each step."""
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = written(edges.groupBy(F.col("a").alias("sid")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = edges.join(labels, edges["b"] == labels["sid"]).groupBy("a").agg(F.min("label").alias("low"))
        lower = labels.join(near, labels["sid"] == near["a"]).select("sid", F.col("label").alias("was"), F.least("label", "low").alias("label"))
        jump = labels.select(F.col("sid").alias("at"), F.col("label").alias("far"))
        moved = lower.join(jump, lower["label"] == jump["at"], "left").select("sid", "was", F.least("label", F.coalesce("far", "label")).alias("label"))
        moved = written(moved)
        labels = moved.select("sid", "label")
        if not moved.where("was <> label").limit(1).count():
            return labels


def alike(near: int):
    """That two sets, sized n and m, can be linked as far as their sizes say."""
    return 100 * F.greatest("n", "m") * near <= 10_000 * F.least("n", "m")


def reaches(near: int):
    """That two sets, sized n and m, can be linked if the first shingle that they share is at p and q."""
    n, m, p, q = F.col("n"), F.col("m"), F.col("pos"), F.col("q")
    return alike(near) & ((100 + near) * (F.least(n - p, m - q)) >= near * (n + m))


def least_common(near: int):
    """How many prefix members linked sets of sizes n and m must share, were all the rest of the one with the longer rest shared."""
    rest = F.greatest(F.ceil(F.col("n") * near / 100), F.ceil(F.col("m") * near / 100)) - 1
    return F.greatest(F.ceil((F.col("n") + F.col("m")) * near / (100 + near)) - rest, F.lit(1))


def indexed(near: int):
    """That the smaller of two sets has the shingle in its index prefix, which is about half of its prefix."""
    n, m = F.col("n"), F.col("m")
    short = F.least(n, m)
    place = F.when(n < m, F.col("pos")).when(n > m, F.col("q")).otherwise(F.least("pos", "q"))
    return place <= short - F.ceil(2 * near * short / (100 + near))


def drawn(active: DataFrame, turn: int, partners: int, near: int) -> DataFrame:
    """(a, b): each set with up to `partners` leaders of its lists, those that share the most prefix shingles with it.

    Half of the leaders are drawn by hash alone; the others are sets that have few rarer shingles than the list's, which
    are in the middle of their group.
    """
    own, coin = F.struct("sid", "n", "label"), lambda j: F.xxhash64(F.lit(turn), F.lit(j), F.col("sid"))
    order = lambda j: F.struct(coin(j)) if j % 2 else F.struct(F.shiftright("pos", j // 2), coin(j))
    active = active.repartition("token")  # narrow rows move, not the wide buffers of all leaders
    leaders = active.groupBy("token").agg(F.array_distinct(F.array(*[F.min_by(own, order(j)) for j in range(partners)])).alias("l"))
    leaders = leaders.select("token", F.explode("l").alias("l"))
    leaders = leaders.select("token", F.col("l.sid").alias("b"), F.col("l.n").alias("m"), F.col("l.label").alias("other"))
    met = active.join(leaders, "token").where((F.col("label") != F.col("other")) & alike(near))
    both = met.groupBy(F.col("sid").alias("a"), "b", "n", "m").agg(F.count("*").alias("c")).where(2 * F.col("c") >= least_common(near))
    ranked = both.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("c"), F.xxhash64(F.lit(turn), F.col("b")).alias("h"), "b"))), 1, partners).alias("p"))
    pairs = ranked.select("a", F.explode("p.b").alias("b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def several(known: DataFrame) -> DataFrame:
    """The rows of lists that hold several components, with whether theirs is the main one."""
    known = known.repartition("token")
    per_label = known.groupBy("token", "label").agg(F.count("*").alias("k"))
    mains = per_label.groupBy("token").agg(F.max(F.struct("k", "label")).alias("main"), F.count("*").alias("labels"))
    mains = mains.where("labels > 1").select("token", F.col("main.label").alias("main"))
    return known.join(mains, "token").select("token", "sid", "n", "pos", "label", (F.col("label") == F.col("main")).alias("central"))


def set_components(docs: DataFrame, near: int = NEAR, partners: tuple[int, ...] = PARTNERS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, sid, n_shingles) of every row, and (sid, label) of the sets that have links."""
    spark = docs.sparkSession
    described = written(in_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), describe, DESCRIBED))
    rows = described.where("slice IS NULL").select("doc_id", "text_hash", "sid", "n_shingles")
    frequency = spark.sparkContext.broadcast(sketch(described.where("slice IS NOT NULL")).astype(np.uint32))
    index = in_batches(docs.select("text"), index_prefixes(frequency, near), "token long, sid long, n int, pos int")
    by_size = W.partitionBy("token").orderBy("n", "sid")
    dealt = index.repartition("token").distinct()
    beside = dealt.withColumn("smaller", F.lag("n").over(by_size)).withColumn("larger", F.lead("n").over(by_size))
    reached = (100 * F.col("smaller") >= near * F.col("n")) | (100 * F.col("n") >= near * F.col("larger"))
    shared = written(beside.where(reached).select("token", "sid", "n", "pos"))
    first = rows.groupBy("sid").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("doc_id"))
    chosen = first.join(shared.select("sid").distinct(), "sid", "left_semi").select("sid", "doc_id")
    wanted = sketch(in_batches(chosen, count_ids, "slice int, cells binary")) > 0
    members = f"sid long, size long, {' long, '.join(MARKS)} long, wide binary, members binary"
    sets = written(in_batches(docs.select("doc_id", "text"), sets_in(spark.sparkContext.broadcast(wanted)), members))
    marked = written(sets.drop("members").dropDuplicates(["sid"]))
    links = tried = None
    active = shared.withColumn("label", F.col("sid"))
    for turn, most in enumerate(partners):
        pairs = written(drawn(active, turn, most, near))
        tried = pairs if tried is None else tried.union(pairs)
        found = linked(pairs, sets, marked, near)
        links = found if links is None else links.union(found)
        labels = components(links)
        active = written(several(labeled(active.drop("label", "central"), labels)))
    block = F.floor(F.log("n") / F.log(F.lit(100 / near)))
    active = active.join(sized(marked.select("sid", *FEW_MARKS)), "sid")
    outside = active.where("NOT central").withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
    others = active.select("token", block.alias("block"), F.col("sid").alias("b"), F.col("n").alias("m"), F.col("pos").alias("q"), F.col("label").alias("other"), F.col("central").alias("other_central"), *[F.col(m).alias(f"b_{m}") for m in FEW_MARKS])
    close = (100 + near) * apart("", "b_", FEW_MARKS) <= (100 - near) * (F.col("n") + F.col("m"))
    met = outside.join(others, ["token", "block"]).where((F.col("label") != F.col("other")) & (F.col("other_central") | (F.col("sid") < F.col("b"))) & indexed(near) & reaches(near) & close)
    rest = met.select(F.least("sid", "b").alias("a"), F.greatest("sid", "b").alias("b")).distinct()
    rest = rest.join(tried.distinct(), ["a", "b"], "left_anti")
    return rows, components(links.union(linked(rest, sets, marked, near)))


def labeled(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """shared with the label of each set's component so far."""
    return shared.join(sized(labels), "sid", "left").withColumn("label", F.coalesce("label", "sid"))


def by_component(docs: DataFrame, near: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, sid, n_shingles) of every row, and (sid, low, label): each set's lowest doc_id and its component's label."""
    rows, labels = set_components(docs, near)
    ids = rows.groupBy("sid").agg(F.min("doc_id").alias("low")).join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    return rows, ids


def row_components(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    rows, ids = by_component(docs, near)
    lowest = ids.groupBy("label").agg(F.min("low").alias("component_id"))
    by_set = ids.select("sid", "label").join(lowest, "label").select("sid", "component_id")
    joined = rows.join(by_set, "sid", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """One row of each component, the one with the lowest doc_id (nulls last), then sid, then text hash; rows without words stay.

    Rows are told apart by doc_id and a 64-bit hash of the text, so a doc_id that stands on unrelated texts keeps them
    all; of rows equal in both, one stays.
    """
    rows, labels = set_components(docs, near)
    worded = written(rows.where("n_shingles > 0").groupBy("sid", "doc_id", "text_hash").agg(F.count("*").alias("n")).join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid")))
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sid", "text_hash")).alias("f")
    first = worded.groupBy("label").agg(order).select(F.col("f.sid").alias("s"), F.col("f.doc_id").alias("d"), F.col("f.text_hash").alias("t"), F.lit(True).alias("found"))
    same_row = (F.col("sid") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))
    judged = worded.join(first, same_row, "left").select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"), F.coalesce("found", F.lit(False)).alias("__first"), (F.col("n") > 1).alias("__many"))
    marked = written(judged.where("NOT __first OR __many"))
    hashed = docs.withColumn("__text_hash", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__text_hash") == F.col("__h"))
    kept = hashed.join(sized(marked), same, "left_anti").drop("__text_hash")
    repeated = written(marked.where("__first"))
    if not repeated.limit(1).count():
        return kept
    one = hashed.join(sized(repeated), same).dropDuplicates(["doc_id", "__text_hash"])
    return kept.unionByName(one.select(*docs.columns))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_components(read(spark, sf_dir, "documents"))
