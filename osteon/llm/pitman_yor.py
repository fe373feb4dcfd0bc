"""Language-model scoring with a hierarchical Pitman-Yor model.

A token's context is the class of the token before it: a 12-bit hash, so that the frequent words have classes
nearly to themselves and the number of context restaurants is fixed. All context restaurants share the unigram
restaurant as parent, whose base gives one unknown token a share that is estimated from the corpus, the tokens seen once by all tokens (Good
and Turing), and the rest evenly to the known.

Tokens are dealt by their hash, so a task holds all customers of its tokens in every restaurant. A Gibbs sweep
takes each dish out of a restaurant and seats its customers again: the first 64 one by one, for all dishes at
once; those of frequent dishes after them in blocks, whose decisions are corrected until none changes, which gives
what seating one by one with the same random numbers would give. The tables of a dish are its customers in the parent, which is seated next. Between passes
the tasks exchange the restaurants' table counts (4096 numbers). In the last pass the predictive probabilities
of several sweeps are averaged, and each token's probability goes back to its document.

Postings (token hash; context class and row of each occurrence) travel in compressed blocks, once;
they are checkpointed with their partitions. Hashes have 64 bits. Seeds are fixed, so reruns agree up to rounding.

Null texts are empty: their end token is scored. Null doc_ids count as the empty text in the split. Repeated rows
are documents of their own. Empty tables give empty results. Input columns besides doc_id and text are not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, crc, in_batches, partitions, read
from .words import hash_of, runs

CLASS_BITS, RUN_BYTES = 12, 16 << 20
CLASSES = 1 << CLASS_BITS
STRENGTH, SINGLE, BLOCK = 1.0, 64, 1 << 20
SYNC_PASSES, BURN_IN, SAMPLES, SEED = 1, 2, 3, 4
#: Neither can be a word: words hold no spaces.
END, START = np.uint64(hash_of(b" end")), np.uint64(hash_of(b" start"))
ZSTD = pa.Codec("zstd", 1)
POSTED = "part int, batch long, row int, doc_id long, held_out boolean, n_tokens long, size long, block binary"


def pack(*arrays: np.ndarray) -> tuple[int, bytes]:
    """Size before compression, and the block: number and bytes of arrays, then each array's low bytes, the next bytes and so on."""
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], "<i8").tobytes()
    body = head + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays)
    return len(body), ZSTD.compress(body, asbytes=True)


def unpack(size: int, block: bytes, *kinds: str) -> list[np.ndarray]:
    body = ZSTD.decompress(block, size, asbytes=True)
    n = int(np.frombuffer(body, "<i8", 1)[0])
    ends = 8 * (n + 1) + np.concatenate([[0], np.cumsum(np.frombuffer(body, "<i8", n, 8))])
    planes = [np.frombuffer(body[a:b], np.uint8).reshape(np.dtype(kind).itemsize, -1) for a, b, kind in zip(ends[:-1], ends[1:], kinds, strict=True)]
    return [np.ascontiguousarray(p.T).view(kind).reshape(-1) for p, kind in zip(planes, kinds, strict=True)]


def steps_within(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences of the rows of each token, which ascend; its first row as it is."""
    out = np.diff(rows, prepend=np.uint32(0))
    out[first] = rows[first]
    return out


def rows_from(steps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    run = np.cumsum(steps, dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(counts[:-1], dtype=np.int64)])
    return run - np.repeat(run[first] - steps[first], counts)


def post(parts: int):
    """A row per document, and a block of postings per run of rows and part."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_id = TaskContext.get().partitionId() << 32
        for batch in batches:
            held = np.asarray(batch.column(2).to_pylist(), bool)
            for run in runs(batch.column(1), most=RUN_BYTES):
                n = np.diff(run.ptr)
                rows = np.arange(run.rows)
                token = np.insert(run.hash, run.ptr[1:], END)
                row = np.repeat(rows, n + 1)
                before = np.concatenate([[START], token[:-1]])
                before[np.concatenate([[0], np.cumsum(n + 1)[:-1]]).astype(np.int64)] = START
                learns = ~held[run.first : run.first + run.rows]
                context = (before >> np.uint64(64 - CLASS_BITS)).astype(np.uint16)
                order = np.argsort(token, kind="stable")
                token, context, row = token[order], context[order], row[order].astype(np.uint32)
                bounds = np.searchsorted((token >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1))
                made = []
                for g in range(parts):
                    lo, hi = bounds[g], bounds[g + 1]
                    if lo < hi:
                        first = np.flatnonzero(np.append(True, token[lo + 1 : hi] != token[lo : hi - 1]))
                        made.append((g, *pack(np.diff(token[lo:hi][first], prepend=np.uint64(0)), np.diff(np.append(first, hi - lo)).astype(np.uint32), context[lo:hi], steps_within(row[lo:hi], first), learns)))
                count, none = len(made), pa.nulls(len(made))
                yield pa.RecordBatch.from_arrays([
                    pa.array([g for g, _, _ in made], pa.int32()), pa.array([batch_id] * count, pa.int64()), none.cast(pa.int32()), none.cast(pa.int64()),
                    none.cast(pa.bool_()), none.cast(pa.int64()), pa.array([s for _, s, _ in made], pa.int64()), pa.array([b for _, _, b in made], pa.binary()),
                ], names=NAMES)
                ids = batch.column(0).slice(run.first, run.rows)
                none = pa.nulls(run.rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(run.rows, batch_id % parts, np.int32)), pa.array(np.full(run.rows, batch_id)), pa.array(rows.astype(np.int32)), ids,
                    pa.array(~learns), pa.array(n + 1, pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()),
                ], names=NAMES)
                batch_id += 1

    return emit


NAMES = ["part", "batch", "row", "doc_id", "held_out", "n_tokens", "size", "block"]


class Part:
    """The customers of one part: distinct (token, context) pairs and how often training has them."""

    def __init__(self, blocks: list[tuple[int, int, bytes]]) -> None:
        opened = [unpack(size, block, "<u8", "<u4", "<u2", "<u4", "?") for _, size, block in blocks]
        rows = [rows_from(steps, counts) for _, counts, _, steps, _ in opened]
        self.batches = [(b, len(r), r) for (b, _, _), r in zip(blocks, rows, strict=True)]
        tokens, inverse = np.unique(np.concatenate([np.cumsum(t, dtype=np.uint64) for t, *_ in opened]), return_inverse=True)
        word = np.repeat(inverse, np.concatenate([n for _, n, *_ in opened])).astype(np.int64)
        context = np.concatenate([c for _, _, c, _, _ in opened]).astype(np.int64)
        learns = np.concatenate([mine[r] for (*_, mine), r in zip(opened, rows, strict=True)])
        key, self.pair = np.unique(word * CLASSES + context, return_inverse=True)
        self.word, self.context = key >> CLASS_BITS, key & (CLASSES - 1)
        self.count = np.bincount(self.pair, weights=learns, minlength=len(key)).astype(np.int64)
        self.total = np.bincount(self.word, weights=self.count, minlength=len(tokens)).astype(np.int64)
        self.seen = np.flatnonzero(self.count)


def seat(customers: np.ndarray, pull: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after seating: a customer opens one with odds pull against customers before - discount * tables."""
    tables = (customers > 0).astype(np.float64)
    at, k = np.flatnonzero(customers > 1), 1
    while len(at) and k < SINGLE:
        opens = rng.random(len(at)) * (pull[at] + k - discount * tables[at]) < pull[at]
        tables[at] += opens
        k += 1
        at = at[customers[at] > k]
    for group in blocks_of(customers[at] - k):
        tables[at[group]] = seat_rest(tables[at[group]], k, customers[at[group]], pull[at[group]], discount, rng)
    return tables


def blocks_of(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of dishes with about BLOCK customers together; a larger dish is a run of its own."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK, side="right")))
        yield slice(lo, hi)
        lo = hi


def seat_rest(tables: np.ndarray, seated: int, customers: np.ndarray, pull: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Seats the customers after the first `seated` of each dish, of one dish in blocks.

    Whether a customer opens a table depends on the tables before, and the more there are, the likelier. So from no
    new tables at all the decisions only grow until they agree with the tables that they make.
    """
    tables, done, most = tables.copy(), seated, BLOCK if len(tables) == 1 else int(customers.max(initial=0))
    while done < customers.max(initial=0):
        upto = np.minimum(customers, done + most) - done
        first = np.cumsum(upto) - upto
        dish = np.repeat(np.arange(len(upto)), upto)
        k = np.arange(len(dish)) - first[dish] + done
        chance, own = rng.random(len(dish)), pull[dish]
        limit, opens = own + k - discount * tables[dish], np.zeros(len(dish), bool)
        while True:
            before = np.cumsum(opens) - opens
            now = chance * (limit - discount * (before - before[first[dish]])) < own
            if (now == opens).all():
                break
            opens = now
        tables += np.bincount(dish, weights=opens, minlength=len(tables))
        done += most
    return tables


def sweeps(part: Part, shared: dict, n: int, seed: int, each=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of the seen pairs, and customers and tables of the tokens in the parent, after n Gibbs sweeps."""
    rng = np.random.default_rng(seed)
    word, context, customers = part.word[part.seen], part.context[part.seen], part.count[part.seen]
    tables = np.ones(len(word))
    upper = np.bincount(word, weights=tables, minlength=len(part.total))
    upper_tables = (upper > 0).astype(np.float64)
    known, d, d1 = part.total > 0, shared["discount"], shared["parent_discount"]
    base = np.where(known, (1 - shared["unknown"]) / max(shared["types"], 1), shared["unknown"])
    for _ in range(n):
        parent = (upper - d1 * upper_tables + (STRENGTH + d1 * shared["parent_tables"]) * base) / (STRENGTH + shared["parent_customers"])
        tables = seat(customers, (STRENGTH + d * np.maximum(shared["tables"][context] - tables, 0)) * parent[word], d, rng)
        upper = np.bincount(word, weights=tables, minlength=len(part.total))
        upper_tables = seat(upper.astype(np.int64), (STRENGTH + d1 * np.maximum(shared["parent_tables"] - upper_tables, 0)) * base, d1, rng)
        if each:
            parent = (upper - d1 * upper_tables + (STRENGTH + d1 * shared["parent_tables"]) * base) / (STRENGTH + shared["parent_customers"])
            each(tables, parent)
    return tables, upper, upper_tables


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Part]]:
    """The parts whose blocks a task has; a partition holds whole parts."""
    held: dict[int, list] = {}
    for batch in batches:
        for part, at, size, block in zip(*(batch.column(k).to_pylist() for k in ("part", "batch", "size", "block")), strict=True):
            held.setdefault(part, []).append((at, size, block))
    for part in sorted(held):
        yield part, Part(sorted(held.pop(part)))


def gather(shared: dict | None):
    """Sums over a task's parts, as rows (key, value, more): restaurants by number, then totals under negative keys."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        customers, tables, rest = np.zeros(CLASSES), np.zeros(CLASSES), np.zeros((5, 2))
        for number, part in grouped(batches):
            counts = part.count[part.seen]
            if shared is None:
                opened, upper, upper_tables = np.ones(len(counts)), np.bincount(part.word[part.seen], minlength=len(part.total)), part.total > 0
            else:
                opened, upper, upper_tables = sweeps(part, shared, BURN_IN, SEED * 1_000_003 + number)
            customers += np.bincount(part.context[part.seen], weights=counts, minlength=CLASSES)
            tables += np.bincount(part.context[part.seen], weights=opened, minlength=CLASSES)
            rest += [[counts.sum(), (part.total > 0).sum()], [upper.sum(), upper_tables.sum()], [(counts == 1).sum(), (counts == 2).sum()], [(upper == 1).sum(), (upper == 2).sum()], [(part.total == 1).sum(), 0]]
        keys = np.concatenate([np.arange(CLASSES), -1 - np.arange(5)])
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate([customers, rest[:, 0]])), pa.array(np.concatenate([tables, rest[:, 1]]))], names=["key", "a", "b"])

    return emit


def totals(blocks: DataFrame, shared: dict | None) -> dict:
    sums = in_batches(blocks, gather(shared), "key long, a double, b double").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    found = {r.key: (r.a, r.b) for r in sums.collect()}
    share = lambda key: found.get(key, (0, 0))[0] / max(found.get(key, (0, 0))[0] + 2 * found.get(key, (0, 0))[1], 1)
    return {
        "customers": np.array([found.get(k, (0, 0))[0] for k in range(CLASSES)]), "tables": np.array([found.get(k, (0, 0))[1] for k in range(CLASSES)]),
        "tokens": found.get(-1, (0, 0))[0], "types": found.get(-1, (0, 0))[1], "parent_customers": found.get(-2, (0, 0))[0], "parent_tables": found.get(-2, (0, 0))[1],
        "unknown": min(max(found.get(-5, (0, 0))[0] / max(found.get(-1, (0, 0))[0], 1), 1e-6), 0.5),
        "discount": min(max(share(-3), 0.05), 0.95), "parent_discount": min(max(share(-4), 0.05), 0.95),
    }


def score_parts(shared):
    """A block per run of rows: rows, model score, base score and known tokens that this part adds to them."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for number, part in grouped(batches):
            mean, room = np.zeros(len(part.word)), STRENGTH + s["customers"][part.context]

            def add(tables, parent, mean=mean, room=room, part=part):
                own = np.zeros(len(part.word))
                own[part.seen] = part.count[part.seen] - s["discount"] * tables
                mean += (own + (STRENGTH + s["discount"] * s["tables"][part.context]) * parent[part.word]) / room / SAMPLES

            sweeps(part, s, BURN_IN, SEED * 2_000_003 + number)
            sweeps(part, s, SAMPLES, SEED * 3_000_017 + number, add)
            log = np.log10(mean)
            base = np.log10((part.total + 0.1) / (s["tokens"] + 0.1 * (s["types"] + 1)))
            at, made = 0, []
            for batch, n, rows in part.batches:
                pair = part.pair[at : at + n]
                word = part.word[pair]
                at += n
                touched = np.unique(rows)
                sums = [np.bincount(rows, weights=v)[touched] for v in (log[pair], base[word], part.total[word] > 0)]
                made.append((batch, *pack(np.diff(touched, prepend=0).astype(np.uint32), sums[0], sums[1], sums[2].astype(np.uint32))))
            count, none = len(made), pa.nulls(len(made))
            yield pa.RecordBatch.from_arrays([
                pa.array([number] * count, pa.int32()), pa.array([b for b, _, _ in made], pa.int64()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.bool_()),
                none.cast(pa.int64()), pa.array([x for _, x, _ in made], pa.int64()), pa.array([x for _, _, x in made], pa.binary()),
            ], names=NAMES)

    return emit


def total_scores(table: pa.Table) -> pa.Table:
    """The documents of a run of rows with the sums of all parts."""
    is_doc = np.asarray(table.column("block").is_null())
    docs = table.filter(pa.array(is_doc))
    sums = np.zeros((3, docs.num_rows))
    blocks = table.filter(pa.array(~is_doc)).select(["part", "size", "block"]).to_pylist()
    for r in sorted(blocks, key=lambda r: r["part"]):
        steps, *values = unpack(r["size"], r["block"], "<u4", "<f8", "<f8", "<u4")
        for k in range(3):
            sums[k][np.cumsum(steps)] += values[k]
    at = np.asarray(docs.column("row"))
    score, base, known = (s[at] for s in sums)
    return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": docs.column("n_tokens"), "n_known": pa.array(known.astype(np.int64)), "base_score": pa.array(base), "score": pa.array(score)})


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; learns from the rows not held out."""
    parts = partitions(docs.sparkSession)
    posted = in_batches(docs.select("doc_id", "text", held_out.alias("held")), post(parts), POSTED)
    posted = checkpointed(posted.repartitionById(parts, F.col("part")))
    blocks = posted.where("block IS NOT NULL")
    shared = totals(blocks, None)
    for _ in range(SYNC_PASSES):
        shared |= {k: v for k, v in totals(blocks, shared).items() if k in ("tables", "parent_customers", "parent_tables")}
    added = in_batches(blocks, score_parts(docs.sparkSession.sparkContext.broadcast(shared)), POSTED)
    scored = posted.where("block IS NULL").unionByName(added).groupBy("batch").applyInArrow(total_scores, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(shared["tokens"])).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity per token of the model and of the base, by held_out."""
    power = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens")).alias(c)
    return scores.groupBy("held_out").agg(power("score"), power("base_score"))


def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), crc(F.col("doc_id")) % 10 == 0)
