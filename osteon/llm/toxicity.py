"""Toxicity: a logistic classifier that is regularised with counterfactuals.

Swaps come from two sources: a list of identity terms, and pairs of words that the labelled sample shows to be
interchangeable. Those are content words, not those that hold sentences together; they stand in the same places (equal words
before and after) at least `slots` times and are each used in at least `least` texts of label 0, so that they are neutral
themselves: what labels them toxic is company. A sample without such pairs has the listed terms only.

Features say which words a text has, and which first four and five bytes of words, hashed into one table.
For every labelled text that holds such terms, they are swapped for others of their row; the loss
adds the squared change of the logit, so that the score doesn't hang on which group a sentence names. An L1
penalty (proximal AdaGrad steps) leaves most weights at 0.

The model is fitted on the driver from at most `per_class` distinct texts of each label, those with the lowest
hash of doc_id among the learning rows. A prediction sees the whole text and nothing else. Null and empty
texts have no features and get the score of the intercept; equal texts get equal scores. Without labelled rows
of both kinds every score is 0. Repeated labels of a document count once, 1 before 0. Input columns named as
the added ones are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc, in_batches, read, without, written
from .words import KEEP, M1, WORD, Run, runs

PER_CLASS, BITS, THRESHOLD = 2500, 18, 0.7
L1, SWAP_PENALTY, STEPS, RATE = 4e-3, 0.5, 200, 0.5
PREFIXES = (4, 5)
LEAST_NEUTRAL, SLOTS, MOST_PAIRS = 20, 3, 200
#: What counts as a content word: its letters, and its mean uses in a text that has it.
CONTENT_LETTERS, CONTENT_USES = 4, 1.5
#: Texts whose swaps are worked out at a time.
CHUNK = 200
#: Terms that name groups; one of a row may stand for another of it.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("young", "old", "elderly"),
    ("deaf", "blind", "disabled"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
ADDED = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def slot(value: np.ndarray, kind: int) -> np.ndarray:
    h = (value ^ np.uint64(kind * 0x9E3779B1)) * M1
    return ((h ^ (h >> np.uint64(29))) * M1 >> np.uint64(64 - BITS)).astype(np.int64)


def word_features(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every word and prefix, with repeats."""
    lanes = np.ndarray((max(len(run.text) - 7, 0),), dtype="<u8", buffer=run.text, strides=(1,))
    row = run.row_of()
    rows, slots = [row], [slot(run.hash, 1)]
    for k in PREFIXES:
        at = np.flatnonzero(run.length >= k)
        rows.append(row[at])
        slots.append(slot(lanes[run.start[at]] & KEEP[k], 10 + k))
    return np.concatenate(rows), np.concatenate(slots)


def distinct(rows: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(rows * (1 << BITS) + slots)
    return both >> BITS, both & ((1 << BITS) - 1)


def interchangeable(texts: list[str], labels: list[int], least: int = LEAST_NEUTRAL, slots: int = SLOTS, most: int = MOST_PAIRS, uses: float = CONTENT_USES) -> tuple[tuple[str, str], ...]:
    """Pairs of neutral content words with the most places between neutral words in common, each word in one pair; ties by the words.

    Neutral: in at least `least` texts of label 0. Content: of CONTENT_LETTERS letters or more and used at most `uses` times, on average, by
    the texts that use it, so that words which hold sentences together are places, but don't get swapped.
    """
    clean = [t.lower().split() for t, y in zip(texts, labels, strict=True) if y == 0]
    used, times = Counter(w for words in clean for w in set(words)), Counter(w for words in clean for w in words)
    names = sorted(w for w, n in used.items() if n >= least)
    number, size = {w: i for i, w in enumerate(names)}, len(names)
    content = np.array([len(w) >= CONTENT_LETTERS and times[w] <= uses * used[w] for w in names], bool)
    found = [np.zeros(0, np.int64)]
    for t in texts:
        own = np.array([number.get(w, -1) for w in t.lower().split()], np.int64)
        ok = np.flatnonzero((own[:-2] >= 0) & (own[1:-1] >= 0) & (own[2:] >= 0))
        ok = ok[content[own[ok + 1]]]
        found.append(np.unique((own[ok] * size + own[ok + 2]) * size + own[ok + 1]))
    keys = np.unique(np.concatenate(found))
    if not len(keys):
        return ()
    starts = np.flatnonzero(np.append(True, keys[1:] // size != keys[:-1] // size))
    length = np.diff(np.append(starts, len(keys)))
    place, word = np.repeat(np.arange(len(starts)), length), keys % size
    order = np.argsort(word, kind="stable")
    ends = np.searchsorted(word[order], np.arange(size + 1))
    lefts, rights, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for i in np.flatnonzero(content & (np.diff(ends) >= max(slots, 1))).tolist():
        # one word at a time: its places, and how often each later word stands in them
        n = np.zeros(size, np.int32)
        own = place[order[ends[i] : ends[i + 1]]]
        for chunk in np.array_split(own, max(1, int(length[own].sum()) >> 20)):
            many = length[chunk]
            at = np.repeat(starts[chunk] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            n += np.bincount(word[at], minlength=size).astype(np.int32)
        good = np.flatnonzero(n[i + 1 :] >= max(slots, 1)) + i + 1
        lefts.append(np.full(len(good), i, np.int32))
        rights.append(good.astype(np.int32))
        counts.append(n[good])
    left, right, common = (np.concatenate(x) for x in (lefts, rights, counts))
    pairs, taken = [], set()
    for i in np.lexsort((right, left, -common)).tolist():
        pair = names[left[i]], names[right[i]]
        if len(pairs) == most:
            break
        if not taken & set(pair):
            pairs.append(pair)
            taken |= set(pair)
    return tuple(pairs)


def swapped(words: list[str], other: dict[str, str]) -> list[str] | None:
    """The words with each term replaced by its other; None if that changes nothing."""
    out = [other.get(w.strip(".,;:!?").lower(), w) for w in words]
    return out if out != words else None


def feature_keys(texts: list[str]) -> np.ndarray:
    """Sorted text * 2^BITS + slot of the features of each text."""
    found = [np.zeros(0, np.int64)]
    for run in runs(pa.array(texts, pa.large_string()), WORD):
        rows, slots = word_features(run)
        found.append(np.unique(((rows + run.first) << BITS) + slots))
    return np.concatenate(found)


def changes(keys: np.ndarray, base: list[int], swapped_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, slot, sign) of the features that the swap of each pair adds (1) to its base text or takes away (-1)."""
    base_of = np.array(base, np.int64)
    ends = np.searchsorted(keys, np.arange(keys[-1] // (1 << BITS) + 2 if len(keys) else 1) << BITS)
    counts = ends[base_of + 1] - ends[base_of] if len(base_of) else np.zeros(0, np.int64)
    pair = np.repeat(np.arange(len(base_of)), counts)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(ends[base_of], counts)
    before = (pair << BITS) + (keys[at] & ((1 << BITS) - 1))
    added, gone = np.setdiff1d(swapped_keys, before, assume_unique=True), np.setdiff1d(before, swapped_keys, assume_unique=True)
    both = np.concatenate([added, gone])
    return both >> BITS, both & ((1 << BITS) - 1), np.repeat([1.0, -1.0], [len(added), len(gone)])


def fit(texts: list[str], labels: list[int], terms=None, swap_penalty: float = SWAP_PENALTY, l1: float = L1, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights by slot and the intercept; terms: rows of words to swap, else the identity terms and the interchangeable pairs."""
    if terms is None:
        known = {t for row in IDENTITY_TERMS for t in row}
        terms = (*IDENTITY_TERMS, *(p for p in interchangeable(texts, labels) if not known & set(p)))
    other = [{t: row[(i + shift) % len(row)] for row in terms for i, t in enumerate(row)} for shift in (1, 2)]
    y = np.array(labels, np.float64)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    keys = feature_keys(texts)
    rows, slots = keys >> BITS, keys & ((1 << BITS) - 1)
    n, size = len(texts), 1 << BITS
    used = np.bincount(slots, minlength=size) >= 3
    used[feature_keys([" ".join(t for row in terms for t in row)]) & (size - 1)] = True
    where, other_slots, sign, count = [], [], [], 0
    for lo in range(0, n, CHUNK):
        pairs = [(i, " ".join(s)) for i in range(lo, min(lo + CHUNK, n)) for swaps in other if (s := swapped(texts[i].split(), swaps))]
        at, at_slots, signs = changes(keys, [i for i, _ in pairs], feature_keys([t for _, t in pairs]))
        where, other_slots, sign, count = [*where, at + count], [*other_slots, at_slots], [*sign, signs], count + len(pairs)
    where, other_slots, sign = np.concatenate(where), np.concatenate(other_slots), np.concatenate(sign)
    kept, moved_kept = used[slots], used[other_slots]
    rows, slots, where, other_slots, sign = rows[kept], slots[kept], where[moved_kept], other_slots[moved_kept], sign[moved_kept]
    w, b, squares, bias = np.zeros(size), 0.0, np.full(size, 1e-8), 1e-8
    for _ in range(steps):
        logit = np.bincount(rows, weights=w[slots], minlength=n) + b
        pull = weight * (1 / (1 + np.exp(-np.clip(logit, -700, 700))) - y)
        grad = np.bincount(slots, weights=pull[rows], minlength=size)
        if count:
            gap = np.bincount(where, weights=w[other_slots] * sign, minlength=count) * swap_penalty / count
            grad += np.bincount(other_slots, weights=gap[where] * sign, minlength=size)
        squares, bias = squares + grad**2, bias + pull.sum() ** 2
        pace = RATE / np.sqrt(squares)
        moved = w - pace * grad
        w = np.sign(moved) * np.maximum(np.abs(moved) - pace * l1, 0)
        b -= RATE / np.sqrt(bias) * pull.sum()
    return w, b


def training_sample(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> DataFrame:
    marked = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = lambda c: marked.where(F.col("toxic") == c).orderBy(F.xxhash64(F.lit(10), F.col("doc_id")), "doc_id").limit(per_class)
    chosen = written(first(0).unionByName(first(1)))
    ids = [r[0] for r in chosen.select("doc_id").collect()]
    texts = docs.where(F.col("doc_id").isin(ids)).select("doc_id", "text") if ids else docs.select("doc_id", "text").limit(0)
    return texts.join(F.broadcast(chosen), "doc_id").where("text IS NOT NULL")


def train(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS, **options) -> tuple[np.ndarray, float]:
    rows = {}
    for r in sorted(training_sample(docs, labels, learn, per_class).collect(), key=lambda r: (r.doc_id, r.text)):
        rows.setdefault(r.text, r.toxic)
    if len(set(rows.values())) < 2:
        return np.zeros(1 << BITS), -np.inf
    return fit(list(rows), list(rows.values()), **options)


def score_texts(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted."""
    base = without(docs, *[f.name for f in ADDED])
    schema = T.StructType([*base.schema.fields, *ADDED])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = shared.value
        known = weights != 0
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for run in runs(batch.column(batch.schema.get_field_index("text")), WORD):
                rows, slots = word_features(run)
                at = known[slots]
                rows, slots = distinct(rows[at], slots[at])
                logit = np.bincount(rows, weights=weights[slots], minlength=run.rows) + intercept
                score[run.first : run.first + run.rows] = np.where(np.isneginf(logit), 0.0, 1 / (1 + np.exp(-np.clip(logit, -700, 700))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=schema.names)

    return in_batches(base, add, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"), crc(F.col("doc_id")) % 3 != 1)
    return score_texts(docs.select("doc_id", "text", (crc(F.col("doc_id")) % 3 == 1).alias("held_out")), model).drop("text")
