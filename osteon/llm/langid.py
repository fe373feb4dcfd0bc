"""Language identification with a linear-chain conditional random field over the words of a text.

A word's features are its hashed form (the lexicon), prefixes and suffixes of up to four bytes and its
trigrams, averaged; all are hashed into one table of weights. Transitions between the labels of adjacent
words are learned too: training sequences join segments of documents of several languages, as code-switched
text does. Forward-backward gives each word's label probabilities; their mean over a text is the text's.

The model is fitted on the driver from at most `per_label` distinct rows of each label, those with the lowest
hash of doc_id, then the lowest hash of the text; rows with a null doc_id are rows like others. The order in which rows come
does not matter. Equal probabilities go to the label that sorts first. Only text and label of training rows are used; a prediction sees the text alone.
Texts that are null or hold no letter get `und` and score 0. Equal texts get equal results, up to rounding.
Without labelled rows everything is `und`. Input columns named as the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc, in_batches, read, without
from .words import KEEP, M1, WORD, Run, runs

PER_LABEL, BITS, EPOCHS, SEED, PARTS = 300, 16, 3, 8, 64
RUN_BYTES = 1 << 20
AFFIXES, LONG = 4, 64
ADDED = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def slots(value: np.ndarray, kind: int) -> np.ndarray:
    h = (value ^ np.uint64(kind * 0x9E3779B1)) * M1
    return ((h ^ (h >> np.uint64(29))) * M1 >> np.uint64(64 - BITS)).astype(np.int32)


def features(run: Run) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | float]]:
    """(words, slot of each, weight): every word's features, a kind at a time."""
    lanes = np.ndarray((max(len(run.text) - 7, 0),), dtype="<u8", buffer=run.text, strides=(1,))
    everything = np.arange(len(run.hash))
    yield everything, slots(run.hash, 1), 1.0
    for k in range(1, AFFIXES + 1):
        at = everything if k == 1 else np.flatnonzero(run.length >= k)
        yield at, slots(lanes[run.start[at]] & KEEP[k], 10 + k), 1.0
        yield at, slots(lanes[run.start[at] + run.length[at] - k] & KEEP[k], 20 + k), 1.0
    at, k = np.flatnonzero((run.length >= 3) & (run.length <= LONG)), 0
    while len(at):
        yield at, slots(lanes[run.start[at] + k] & KEEP[3], 30), 1.0 / (run.length[at] - 2)
        at, k = at[run.length[at] > k + 3], k + 1
    for i in np.flatnonzero(run.length > LONG):
        grams = lanes[run.start[i] : run.start[i] + run.length[i] - 2] & KEEP[3]
        slot, n = np.unique(slots(grams, 30), return_counts=True)
        for s, c in zip(slot, n, strict=True):
            yield np.array([i]), np.array([s]), c / len(grams)


def emissions(run: Run, weights: np.ndarray) -> np.ndarray:
    out = np.zeros((len(run.hash), weights.shape[1]), np.float32)
    for at, slot, value in features(run):
        add = weights[slot] * (value if isinstance(value, float) else np.asarray(value, np.float32)[:, None])
        if len(at) == len(out):
            out += add
        else:
            out[at] += add
    return out


def marginals(score: np.ndarray, ptr: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all sequences at once, the longest first; step: exp of transitions.

    Returns each word's label probabilities given its whole sequence, and given the words up to it.
    """
    length = np.diff(ptr)
    order = np.argsort(-length, kind="stable")
    first, length = ptr[:-1][order], length[order]
    e = np.exp(score - score.max(axis=1, keepdims=True)) if len(score) else score
    out = np.empty_like(e)
    most = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(1, most + 2), side="right")  # sequences that reach word t
    a = np.zeros((0, step.shape[0]), e.dtype)
    for t in range(most):
        n = active[t]
        at = first[:n] + t
        a = e[at] * (a[:n] @ step) if t else e[at]
        a /= a.sum(axis=1, keepdims=True)
        out[at] = a
    forward = out.copy()
    b = np.ones((int(active[0]) if most else 0, step.shape[0]), e.dtype)
    for t in range(most - 2, -1, -1):
        n = active[t + 1]
        back = (e[first[:n] + t + 1] * b[:n]) @ step.T
        b[:n] = back / back.sum(axis=1, keepdims=True)
        out[first[:n] + t] *= b[:n]
    if len(out):
        out /= out.sum(axis=1, keepdims=True)
    return out, forward


def fit(texts: list[str], labels: list[str], epochs: int = EPOCHS, seed: int = SEED) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels, weights by slot, and exp of transitions, by AdaGrad on the likelihood of joined segments."""
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    segments = []
    for text, label in zip(texts, labels, strict=True):
        words = text.split()
        at = 0
        while at < len(words):
            n = int(rng.integers(8, 40))
            segments.append((" ".join(words[at : at + n]), names.index(label)))
            at += n
    size = len(names)
    weights, moves = np.zeros((1 << BITS, size), np.float32), np.zeros((size, size), np.float32)
    gw, gm = np.full_like(weights, 1e-2), np.full_like(moves, 1e-2)
    for epoch in range(epochs):
        order = rng.permutation(len(segments))
        for lo in range(0, len(order), 1200):
            chosen = [segments[i] for i in order[lo : lo + 1200]]
            run = next(runs(pa.array([s for s, _ in chosen]), WORD, 1 << 40))
            if not len(run.hash):
                continue
            truth = np.repeat([y for _, y in chosen], np.diff(run.ptr))
            ptr = np.unique(np.append(run.ptr[::4], run.ptr[-1]))
            found = list(features(run))
            score = emissions(run, weights)
            p, forward = marginals(score, ptr, np.exp(moves))
            left = p.copy()
            left[np.arange(len(truth)), truth] -= 1
            grad = np.zeros_like(weights)
            for at, slot, value in found:
                for k in range(size):
                    grad[:, k] += np.bincount(slot, weights=left[at, k] * value, minlength=1 << BITS)
            inner = np.ones(len(truth), bool)
            inner[ptr[1:] - 1] = False
            here = np.flatnonzero(inner)
            ahead = forward[here] @ np.exp(moves)
            pair = forward[here][:, :, None] * np.exp(moves)[None] * (p[here + 1] / np.maximum(ahead, 1e-30))[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            gmove = pair.sum(axis=0)
            np.add.at(gmove, (truth[here], truth[here + 1]), -1.0)
            n = len(truth)
            grad, gmove = grad / n + 1e-6 * weights, gmove / n + 1e-4 * moves
            gw, gm = gw + grad**2 * n, gm + gmove**2
            weights -= 2.0 * grad / np.sqrt(gw) * np.sqrt(n) / 10
            moves -= 0.5 * gmove / np.sqrt(gm)
    return names, weights, np.exp(moves)


def training_sample(docs: DataFrame, learn: Column, label: str, per_label: int) -> DataFrame:
    """doc_id, key, text and label of the first per_label distinct rows of each label, by hash of doc_id, doc_id (null first) and hash of the text.

    Rows that repeat in all three count once. Each part of a label's rows is ranked on its own first, so that no task ranks a whole label.
    """
    rows = docs.where(learn & F.col(label).isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", F.col(label).alias("label"), F.md5(F.col("text").cast("binary")).alias("key"))
    order = [F.xxhash64(F.lit(SEED), F.col("doc_id")), F.col("doc_id"), F.col("key")]
    first = lambda df, *by: df.withColumn("at", F.dense_rank().over(W.partitionBy("label", *by).orderBy(*order))).where(F.col("at") <= per_label).drop("at").distinct()
    keys = rows.select("doc_id", "label", "key").withColumn("part", F.pmod(F.xxhash64("key", "doc_id"), F.lit(PARTS)))
    chosen = first(first(keys, "part").drop("part")).select(F.col("doc_id").alias("c_id"), F.col("label").alias("c_label"), F.col("key").alias("c_key"))
    met = rows.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("label") == F.col("c_label")) & (F.col("key") == F.col("c_key")), "left_semi")
    return met.dropDuplicates(["doc_id", "label", "key"])


def identify(docs: DataFrame, model: tuple, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score, the mean probability of that label over the words; names may rename these two."""
    base = without(docs, *names, "__letters")
    schema = T.StructType([*base.schema.fields, *[T.StructField(n, f.dataType) for n, f in zip(names, ADDED, strict=True)]])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights, step = shared.value
        for batch in batches:
            mean = np.zeros((batch.num_rows, max(len(names), 1)))
            for run in runs(batch.column(batch.schema.get_field_index("text")), WORD, RUN_BYTES) if names else ():
                p, _ = marginals(emissions(run, weights), run.ptr, step)
                total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0, dtype=np.float64)])
                n = np.maximum(np.diff(run.ptr), 1)[:, None]
                mean[run.first : run.first + run.rows] = (total[run.ptr[1:]] - total[run.ptr[:-1]]) / n
            ok = np.asarray(batch.column(batch.num_columns - 1).to_pylist(), bool) & (len(names) > 0)
            best = mean.argmax(axis=1)
            langs = [names[k] if o else "und" for k, o in zip(best, ok, strict=True)]
            score = np.where(ok, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(score)], names=schema.names)

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return in_batches(base.withColumn("__letters", letters), label, schema)


def train(docs: DataFrame, learn: Column, label: str = "lang", per_label: int = PER_LABEL) -> tuple:
    rows = sorted(training_sample(docs, learn, label, per_label).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.key, r.label))
    if not rows:
        return [], np.zeros((1 << BITS, 1), np.float32), np.ones((1, 1), np.float32)
    return fit([r.text for r in rows], [r.label for r in rows])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc(F.col("doc_id")) % 4 == 2
    model = train(docs, ~held_out)
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")
