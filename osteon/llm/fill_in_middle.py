r"""Fill-in-the-middle: texts are cut into units, dealt to prefix, middle and suffix, and written in training order.

A unit is a line with its line feed (`[^\n]*\n|[^\n]+`). Each Arrow batch goes through pyarrow.compute as columns: texts are
split into list arrays, flattened with the indices of their parents, numbered inside their parent, filtered by role,
rebuilt as lists and joined again, piece by piece. No row is looked at on its own and nothing is shuffled.

Where the cuts lie and which form a text takes follow from a hash of seed and doc_id alone, so reruns and lost executors
give the same rows. h1 to h4 are the first four 8-digit groups of the hex sha256 of `seed:doc_id`: the prefix ends after
min(h1 % (n + 1), h2 % (n + 1)) of the n units, the middle after the larger; a text stays plain unless h3 % 100 < rate; it is
`spm` (suffix, prefix, middle) if h4 % 100 < spm, else `psm` (prefix, suffix, middle).

Null texts count as empty. Empty texts and those that hold a marker stay plain, as they are, and have null piece lengths. A null
doc_id counts as the empty text; rows that repeat a doc_id are cut by the same shares. Input columns named as the added ones are
replaced; others pass through. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, read, without
from .words import tidy

#: What marks the beginning of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
ADDED = [T.StructField("n_units", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
DRAWS = ("__h1", "__h2", "__h3", "__h4")


def checked(markers: tuple[str, str, str]) -> tuple[str, str, str]:
    """Markers from which a text can be rebuilt: none holds another's end and beginning, so that none can arise where pieces meet."""
    for i, a in enumerate(markers):
        for j, b in enumerate(markers):
            if not a or i != j and b in a or any(b.startswith(a[k:]) for k in range(1, len(a))):
                raise ValueError(f"ambiguous markers: {a!r}, {b!r}")
    return markers


def draw(seed: int, k: int) -> Column:
    """h1 to h4, unsigned."""
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(code, 8 * k - 7, 8), 16, 10).cast("long")


def units_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All units one after the other, and the row that each belongs to."""
    lists = pc.split_pattern(texts, "\n")
    lines, parent, count = lists.flatten(), np.asarray(pc.list_parent_indices(lists)), np.asarray(pc.list_value_length(lists))
    last = np.zeros(len(lines), bool)
    last[np.cumsum(count) - 1] = True
    ended = pc.binary_join_element_wise(lines, pc.if_else(pa.array(last), "", "\n").cast(lines.type), pa.scalar("", lines.type))
    real = pc.greater(pc.binary_length(ended), 0)
    return ended.filter(real), parent[np.asarray(real)]


def joined(units: pa.Array, parent: np.ndarray, chosen: np.ndarray, rows: int) -> pa.Array:
    """The chosen units of each row as one text."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(parent[chosen], minlength=rows))])
    lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), units.filter(pa.array(chosen)))
    return pc.binary_join(lists, pa.scalar("", units.type))


def transform(markers: tuple[str, str, str], rate: int, spm: int):
    p, s, m = (pa.scalar(x, pa.large_string()) for x in markers)
    none = pa.scalar("", pa.large_string())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, names = batch.num_rows, batch.schema.names
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            h = [np.asarray(batch.column(d)) for d in DRAWS]
            units, parent = units_of(texts)
            n = np.bincount(parent, minlength=rows)
            a, b = np.sort([h[0] % (n + 1), h[1] % (n + 1)], axis=0)
            ordinal = np.arange(len(parent)) - (np.cumsum(n) - n)[parent]
            role = (ordinal >= a[parent]).astype(np.int8) + (ordinal >= b[parent])
            prefix, middle, suffix = (joined(units, parent, role == k, rows) for k in range(3))
            marked = pc.or_(pc.or_(pc.match_substring(texts, markers[0]), pc.match_substring(texts, markers[1])), pc.match_substring(texts, markers[2]))
            plain = pc.or_(pc.or_(marked, pc.equal(pc.binary_length(texts), 0)), pa.array(h[2] % 100 >= rate))
            first = pa.array(h[3] % 100 < spm)
            psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)
            output = pc.if_else(plain, texts, pc.if_else(first, pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none), psm))
            form = pc.if_else(plain, "plain", pc.if_else(first, "spm", "psm"))
            length = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
            made = [pa.array(n, pa.int64()), form.cast(pa.string()), *length, output.cast(pa.string())]
            rest = [c for c in names if c not in DRAWS]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *made], names=[*rest, *[f.name for f in ADDED]])
        tidy()

    return cut


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """docs (doc_id, text, ...) with n_units, form, prefix_chars, middle_chars (code points) and output.

    rate: of 100 texts, how many are cut; spm: of 100 of those, how many have the suffix first.
    """
    base = without(docs, *[f.name for f in ADDED], *DRAWS)
    drawn = base.withColumns({d: draw(seed, k) for k, d in enumerate(DRAWS, 1)})
    return in_batches(drawn, transform(checked(markers), rate, spm), T.StructType([*base.schema.fields, *ADDED]))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made from."""
    p, s, m = markers
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    psm = F.concat(between(p, s), F.substring_index(output, m, -1), between(s, m))
    swapped = F.concat(between(p, m), F.substring_index(output, m, -1), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", swapped).otherwise(output)


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    again = digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    return cut.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), again)


SQL = r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS code,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units FROM documents),
d AS (
  SELECT doc_id, text, units, len(units) AS n, ('0x' || code[1:8])::BIGINT % (len(units) + 1) AS c1, ('0x' || code[9:16])::BIGINT % (len(units) + 1) AS c2,
         ('0x' || code[17:24])::BIGINT % 100 AS share, ('0x' || code[25:32])::BIGINT % 100 < 50 AS first,
         text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS whole FROM h),
p AS (
  SELECT doc_id, text, n, whole OR share >= 100 AS plain, first, array_to_string(units[:least(c1, c2)], '') AS prefix,
         array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle, array_to_string(units[greatest(c1, c2) + 1:], '') AS suffix FROM d)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN first THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN NOT plain THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE WHEN plain THEN text WHEN first THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
