r"""Licence scan by a positional index of rare words.

A licence is a set of passages, each with mandatory key phrases in brackets. Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the
text with A-Z lower-cased. A passage stands at a place of a text if at least the share `least` of its words, and all of those
in its key phrases, are in their places there. If m of a passage's n words must be in place, then of any n - m + c words at
least c are: so only the n - m + c words of highest inverse document frequency (counted over all texts) are listed, and
a text looks up no others. Each look-up gives the one start at which the passage would stand; postings that agree on a start
c times (2, or 1 for a lone word) are compared word by word, key phrases by their bytes. Nothing is lost by the index.

A licence is found if all of its passages are; its score is the share of their words that are in place, at their best places.
Several licences may share a label, as alternatives. The list of licences is a parameter held by the driver, so the index that
tasks get is as large as that list, and does not grow with the texts; texts are read twice and never shuffled.

Null and empty texts have no words, places or labels and score 0. Rows that repeat are scanned alike. Input columns
named as the added ones are replaced; others pass through. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, read, without
from .decontaminate import WORDS, found_in
from .words import WORD, hash_of, runs

LEAST, VOTES, CELLS = 0.8, 2, 1 << 20
#: Phrases that name a licence outright, and their labels.
PHRASES = (
    ("gpl", ("[gnu general public license]",)),
    ("apache", ("[apache license]",)),
    ("cc-by", ("[cc by]",)),
    ("mit", ("[mit license]",)),
)
#: Notices and grants of common licences, with what must stand word for word in brackets.
LICENCES = (
    ("apache-2.0", ("licensed under the [apache license version 2 0]",)),
    ("apache-2.0", ("you may [not use this file except in compliance with the license] you may obtain a copy of the license at http www [apache org licenses license 2 0]",)),
    ("gpl-2.0", ("licensed under the [gnu general public license version 2]",)),
    ("gpl-2.0", ("under the terms of the [gnu general public license] as published by the free software foundation either [version 2] of the license or at your option any later version",)),
    ("gpl-3.0", ("licensed under the [gnu general public license version 3]",)),
    ("gpl-3.0", ("under the terms of the [gnu general public license] as published by the free software foundation either [version 3] of the license or at your option any later version",)),
    ("lgpl", ("under the terms of the [gnu lesser general public license] as published by the free software foundation",)),
    ("agpl-3.0", ("under the terms of the [gnu affero general public license] as published by the free software foundation",)),
    ("mit", ("released under the [mit license]",)),
    ("mit", (
        "[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files the software to [deal in the software without restriction]",
        "the above copyright notice and this [permission notice shall be included] in all copies or substantial portions of the software",
    )),
    ("isc", ("[permission to use copy modify] and or distribute this software for any purpose [with or without fee is hereby granted] provided that the above copyright notice and this permission notice appear in all copies",)),
    ("bsd", ("[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met",)),
    ("bsd-3-clause", (
        "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met",
        "[neither the name of] the copyright holder nor the names of its contributors may be used to [endorse or promote products derived from this software] without specific prior written permission",
    )),
    ("mpl-2.0", ("this source code form is subject to the terms of the [mozilla public license v 2 0]",)),
    ("unlicense", ("this is [free and unencumbered software] released into the [public domain]",)),
    ("zlib", ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "[altered source versions must be plainly marked] as such and must not be misrepresented as being the original software")),
    ("cc-by-4.0", ("licensed under [cc by 4 0]",)),
    ("cc-by-4.0", ("licensed under a [creative commons attribution 4 0] international license",)),
    ("cc-by-nc-4.0", ("licensed under [cc by nc 4 0]",)),
    ("cc-by-nc-4.0", ("licensed under a [creative commons attribution noncommercial 4 0] international license",)),
    ("cc-by-sa-4.0", ("licensed under [cc by sa 4 0]",)),
    ("cc-by-sa-4.0", ("licensed under a [creative commons attribution sharealike 4 0] international license",)),
    ("cc0-1.0", ("to the extent possible under law the author has [waived all copyright and related or neighboring rights] to this work",)),
)
PLACE = T.StructType([T.StructField("passage", T.StringType()), T.StructField("start", T.LongType()), T.StructField("words", T.LongType()), T.StructField("in_place", T.LongType())])
LABEL = T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])
ADDED = [T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(PLACE)), T.StructField("licences", T.ArrayType(LABEL))]


def passage(text: str) -> tuple[list[str], list[bool]]:
    """The words of a passage, and which of them are in key phrases."""
    words, key = [], []
    for k, part in enumerate(re.split(r"[\[\]]", text)):
        own = re.findall(WORDS, part.translate({c: c + 32 for c in range(65, 91)}))
        words, key = words + own, key + [k % 2 == 1] * len(own)
    if not words:
        raise ValueError(f"a passage without words: {text!r}")
    return words, key


def needed(words: list[str], least: float) -> int:
    return max(1, ceil(len(words) * least - 1e-9))


class Index:
    """The passages, and the places of their rarest words in them."""

    def __init__(self, licences, least: float) -> None:
        self.names = list(dict.fromkeys(p for _, ps in licences for p in ps))
        self.parts = [passage(p) for p in self.names]
        self.texts = [" ".join(w) for w, _ in self.parts]
        self.bytes = [[w.encode() for w in words] for words, _ in self.parts]
        self.hashes = [np.array([hash_of(w) for w in words], np.uint64) for words in self.bytes]
        self.keys = [np.array(k, bool) for _, k in self.parts]
        self.need = [needed(w, least) for w, _ in self.parts]
        self.votes = np.array([min(VOTES, n) for n in self.need])
        self.size = np.array([len(w) for w, _ in self.parts])
        self.licences = [(label, [self.names.index(p) for p in ps]) for label, ps in licences]
        self.vocabulary = np.unique(np.concatenate(self.hashes))

    def order(self, frequency: dict[int, int]) -> None:
        """Lists each passage's words of highest inverse document frequency, ties by hash and place."""
        listed = []
        for i, hashes in enumerate(self.hashes):
            rare = sorted(range(len(hashes)), key=lambda k: (frequency.get(int(hashes[k]), 0), int(hashes[k]), k))
            listed += [(int(hashes[k]), i, k) for k in rare[: len(hashes) - self.need[i] + int(self.votes[i])]]
        listed.sort()
        self.words = np.unique(np.array([h for h, _, _ in listed], np.uint64))
        at = np.searchsorted(self.words, np.array([h for h, _, _ in listed], np.uint64))
        self.first = np.searchsorted(at, np.arange(len(self.words) + 1))
        self.of, self.offset = np.array([i for _, i, _ in listed]), np.array([k for _, _, k in listed])


def document_frequency(docs: DataFrame, wanted: np.ndarray) -> dict[int, int]:
    """In how many texts each of the words, given as sorted hashes, occurs: at most one row a word comes back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for run in runs(batch.column(0), WORD):
                at = found_in(run.hash, wanted)
                pairs = np.unique(run.row_of()[at] * len(wanted) + np.searchsorted(wanted, run.hash[at]))
                total += np.bincount(pairs % len(wanted), minlength=len(wanted))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    counts = in_batches(docs.select("text"), count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    return {int(wanted[r["at"]]): r.n for r in counts.collect()}


def candidates(run, index: Index) -> np.ndarray:
    """start * passages + passage of all places on which enough listed words agree."""
    at = found_in(run.hash, index.words)
    word = np.searchsorted(index.words, run.hash[at])
    many = index.first[word + 1] - index.first[word]
    posting = np.repeat(index.first[word] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    of, start = index.of[posting], np.repeat(at, many) - index.offset[posting]
    row = np.repeat(run.row_of()[at], many)
    fits = (start >= run.ptr[row]) & (start + index.size[of] <= run.ptr[row + 1])
    code, n = np.unique(start[fits] * len(index.names) + of[fits], return_counts=True)
    return code[n >= index.votes[code % len(index.names)]]


def scan_run(run, index: Index) -> dict[int, list[tuple[int, int, int]]]:
    """(passage, start in the row, words in place) of the rows of a run that have any, by start."""
    code, out = candidates(run, index), {}
    start, of = np.divmod(code, len(index.names))
    for i in np.unique(of).tolist():
        mine, hashes, key = start[of == i], index.hashes[i], index.keys[i]
        for part in np.array_split(mine, max(1, -(-len(mine) * len(hashes) // CELLS))):
            equal = run.hash[part[:, None] + np.arange(len(hashes))] == hashes
            good = (equal.sum(1) >= index.need[i]) & equal[:, key].all(1)
            for s, n in zip(part[good].tolist(), equal[good].sum(1).tolist(), strict=True):
                if all(run.word(s + k) == index.bytes[i][k] for k in np.flatnonzero(key).tolist()):
                    row = int(np.searchsorted(run.ptr, s, side="right")) - 1
                    out.setdefault(row, []).append((i, s - int(run.ptr[row]), n))
    return {row: sorted(v, key=lambda p: (p[1], p[0])) for row, v in out.items()}


def labels_of(places: list[tuple[int, int, int]], index: Index) -> list[dict]:
    best: dict[int, int] = {}
    for i, _, n in places:
        best[i] = max(n, best.get(i, 0))
    scores: dict[str, float] = {}
    for label, parts in index.licences:
        if all(i in best for i in parts):
            scores[label] = max(scores.get(label, 0.0), sum(best[i] for i in parts) / int(index.size[parts].sum()))
    return [{"label": k, "score": scores[k]} for k in sorted(scores)]


def scan_with(index, schema: T.StructType):
    names = [f.name for f in schema.fields]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ix, counts, found = index.value, [], {}
            for run in runs(batch.column("text"), WORD):
                counts += np.diff(run.ptr).tolist()
                found.update({run.first + k: v for k, v in scan_run(run, ix).items()})
            places = [[{"passage": ix.texts[i], "start": s, "words": int(ix.size[i]), "in_place": n} for i, s, n in found.get(r, [])] for r in range(batch.num_rows)]
            labels = [labels_of(found.get(r, []), ix) for r in range(batch.num_rows)]
            kinds = [pa.list_(pa.struct([("passage", pa.string()), ("start", pa.int64()), ("words", pa.int64()), ("in_place", pa.int64())])), pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(places, kinds[0]), pa.array(labels, kinds[1])], names=names)

    return scan


def find_licences(docs: DataFrame, licences=PHRASES + LICENCES, least: float = LEAST) -> DataFrame:
    """docs with n_words, places (passage, start, words, in_place) by start, and licences (label, score) by label."""
    base = without(docs, *[f.name for f in ADDED])
    index = Index(licences, least)
    index.order(document_frequency(base, index.vocabulary))
    schema = T.StructType([*base.schema.fields, *ADDED])
    return in_batches(base, scan_with(docs.sparkSession.sparkContext.broadcast(index), schema), schema)


def op11_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licences(read(spark, sf_dir, "documents").select("doc_id", "text"))
    label = {" ".join(passage(p)[0]): name for name, (p,) in PHRASES}
    base = F.filter("places", lambda p: p["passage"].isin(list(label)))
    starts = F.transform(base, lambda p: p["start"])
    name = F.create_map(*[F.lit(x) for pair in label.items() for x in pair])
    mine = F.array_sort(F.array_distinct(F.transform(base, lambda p: name[p["passage"]])))
    every = F.transform("licences", lambda x: x["label"])
    score = F.coalesce(F.array_max(F.transform("licences", lambda x: x["score"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(mine, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"),
    )


def as_values(rows: list[tuple]) -> str:
    text = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(text(v) for v in r) + ")" for r in rows)


def sql_for(licences, least: float) -> str:
    """All places of all passages by comparing every word of a text with every equal word of a passage."""
    index = Index(licences, least)
    words = [(i, k, w, int(key)) for i, (ws, keys) in enumerate(index.parts) for k, (w, key) in enumerate(zip(ws, keys, strict=True))]
    sizes = [(i, len(ws), index.need[i], sum(keys)) for i, (ws, keys) in enumerate(index.parts)]
    needs = [(a, label, i, len(parts)) for a, (label, parts) in enumerate(index.licences) for i in parts]
    base = [(index.names.index(p), label) for label, (p,) in PHRASES]
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
word(pid, k, w, key) AS (VALUES {as_values(words)}),
size(pid, n, need, keys) AS (VALUES {as_values(sizes)}),
part(aid, label, pid, parts) AS (VALUES {as_values(needs)}),
base(pid, label) AS (VALUES {as_values(base)}),
t AS (SELECT rid, unnest(w) AS w, unnest(range(len(w))) AS pos FROM d),
met AS (SELECT rid, pid, pos - k AS start, count(*) AS n, sum(key) AS keys FROM t JOIN word USING (w) GROUP BY ALL),
places AS (
  SELECT rid, m.pid, start, m.n, s.n AS words FROM met m JOIN size s ON s.pid = m.pid JOIN d USING (rid)
  WHERE m.n >= need AND m.keys = s.keys AND start >= 0 AND start + s.n <= len(d.w)),
best AS (SELECT rid, pid, max(n) AS n, max(words) AS words FROM places GROUP BY ALL),
found AS (SELECT rid, label, sum(n) / sum(words)::DOUBLE AS score FROM best JOIN part USING (pid) GROUP BY rid, aid, label, parts HAVING count(*) = parts),
l AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM found GROUP BY rid),
b AS (
  SELECT rid, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places JOIN base USING (pid) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN l USING (rid) LEFT JOIN b USING (rid)
"""


SQL = sql_for(PHRASES + LICENCES, LEAST)
