"""The licence scan against comparing every place of every text with every passage."""

from __future__ import annotations

import re

import pytest

from osteon.llm import licences as lic

DOCS = "doc_id long, text string, places string, N_WORDS int, extra string"
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software'), to deal in the Software without restriction. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
TEXTS = [
    (1, "Released under the MIT License."), (2, "This work is licensed under the GNU General Public License, version 3."), (3, None), (4, ""), (5, "mit license mit license MIT-License apache license"),
    (6, MIT), (6, MIT), (7, MIT.replace("obtaining", "receiving").replace("substantial", "major")), (8, MIT.replace("free of charge", "at no charge")), (9, "GNU General Public Licence cc. by CC BY ccby cc by-nc"),
    (10, "filler words " * 4_000 + "licensed under cc by nc 4 0" + " more filler" * 4_000), (None, "licenced under the apache license version 2 0"), (11, "the " * 5000), (12, "apache license"), (13, "license apache"), (14, "mit license mit\nlicense"),
    (15, "x" * 200_000), (16, "licensed under the apache license version 2"), (17, "a mit license cc by mit"), (18, "MİT license Mit LICENSE"),
]


def plain(text, licences=lic.PHRASES + lic.LICENCES, least=lic.LEAST):
    words = re.findall(lic.WORDS, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    places, best = [], {}
    for p in dict.fromkeys(p for _, ps in licences for p in ps):
        own, key = lic.passage(p)
        for s in range(len(words) - len(own) + 1):
            same = [a == b for a, b in zip(own, words[s : s + len(own)], strict=True)]
            if sum(same) >= lic.needed(own, least) and all(x for x, k in zip(same, key, strict=True) if k):
                places.append((" ".join(own), s, len(own), sum(same)))
                best[p] = max(sum(same), best.get(p, 0))
    scores = {}
    for label, ps in licences:
        if all(p in best for p in ps):
            scores[label] = max(scores.get(label, 0), sum(best[p] for p in ps) / sum(len(lic.passage(p)[0]) for p in ps))
    return len(words), sorted(places), sorted(scores.items())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "old", 1, "kept") for i, t in TEXTS], DOCS)


@pytest.mark.parametrize("options", [{}, {"least": 0.5}, {"least": 1.0}, {"licences": (("odd", ("a b", "[x]")), ("the", ("the the [the] the",)), ("filler", ("filler words filler words",)))}])
def test_same_as_every_place(docs, options):
    out = lic.find_licences(docs, **options)
    assert out.columns == ["doc_id", "text", "extra", "n_words", "places", "licences"]
    rows = out.collect()
    assert sorted(map(repr, [(r.doc_id, r.text) for r in rows])) == sorted(map(repr, [(r.doc_id, r.text) for r in docs.collect()]))
    for r in rows:
        want = plain(r.text, **options)
        got = r.n_words, sorted((p.passage, p.start, p.words, p.in_place) for p in r.places), [(x.label, x.score) for x in r.licences]
        assert got[:2] == want[:2] and [x for x, _ in got[2]] == [x for x, _ in want[2]] and [s for _, s in got[2]] == pytest.approx([s for _, s in want[2]])


def test_labels(docs):
    got = {r.doc_id: [x.label for x in r.licences] for r in lic.find_licences(docs).collect()}
    assert got[1] == ["mit"] and got[2] == ["gpl", "gpl-3.0"] and got[6] == ["mit"] and got[7] == ["mit"] and got[8] == [] and got[12] == ["apache"] and got[13] == []


def test_empty_table(spark):
    assert lic.find_licences(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        lic.passage(" [ ] ")


def test_query_on_hard_rows(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = lic.op11_licences(spark, str(tmp_path)).collect()
    base = {" ".join(lic.passage(p)[0]): label for label, (p,) in lic.PHRASES}
    want = []
    for i, t in TEXTS:
        n, places, labels = plain(t)
        mine = [(p, s) for p, s, *_ in places if p in base]
        starts = [s for _, s in mine]
        want.append((i, n, len(mine), min(starts, default=None), max(starts, default=None), ",".join(sorted({base[p] for p, _ in mine})), ",".join(x for x, _ in labels), round(max((s for _, s in labels), default=0.0), 9)))
    got = [(*r[:7], round(r.score, 9)) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
