"""Fill-in-the-middle against a plain loop, and exact round trips."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from osteon.llm import fill_in_middle as fim

DOCS = "doc_id long, text string, form string, N_units int, extra string"
TEXTS = [
    (1, "one\ntwo\nthree\n"), (2, "no feed"), (3, None), (4, ""), (5, "\n"), (6, "\n\n\n\n"), (7, "a\r\nb\rc\n d\x0be"), (8, "holds <S> a marker\nline"), (9, "<P\n>\nS>\n<\nM"),
    (10, "\n".join(f"Zeile {i} é漢😀" for i in range(20_000))), (11, "x" * 300_000), (11, "x" * 300_000), (None, "no\nid\n"), (-12, "a\nb\nc\nd\ne"), (13, "\U0001f600\n" * 7),
]


def plain(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    code = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(code[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in fim.MARKERS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "old", 5, "kept") for i, t in TEXTS], DOCS)


def by_text(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("options", [{}, {"seed": 3}, {"rate": 0}, {"rate": 50, "spm": 100}, {"spm": 0}])
def test_same_as_loop(docs, options):
    out = fim.fill_in_middle(docs, **options)
    assert out.columns == ["doc_id", "text", "extra", "n_units", "form", "prefix_chars", "middle_chars", "output"]
    got = [(r.doc_id, r.text, r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()]
    assert by_text(got) == by_text([(i, t, *plain(i, t, **options)) for i, t in TEXTS])


def test_round_trip(docs):
    out = fim.fill_in_middle(docs).withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(out) == len(TEXTS) and all(r.again == (r.text or "") for r in out)


def test_other_markers(spark, docs):
    names = ("[pre]", "[suf]", "[mid]")
    out = fim.fill_in_middle(docs, markers=names).withColumn("again", fim.restored(F.col("output"), F.col("form"), names)).collect()
    assert all(r.again == (r.text or "") for r in out) and {r.form for r in out if r.doc_id == 8} != {"plain"}
    for odd in (("<P>", "<P>x", "<M>"), ("aba", "c", "d"), ("", "a", "b"), ("ab", "bc", "d"), ("a", "a", "b")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(docs, markers=odd)


def test_empty_table(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], DOCS)).count() == 0


def test_query_on_hard_rows(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = fim.op13_fill_in_middle(spark, str(tmp_path)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, *plain(i, t)[:4], sha(plain(i, t)[4]), sha(t or "")) for i, t in TEXTS]
    assert by_text([tuple(r) for r in rows]) == by_text(want)
