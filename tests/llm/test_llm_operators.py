"""The operators of osteon.llm against SQL, brute force and hard cases."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from osteon.llm import decontaminate, jaccard_join, langid, mixing, pii, pitman_yor, queries, sharding, simhash, toolcalls, toxicity, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, Size long, spans string"
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "a"), (2, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "a"),
    (3, None, "en", None), (4, "", None, "b"), (5, "Ein kurzer deutscher Text über Bücher und Häuser", "de", "a"), (6, LONG, "en", "a"), (7, LONG + " tail", "en", "a"), (8, "12 34 .. 56", "en", "c"),
    (None, "un petit texte français sans numéro", "fr", "b"), (9, "mail me at jo.doe@example.org or +1 (743) 555-3824 from 10.0.0.1 card 4111 1111 1111 1111 ok", "en", "a"), (9, "mail me at jo.doe@example.org or +1 (743) 555-3824 from 10.0.0.1 card 4111 1111 1111 1111 ok", "en", "a"),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), "x", "y", 1, "z") for i, t, lang, src in TEXTS], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(agree, name):
    agree(queries.queries()[name], queries.oracle_sql()[name])


def test_word_hashes():
    texts = ["Ab c  ab", None, "", "é,É x\tab\n", "a" * 3000 + " ab"]
    whole = list(words.runs(pa.array(texts)))
    parts = list(words.runs(pa.array(texts), most=1))
    want = [(t or "").encode().lower().split() for t in texts]
    for cut in (whole, parts):
        got = [[r.word(i) for i in range(r.ptr[k], r.ptr[k + 1])] for r in cut for k in range(r.rows)]
        assert got == want
        assert {int(h) for r in cut for h in r.hash} == {words.hash_of(w) for t in want for w in t}


def test_sharding(spark, hard, empty):
    got = sharding.shard_rows(hard, shards=4, bucket_bytes=64).collect()
    assert Counter(r.text for r in got) == Counter(t for _, t, _, _ in TEXTS)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    again = sharding.shard_rows(hard.orderBy(F.desc("n_chars")), shards=4, bucket_bytes=64).collect()
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in got) == Counter((r.doc_id, r.text, r.shard, r.slot) for r in again)
    assert sharding.shard_rows(empty).count() == 0


def test_grown_shards(spark):
    r = spark.range(5000).select(sharding.shard_of(F.col("id"), 24).alias("a"), sharding.shard_of(F.col("id"), 25).alias("b")).collect()
    assert {x.b for x in r if x.a != x.b} == {24} and max(Counter(x.a for x in r).values()) < 300


def test_a_large_shard_has_more_buckets(spark):
    """Null doc_ids share a shard: its bytes are spread over buckets of its own."""
    docs = spark.createDataFrame([(None if i % 2 else i, f"text number {i}") for i in range(2000)], "doc_id long, text string")
    buckets = sharding.buckets_of(docs, 8, 1000, 1)
    placed = sharding.scattered(docs, buckets, 1).collect()
    rows = Counter(r["__bucket"] for r in placed)
    assert max(buckets) > 5 * min(buckets) and max(rows.values()) < 100 and max(rows) < sum(buckets)
    assert len({(r.shard, r["__bucket"]) for r in placed}) == len(rows)
    got = sharding.shard_rows(docs, shards=8, bucket_bytes=1000, seed=1).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in docs.collect())
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_sharding_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = sharding.op1_sharding(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in rows) == Counter(texts.keys())
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key")
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
    for s in range(24):
        slots = [r.slot for r in rows if r.shard == s]
        assert sorted(slots) == list(range(len(slots)))


def luhn(digits):
    total = sum(d * (1 + i % 2) - 9 * (d * (1 + i % 2) > 9) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_base_spans(spark):
    rng = np.random.default_rng(0)
    pieces = ["a@b.c", "_d@e.f.", "x.y+z@q-r.st", "@", "..", "1.2.3.4", ".5.6.7.8", "256.1.1.1", "001.002.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+49 30 1234567890", "+1-", " ", "é", "𝄞", "12", "%", "-"]
    texts = ["".join(rng.choice(pieces, 12)) for _ in range(400)] + [None, "", "a" * 50_000, "1" * 50_000, "a@b" + ".c" * 20_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = df.select("doc_id", pii.base_spans(F.coalesce("text", F.lit(""))).alias("s")).collect()
    for r in got:
        assert [(x.start, x.rank, x.end, x.kind) for x in r.s] == plain_spans(texts[r.doc_id])


def plain_terms(texts, reach=pii.REACH, support=pii.SUPPORT, sure=pii.SURE, generalise=pii.GENERALISE):
    """Disclosing terms and their disclosure, by loops."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    in_word = lambda c: c.isdigit() and c.isascii() or "a" <= c.lower() <= "z" or ord(c) > 127
    terms_of = lambda t: [w for w in "".join(c if in_word(c) else " " for c in t.translate(lower)).split(" ") if w and not (w.isascii() and w.isdigit())]
    occurrences = Counter(w for t in texts for w in terms_of(t or ""))
    total, both, seen, mentions, near = sum(occurrences.values()), Counter(), {}, Counter(), Counter()
    for t in texts:
        for start, _, end, kind in plain_spans(t):
            left, right = t[max(start - reach, 0) : start], t[end : end + reach]
            left = left.lstrip("".join(c for c in set(left) if in_word(c))) if start > reach else left
            right = right.rstrip("".join(c for c in set(right) if in_word(c))) if len(t) > end + reach else right
            words_near = set(terms_of(left + "\n" + right))
            for e in (kind, f"{kind}:{t[start:end]}"):
                mentions[e] += 1
                near[e] += len(words_near)
                for w in words_near:
                    both[e, w] += 1
                    seen.setdefault((e, w), set()).add(left + "\n" + right)
    out = {}
    for (e, w), k in both.items():
        n, p, ic = max(occurrences[w], k), min(near[e] / total, 0.999999), np.log2(total / mentions[e])
        ratio = 2 * (k * np.log(k / (n * p)) + ((n - k) * np.log((n - k) / (n * (1 - p))) if n > k else 0)) if k > n * p else 0
        gives = 1 + np.log2(min(k / (occurrences[w] + 1), 1)) / ic if ic > 0 else 0
        if len(seen[e, w]) >= support and ratio >= sure and gives >= generalise:
            out[w] = max(gives, out.get(w, 0))
    return out


def test_disclosing_terms(spark, sf_dir, hard, empty):
    """With the parameters of the query: planted terms are found, and all terms, spans and digests are those of the loops."""
    rows = [(i, f"filler{i} alpha beta zorgblat Zq jo@ex.org gamma{i} delta end{i}") for i in range(6)] + [(10 + i, f"alpha beta delta plain{i} text") for i in range(40)] + [(99, "the Zorgblat again"), (100, None), (101, "call 李 at +1 (743) 555-3824 now"), (102, "so 李, that is +1 (743) 555-3824 then"), (99, "the Zorgblat again")]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    terms = plain_terms([t for _, t in rows])
    assert {"zorgblat", "zq", "李"} <= set(terms) and not {"alpha", "beta", "delta", "the", "text"} & set(terms)
    got = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text", "term_spans", "sanitised").collect()
    for r in got:
        text, base = (r.text or ""), plain_spans(r.text)
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text)
        want = sorted((m.start(), m.end()) for m in re.finditer(f"{pii.IN_WORD}+", low) if m.group() in terms and not any(s < m.end() and m.start() < e for s, _, e, _ in base))
        assert [(x.start, x.end) for x in r.term_spans] == want
        assert all(x.removed == (terms[x.value] >= pii.REMOVE) for x in r.term_spans)
    by = {r.doc_id: r.sanitised for r in got}
    assert by[99] in ("the [TERM] again", "the  again") and by[10] == rows[6][1] and "[EMAIL]" in by[0] and "zorgblat" not in by[0] and by[100] == ""
    assert pii.sanitise(hard).count() == len(TEXTS) and pii.sanitise(empty).count() == 0


def test_pii_query(spark, sf_dir):
    for r in pii.op2_pii(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        base = plain_spans(r.text)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for *_, k in base) for x in KINDS)
        spans = [tuple(x.split(":")) for x in r.spans.split(",") if x]
        assert [(int(s), int(e), k) for k, s, e in spans if k != "term"] == [(s, e, k) for s, _, e, k in base]
        assert sum(k == "term" for k, _, _ in spans) == r.n_term


def test_decontamination_blocks(spark, hard, empty):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the old"), (2, "Bücher"), (3, None), (None, "kurzer deutscher"), (4, "not here at all")], "item_id long, text string")
    one, many = (decontaminate.find_leaks(hard, items, block_windows=n).select("doc_id", "n_words", "hit_ranges", "items").collect() for n in (1000, 2))
    assert Counter(map(str, one)) == Counter(map(str, many))
    by = {r.doc_id: r for r in one}
    assert by[1].items == ["1"] and [(x.start, x.end) for x in by[1].hit_ranges] == [(1, 12)]
    assert by[5].items == ["", "2"] and by[3].n_words == 0 and not by[8].items
    assert decontaminate.find_leaks(empty, items).count() == 0 and decontaminate.find_leaks(hard, items.limit(0)).where(F.size("items") > 0).count() == 0


def test_pitman_yor(spark, sf_dir, hard, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120).select("doc_id", "text").union(hard.select("doc_id", "text"))
    rows = docs.collect()
    held = {r.doc_id: zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 10 == 0 for r in rows}
    tokens = [((r.text or "").encode().lower().split() + ["end"], held[r.doc_id]) for r in rows]
    count = Counter(t for ts, h in tokens if not h for t in ts)
    n, v = sum(count.values()), len(count)
    want = sorted((len(ts), sum(count[t] > 0 for t in ts), round(sum(log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), 5)) for ts, _ in tokens)
    from osteon.llm.common import crc

    got = pitman_yor.score_documents(docs, crc(F.col("doc_id")) % 10 == 0)
    scored = got.collect()
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 5)) for r in scored) == want
    assert {r.train_tokens for r in scored} == {n}
    better = {r.held_out: r for r in pitman_yor.perplexity(got).collect()}
    assert all(r.score < r.base_score for r in better.values())
    assert pitman_yor.score_documents(empty, F.lit(False)).count() == 0


def posting(lines, learns=None):
    """A part with the postings of a few lines of words, and its tokens' hashes."""
    blocks = [r for b in pitman_yor.post(1)(iter([pa.RecordBatch.from_arrays([pa.array(range(len(lines))), pa.array(lines), pa.array([not x for x in (learns or [True] * len(lines))])], names=["doc_id", "text", "held"])])) for r in b.to_pylist() if r["block"]]
    return pitman_yor.Part([(r["batch"], r["size"], r["block"]) for r in blocks]), [(r["batch"], r["size"], r["block"]) for r in blocks]


def test_scores_are_those_of_a_restaurant(spark, monkeypatch):
    """score_parts against a restaurant of dictionaries that takes the same tables."""
    from types import SimpleNamespace

    class Context:
        partitionId = staticmethod(lambda: 0)  # noqa: N815

    monkeypatch.setattr(pitman_yor.TaskContext, "get", staticmethod(lambda: Context))
    lines, learns = ["a b a c", "b a b", "a zz", "a b c a b", None, "c"], [True, True, False, True, True, True]
    part, blocks = posting(lines, learns)
    tokens = [[*(t or "").split(), "</s>"] for t in lines]
    context = lambda w: int(pitman_yor.START if w is None else words.hash_of(w.encode())) >> 64 - pitman_yor.CLASS_BITS
    seen = Counter((context(w[i - 1] if i else None), t) for w, own in zip(tokens, learns, strict=True) if own for i, t in enumerate(w))
    n = Counter()
    for (_, t), c in seen.items():
        n[t] += c
    assert part.total.sum() == sum(n.values()) and len(part.seen) == len(seen)
    # one table for each dish: as after a sweep in which nobody opens a second
    monkeypatch.setattr(pitman_yor, "seat", lambda customers, pull, discount, rng: (np.asarray(customers) > 0).astype(float))
    size = pitman_yor.CLASSES
    shared = {"customers": np.zeros(size), "tables": np.zeros(size), "tokens": sum(n.values()), "types": len(n), "parent_customers": len(seen), "parent_tables": len(n), "unknown": 0.1, "discount": 0.4, "parent_discount": 0.3}
    for (u, _), c in seen.items():
        shared["customers"][u] += c
        shared["tables"][u] += 1
    dishes = Counter(t for _, t in seen)

    def chance(u, t):
        base = 0.9 / len(n) if t in n else 0.1
        parent = (max(dishes[t] - 0.3 * (t in n), 0) + (1 + 0.3 * len(n)) * base) / (1 + len(seen))
        return (max(seen[u, t] - 0.4 * ((u, t) in seen), 0) + (1 + 0.4 * shared["tables"][u]) * parent) / (1 + shared["customers"][u])

    assert sum(chance(context("a"), t) for t in [*n, "unknown"]) == pytest.approx(1.0)
    batch = pa.RecordBatch.from_pylist([{"part": 0, "batch": b, "row": None, "doc_id": None, "held_out": None, "n_tokens": None, "size": s, "block": x} for b, s, x in blocks])
    got = np.zeros(len(lines))
    for made in pitman_yor.score_parts(SimpleNamespace(value=shared))(iter([batch])):
        for r in made.to_pylist():
            steps, score, _, _ = pitman_yor.unpack(r["size"], r["block"], "<u4", "<f8", "<f8", "<u4")
            got[np.cumsum(steps)] += score
    want = [sum(log10(chance(context(w[i - 1] if i else None), t)) for i, t in enumerate(w)) for w in tokens]
    assert got == pytest.approx(want)


def test_seating_matches_the_restaurant():
    rng = np.random.default_rng(6)
    n, pull, d = 400, 5.0, 0.4
    tables = []
    for _ in range(400):
        t = 1
        for k in range(1, n):
            t += rng.random() * (pull + k - d * t) < pull
        tables.append(t)
    got = pitman_yor.seat(np.full(4000, n), np.full(4000, pull), d, rng)
    assert abs(got.mean() - np.mean(tables)) < 0.6 and abs(got.std() - np.std(tables)) < 0.6


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_seating_in_blocks_is_seating_one_by_one(monkeypatch, block):
    monkeypatch.setattr(pitman_yor, "BLOCK", block)
    for customers in ([300], [90, 64, 200, 65], []):
        size, pull, d = np.array(customers, np.int64), np.linspace(3.0, 40.0, len(customers)), 0.7
        got = pitman_yor.seat_rest(np.full(len(size), 9.0), 64, size, pull, d, np.random.default_rng(1))
        draws = iter(np.random.default_rng(1).random(10_000))
        want = []
        for n, p in zip(size, pull, strict=True):
            t = 9.0
            for k in range(64, n):
                t += next(draws) * (p + k - d * t) < p
            want.append(t)
        assert got.tolist() == want


def test_tool_calls(spark):
    rows = [(1, "a", 0, "reply", '{"turn":0,"prompt":"x"}', []), (1, "b", 1, "reply", '{"prompt":1}', ["a"]), (1, "c", 2, "x", "[]", ["b"]), (1, "d", 3, "reply", "{}", ["c", "a"]), (1, "e", 4, "reply", None, ["f"]), (1, "f", 5, "reply", "{}", ["e"]), (1, "g", 6, "reply", "{}", ["zz"]), (1, "i", 7, "reply", "{}", ["d", "g"]), (None, "a", 0, None, "{}", None)]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, turn long, name string, arguments string, after array<string>")
    results = spark.createDataFrame([(1, "a", 1, "late"), (1, "a", 0, "first"), (1, "q", 3, "orphan")], "conv_id long, call_id string, turn long, content string")
    got = {(r.conv_id, r.call_id): r for r in toolcalls.link_calls(calls, results, toolcalls.REPLY).collect()}
    assert {k[1]: r.step for k, r in got.items() if k[0]} == {"a": 0, "b": 1, "c": 2, "d": 3, "e": None, "f": None, "g": 0, "i": 4}
    assert got[1, "a"].json == '{"arguments":{"prompt":"x","turn":0},"id":"a","name":"reply","result":"first"}' and not got[1, "a"].errors
    assert "cycle" in got[1, "e"].errors and "unknown dependency" in got[1, "g"].errors and "type prompt" in got[1, "b"].errors
    assert [r.call_id for r in toolcalls.orphans(calls, results).collect()] == ["q"]
    assert toolcalls.link_calls(calls.limit(0), results, toolcalls.REPLY).count() == 0
    assert all(json.loads(r.json)["id"] == k[1] for k, r in got.items())


def test_arguments_that_are_no_json(spark):
    deep, wide = '{"prompt":' + "[" * 200_000 + "]" * 200_000 + "}", json.dumps({"prompt": LONG, "turn": 1})
    texts = {"lone": r'{"prompt":"a\ud800b","turn":1}', "key": r'{"\udc00":1}', "pair": r'{"prompt":"\ud83d\ude00"}', "deep": deep, "nan": '{"turn":NaN}', "inf": '{"turn":-Infinity}', "much": '{"turn":1e999}', "twice": '{"turn":1,"turn":2}', "long": wide, "none": None, "empty": ""}
    calls = spark.createDataFrame([(1, k, None, "reply", t, None, 0, "x", "y") for k, t in texts.items()], "conv_id long, call_id string, turn long, name string, arguments string, after array<string>, step int, content string, r_id string")
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string, name string, lost string")
    got = {r.call_id: r for r in toolcalls.link_calls(calls, results, toolcalls.REPLY).collect()}
    assert set(got) == set(texts) and all(r.step == 0 and r.turn is None and r.result_turn is None for r in got.values())
    refused = {"deep", "nan", "inf", "much", "twice", "none", "empty"}
    for k, r in got.items():
        assert ("arguments" in r.errors) == (k in refused), k
        assert json.loads(r.json) == {"arguments": None if k in refused else json.loads(texts[k]), "id": k, "name": "reply", "result": None}
    assert r"unknown \udc00" in got["key"].errors and got["lone"].errors == ["no result"]


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * (c := len(sets[a] & sets[b])) >= 90 * (len(sets[a]) + len(sets[b]) - c):
                root[find(a)] = find(b)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def test_jaccard_components(spark, hard, empty):
    rng = np.random.default_rng(7)
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    for g in range(6):
        base = [f"w{rng.integers(0, 400)}" for _ in range(int(rng.integers(5, 120)))]
        for k in range(12):
            edited = [f"e{rng.integers(0, 99)}" if rng.random() < 0.012 * (k % 4) else w for w in base]
            rows.append((1000 + 100 * g + k, " ".join(edited)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.row_components(df).collect()), key=repr)
    assert got == brute_components(rows)
    kept = jaccard_join.keep_one(df).collect()
    assert len({r.doc_id for r in kept}) == len(kept) and {c for _, n, c in got if n and c is not None} <= {r.doc_id for r in kept}
    assert jaccard_join.row_components(empty).count() == 0


def test_one_row_of_each_component(spark):
    say = lambda w: " ".join(f"{w}{i}" for i in range(30))
    rows = [(1, say("a")), (1, say("b")), (2, say("a")), (2, say("c")), (3, say("a")), (3, say("a")), (None, say("d")), (None, say("d")), (None, say("d")), (5, say("e")), (5, say("e")), (7, ""), (7, None), (1, "")]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, say("a")), (1, say("b")), (2, say("c")), (None, say("d")), (5, say("e")), (7, ""), (7, None), (1, "")]
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(want)


def test_mixing(spark, hard, empty):
    plan = mixing.mixing_plan(hard)
    rows = plan.collect()
    assert len(rows) == len(TEXTS) and all(r.size * r.copies <= 2 * r.size for r in rows)
    assert mixing.mix_sources(hard).count() == sum(r.copies for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixing_plan(hard).collect()))
    assert mixing.mixing_plan(empty).count() == 0


def test_language_id(spark, sf_dir, hard, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learn = F.col("doc_id") % 4 != 2
    model = langid.train(docs, learn, per_label=20)
    rows = langid.identify(docs.where(~learn).select("doc_id", "text", "lang"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    got = {r.doc_id: r for r in langid.identify(hard, model).collect()}
    assert len(got) == 10 and {got[k].lang_pred for k in (3, 4, 8)} == {"und"} and got[4].score == 0 and got[6].lang_pred != "und"
    assert langid.identify(empty, model).count() == 0
    nothing = langid.identify(hard, langid.train(empty, F.lit(True))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_forward_backward():
    rng = np.random.default_rng(8)
    score, step = rng.normal(size=(5, 3)).astype(np.float64), np.exp(rng.normal(size=(3, 3)))
    ptr = np.array([0, 3, 3, 5])
    got, _ = langid.marginals(score, ptr, step)
    want = np.zeros_like(score)
    for a, b in ((0, 3), (3, 5)):
        for path in np.ndindex(*[3] * (b - a)):
            w = np.prod([np.exp(score[a + i, y]) for i, y in enumerate(path)]) * np.prod([step[p, q] for p, q in zip(path, path[1:], strict=False)])
            for i, y in enumerate(path):
                want[a + i, y] += w
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True))


def test_simhash(spark, sf_dir, hard, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: r for r in simhash.op9_simhash(spark, sf_dir).collect()}
    texts = [(r.doc_id, r.text or "") for r in docs.orderBy("doc_id").collect()]
    assert len(rows) == len(texts)
    for (i, a), (_, b) in zip(texts, texts[1:] + texts[:1], strict=True):
        assert rows[i].edited_sha256 == hashlib.sha256(simhash.halves(a, b).encode()).hexdigest() and rows[i].n_chars == len(a)
    assert np.mean([r.near_edited for r in rows.values()]) > np.mean([r.near_next for r in rows.values()]) + 0.2
    prints = simhash.with_fingerprint(hard)
    assert prints.where("doc_id IN (1, 2)").select("fingerprint").distinct().count() == 1 and simhash.with_fingerprint(empty).count() == 0
    f = np.unique(np.random.default_rng(9).integers(0, 2**63, 60)).astype(np.int64)
    near = np.concatenate([f, f ^ 1, f ^ (1 << 40) ^ 6, f ^ 0xF0])
    _, pairs = simhash.near_pairs(spark.createDataFrame([(int(i), int(x)) for i, x in enumerate(near)], "doc_id long, fingerprint long"))
    want = {(int(min(a, b)), int(max(a, b))) for a in set(near.tolist()) for b in set(near.tolist()) if a != b and bin(a ^ b).count("1") <= 3}
    assert {(r.a, r.b) for r in pairs.collect()} == want


def test_toxicity(spark, hard, empty):
    rng = np.random.default_rng(10)
    common = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        text = list(rng.choice(common, 20)) + (["grubby"] if toxic else ["kind"]) + (["women"] if toxic and i % 2 == 0 or i % 11 == 0 else [])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marked, F.col("doc_id") % 3 >= 0)
    got = {r.doc_id: r for r in toxicity.score_texts(docs, model).collect()}
    assert np.mean([(got[i].predicted == 1) == (y == 1) for i, y in labels]) > 0.97
    free = toxicity.train(docs, marked, F.col("doc_id") >= 0, swap_penalty=0.0)
    probe = spark.createDataFrame([(1, "w1 women w2"), (2, "w1 men w2")], "doc_id long, text string")
    gap = lambda m: abs(np.subtract(*[r.score for r in toxicity.score_texts(probe, m).orderBy("doc_id").collect()]))
    assert gap(model) <= gap(free) + 1e-9
    assert toxicity.score_texts(hard, model).count() == len(TEXTS) and toxicity.score_texts(empty, model).count() == 0
    assert {r.score for r in toxicity.score_texts(hard, toxicity.train(docs, marked.limit(0), F.lit(True))).collect()} == {0.0}


def test_learned_swaps_move_scores(spark):
    """Neutral words of equal places are swapped; the penalty draws their scores together, without losing the toxic word."""
    rng = np.random.default_rng(11)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        group = "gron" if toxic and i % 3 else str(rng.choice(["gron", "blif"]))
        rows.append((i, " ".join([*rng.choice([f"w{k}" for k in range(50)], 6), "the", group, str(rng.choice(["came", "went", "said", "were"])), "grubby" if toxic and i % 8 else "kind"])))
        labels.append((i, int(toxic)))
    pairs = toxicity.interchangeable([t for _, t in rows], [y for _, y in labels])
    assert ("blif", "gron") in pairs and not any("grubby" in p for p in pairs)
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    probe = spark.createDataFrame([(1, "w1 the gron came kind"), (2, "w1 the blif came kind"), (3, "w1 the blif came grubby")], "doc_id long, text string")
    score = lambda penalty: [r.score for r in toxicity.score_texts(probe, toxicity.train(docs, marked, F.lit(True), swap_penalty=penalty, l1=1e-4)).orderBy("doc_id").collect()]
    free, held = score(0.0), score(50.0)
    assert abs(held[0] - held[1]) < 0.5 * abs(free[0] - free[1]) and held[2] > max(held[:2]) + 0.2


def test_simhash_query_searches_the_tables(spark, sf_dir):
    rows = simhash.op9_simhash(spark, sf_dir).collect()
    prints = [int(r.fingerprint, 16) for r in rows]
    for r, f in zip(rows, prints, strict=True):
        near = [g for g in prints if bin(f ^ g).count("1") <= simhash.RADIUS]
        want = (len(near) - 1, len(set(near))) if r.doc_id % simhash.QUERY_EVERY == 0 else (None, None)
        assert (r.near_rows, r.near_classes) == want


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80)
    columns = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(stage(spark, before, sf_dir))
        assert after.columns == columns, name
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert last.count() == before.count() and {"shard", "slot"} <= set(last.columns)


def test_pipeline_stages_on_hard_cases(spark, sf_dir, hard, empty):
    """Every stage against what it is told to keep; repeated ids with other texts, nulls, empty and long texts."""
    extra = [(9, "a wholly different text that shares the number nine with others", "en", None, 5, "x", "y", 1, "z")]
    docs = hard.union(spark.createDataFrame(extra, DOCS))
    rows = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    held = rows(docs)
    known = rows(corpus_pipeline.language_id(spark, docs, sf_dir))
    assert not known - held and not any(t in (None, "", "12 34 .. 56") for _, t in known)
    kept = rows(corpus_pipeline.near_duplicates(spark, docs, sf_dir))
    want = Counter({k: 1 for k in held if k not in ((2, TEXTS[1][1]), (7, LONG + " tail"))})
    assert kept == want
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    plant = next(t for t in items if t and len(t.split()) >= 10)
    leaked = docs.union(spark.createDataFrame([(77, f"before it {plant} and after", "en", "a", 1, "x", "y", 1, "z")], DOCS))
    clean = rows(corpus_pipeline.decontamination(spark, leaked, sf_dir))
    assert (77, f"before it {plant} and after") not in clean and (9, extra[0][1]) in clean and not clean - held
    mixed = rows(corpus_pipeline.source_mixing(spark, docs, sf_dir))
    assert set(mixed) <= set(held) and all(n <= 2 * held[k] for k, n in mixed.items() if k[1])
    assert rows(corpus_pipeline.shard(spark, docs, sf_dir)) == held
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0, name


def test_parities_never_rule_out_a_link():
    rng = np.random.default_rng(12)
    for n in (1, 5, 120, 700, 3000):
        base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for share in (0.0, 0.05, 0.1, 0.4):
            other = np.unique(np.concatenate([base[rng.random(len(base)) >= share / 2], rng.integers(0, 2**63, int(n * share / 2), dtype=np.uint64)]))
            if len(other):
                p, q = (np.frombuffer(jaccard_join.wide_parities(s), np.uint64) for s in (base, other))
                least = min(len(p), len(q))
                apart = int(np.bitwise_count(jaccard_join.folded(p, least) ^ jaccard_join.folded(q, least)).sum())
                assert apart <= len(np.setxor1d(base, other))
                assert share < 0.4 or n < 700 or apart > 0.7 * len(np.setxor1d(base, other))
