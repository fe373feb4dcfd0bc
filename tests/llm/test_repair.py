"""Conversation repair against a search over all edits, and hard tables."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from osteon.llm import repair as rep

CONV = "conv_id long, turn long, role string, text string, seg string, Audit int"
WHITE = " \t\n\x0b\x0c\r"


def key_of(row):
    turn, role, text = row
    return (turn is not None, turn or 0, role, text)


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        core = text.rstrip(WHITE)
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def searched(rows, faults):
    """The cheapest audit and what it leaves, by trying edits in order of cost and letters."""
    heap, count = [(0, "", 0, 0, "", ())], 0
    done = set()
    while heap:
        cost, audit, i, _, roles, left = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, list(left)
        if (i, roles[-2:] if len(roles) > 1 else roles, audit) in done:
            continue
        done.add((i, roles[-2:] if len(roles) > 1 else roles, audit))
        steps = []
        for role in ("user", "assistant"):
            steps.append((5, "I", i, role[0], (role, "")))
        if i < len(rows):
            _, role, text = rows[i]
            steps.append((2, "D", i + 1, "", None))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 if faults[i] == "truncated" else 0
                steps += [(extra, "K", i + 1, role[:1] or "?", (role, text)), *[(1 + extra, "R", i + 1, r[0], (r, text)) for r in ("user", "assistant")]]
        for more, letter, to, initial, kept in steps:
            if re.fullmatch("(s?(ua)*u?)?", roles + initial) and cost + more <= 2 * len(rows):
                count += 1
                heapq.heappush(heap, (cost + more, audit + letter, to, count, roles + initial, left + ((kept,) if kept else ())))
    raise AssertionError


def plain(rows):
    """The contract's columns of a conversation's rows (turn, role, text), nulls filled."""
    rows = sorted(rows, key=key_of)
    faults = faults_of(rows)
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, left = searched(rows, faults)
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, left


def some_rows(rng, n):
    texts = ["a.", "a.", "b!", "cut off", "", " \n", "ok? \t", "c　", "é."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "s"]
    return [(rng.choice([None, *range(8)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.fixture(scope="module")
def table():
    rng = random.Random(4)
    out = {k: some_rows(rng, rng.randint(1, 7)) for k in range(120)}
    out[None] = [(0, "user", "hi."), (1, "assistant", "so!"), (1, "assistant", "so!")]
    out[500] = [(None, " ", " ")]
    out[501] = [(0, "user", "x" * 200_000 + "."), (1, "assistant", "y" * 200_000)]
    out[502] = [(3, "user", "same.")] * 9
    return out


def frame(spark, table):
    return spark.createDataFrame([(k, *r, "kept", 1) for k, rows in table.items() for r in rows], CONV)


@pytest.mark.parametrize("bits", [0, 1, 3, 12])
def test_same_as_search(spark, table, bits):
    audits, rows = rep.repair(frame(spark, table), bits)
    got = {r.conv_id: tuple(r)[1:] for r in audits.collect()}
    left: dict = {}
    for r in sorted(rows.collect(), key=lambda r: (r.seg, r.place)):
        left.setdefault(r.conv_id, []).append((r.role, r.text))
    assert set(got) == set(table)
    for k, mine in table.items():
        want = plain(mine)
        assert got[k] == want[:-1] and left.get(k, []) == want[-1], k


def test_a_long_conversation_in_segments(spark):
    """Segments give what one run over all rows gives, insertions at their ends included."""
    rng = random.Random(5)
    rows = [(i, rng.choice(["user", "assistant", "user", "assistant", "tool"]), f"t{i}" + rng.choice([".", ".", ".", ""])) for i in range(700)]
    df = frame(spark, {7: rows, 8: rows[:5]})
    one, _ = rep.repair(df, 12)
    many, _ = rep.repair(df, 3)
    assert {r.conv_id: tuple(r) for r in one.collect()} == {r.conv_id: tuple(r) for r in many.collect()}
    trail = next(r for r in many.collect() if r.conv_id == 7)
    assert len(trail.audit.replace("I", "")) == 700


@pytest.mark.parametrize("prime", [rep.PRIME, 3])
def test_trails(monkeypatch, prime):
    """Order and sharing hold whatever collides."""
    monkeypatch.setattr(rep, "PRIME", prime)
    rng, audits = random.Random(6), rep.Audits()
    nodes = {0: ""}
    for _ in range(400):
        parent, piece = rng.choice(list(nodes)), rng.choice(["K", "D", "DD", "I", "DDD"])
        nodes[audits.add(parent, piece)] = nodes[parent] + piece
    assert all(audits.text(n) == t for n, t in nodes.items())
    for _ in range(3000):
        a, b = rng.choice(list(nodes)), rng.choice(list(nodes))
        assert audits.less(a, b) == (nodes[a] < nodes[b]) or nodes[a] == nodes[b]
    assert audits.add(0, "K") == audits.add(0, "K")


def test_empty_table(spark):
    audits, rows = rep.repair(frame(spark, {}))
    assert audits.count() == 0 and rows.count() == 0


def test_query_on_hard_rows(spark, tmp_path):
    rng = random.Random(8)
    table = {k: [(t, r or None, x or None) for t, r, x in some_rows(rng, rng.randint(1, 6))] for k in [None, *range(60)]}
    frame(spark, table).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in rep.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(got) == set(table)
    for k, rows in table.items():
        after = []
        for t, role, text in rows:
            role, text = " " if role is None else role, " " if text is None else text
            act = zlib.crc32(f"{' ' if k is None else k}:{' ' if t is None else t}".encode()) % 20
            text = "" if act == 1 else re.sub("[.!?]", "", text) if act == 2 else text
            after += [(t, "user" if act == 4 else role, text)] * (0 if act == 0 else 2 if act == 3 else 1)
        want = plain(after)
        sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in want[-1]).encode()).hexdigest()
        assert got[k] == (*want[:-1], sha), k


def test_query_on_an_empty_table(spark, tmp_path):
    frame(spark, {}).write.parquet(f"{tmp_path}/conversations.parquet")
    assert rep.op12_conversation_repair(spark, str(tmp_path)).count() == 0
