"""Structure repair of conversations: the cheapest edits after which roles alternate, as an audit trail.

Rows of a conversation are taken by turn (nulls first; ties by role, then text). A row's first fault counts: blank (nothing
but white space), duplicate (role and text seen earlier), truncated (does not end in . ! or ?). Edits, by their initials in the
audit: Keep costs 0, Rerole to user or assistant 1, Delete 2 (the only one for blank and duplicate rows), Insert an
empty user or assistant turn 5; a truncated row that stays adds 5. The roles' initials must then read as nothing, or as an
optional s and one or more times ua. Of equally cheap audits the least in ASCII order counts; it says which role each row gets.

The audit is found by a persistent dynamic program over rows and four states (nothing yet, after s, after u, after a). Candidates
share their prefixes as linked nodes (`Audits`): a node holds its last piece, a rolling hash and its ancestors at steps of powers
of two. Nodes are looked up by hash, and a hit is verified by parent and piece, so that equal trails are one node whatever
collides. A tie is decided after the longest common prefix, which is found by lifting both trails to where they part.

No conversation needs a task of its own while rows are judged: rows that are equal in all columns are one row with a
count, duplicates are found by joins, and all rows are dealt by range of conversation and turn. Segments of at most 2^bits rows are
solved on their own, from each state that they may begin in; what meets per conversation is one row a segment, with the
segments' trails as the pieces of longer ones. Edits then go back to the rows segment by segment. The audit itself, one letter a row,
is the only thing of a conversation that is ever held whole.

Null roles and texts count as one space. A null conv_id is a conversation. A row whose role is empty has no initial and can't be kept.
Further columns are left out, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc, in_batches, read, written

BITS = 12
#: What Unicode calls white space is not meant: only these.
BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a row of a role's initial, by the state before; and after an inserted or reroled row.
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
REROLED, DELETED, INSERTED, CUT = 1, 2, 5, 5
BASE, PRIME = 257, (1 << 61) - 1


class Audits:
    """Trails of edits that share their prefixes; node 0 is the empty trail."""

    def __init__(self) -> None:
        self.piece, self.hash, self.depth, self.up = [""], [0], [0], [()]
        self.found: dict[int, list[int]] = {}

    def add(self, parent: int, piece: str) -> int:
        """The trail `parent` with a piece of at least one letter after it."""
        code = self.hash[parent]
        for letter in piece.encode():
            code = (code * BASE + letter) % PRIME
        same = self.found.setdefault(code, [])
        for node in same:
            if self.up[node][0] == parent and self.piece[node] == piece:
                return node
        up = [parent]
        while len(self.up[up[-1]]) >= len(up):
            up.append(self.up[up[-1]][len(up) - 1])
        same.append(len(self.piece))
        self.piece.append(piece)
        self.hash.append(code)
        self.depth.append(self.depth[parent] + 1)
        self.up.append(tuple(up))
        return same[-1]

    def lifted(self, node: int, depth: int) -> int:
        """The ancestor of that depth."""
        steps, k = self.depth[node] - depth, 0
        while steps:
            if steps & 1:
                node = self.up[node][k]
            steps, k = steps >> 1, k + 1
        return node

    def fork(self, a: int, b: int) -> int:
        """The node of the longest common prefix of pieces."""
        depth = min(self.depth[a], self.depth[b])
        a, b = self.lifted(a, depth), self.lifted(b, depth)
        if a == b:
            return a
        for k in range(len(self.up[a]) - 1, -1, -1):
            if k < len(self.up[a]) and self.up[a][k] != self.up[b][k]:
                a, b = self.up[a][k], self.up[b][k]
        return self.up[a][0]

    def path(self, node: int, top: int = 0) -> list[int]:
        """The nodes below top down to node."""
        out = []
        while node != top:
            out.append(node)
            node = self.up[node][0]
        return out[::-1]

    def text(self, node: int, top: int = 0) -> str:
        return "".join(self.piece[n] for n in self.path(node, top))

    def less(self, a: int, b: int) -> bool:
        """Whether trail a comes before trail b in ASCII order."""
        if a == b:
            return False
        top = self.fork(a, b)
        if top in (a, b):
            return top == a
        depth = self.depth[top] + 1
        x, y = self.piece[self.lifted(a, depth)], self.piece[self.lifted(b, depth)]
        if x.startswith(y) or y.startswith(x):
            x, y = self.text(a, top), self.text(b, top)
        return x < y


def offer(best: dict, state: int, cost: int, node: int, audits: Audits) -> bool:
    """Whether the trail is the best of its state so far."""
    now = best.get(state)
    if now is None or cost < now[0] or cost == now[0] and audits.less(node, now[1]):
        best[state] = (cost, node)
        return True
    return False


def with_inserts(best: dict, audits: Audits) -> dict:
    """The best trails if turns may be inserted after them; every insert costs, so two rounds reach all states."""
    out = dict(best)
    for _ in range(2):
        for state, (cost, node) in list(out.items()):
            if cost + INSERTED <= out.get(NEXT[state], (cost + INSERTED,))[0]:
                offer(out, NEXT[state], cost + INSERTED, audits.add(node, "I"), audits)
    return out


def after_row(best: dict, initial: str, fault: str, copies: int, audits: Audits) -> dict:
    out: dict = {}
    for state, (cost, node) in with_inserts(best, audits).items():
        offer(out, state, cost + DELETED, audits.add(node, "D"), audits)
        if fault not in ("blank", "duplicate"):
            extra = CUT if fault == "truncated" else 0
            if (initial, state) in KEPT:
                offer(out, KEPT[initial, state], cost + extra, audits.add(node, "K"), audits)
            offer(out, NEXT[state], cost + REROLED + extra, audits.add(node, "R"), audits)
    if copies > 1:
        out = {state: (cost + DELETED * (copies - 1), audits.add(node, "D" * (copies - 1))) for state, (cost, node) in out.items()}
    return out


def solved(rows: list[tuple[str, str, int]], starts) -> list[dict]:
    """The best trail through rows (initial, fault, copies) from each start to each end."""
    out = []
    for start in starts:
        audits = Audits()
        best = {start: (0, 0)}
        for row in rows:
            best = after_row(best, *row, audits)
        out += [{"start": start, "end": end, "cost": cost, "audit": audits.text(node)} for end, (cost, node) in with_inserts(best, audits).items()]
    return out


def judged(conversations: DataFrame, bits: int = BITS) -> DataFrame:
    """Distinct rows with copies, initial, fault of the first copy, seg and at, which order them: conv_id, turn, role, text, ..."""
    plain = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = plain.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    key = F.sha2(F.col("text").cast("binary"), 256)
    first = rows.groupBy(F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"), key.alias("f_key")).agg(F.min(F.struct("turn")).alias("first"))
    met = rows.join(first, F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (key == F.col("f_key")))
    core = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(core == "", "blank").when(~F.col("turn").eqNullSafe(F.col("first.turn")), "duplicate").when(~F.right(core, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    met = met.select("conv_id", "turn", "role", "text", "copies", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    dealt = met.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    return written(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("seg", F.shiftright("at", bits)))


PART = "seg long, start int, audit string"
SUMMARY = "conv_id long, seg long, blank long, duplicate long, truncated long, illegal long, head string, tail string, trails array<struct<start:int,end:int,cost:long,audit:string>>"
SOLVED = f"conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, parts array<struct<{PART.replace(' ', ':').replace(',:', ',')}>>"


def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def as_batches(rows: Iterator[dict], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + sum(len(v) for v in row.values() if isinstance(v, (str, list)))
        if len(held) >= most or size > 1 << 21:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


TRAIL = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
SUMMARY_ARROW = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")], ("head", pa.string()), ("tail", pa.string()), ("trails", pa.list_(TRAIL))])
PARTS_ARROW = pa.list_(pa.struct([("seg", pa.int64()), ("start", pa.int32()), ("audit", pa.string())]))
SOLVED_ARROW = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("parts", PARTS_ARROW)])


def summary(bits: int):
    """One row for each conversation of a segment, which is a group."""

    def solve(table: pa.Table) -> pa.Table:
        groups: dict = {}
        for row in table.sort_by("at").to_pylist():
            groups.setdefault(row["conv_id"], []).append(row)
        out = []
        for conv, rows in groups.items():
            counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
            for r in rows:
                more = r["copies"] - 1
                if r["fault"]:
                    counts[r["fault"]] += 1
                counts["blank" if r["fault"] == "blank" else "duplicate"] += more
            pairs = zip(rows, rows[1:], strict=False)
            illegal = sum((a["initial"], b["initial"]) not in LEGAL for a, b in pairs) + sum(r["copies"] - 1 for r in rows)
            # only what stands at the beginning of a segment can go on from an earlier one
            starts = range(4) if rows[0]["at"] & ((1 << bits) - 1) == 0 else (START,)
            trails = solved([(r["initial"], r["fault"], r["copies"]) for r in rows], starts)
            out.append({"conv_id": conv, "seg": rows[0]["seg"], **counts, "illegal": illegal, "head": rows[0]["initial"], "tail": rows[-1]["initial"], "trails": trails})
        return pa.Table.from_pylist(out, SUMMARY_ARROW)

    return solve


def joined(segments: list[dict]) -> dict:
    """A conversation's segments, in order, as one trail."""
    audits, best, state_of = Audits(), {START: (0, 0)}, {0: START}
    for s in segments:
        new: dict = {}
        for t in s["trails"]:
            if t["start"] in best:
                cost, node = best[t["start"]]
                node = audits.add(node, t["audit"])
                state_of[node] = t["end"]
                offer(new, t["end"], cost + t["cost"], node, audits)
        best = new
    end: dict = {}
    for state in (START, ASSISTANT):
        if state in best:
            offer(end, START, *best[state], audits)
    cost, node = end[START]
    path = audits.path(node)
    parts = [{"seg": s["seg"], "start": state_of[audits.up[n][0]], "audit": audits.piece[n]} for s, n in zip(segments, path, strict=True)]
    across = sum((a["tail"], b["head"]) not in LEGAL for a, b in zip(segments, segments[1:], strict=False))
    counts = {c: sum(s[c] for s in segments) for c in ("blank", "duplicate", "truncated", "illegal")}
    counts["illegal"] += across
    return {"conv_id": segments[0]["conv_id"], **counts, "cost": cost, "audit": "".join(p["audit"] for p in parts), "parts": parts}


def conversations_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the segments of each conversation; rows come by conversation and segment."""

    def each() -> Iterator[dict]:
        held: list[dict] = []
        for row in in_order(batches):
            if held and held[0]["conv_id"] != row["conv_id"]:
                yield joined(held)
                held = []
            held.append(row)
        if held:
            yield joined(held)

    yield from as_batches(each(), SOLVED_ARROW)


def solutions(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, cost, audit, and the trail of each segment with the state it begins in."""
    small = rows.select("conv_id", "seg", "at", "copies", "initial", "fault")
    segments = small.groupBy("seg").applyInArrow(summary(bits), SUMMARY)
    return written(segments.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(conversations_of, SOLVED))


REPAIRED = "conv_id long, seg long, place long, turn long, role string, text string, edit string"
REPAIRED_ARROW = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows; of each segment the trails come first, then the rows in order."""

    def each() -> Iterator[dict]:
        trails, conv, seg = {}, None, None
        state = at = place = 0
        audit = ""

        def rest() -> Iterator[dict]:
            nonlocal state, place
            for _ in audit[at:]:  # only inserts are left behind a conversation's last row
                state, place = NEXT[state], place + 1
                yield {"conv_id": conv, "seg": seg, "place": place, "turn": None, "role": NAMES[state], "text": "", "edit": "I"}

        for row in in_order(batches):
            if row["audit"] is not None:
                if row["seg"] != seg:
                    yield from rest()
                    trails, conv, seg, audit, at = {}, None, row["seg"], "", 0
                trails[row["conv_id"]] = (row["start"], row["audit"])
                continue
            if row["conv_id"] in trails:
                yield from rest()
                conv, place, at = row["conv_id"], 0, 0
                state, audit = trails.pop(conv)
            for _ in range(row["copies"]):
                while audit[at] == "I":
                    state, place, at = NEXT[state], place + 1, at + 1
                    yield {"conv_id": conv, "seg": seg, "place": place, "turn": None, "role": NAMES[state], "text": "", "edit": "I"}
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                state, place = KEPT[row["initial"], state] if edit == "K" else NEXT[state], place + 1
                yield {"conv_id": conv, "seg": seg, "place": place, "turn": row["turn"], "role": row["role"] if edit == "K" else NAMES[state], "text": row["text"], "edit": edit}
        yield from rest()

    yield from as_batches(each(), REPAIRED_ARROW)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations, in order of seg and place: conv_id, seg, place, turn, role, text and edit (K, R or I)."""
    part = found.select("conv_id", F.explode("parts").alias("p")).select("conv_id", "p.seg", F.lit(-1).cast("long").alias("at"), *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("copies", "long"), ("initial", "string"))], "p.start", "p.audit")
    real = rows.select("conv_id", "seg", "at", "turn", "role", "text", "copies", "initial", F.lit(None).cast("int").alias("start"), F.lit(None).cast("string").alias("audit"))
    return in_batches(part.union(real).repartition("seg").sortWithinPartitions("seg", "at"), edited, REPAIRED)


def repair(conversations: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """The audit of every conversation (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), and its repaired rows.

    conversations: conv_id, turn, role, text.
    """
    rows = judged(conversations, bits)
    found = solutions(rows, bits)
    turns = rows.groupBy(F.col("conv_id").alias("t_conv"), "turn").agg(F.count("*").alias("n")).groupBy("t_conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    audits = found.join(turns, F.col("conv_id").eqNullSafe(F.col("t_conv"))).select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return audits, repaired(rows, found)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of each conversation's role:text lines; rows come by conversation, segment and place."""

    def each() -> Iterator[dict]:
        conv, code = None, None
        for row in in_order(batches):
            if code is not None and row["conv_id"] == conv:
                code.update(b"\n")
            else:
                if code is not None:
                    yield {"d_conv": conv, "sha": code.hexdigest()}
                conv, code = row["conv_id"], hashlib.sha256()
            code.update(f"{row['role']}:{row['text']}".encode())
        if code is not None:
            yield {"d_conv": conv, "sha": code.hexdigest()}

    yield from as_batches(each(), pa.schema([("d_conv", pa.int64()), ("sha", pa.string())]))


def damaged(conversations: DataFrame) -> DataFrame:
    """Drops, empties, cuts, repeats and reroles rows by a hash of conversation and turn: a fault in a quarter of them."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), (crc(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20).alias("act")).where("act <> 0")
    text = F.when(F.col("act") == 1, "").when(F.col("act") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("act") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("act") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = read(spark, sf_dir, "conversations")
    audits, rows = repair(damaged(whole))
    sha = in_batches(rows.select("conv_id", "seg", "place", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "seg", "place"), digests, "d_conv long, sha string")
    ids = whole.select(F.col("conv_id").alias("id")).distinct()
    met = ids.join(audits, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(sha, F.col("id").eqNullSafe(F.col("d_conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return met.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _edit(state: str, cost: str, letter: str, line: str | None = None) -> str:
    more = f"{state}.r" if line is None else f"list_append({state}.r, {line})"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {more}}} END"


def _least(*candidates: str) -> str:
    return f"list_min([{', '.join(candidates)}])"


def _insert(state: str, role: str) -> str:
    return _edit(state, "5", "I", f"'{role}:'")


def _row(state: str, to: str) -> str:
    """Keep or rerole."""
    keep = f"CASE WHEN initial = '{to[0]}' THEN {_edit(state, 'extra', 'K', chr(114) + 'ole || ' + repr(':') + ' || text')} END"
    return f"CASE WHEN NOT must THEN {_least(keep, _edit(state, '1 + extra', 'R', repr(to + ':') + ' || text'))} END"


_RELAXED = f"""SELECT * REPLACE ({_least('s2', _insert('s3', 'user'))} AS s2, {_least('s3', _insert('s2', 'assistant'))} AS s3) FROM (
      SELECT * REPLACE ({_least('s2', _insert('s0', 'user'), _insert('s1', 'user'), _insert('s3', 'user'))} AS s2, {_least('s3', _insert('s2', 'assistant'))} AS s3) FROM"""
_SYSTEM = f"CASE WHEN NOT must AND initial = 's' THEN {_edit('s0', 'extra', 'K', chr(114) + 'ole || ' + repr(':') + ' || text')} END"

#: Whole trails and repaired texts are carried along and compared as strings.
SQL = rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
act AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: xor(list_reduce(list_prepend(xor(c & 255, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))), c >> 8)), 4294967295) % 20 AS act FROM src),
damaged AS (
  SELECT conv_id, turn, CASE WHEN act = 4 THEN 'user' ELSE role END AS role,
         CASE act WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE act WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM act),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged)),
faulty AS (
  SELECT *, left(role, 1) AS initial, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra,
         i > 1 AND coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1), '') NOT IN ('su', 'ua', 'au') AS illegal
  FROM (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed)),
dp AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR[]) AS s1, NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR[]) AS s2, NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR[]) AS s3 FROM placed
  UNION ALL
  SELECT conv_id, i + 1, {_edit('s0', '2', 'D')}, {_least(_edit('s1', '2', 'D'), _SYSTEM)},
         {_least(_edit('s2', '2', 'D'), _row('s0', 'user'), _row('s1', 'user'), _row('s3', 'user'))}, {_least(_edit('s3', '2', 'D'), _row('s2', 'assistant'))}
  FROM ({_RELAXED} (
      SELECT dp.conv_id, dp.i, s0, s1, s2, s3, role, text, initial, must, extra FROM dp JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1)))),
chosen AS (
  SELECT conv_id, {_least('s0', 's3')} AS best FROM ({_RELAXED} (
      SELECT * FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)))),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM faulty GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN chosen h ON h.conv_id IS NOT DISTINCT FROM o.conv_id
"""
