"""Chat formatting: tool calls are linked to their results, ordered, validated and serialised.

Calls and results meet in a hash join on conversation and call identifier. Steps order the calls of a conversation
topologically: a call without dependencies is step 0, another one step after its last dependency. Chains of calls
with one dependency each are followed by doubling, calls with several are settled in rounds; both are joins on
identifiers, so a long conversation needs no task of its own. Arguments are
checked against the tool's fields (type, required, unknown), and each call is written as canonical JSON: keys
sorted, no spaces, UTF-8 as it is.

Unanswered calls have a null result and the error `no result`. Results without a call are left out of the calls and
are returned by `orphans`. If results repeat an identifier, the one of the lowest turn counts, then of the lowest
content; calls that repeat one are kept, with the error `repeated id`. Dependencies on unknown calls are the error `unknown dependency`
and don't hold a call back; calls in or behind a cycle have a null step and the error `cycle`. Arguments that are no JSON
object are the error `arguments` and are written as null: so are NaN and infinite numbers, objects that repeat a key,
and what is nested too deep for Python's parser. Half a surrogate pair is written as its escape. Nulls in identifiers
equal each other; further columns are left out, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from math import isfinite

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, written

#: The tool that a user's turn stands for in a plain conversation, with its fields: (type, required).
REPLY = {"reply": {"prompt": ("string", True), "turn": ("integer", True)}}
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def escaped(text: str) -> str:
    """Halves of surrogate pairs, which UTF-8 can't hold, as JSON escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m.group()):04x}", text)


def as_text(value) -> str:
    return escaped(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def finite(text: str) -> float:
    value = float(text)
    if not isfinite(value):
        raise ValueError(text)
    return value


def without_repeats(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("repeated key")
    return found


def parsed(arguments: str | None) -> tuple[object, str]:
    """The arguments and their canonical text; None and null for what is no JSON."""
    try:
        value = json.loads(arguments or "", parse_float=finite, parse_constant=finite, object_pairs_hook=without_repeats)
        return value, as_text(value)
    except (ValueError, RecursionError):
        return None, "null"


def problems(name: str | None, arguments: object, schemas: dict) -> list[str]:
    if not isinstance(arguments, dict):
        return ["arguments"]
    fields = schemas.get(name)
    if fields is None:
        return ["unknown tool"]
    out = [f"missing {f}" for f, (_, required) in sorted(fields.items()) if required and f not in arguments]
    for f, v in sorted(arguments.items()):
        if f not in fields:
            out.append(f"unknown {f}")
        elif not isinstance(v, TYPES[fields[f][0]]) or isinstance(v, bool) and fields[f][0] in ("integer", "number"):
            out.append(f"type {f}")
    return out


def serialise(schemas: dict):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for row in batch.select(["call_id", "name", "arguments", "content", "errors"]).to_pylist():
                arguments, text = parsed(row["arguments"])
                errors.append(row["errors"] + [escaped(p) for p in problems(row["name"], arguments, schemas)])
                rest = as_text({"id": row["call_id"], "name": row["name"], "result": row["content"]})
                texts.append(f'{{"arguments":{text},{rest[1:]}')
            made = {"errors": pa.array(errors, pa.list_(pa.string())), "json": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([made.get(c, batch.column(c) if c in batch.schema.names else None) for c in LINKED], names=LINKED)

    return emit


LINKED = ["conv_id", "call_id", "turn", "name", "step", "result_turn", "errors", "json"]
SCHEMA = "conv_id long, call_id string, turn long, name string, step long, result_turn long, errors array<string>, json string"


def same(left: str, right: str):
    return F.col(left).eqNullSafe(F.col(right))


def first_results(results: DataFrame) -> DataFrame:
    chosen = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"))
    return chosen.select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_id"), F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), F.lit(True).alias("answered"))


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    ids = calls.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i")).distinct()
    return results.join(ids, same("conv_id", "c") & same("call_id", "i"), "left_anti")


def node(conv: str, call) -> Column:
    """One key for conversation and call; nulls are left out, and so equal each other."""
    return F.to_json(F.struct(F.col(conv).alias("conv_id"), call.alias("call_id")))


def followed(single: DataFrame) -> DataFrame:
    """node, root and distance: chains of calls with one dependency each are followed by doubling.

    A root is no such call. Calls that lead into a cycle of them have a null root.
    """
    most = max(single.count(), 1).bit_length() + 1
    for _ in range(most):
        far = single.select(F.col("node").alias("at"), F.col("root").alias("next"), F.col("distance").alias("more"))
        single = written(single.join(far, single["root"] == far["at"], "left").select("node", F.coalesce("next", "root").alias("root"), (F.col("distance") + F.coalesce("more", F.lit(0))).alias("distance"), F.col("at").isNotNull().alias("moves")))
        if not single.where("moves").limit(1).count():
            break
    return single.select("node", F.when(~F.col("moves"), F.col("root")).alias("root"), "distance")


def steps(calls: DataFrame) -> DataFrame:
    """node, step and whether a dependency is unknown, for every identifier; step is null in and behind cycles."""
    pairs = calls.select("conv_id", node("conv_id", F.col("call_id")).alias("node"), F.explode_outer("after").alias("need"))
    pairs = written(pairs.select("node", F.when(F.col("need").isNotNull(), node("conv_id", F.col("need"))).alias("need")).distinct())
    nodes = pairs.select("node").distinct()
    needs = written(pairs.where("need IS NOT NULL").join(nodes.select(F.col("node").alias("need"), F.lit(True).alias("found")), "need", "left"))
    lost = needs.where("found IS NULL").select("node").distinct().withColumn("lost", F.lit(True))
    edges = needs.where("found").select("node", "need")
    degree = edges.groupBy("node").agg(F.count("*").alias("open"), F.min("need").alias("only"))
    chains = followed(written(degree.where("open = 1").select("node", F.col("only").alias("root"), F.lit(1).cast("long").alias("distance"))))
    chained = chains.select(F.col("node").alias("need"), "root", "distance", F.lit(True).alias("chained"))
    several = edges.join(degree.where("open > 1").select("node"), "node", "left_semi").join(chained, "need", "left")
    several = written(several.select("node", F.when(F.col("chained"), F.col("root")).otherwise(F.col("need")).alias("need"), F.coalesce("distance", F.lit(0)).alias("distance")))
    newest = written(nodes.join(edges, "node", "left_anti").withColumn("step", F.lit(0).cast("long")))
    done, left = newest, written(several.groupBy("node").agg(F.count("*").alias("open"), F.lit(0).cast("long").alias("step")))
    while left.limit(1).count() and newest.limit(1).count():
        met = several.join(newest.select(F.col("node").alias("need"), F.col("step").alias("base")), "need")
        met = met.groupBy("node").agg(F.count("*").alias("closed"), F.max(F.col("base") + F.col("distance")).alias("base"))
        met = left.join(met, "node", "left")
        left = written(met.select("node", (F.col("open") - F.coalesce("closed", F.lit(0))).alias("open"), F.greatest("step", F.coalesce(F.col("base") + 1, F.lit(0))).alias("step")))
        newest = left.where("open = 0").select("node", "step")
        left = left.where("open > 0")
        done = written(done.union(newest))
    ends = chains.join(done.select(F.col("node").alias("root"), "step"), "root").select("node", (F.col("step") + F.col("distance")).alias("step"))
    return nodes.join(done.union(ends), "node", "left").join(lost, "node", "left").select("node", "step", F.coalesce("lost", F.lit(False)).alias("lost"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """One row per call: conv_id, call_id, turn, name, step, result_turn, errors, json.

    calls: conv_id, call_id, turn, name, arguments (JSON), after (ids it needs); results: conv_id, call_id, turn, content.
    """
    calls = calls.select("conv_id", "call_id", "turn", "name", "arguments", "after")
    order = steps(calls).withColumnRenamed("node", "s_node")
    times = calls.groupBy(F.col("conv_id").alias("t_conv"), F.col("call_id").alias("t_id")).agg(F.count("*").alias("times"))
    joined = calls.join(first_results(results), same("conv_id", "r_conv") & same("call_id", "r_id"), "left")
    joined = joined.join(order, node("conv_id", F.col("call_id")) == F.col("s_node"), "left").join(times, same("conv_id", "t_conv") & same("call_id", "t_id"), "left")
    errors = F.array_compact(F.array(
        F.when(F.col("answered").isNull(), "no result"), F.when(F.col("times") > 1, "repeated id"),
        F.when(F.col("lost"), "unknown dependency"), F.when(F.col("step").isNull(), "cycle"),
    ))
    return joined.select("conv_id", "call_id", "turn", "name", "arguments", "step", "result_turn", "content", errors.alias("errors")).mapInArrow(serialise(schemas), SCHEMA)


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User turns as calls of `reply`, each after the conversation's call before it; the next turn, if an assistant's, is the result.

    A call is named after conversation and turn; where the turn is null, after the conversation alone.
    """
    user = conversations.where("role = 'user'").withColumn("call_id", F.concat_ws(":", "conv_id", "turn"))
    before = F.lag("call_id").over(W.partitionBy("conv_id").orderBy("turn", "text"))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn")))
    calls = user.withColumn("after", F.array_compact(F.array(F.when(before != F.col("call_id"), before))))
    calls = calls.select("conv_id", "call_id", "turn", F.lit("reply").alias("name"), arguments.alias("arguments"), "after")
    results = conversations.where("role = 'assistant'").select("conv_id", F.concat_ws(":", "conv_id", F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = turns_as_calls(read(spark, sf_dir, "conversations"))
    linked = link_calls(calls, results, REPLY)
    return linked.select("conv_id", "call_id", "turn", "name", "step", "result_turn", F.array_join("errors", ",").alias("errors"), "json")


SQL = r"""
WITH u AS (
  SELECT conv_id, turn, text, conv_id::VARCHAR || ':' || turn::VARCHAR AS call_id FROM conversations WHERE role = 'user'),
ids AS (SELECT conv_id, call_id, turn, count(*) AS times FROM u GROUP BY ALL),
ordered AS (SELECT conv_id, call_id, times, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step FROM ids),
r AS (
  SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS k FROM conversations WHERE role = 'assistant')
SELECT u.conv_id, u.call_id, u.turn, 'reply' AS name, o.step::BIGINT AS step, r.turn AS result_turn,
       concat_ws(',', CASE WHEN r.turn IS NULL THEN 'no result' END, CASE WHEN o.times > 1 THEN 'repeated id' END, CASE WHEN u.text IS NULL THEN 'missing prompt' END) AS errors,
       '{"arguments":{' || CASE WHEN u.text IS NULL THEN '' ELSE '"prompt":' || to_json(u.text)::VARCHAR || ',' END || '"turn":' || u.turn::VARCHAR || '},"id":"' || u.call_id
         || '","name":"reply","result":' || coalesce(to_json(r.text)::VARCHAR, 'null') || '}' AS json
FROM u JOIN ordered o ON u.conv_id = o.conv_id AND u.call_id = o.call_id
LEFT JOIN r ON r.conv_id = u.conv_id AND r.turn = u.turn + 1 AND r.k = 1
"""
