"""Chat formatting: tool calls linked to their results, in DataFrame functions.

Calls and results are hash-joined by conversation and identifier. Calls that
wait for other calls' results are ordered topologically: a call's depth is the
length of the longest way from a call that waits for none. Calls with a single
prerequisite form chains, which pointer doubling shortens: a chain of n calls
takes log2 n joins on unique keys, and no task ever holds a whole conversation.
Calls with several are settled level by level over what the chains leave. Calls
on a cycle, or that wait for one, are told by a null depth. Arguments are checked against the schema of the
call's name, and everything is written as canonical JSON: keys sorted, no white
space, null fields left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from . import common

KEY = ["conv_id", "call_id"]

#: name of a tool: field: (type, required). A field's type is as schema_of_variant names it.
Schemas = dict[str, dict[str, tuple[str, bool]]]

REPLY: Schemas = {"reply": {"prompt": ("STRING", True), "turn": ("BIGINT", True), "system": ("STRING", False)}}


def argument_faults(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Array of faults, empty if the arguments (a variant, null if no JSON
    object) fit the schema of name: unknown_tool, not_an_object, and
    missing:field, type:field, unknown:field."""
    out = F.when(arguments.isNull(), F.array(F.lit("not_an_object")))
    for tool, fields in schemas.items():
        faults = []
        for field, (kind, required) in sorted(fields.items()):
            value = F.try_variant_get(arguments, f"$.{field}", "variant")
            lacks = value.isNull() | F.is_variant_null(value)
            faults.append(F.when(lacks, F.lit(f"missing:{field}") if required else F.lit(None)).when(F.schema_of_variant(value) != kind, F.lit(f"type:{field}")))
        known = F.array(*(F.lit(f) for f in sorted(fields)))
        extra = F.transform(F.array_sort(F.array_except(F.json_object_keys(F.to_json(arguments)), known)), lambda k: F.concat(F.lit("unknown:"), k))
        out = out.when(name == tool, F.concat(F.array_compact(F.array(*faults)), extra))
    return out.otherwise(F.array(F.lit("unknown_tool")))


def edges(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, after: a row per prerequisite that is a call of the
    conversation. `after` of calls is an identifier or an array of them."""
    waits = F.explode("after") if isinstance(calls.schema["after"].dataType, ArrayType) else F.col("after")
    named = calls.select("conv_id", F.col("call_id").alias("after")).distinct()
    return calls.select(*KEY, waits.alias("after")).where("after is not null").distinct().join(named, ["conv_id", "after"]).select(*KEY, "after")


def _chains(state: DataFrame) -> DataFrame:
    """conv_id, call_id, to, far, done -> the same, with `to` the end of the call's
    chain and `far` its distance. A chain that runs into a cycle is never done."""
    state = common.materialise(state, "call-chains")
    waiting = state.where("not done").count()
    while waiting:
        above = state.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"), F.col("done").alias("ended"))
        ahead = state.where("not done").join(above, ["conv_id", "to"]).select(*KEY, F.col("next").alias("to"), (F.col("far") + F.col("more")).alias("far"), F.col("ended").alias("done"))
        before, state = state, common.materialise(state.where("done").select(*KEY, "to", "far", "done").unionByName(ahead), "call-chains")
        common.discard(before)
        left = state.where("not done").count()
        if left == waiting:
            break
        waiting = left
    return state


def depths(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, after -> conv_id, call_id, depth. Prerequisites that are
    no calls of the conversation count as none. Depth is null for calls that
    wait for a cycle, or are on one."""
    waits = common.materialise(edges(calls), "call-edges")
    known = calls.select(*KEY).distinct()
    several = waits.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("after").alias("after"))
    ends = known.join(several, KEY, "left")
    single = F.coalesce(F.col("n") == 1, F.lit(False))
    chains = _chains(ends.select(*KEY, F.when(single, F.col("after")).otherwise(F.col("call_id")).alias("to"), F.when(single, 1).otherwise(0).alias("far"), (~single).alias("done")))
    joins = common.materialise(several.where("n > 1").select(*KEY), "call-joins")
    # what a call with several prerequisites waits for, and how far above it is
    at = chains.select("conv_id", F.col("call_id").alias("after"), F.when(F.col("done"), F.col("to")).alias("to"), (F.col("far") + 1).alias("far"))
    above = common.materialise(waits.join(joins, KEY, "left_semi").join(at, ["conv_id", "after"]).select(*KEY, "to", "far"), "call-levels")
    settled = common.materialise(chains.where("done and far = 0").join(joins, KEY, "left_anti").select(*KEY, F.lit(0).alias("depth")), "call-depths")
    waiting = joins.count()
    while waiting:
        here = settled.select("conv_id", F.col("call_id").alias("to"), "depth")
        ready = above.join(settled, KEY, "left_anti").join(here, ["conv_id", "to"], "left").groupBy(*KEY).agg(F.max(F.col("far") + F.col("depth")).alias("depth"), F.count("*").alias("n"), F.count("depth").alias("told"))
        ready = common.materialise(ready.where("n = told").select(*KEY, F.col("depth").cast("int").alias("depth")), "call-depths")
        found = ready.count()
        if not found:
            break
        settled, waiting = common.materialise(settled.unionByName(ready), "call-depths"), waiting - found
    end = settled.select("conv_id", F.col("call_id").alias("to"), "depth")
    return chains.join(end, ["conv_id", "to"], "left").select(*KEY, F.when(F.col("done"), F.col("depth") + F.col("far")).alias("depth"))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """calls (conv_id, call_id, turn, name, arguments JSON, after: an identifier
    or an array of them) and results (conv_id, call_id, turn, content) -> a row
    per call and per result.

    Columns: conv_id, turn, kind, call_id, depth (even for calls, odd for their
    results, so that sorting a conversation by depth and turn is an order in
    which nothing comes before what it waits for), linked, faults, json.
    Of calls, or results, with the same identifier in a conversation the one of
    the earliest turn stands for all; later ones stay as rows but are not
    linked. Rows without conv_id or call_id are never linked.
    """
    first = lambda df: df.where("conv_id is not null and call_id is not null").groupBy(*KEY).agg(F.min("turn").alias("first_turn"))
    heads = first(calls).withColumnRenamed("first_turn", "call_turn")
    tails = first(results).withColumnRenamed("first_turn", "result_turn")
    pairs = heads.hint("shuffle_hash").join(tails, KEY, "full")
    # all prerequisites of all rows that stand for the call
    prior = calls.select(*KEY, "turn", "after").join(heads.withColumnRenamed("call_turn", "turn"), [*KEY, "turn"], "left_semi")
    order = pairs.join(depths(prior), KEY, "left")
    parsed = F.try_parse_json(F.col("arguments"))
    parsed = F.when(F.json_object_keys(F.col("arguments")).isNotNull(), parsed)
    call_rows = calls.join(order, KEY, "left").withColumn("parsed", parsed).select(
        "conv_id", "turn", F.lit("call").alias("kind"), "call_id", (F.col("depth") * 2).alias("depth"),
        F.coalesce((F.col("turn") == F.col("call_turn")) & F.col("result_turn").isNotNull(), F.lit(False)).alias("linked"),
        argument_faults(F.col("name"), F.col("parsed"), schemas).alias("faults"),
        F.to_json(F.struct(F.col("parsed").alias("arguments"), F.col("call_id").alias("id"), "name", F.lit("call").alias("type"))).alias("json"),
    )
    result_rows = results.join(order, KEY, "left").select(
        "conv_id", "turn", F.lit("result").alias("kind"), "call_id", (F.col("depth") * 2 + 1).alias("depth"),
        F.coalesce((F.col("turn") == F.col("result_turn")) & F.col("call_turn").isNotNull(), F.lit(False)).alias("linked"),
        F.array().cast("array<string>").alias("faults"),
        F.to_json(F.struct("content", F.col("call_id").alias("id"), F.lit("result").alias("type"))).alias("json"),
    )
    return call_rows.unionByName(result_rows)


def format_conversations(messages: DataFrame, schemas: Schemas = REPLY) -> DataFrame:
    """conversations as calls of the tool `reply`: a user turn is a call, the
    assistant turn right after it its result, and a call waits for the call two
    turns before if that has a result. All other turns are plain messages.

    Rows equal in text too stand once. Of different texts of a turn and role the
    least one is the call or result; the others are plain messages, which the SQL
    leaves out. Null conv_id, turn or role: a plain message. Other columns are
    ignored.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    texts = common.materialise(rows.distinct(), "texts")
    rows = common.materialise(texts.groupBy("conv_id", "turn", "role").agg(F.min("text").alias("text")), "turns")
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    name = lambda turn: F.concat(F.lit("c"), turn.cast("string"))
    users = rows.where(placed & (F.col("role") == "user"))
    answers = rows.where(placed & (F.col("role") == "assistant")).join(users.select("conv_id", (F.col("turn") + 1).alias("turn")), ["conv_id", "turn"], "left_semi")
    ready = answers.select("conv_id", (F.col("turn") + 1).alias("turn"), name(F.col("turn") - 1).alias("after"))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))
    calls = users.join(ready, ["conv_id", "turn"], "left").select("conv_id", name(F.col("turn")).alias("call_id"), "turn", F.lit("reply").alias("name"), arguments.alias("arguments"), "after")
    results = answers.select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    linked = link(calls, results, schemas)
    told = linked.select("conv_id", "turn", F.when(F.col("kind") == "call", "user").otherwise("assistant").alias("role"))
    same = lambda c: F.col(f"m.{c}").eqNullSafe(F.col(f"t.{c}"))
    left = lambda a, b, columns: a.alias("m").join(b.alias("t"), reduce(lambda x, y: x & y, map(same, columns)), "left_anti")
    further = left(texts, rows, ("conv_id", "turn", "role", "text"))
    plain = left(rows, told, ("conv_id", "turn", "role")).unionByName(further)
    plain = plain.select(
        "conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("int").alias("depth"), F.lit(False).alias("linked"),
        F.array().cast("array<string>").alias("faults"), F.to_json(F.struct(F.col("text").alias("content"), "role", F.lit("message").alias("type"))).alias("json"),
    )
    return linked.unionByName(plain)


def op9(spark, sf_dir: str) -> DataFrame:
    found = format_conversations(common.table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "turn", "kind", "call_id", F.col("depth").cast("long").alias("depth"), "linked", F.array_join("faults", ",").alias("faults"), "json")


ORACLE = r"""
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, role, min(text) AS text FROM conversations GROUP BY conv_id, turn, role
), answers AS (
  SELECT a.conv_id, a.turn, a.text FROM turns a WHERE a.role = 'assistant'
    AND EXISTS (SELECT 1 FROM turns u WHERE u.role = 'user' AND u.conv_id = a.conv_id AND u.turn = a.turn - 1)
), calls AS (
  SELECT u.conv_id, u.turn, u.text, EXISTS (SELECT 1 FROM answers a WHERE a.conv_id = u.conv_id AND a.turn = u.turn - 1) AS waits,
         EXISTS (SELECT 1 FROM answers a WHERE a.conv_id = u.conv_id AND a.turn = u.turn + 1) AS linked
  FROM turns u WHERE u.role = 'user'
), depths AS (
  SELECT conv_id, turn, 0 AS depth FROM calls WHERE NOT waits
  UNION ALL
  SELECT c.conv_id, c.turn, d.depth + 1 FROM calls c JOIN depths d ON c.waits AND c.conv_id = d.conv_id AND c.turn = d.turn + 2
)
SELECT c.conv_id, c.turn, 'call' AS kind, 'c' || c.turn AS call_id, CAST(2 * d.depth AS BIGINT) AS depth, c.linked,
       CASE WHEN c.text IS NULL THEN 'missing:prompt' ELSE '' END AS faults,
       '{"arguments":{' || CASE WHEN c.text IS NULL THEN '' ELSE '"prompt":' || CAST(to_json(c.text) AS VARCHAR) || ',' END || '"turn":' || c.turn || '},"id":"c' || c.turn || '","name":"reply","type":"call"}' AS json
FROM calls c JOIN depths d USING (conv_id, turn)
UNION ALL
SELECT a.conv_id, a.turn, 'result', 'c' || (a.turn - 1), CAST(2 * d.depth + 1 AS BIGINT), true, '',
       '{' || CASE WHEN a.text IS NULL THEN '' ELSE '"content":' || CAST(to_json(a.text) AS VARCHAR) || ',' END || '"id":"c' || (a.turn - 1) || '","type":"result"}'
FROM answers a JOIN depths d ON d.conv_id = a.conv_id AND d.turn = a.turn - 1
UNION ALL
SELECT m.conv_id, m.turn, 'message', NULL, NULL, false, '',
       '{' || CASE WHEN m.text IS NULL THEN '' ELSE '"content":' || CAST(to_json(m.text) AS VARCHAR) || ',' END || CASE WHEN m.role IS NULL THEN '' ELSE '"role":' || CAST(to_json(m.role) AS VARCHAR) || ',' END || '"type":"message"}'
FROM turns m
WHERE NOT (m.role IS NOT DISTINCT FROM 'user' AND m.conv_id IS NOT NULL AND m.turn IS NOT NULL)
  AND NOT EXISTS (SELECT 1 FROM answers a WHERE m.role = 'assistant' AND a.conv_id = m.conv_id AND a.turn = m.turn)
"""
