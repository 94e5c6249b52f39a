"""Chat formatting with tool-call linking (operator 9). DataFrame and SQL functions only.

Calls and results are linked by a hash join on the call's identifier, and so is each call with the call
it waits for. The order is topological: a call's level is the length of the chain of calls before it,
found by pointer doubling (as many rounds as the logarithm of the longest chain), so neither a long
conversation nor a common identifier is gathered in one task. Arguments are parsed as variants, checked
against the schema of their tool, and serialised as canonical JSON: no spaces, keys in order.

Repeated identifiers are reduced before any join (the first by turn, then by text, stays; ``copies``
counts them), so copies never multiply.

Defined cases: rows with a null conversation or turn are formatted but neither call nor answer; a call
without a result has a null ``result_turn``, a result without a call no ``call_id``; a call that waits for an
unknown one has level 0 and says so; calls on a cycle and those behind one have a null level; arguments
that are no JSON object are an error and serialised as null; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import settled

_SPEC = "map<string,array<struct<field:string,type:string,required:boolean,least:bigint,most:bigint>>>"
# Tools of the conversations: what is asked of the assistant, and what sets it up.
TOOLS = {
    "answer": [
        {"field": "text", "type": "STRING", "required": True, "least": 1, "most": 300},
        {"field": "turn", "type": "BIGINT", "required": True, "least": 0, "most": 1_000_000},
        {"field": "words", "type": "BIGINT", "required": True, "least": 2, "most": 1_000_000},
    ],
    "setup": [
        {"field": "text", "type": "STRING", "required": True, "least": 1, "most": 100_000},
        {"field": "turn", "type": "BIGINT", "required": True, "least": 0, "most": 0},
    ],
}


def quoted(text: Column) -> Column:
    """A string as JSON."""
    whole = F.to_json(F.struct(text.alias("x")))  # {"x":...}
    return F.when(text.isNull(), F.lit("null")).otherwise(whole.substr(F.lit(6), F.length(whole) - 6))


def argument_errors(arguments: str, name: str, tools: dict) -> Column:
    """What is wrong with a column of JSON arguments: an ordered list, empty if they are valid."""
    spec = "'" + json.dumps(tools).replace("'", "\\'") + "'"
    size = "if(schema_of_variant(v) = 'STRING', length(cast(v as string)), try_cast(cast(v as string) as bigint))"
    return F.expr(f"""
        transform(array(struct(try_variant_get(try_parse_json({arguments}), '$', 'map<string,variant>') AS given,
                               element_at(from_json({spec}, '{_SPEC}'), {name}) AS spec)), c ->
            CASE WHEN c.spec IS NULL THEN array('unknown tool') WHEN c.given IS NULL THEN array('not an object')
            ELSE array_sort(filter(concat(
                transform(c.spec, f -> transform(array(element_at(c.given, f.field)), v ->
                    CASE WHEN v IS NULL THEN if(f.required, concat('missing ', f.field), null)
                         WHEN schema_of_variant(v) <> f.type THEN concat('type ', f.field)
                         WHEN {size} < f.least OR {size} > f.most THEN concat('range ', f.field) END)[0]),
                transform(map_keys(c.given), k -> if(exists(c.spec, f -> f.field = k), null, concat('unknown ', k)))), e -> e IS NOT NULL))
            END)[0]""")


def canonical(arguments: Column) -> Column:
    """JSON with keys in order and without spaces; null for what is no JSON."""
    return F.coalesce(F.to_json(F.try_parse_json(arguments)), F.lit("null"))


def levels(calls: DataFrame) -> DataFrame:
    """call_id, level for calls (call_id, after); null where the chain of ``after`` never ends."""
    known = calls.select(F.col("call_id").alias("known"))
    at = settled(calls.join(known, calls["after"] == known["known"], "left")
                 .select("call_id", F.col("known").alias("after"), F.when(F.col("known").isNull(), 0).otherwise(1).cast("long").alias("level")))
    open_before = None
    while True:
        still_open = at.where("after IS NOT NULL").count()
        # each round ends some of the chains that end at all, so what stays the same runs in circles
        if still_open in (0, open_before):
            return at.select("call_id", F.when(F.col("after").isNull(), F.col("level")).alias("level"))
        open_before = still_open
        on = at.select(F.col("call_id").alias("next"), F.col("after").alias("then"), F.col("level").alias("more"))
        at = settled(at.join(on, at["after"] == on["next"], "left")
                     .select("call_id", F.col("then").alias("after"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")))


def linked(calls: DataFrame, results: DataFrame, tools: dict | None = None) -> DataFrame:
    """Calls (call_id, name, arguments, after, turn) with results (call_id, turn, text).

    Returns call_id, name, arguments (canonical), after, copies, result_turn, results, level, errors.
    """
    first = F.min(F.struct("turn", "name", "arguments", "after")).alias("first")
    once = settled(calls.groupBy("call_id").agg(first, F.count("*").alias("copies"))
                   .select("call_id", "copies", "first.name", "first.arguments", "first.after"))
    answers = results.groupBy("call_id").agg(F.min("turn").alias("result_turn"), F.count("*").alias("results"))
    checked = once.withColumn("errors", argument_errors("arguments", "name", tools or TOOLS)).withColumn("arguments", canonical(F.col("arguments")))
    ordered = levels(once.select("call_id", "after"))
    return checked.join(answers, "call_id", "left").join(ordered, "call_id") \
        .select("call_id", "name", "arguments", "after", "copies", "result_turn", F.coalesce("results", F.lit(0).cast("long")).alias("results"), "level", "errors")


def identifier(conv_id: Column, turn: Column) -> Column:
    return F.concat(conv_id.cast("string"), F.lit(":"), turn.cast("string"))


def formatted(conversations: DataFrame, tools: dict | None = None) -> DataFrame:
    """One row per message, with its place in the order of calls and its canonical JSON.

    A user or system turn is a call to the assistant and waits for the call two turns before; an
    assistant turn is the result of the call of the turn before.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    is_call = F.col("role").isin("user", "system")
    sizes = F.when(F.col("role") == "user", F.concat(F.lit(',"words":'), F.size(F.split(F.coalesce("text", F.lit("")), " ")).cast("string"))).otherwise("")
    calls = rows.where(is_call & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select(
        identifier(F.col("conv_id"), F.col("turn")).alias("call_id"), "turn",
        F.when(F.col("role") == "user", "answer").otherwise("setup").alias("name"),
        F.concat(F.lit('{"turn":'), F.col("turn").cast("string"), F.lit(', "text":'), quoted(F.col("text")), sizes, F.lit("}")).alias("arguments"),
        F.when(F.col("turn") >= 2, identifier(F.col("conv_id"), F.col("turn") - 2)).alias("after"))
    results = rows.where((F.col("role") == "assistant") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()) \
        .select(identifier(F.col("conv_id"), F.col("turn") - 1).alias("call_id"), "turn", "text")
    known = settled(linked(calls, results, tools))
    wanted = rows.withColumn("call_id", F.when(is_call, identifier(F.col("conv_id"), F.col("turn")))
                             .when(F.col("role") == "assistant", identifier(F.col("conv_id"), F.col("turn") - 1)))
    side = known.withColumnRenamed("call_id", "known_id")
    joined = wanted.join(side, wanted["call_id"] == side["known_id"], "left")
    asked = is_call & F.col("known_id").isNotNull()
    errors = F.concat(F.lit("["), F.concat_ws(",", F.transform("errors", lambda e: F.concat(F.lit('"'), e, F.lit('"')))), F.lit("]"))
    line = F.concat(
        F.when(asked, F.concat(F.lit('{"call":{"arguments":'), F.col("arguments"), F.lit(',"errors":'), errors, F.lit(',"id":'), quoted(F.col("known_id")),
                               F.lit(',"name":'), quoted(F.col("name")), F.lit("},")))
        .when(F.col("known_id").isNotNull(), F.concat(F.lit('{"call_id":'), quoted(F.col("known_id")), F.lit(",")))
        .otherwise(F.lit("{")),
        F.lit('"content":'), quoted(F.col("text")), F.lit(',"role":'), quoted(F.col("role")), F.lit("}"))
    return joined.select("conv_id", "turn", "role", F.col("known_id").alias("call_id"), "level",
                         F.when(asked, F.col("result_turn")).alias("result_turn"),
                         F.when(asked, F.size("errors").cast("long")).alias("n_errors"), line.alias("json"))


FORMATTED_SQL = r"""
WITH RECURSIVE messages AS (SELECT conv_id, turn, role, text, conv_id::VARCHAR || ':' || turn::VARCHAR AS own,
    conv_id::VARCHAR || ':' || (turn - 1)::VARCHAR AS asked FROM conversations),
calls AS (
  SELECT own AS call_id, role, text, turn, conv_id,
    CASE WHEN turn >= 2 THEN conv_id::VARCHAR || ':' || (turn - 2)::VARCHAR END AS after
  FROM messages WHERE role IN ('user', 'system')),
chain AS (
  SELECT c.call_id, 0::BIGINT AS level FROM calls c LEFT JOIN calls p ON c.after = p.call_id WHERE p.call_id IS NULL
  UNION ALL
  SELECT c.call_id, chain.level + 1 FROM calls c JOIN chain ON c.after = chain.call_id),
results AS (SELECT asked AS call_id, min(turn) AS result_turn FROM messages WHERE role = 'assistant' GROUP BY asked),
checked AS (
  SELECT c.call_id, c.role, level, result_turn,
    CASE WHEN c.role = 'user' THEN
      list_filter([CASE WHEN length(text) NOT BETWEEN 1 AND 300 THEN 'range text' END,
                   CASE WHEN len(string_split(text, ' ')) < 2 THEN 'range words' END], lambda e: e IS NOT NULL)
    ELSE list_filter([CASE WHEN length(text) NOT BETWEEN 1 AND 100000 THEN 'range text' END,
                      CASE WHEN turn <> 0 THEN 'range turn' END], lambda e: e IS NOT NULL) END AS errors,
    '{"text":' || to_json(text)::VARCHAR || ',"turn":' || turn::VARCHAR
      || CASE WHEN c.role = 'user' THEN ',"words":' || len(string_split(text, ' '))::VARCHAR ELSE '' END || '}' AS arguments
  FROM calls c JOIN chain USING (call_id) LEFT JOIN results USING (call_id))
SELECT m.conv_id, m.turn, m.role, k.call_id, k.level,
  CASE WHEN m.role <> 'assistant' THEN k.result_turn END AS result_turn,
  CASE WHEN m.role <> 'assistant' THEN len(k.errors)::BIGINT END AS n_errors,
  CASE WHEN k.call_id IS NULL THEN '{'
    WHEN m.role = 'assistant' THEN '{"call_id":"' || k.call_id || '",'
    ELSE '{"call":{"arguments":' || k.arguments || ',"errors":['
      || coalesce(array_to_string(list_transform(k.errors, lambda e: '"' || e || '"'), ','), '') || '],"id":"' || k.call_id
      || '","name":"' || CASE WHEN m.role = 'user' THEN 'answer' ELSE 'setup' END || '"},' END
  || '"content":' || to_json(m.text)::VARCHAR || ',"role":"' || m.role || '"}' AS json
FROM messages m LEFT JOIN checked k ON k.call_id = CASE WHEN m.role = 'assistant' THEN m.asked ELSE m.own END
"""
