"""Tool calls of conversations: linked with their results, ordered by what they build on, validated, in canonical JSON.

Everything is a DataFrame operation. Messages are (conv_id, turn, role, text, tool_calls, tool_call_id); tool_calls is an
array of (id, name, arguments), arguments being JSON text, and a message with a tool_call_id is the result of that call.

1. Calls and results are reduced to one row for each identifier and hash-joined on conversation and identifier.
2. A call builds on another if its arguments cite it as {"$ref": "<id>"}. Calls get levels in topological order: level 0
   builds on nothing, every other call lies one above the highest call it cites. Each round takes the calls whose
   last open citation was resolved, so there are as many rounds as levels, on the citations that are left.
3. Arguments are checked against the tool's schema: type, enum, minimum, maximum and maxLength of properties, required,
   additionalProperties. A citation stands for a value of any type.
4. Calls are written as JSON with sorted keys, without white space and with numbers in one form (by Spark's VARIANT).

Defined cases: of calls that repeat an identifier the first by turn and place counts, of results the first by turn and
text, and n_calls and n_results say how many there were; a call without an identifier or conversation is linked with
nothing; arguments that are no JSON object, repeat a key or exceed the size of a VARIANT are the error `json` and
written as null; an unknown tool is the error `tool`; a citation of no call is `reference:<id>`, calls on a circle have
no level and the error `cycle`; a result without a call is a row without a name. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.sources.stage import staged

SCHEMA = ("struct<properties:map<string,struct<type:string,enum:array<string>,minimum:double,maximum:double,"
          "maxLength:int>>,required:array<string>,additionalProperties:boolean>")
CITED = r'"\$ref"\s*:\s*"((?:[^"\\]|\\.)*+)"'
MAX_LEVELS = 10_000


def calls_of(messages: DataFrame) -> DataFrame:
    """(conv_id, id, turn, call_no, name, arguments, n_calls): the first call of each identifier."""
    every = messages.select("conv_id", "turn", F.posexplode("tool_calls").alias("call_no", "call")).select(
        "conv_id", F.col("call.id").alias("id"), "turn", "call_no", "call.name", "call.arguments")
    own = F.struct("turn", "call_no", "name", "arguments")
    named = every.filter("conv_id is not null and id is not null").groupBy("conv_id", "id").agg(
        F.min(own).alias("own"), F.count("*").alias("n_calls")).select("conv_id", "id", "own.*", "n_calls")
    unnamed = every.filter("conv_id is null or id is null").withColumn("n_calls", F.lit(1).cast("long"))
    return named.unionByName(unnamed)


def results_of(messages: DataFrame) -> DataFrame:
    """(conv_id, id, result_turn, result, n_results): the first result for each identifier."""
    return messages.filter("tool_call_id is not null").groupBy("conv_id", F.col("tool_call_id").alias("id")).agg(
        F.min(F.struct("turn", "text")).alias("own"), F.count("*").alias("n_results")).select(
        "conv_id", "id", F.col("own.turn").alias("result_turn"), F.col("own.text").alias("result"), "n_results")


def levels(edges: DataFrame) -> DataFrame:
    """(conv_id, id, level) of the calls that cite others; edges (conv_id, id, cited) lead to calls that exist.

    Calls on a circle, or that build on one, are left out.
    """
    edges = staged(edges.distinct(), "citations")
    citing = edges.select("conv_id", F.col("id").alias("cited")).distinct()
    ready = edges.select("conv_id", "cited").distinct().join(citing, ["conv_id", "cited"], "left_anti")
    out = None
    for level in range(1, MAX_LEVELS):
        left = staged(edges.join(ready, ["conv_id", "cited"], "left_anti"), "citations")
        solved = edges.join(ready, ["conv_id", "cited"], "left_semi").select("conv_id", "id").distinct()
        done = staged(solved.join(left.select("conv_id", "id").distinct(), ["conv_id", "id"], "left_anti"), "ready")
        part = done.withColumn("level", F.lit(level))
        out = part if out is None else out.union(part)
        if done.isEmpty():
            return out
        edges, ready = left, done.select("conv_id", F.col("id").alias("cited"))
    raise RuntimeError(f"more than {MAX_LEVELS} levels")


def _kind(value: Column) -> Column:
    """The JSON type of a variant."""
    said = F.schema_of_variant(value)
    return (F.when(said == "STRING", "string").when(said == "BIGINT", "integer").when(said == "BOOLEAN", "boolean")
            .when(said == "VOID", "null").when(said.startswith("OBJECT"), "object")
            .when(said.startswith("ARRAY"), "array").otherwise("number"))


def _value_errors(entry: Column, schema: Column) -> Column:
    """Names of what is wrong with one argument; entry is (key, value)."""
    key, value = entry["key"], entry["value"]
    rule = F.try_element_at(schema["properties"], key)
    kind, number = _kind(value), F.try_variant_get(value, "$", "double")
    text = F.try_variant_get(value, "$", "string")
    cites = F.coalesce(F.try_variant_get(value, "$['$ref']", "string").isNotNull(), F.lit(False)) & (kind == "object")
    fits = (kind == rule["type"]) | ((rule["type"] == "number") & (kind == "integer"))
    is_number = kind.isin("integer", "number")
    said = lambda word, when: F.when(when, F.concat(F.lit(word + ":"), key))
    unknown = said("unknown", rule.isNull() & (schema["additionalProperties"] == F.lit(False)))
    return F.when(cites, F.array(unknown)).otherwise(F.array(
        unknown, said("type", ~fits), said("enum", ~F.array_contains(rule["enum"], text)),
        said("range", is_number & ((number < rule["minimum"]) | (number > rule["maximum"]))),
        said("length", (kind == "string") & (F.length(text) > rule["maxLength"]))))


def argument_errors(arguments: Column, parsed: Column, schema: Column) -> Column:
    """Sorted names of all that is wrong with a call's arguments; an unknown tool has a null schema."""
    entries = F.map_entries(F.from_json(arguments, "map<string,variant>"))
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    wrong = F.flatten(F.transform(entries, lambda e: _value_errors(e, schema)))
    keys = F.transform(entries, lambda e: e["key"])
    missing = F.transform(F.filter(schema["required"], lambda k: ~F.array_contains(keys, k)),
                          lambda k: F.concat(F.lit("missing:"), k))
    nothing = F.array().cast("array<string>")
    return (F.when(~is_object, F.array(F.lit("json"))).when(schema.isNull(), F.array(F.lit("tool")))
            .otherwise(F.array_compact(F.concat(F.coalesce(wrong, nothing), F.coalesce(missing, nothing)))))


def linked_calls(messages: DataFrame, tools: DataFrame) -> DataFrame:
    """One row for each identifier of a call or result; tools is (name, schema), schema being JSON text.

    (conv_id, call_id, turn, call_no, name, level, status, valid, errors, canonical, n_calls, n_results); turn and
    call_no order the calls of one level.
    """
    calls = staged(calls_of(messages), "calls")
    cited = calls.filter("conv_id is not null and id is not null").select(
        "conv_id", "id", F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(CITED), 1))).alias("cited"))
    known = calls.select("conv_id", F.col("id").alias("cited"), F.lit(True).alias("known"))
    cited = staged(cited.join(known, ["conv_id", "cited"], "left"), "cited")
    dangling = cited.filter("known is null").groupBy("conv_id", "id").agg(
        F.collect_set(F.concat(F.lit("reference:"), "cited")).alias("dangling"))
    edges = cited.filter("known").select("conv_id", "id", "cited")
    citing = edges.select("conv_id", "id").distinct().withColumn("cites", F.lit(True))
    level = levels(edges)

    schemas = tools.groupBy("name").agg(F.min("schema").alias("schema")).select(
        "name", F.from_json("schema", SCHEMA).alias("schema"))
    parsed = calls.withColumn("parsed", F.try_parse_json("arguments")).join(schemas, "name", "left")
    checked = parsed.withColumn("wrong", argument_errors(F.col("arguments"), F.col("parsed"), F.col("schema")))
    checked = (checked.join(dangling, ["conv_id", "id"], "left").join(citing, ["conv_id", "id"], "left")
               .join(level, ["conv_id", "id"], "left"))
    rank = F.when(F.col("cites"), F.col("level")).otherwise(F.lit(0))
    errors = F.array_sort(F.concat(
        "wrong", F.coalesce("dangling", F.array().cast("array<string>")),
        F.when(rank.isNull(), F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>"))))
    checked = checked.select("conv_id", "id", "turn", "call_no", "name", "parsed", rank.alias("level"),
                             errors.alias("errors"), "n_calls")
    both = checked.join(results_of(messages).hint("shuffle_hash"), ["conv_id", "id"], "full")
    is_call = F.col("n_calls").isNotNull()
    status = (F.when(~is_call, "orphan result").when(F.col("n_results").isNull(), "no result")
              .when(F.col("result_turn") < F.col("turn"), "early result").otherwise("linked"))
    canonical = F.to_json(F.struct(F.col("parsed").alias("arguments"), "id", "name", "result"))
    return both.select(
        "conv_id", F.col("id").alias("call_id"), "turn", "call_no", "name", "level", status.alias("status"),
        (is_call & (F.size("errors") == 0)).alias("valid"), F.array_join("errors", ",").alias("errors"),
        canonical.alias("canonical"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"))


# ---- the table conversations as tool calls

#: The tools that conversations are read with.
TOOLS = {
    "search": '{"properties":{"query":{"type":"string"},"limit":{"type":"integer","minimum":1,"maximum":50}},'
              '"required":["query"],"additionalProperties":false}',
    "count": '{"properties":{"query":{"type":"string"},"limit":{"type":"number","minimum":0,"maximum":40},'
             '"after":{"type":"object"}},"required":["query"],"additionalProperties":false}',
    "translate": '{"properties":{"query":{"type":"string","maxLength":400},"limit":{"type":"integer"}},'
                 '"required":["query"]}',
}


def as_messages(conversations: DataFrame) -> DataFrame:
    """Conversations as messages with tool calls: an assistant's turn calls a tool with its text, and the user's next turn
    is the result. The text's length chooses the tool and the limit; `count` cites the assistant's turn before."""
    size = F.coalesce(F.length("text"), F.lit(0))
    name_of = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    name = F.get(F.array(*[F.lit(x) for x in TOOLS]), size % 3)
    after = F.when(size % 3 == 1, F.struct(name_of(F.col("turn") - 2).alias("$ref")))
    arguments = F.to_json(F.struct(F.col("text").alias("query"), (size % 60).alias("limit"), after.alias("after")))
    call = F.struct(name_of(F.col("turn")).alias("id"), name.alias("name"), arguments.alias("arguments"))
    return conversations.select(
        "conv_id", "turn", "role", "text", F.when(F.col("role") == "assistant", F.array(call)).alias("tool_calls"),
        F.when((F.col("role") == "user") & (F.col("turn") > 0), name_of(F.col("turn") - 1)).alias("tool_call_id"))


def tool_table(spark) -> DataFrame:
    return spark.range(1).select(F.explode(F.create_map(*[F.lit(x) for t in TOOLS.items() for x in t])).alias("name", "schema"))


#: `linked_calls` over the messages of the table conversations, in DuckDB's SQL.
SQL = """
WITH RECURSIVE sized AS (SELECT *, coalesce(length(text), 0) AS n FROM conversations),
calls AS (
  SELECT conv_id, turn, n, text, 'call_' || conv_id || '_' || turn AS id, ['search', 'count', 'translate'][n % 3 + 1] AS name,
    CASE WHEN n % 3 = 1 THEN 'call_' || conv_id || '_' || (turn - 2) END AS cited
  FROM sized WHERE role = 'assistant'),
results AS (
  SELECT conv_id, turn AS result_turn, text AS result, 'call_' || conv_id || '_' || (turn - 1) AS id
  FROM sized WHERE role = 'user' AND turn > 0),
ranked AS (
  SELECT c.conv_id, c.id, 0 AS level, d.id IS NULL AND c.cited IS NOT NULL AS dangling
  FROM calls c LEFT JOIN calls d ON d.conv_id = c.conv_id AND d.id = c.cited WHERE d.id IS NULL
  UNION ALL
  SELECT c.conv_id, c.id, r.level + 1, false FROM ranked r JOIN calls c ON c.conv_id = r.conv_id AND c.cited = r.id),
judged AS (
  SELECT c.*, level, list_sort(list_filter([
    CASE WHEN dangling THEN 'reference:' || cited END,
    CASE WHEN text IS NULL THEN 'missing:query' END,
    CASE WHEN (name = 'search' AND n % 60 NOT BETWEEN 1 AND 50) OR (name = 'count' AND n % 60 > 40) THEN 'range:limit' END,
    CASE WHEN name = 'translate' AND n > 400 THEN 'length:query' END], lambda x: x IS NOT NULL)) AS errors
  FROM calls c JOIN ranked USING (conv_id, id))
SELECT conv_id, id AS call_id, turn, CASE WHEN turn IS NOT NULL THEN 0 END::INTEGER AS call_no, name, level,
  CASE WHEN turn IS NULL THEN 'orphan result' WHEN result_turn IS NULL THEN 'no result' ELSE 'linked' END AS status,
  turn IS NOT NULL AND len(errors) = 0 AS valid, array_to_string(errors, ',') AS errors,
  '{' || CASE WHEN turn IS NULL THEN '' ELSE '"arguments":{'
    || CASE WHEN cited IS NULL THEN '' ELSE '"after":{"$ref":"' || cited || '"},' END || '"limit":' || (n % 60)
    || CASE WHEN text IS NULL THEN '' ELSE ',"query":' || to_json(text)::VARCHAR END || '},' END || '"id":"' || id || '"'
    || CASE WHEN turn IS NULL THEN '' ELSE ',"name":"' || name || '"' END
    || CASE WHEN result IS NULL THEN '' ELSE ',"result":' || to_json(result)::VARCHAR END || '}' AS canonical,
  (turn IS NOT NULL)::BIGINT AS n_calls, (result_turn IS NOT NULL)::BIGINT AS n_results
FROM judged FULL JOIN results USING (conv_id, id)
"""
