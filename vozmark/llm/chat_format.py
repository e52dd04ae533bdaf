"""Chat formatting with tool calls linked to their results.

Messages hold calls and results as JSON objects in ``<tool_call>...</tool_call>`` and
``<tool_result>...</tool_result>``: a call has id, name and arguments, a result has id and
content. Calls and results are hash-joined by conversation and identifier. A call depends
on those whose identifiers stand in its arguments as ``$ref:ID``; its level is one more
than the highest of these. Arguments are validated against the tools' schemas, and every
part is serialised as canonical JSON: keys in order, no white space.

One row is given for each part of a message, not for each conversation, so that a
conversation of any length is never gathered in one task; (conv_id, turn, level, part)
is the order of a conversation, calls that others of the turn need standing first.

Cases: null text or role counts as empty. Parts that are no JSON object, or lack an id, have
status ``malformed`` and their raw text as content. A repeated id is linked once: its first
call in the order of (turn, part) with its first result; later ones are ``duplicate_id``.
Calls without a result are ``no_result``, results without a call ``no_call``; a reference
to no call is ``missing_reference``; calls that wait for each other are ``cycle``, with level
-1. Rows that repeat whole repeat their plain part, while their calls are duplicates. A null
conv_id is a conversation of its own. Columns other than those named are ignored.
Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, attach, pick

#: tool -> parameter -> (type, required)
TOOLS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "fetch": {"url": ("string", True)},
    "calculate": {"expression": ("string", True), "precision": ("integer", False)},
    "translate": {"text": ("string", True), "to": ("string", True), "formal": ("boolean", False)},
}
_CALL, _RESULT = r"(?s)<tool_call>(.*?)</tool_call>", r"(?s)<tool_result>(.*?)</tool_result>"
_ANY = r"(?s)<tool_call>.*?</tool_call>|<tool_result>.*?</tool_result>"


def _fits(kind: str, wanted: str) -> str:
    """SQL: the type a variant has is one that the schema's type allows."""
    return (
        f"CASE {wanted} WHEN 'string' THEN {kind} = 'STRING' WHEN 'boolean' THEN {kind} = 'BOOLEAN'"
        f" WHEN 'integer' THEN {kind} = 'BIGINT'"
        f" WHEN 'number' THEN {kind} = 'BIGINT' OR {kind} = 'DOUBLE' OR startswith({kind}, 'DECIMAL')"
        f" WHEN 'array' THEN startswith({kind}, 'ARRAY') WHEN 'object' THEN startswith({kind}, 'OBJECT')"
        " ELSE true END"
    )


def parts(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, part, kind, body): the plain text, calls and results of messages."""
    rows = pick(messages, conv_id="long", turn="long", role="string", text="string").select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    one = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("body"))
    split = F.concat(
        F.array(one("message")(F.regexp_replace("text", _ANY, ""))),
        F.when(F.col("text").contains("<tool_call>"), F.transform(F.regexp_extract_all("text", F.lit(_CALL), 1), one("call"))).otherwise(F.array()),
        F.when(F.col("text").contains("<tool_result>"), F.transform(F.regexp_extract_all("text", F.lit(_RESULT), 1), one("result"))).otherwise(F.array()),
    )
    return rows.select("conv_id", "turn", "role", F.posexplode(split).alias("part", "p")).select(
        "conv_id", "turn", "role", "part", "p.kind", "p.body"
    )


def _field(name: str, kind: str) -> Column:
    return F.expr(f"try_variant_get(v, '$.{name}', '{kind}')")


def levels(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, call_id, level, lost) of calls (conv, call_id, refs).

    Round by round: calls whose last need got its level in the round before get theirs, which
    is the round's number. Those left when nothing moves wait for each other. The rounds are as many
    as the longest chain of references; each adds its calls to one table, and the references
    still open are written anew when half of them are settled.
    """
    known = calls.select("conv", "call_id")
    needs = calls.select("conv", "call_id", F.explode("refs").alias("need"))
    there = known.withColumnRenamed("call_id", "need").withColumn("found", F.lit(True))
    edges = scratch.keep(needs.join(there, ["conv", "need"], "left"))
    lost = edges.where("found is null").groupBy("conv", "call_id").agg(F.lit(True).alias("lost"))
    waiting = edges.where("found").drop("found")
    first = known.join(waiting.select("conv", "call_id").distinct(), ["conv", "call_id"], "left_anti")
    done = scratch.keep(first.withColumn("level", F.lit(0)))
    written, n_open, level = None, waiting.count(), 0
    while n_open:
        level += 1
        settled = done.select("conv", F.col("call_id").alias("need"))
        left = waiting.join(settled, ["conv", "need"], "left_anti")
        open_calls = left.select("conv", "call_id").distinct()
        ready = waiting.select("conv", "call_id").distinct().join(open_calls, ["conv", "call_id"], "left_anti")
        ready = ready.join(done.select("conv", "call_id"), ["conv", "call_id"], "left_anti")
        ready = scratch.keep(ready.withColumn("level", F.lit(level)))
        n_ready = ready.count()
        if not n_ready:
            break
        n_left = left.count()
        if 2 * n_left <= n_open:
            before, waiting, n_open = written, scratch.keep(left), n_left
            written = waiting
            if before is not None:
                scratch.drop(before)
        done = scratch.append(done, ready)
        scratch.drop(ready)
    return known.join(done, ["conv", "call_id"], "left").join(lost, ["conv", "call_id"], "left").select(
        "conv", "call_id", F.coalesce("level", F.lit(-1)).alias("level"), F.coalesce("lost", F.lit(False)).alias("lost")
    )


def argument_errors(tools: dict) -> Column:
    """Errors of a call to ``name`` whose arguments have types ``kinds``, as strings."""
    unknown = F.array(F.concat(F.lit("unknown_tool:"), F.coalesce("name", F.lit(""))))
    cases = None
    for tool, params in sorted(tools.items()):
        spec = "map(" + ", ".join(f"'{p}', '{t}'" for p, (t, _) in sorted(params.items())) + ")"
        must = "array(" + ", ".join(f"'{p}'" for p, (_, r) in sorted(params.items()) if r) + ")"
        must = must if must != "array()" else "CAST(array() AS ARRAY<STRING>)"
        errors = F.expr(
            f"concat(transform(filter({must}, p -> NOT map_contains_key(kinds, p)), p -> concat('missing:', p)),"
            " transform(filter(array_sort(map_keys(kinds)), p ->"
            f" NOT map_contains_key({spec}, p)), p -> concat('unknown:', p)),"
            " transform(filter(array_sort(map_keys(kinds)), p ->"
            f" map_contains_key({spec}, p) AND NOT ({_fits('kinds[p]', f'{spec}[p]')})), p -> concat('type:', p)))"
        )
        cases = (F.when if cases is None else cases.when)(F.col("name") == tool, errors)
    return unknown if cases is None else cases.otherwise(unknown)


def format_chats(messages: DataFrame, tools: dict | None = None) -> DataFrame:
    """(conv_id, turn, level, part, kind, call_id, status, errors, json) of every part."""
    scratch = Scratch(messages.sparkSession)
    every = parts(messages)
    plain = every.where("kind = 'message'").select(
        "conv_id",
        "turn",
        F.lit(0).alias("level"),
        "part",
        "kind",
        F.lit(None).cast("string").alias("call_id"),
        F.lit("ok").alias("status"),
        F.lit("").alias("errors"),
        F.to_json(F.struct(F.col("body").alias("content"), "role")).alias("json"),
    )
    tooled = scratch.keep(
        every.where("kind <> 'message'")
        .withColumn("v", F.expr("try_parse_json(body)"))
        .withColumn("call_id", _field("id", "string"))
        .withColumn("name", _field("name", "string"))
        .withColumn("args", F.expr("to_json(try_variant_get(v, '$.arguments', 'variant'))"))
        .withColumn("content", F.expr("to_json(try_variant_get(v, '$.content', 'variant'))"))
        .withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
        .drop("v")
    )
    if tooled.isEmpty():
        return plain
    good = tooled.where("call_id is not null")
    first = good.groupBy("kind", "conv", "call_id").agg(
        F.min(F.struct("turn", "part", "role", "body")).alias("first"), F.count("*").alias("all")
    )
    marked = attach(good, scratch.keep(first), ["kind", "conv", "call_id"], "all").drop("all").withColumn(
        "again", ~F.struct("turn", "part", "role", "body").eqNullSafe(F.col("first"))
    )
    # Whole repeats of a row share their place; only one of them is the first.
    marked = scratch.keep(
        marked.groupBy(*[c for c in marked.columns if c != "first"]).agg(F.count("*").alias("times"))
    )
    single = marked.where("not again")
    calls = single.where("kind = 'call'").withColumn("refs", F.expr(r"array_distinct(regexp_extract_all(coalesce(args, ''), '\\$ref:([A-Za-z0-9_.-]+)', 1))"))
    results = single.where("kind = 'result'")
    placed = levels(calls.select("conv", "call_id", "refs"), scratch)
    kinds = F.expr("transform_values(arguments, (k, v) -> schema_of_variant(v))")
    errors = argument_errors(TOOLS if tools is None else tools)
    has_result = results.select("conv", "call_id", F.lit(True).alias("answered"))
    linked_calls = (
        calls.join(placed, ["conv", "call_id"])
        .join(has_result, ["conv", "call_id"], "left")
        .withColumn("arguments", F.expr("from_json(args, 'map<string,variant>')"))
        .withColumn("kinds", F.coalesce(kinds, F.expr("CAST(map() AS MAP<STRING,STRING>)")))
        .withColumn("wrong", errors)
        .select(
            "conv_id", "turn", "level", "part", "kind", "call_id",
            F.when(F.col("lost"), "missing_reference")
            .when(F.col("level") < 0, "cycle")
            .when(F.size("wrong") > 0, "invalid")
            .when(F.col("answered"), "ok")
            .otherwise("no_result")
            .alias("status"),
            F.array_join("wrong", ",").alias("errors"),
            F.concat(
                F.lit('{"arguments":'), F.coalesce("args", F.lit("{}")),
                F.lit(',"id":'), F.to_json(F.struct(F.col("call_id").alias("i"))).substr(F.lit(6), F.lit(1 << 30)),
            ).alias("head"),
            F.to_json(F.struct(F.coalesce("name", F.lit("")).alias("name"))).alias("tail"),
        )
    )
    close = F.expr("concat(substring(head, 1, length(head) - 1), ',', substring(tail, 2))")
    linked_calls = linked_calls.withColumn("json", close).drop("head", "tail")
    known = placed.select("conv", "call_id", "level")
    linked_results = results.join(known, ["conv", "call_id"], "left").select(
        "conv_id", "turn", F.coalesce("level", F.lit(0)).alias("level"), "part", "kind", "call_id",
        F.when(F.col("level").isNull(), "no_call").otherwise("ok").alias("status"),
        F.lit("").alias("errors"),
        F.concat(
            F.lit('{"content":'), F.coalesce("content", F.lit("null")), F.lit(","),
            F.to_json(F.struct(F.col("call_id").alias("id"))).substr(F.lit(2), F.lit(1 << 30)),
        ).alias("json"),
    )
    raw = lambda df, status: df.select(
        "conv_id", "turn", F.lit(0).alias("level"), "part", "kind", "call_id", F.lit(status).alias("status"),
        F.lit("").alias("errors"), F.to_json(F.struct(F.col("body").alias("content"), "role")).alias("json"),
    )
    extra = marked.withColumn("n", F.when(F.col("again"), F.col("times")).otherwise(F.col("times") - 1)).where("n > 0")
    extra = extra.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return (
        plain.unionByName(linked_calls)
        .unionByName(linked_results)
        .unionByName(raw(extra, "duplicate_id"))
        .unionByName(raw(tooled.where("call_id is null"), "malformed"))
    )


def op4_chat_format(messages: DataFrame) -> DataFrame:
    return format_chats(messages)
