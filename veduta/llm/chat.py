"""Tool-call linking in DataFrame functions alone.

A call is a span ``<tool_call>{"id", "name", "arguments"}</tool_call>`` in a message of any role; a result is a
``<tool_result>{"id", "content"}</tool_result>`` span, or a message of role ``tool`` whose whole text is such an object
(``tool_call_id`` is taken for ``id``).  A tool message of any other text without a span keeps its text and has a
malformed result besides.  A row comes out for every message, call and result.

Texts are parsed once, into a written table of events.  Results are hash-joined to calls by (conv_id, id); of calls with
the same id, the first by position counts.  An id that very many events share is joined by broadcast, so that they need
not meet in one task.  Every edge goes from a call to its results, so the order that places each event at (turn, part,
kind), but a result that precedes its call right behind the call, is topological and otherwise the order of the messages;
events of one place keep their own turn and part as the last keys.  Rows sort within a conversation by ``order_turn,
order_part, order_kind, turn, part``; no conversation is gathered into one task.

Arguments are validated against a table of schemas: known name, required keys present, values of the declared type,
no undeclared keys.  Canonical JSON is that of a parsed variant: keys in order, no white space.  Calls and results that
are malformed, or hold more than these fields, have their text as it was written under ``raw``.

``status``: message | call: answered, unanswered, duplicate, malformed | result: linked, orphan, malformed.
Null text is an empty message; a null conv_id or id links to nothing, nor does a call with a null turn come first unless
all have one.  Calls that share id, turn and part are all first.  Repeated rows give repeated events, an empty table
none; texts are read whole, however long.  Only conv_id, turn, role and text are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veduta.llm.common import cut, grouped_rows, table

#: name -> {argument: (type, required)}; types: string, number, boolean, array, object
SCHEMAS = {
    "search": {"query": ("string", True), "limit": ("number", False)},
    "calculator": {"expression": ("string", True)},
    "weather": {"city": ("string", True), "units": ("string", False)},
    "fetch": {"url": ("string", True), "headers": ("object", False)},
}
_STARTS = {"string": '^"', "number": r"^-?\d", "boolean": "^(true|false)$", "array": r"^\[", "object": r"^\{"}


def _text(x: Column, path: str) -> Column:
    return F.try_variant_get(x, path, "string")


def _json(x: Column, path: str) -> Column:
    return F.to_json(F.try_variant_get(x, path, "variant"))


def schema_error(name: Column, arguments: Column, schemas: dict = SCHEMAS) -> Column:
    """Null if ``arguments`` (canonical JSON text) fits, else what is wrong first."""
    parsed = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    out = F.when(name.isNull(), F.lit("no name")).when(~name.isin(list(schemas)), F.lit("unknown tool"))
    out = out.when(arguments.isNull() | ~arguments.startswith("{"), F.lit("arguments are no object"))
    for tool, fields in schemas.items():
        own = name == tool
        for key, (kind, required) in fields.items():
            value = _json(parsed, f"$.{key}")
            if required:
                out = out.when(own & ~F.array_contains(keys, key), F.lit(f"missing {key}"))
            out = out.when(own & F.array_contains(keys, key) & ~F.coalesce(value.rlike(_STARTS[kind]), F.lit(False)), F.lit(f"{key} is no {kind}"))
        out = out.when(own & (F.size(F.array_except(keys, F.array(*map(F.lit, fields)))) > 0), F.lit("undeclared argument"))
    return out


def linked(messages: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """conv_id, turn, part, kind, call_id, name, status, error, order_turn, order_part, order_kind, json."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    spans = lambda tag: F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    alone = (role == "tool") & (F.size(spans("tool_result")) == 0)
    is_object = alone & F.coalesce(F.to_json(F.try_parse_json(text)).startswith("{"), F.lit(False))
    whole = F.when(alone, F.array(text)).otherwise(spans("tool_result"))
    rows = messages.select("conv_id", "turn", role.alias("role"), text.alias("text"), is_object.alias("is_object"), spans("tool_call").alias("calls"), whole.alias("results"))
    plain = F.trim(F.regexp_replace("text", r"(?s)<(tool_call|tool_result)>.*?</\1>", ""))
    plain = F.when(F.col("is_object"), F.lit("")).otherwise(plain)
    event = lambda kind, place, raw: F.struct(F.lit(kind).alias("kind"), place.cast("int").alias("part"), raw.alias("raw"))
    events = F.concat(
        F.array(event("message", F.lit(0), plain)),
        F.transform("calls", lambda x, i: event("call", i + 1, x)),
        F.transform("results", lambda x, i: event("result", i + 1, x)),
    )
    each = rows.select("conv_id", "turn", "role", F.explode(events).alias("e")).select("conv_id", "turn", "role", "e.*")
    found = each.withColumn("v", F.when(F.col("kind") != "message", F.try_parse_json("raw")))
    call_id = F.coalesce(_text(F.col("v"), "$.id"), F.when(F.col("kind") == "result", _text(F.col("v"), "$.tool_call_id")))
    fields = {"name": _text(F.col("v"), "$.name"), "arguments": _json(F.col("v"), "$.arguments"), "content": _json(F.col("v"), "$.content")}
    found = found.withColumns({"call_id": call_id, "keys": F.json_object_keys("raw"), **fields})
    # What the fields do not hold stays as it was written.
    known = F.when(F.col("kind") == "call", F.array(*map(F.lit, ("arguments", "id", "name"))))
    known = known.when(F.array_contains("keys", "id"), F.array(F.lit("content"), F.lit("id"))).otherwise(F.array(F.lit("content"), F.lit("tool_call_id")))
    more = F.col("call_id").isNull() | ((F.col("kind") == "call") & F.col("name").isNull()) | F.coalesce(F.size(F.array_except("keys", known)) > 0, F.lit(True))
    raw = F.when((F.col("kind") == "message") | more, F.col("raw")).alias("raw")
    error = F.when(F.col("kind") == "call", schema_error(F.col("name"), F.col("arguments"), schemas)).alias("error")
    link = F.when(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull(), F.struct(F.col("conv_id").alias("c"), F.col("call_id").alias("i"))).alias("link")
    parsed = cut(found.select("conv_id", "turn", "role", "kind", "part", "call_id", *fields, raw, error, link))

    here = F.struct(F.col("turn").isNull().alias("none"), "turn", "part").alias("here")
    ends = parsed.where("link IS NOT NULL").select("link", "kind", here)
    calls = ends.where("kind = 'call'").groupBy("link").agg(F.min("here").alias("first"), F.count("*").alias("n_calls"))
    answers = ends.where("kind = 'result'").groupBy("link").agg(F.count("*").alias("n_results"))
    keyed = calls.join(answers.hint("shuffle_hash"), "link", "full")
    keyed = cut(keyed.select("link", "first", F.coalesce("n_results", F.lit(0)).alias("n_results"), (F.coalesce("n_calls", F.lit(0)) + F.coalesce("n_results", F.lit(0))).alias("held")))
    both = grouped_rows(parsed.where("link IS NOT NULL"), keyed, "link", "held", "shuffle_hash").drop("held")
    alone = parsed.where("link IS NULL").withColumns({"first": F.lit(None).cast(keyed.schema["first"].dataType), "n_results": F.lit(0).cast("long")})
    both = both.unionByName(alone).withColumn("here", here)

    first = F.col("first")
    status = (
        F.when(F.col("kind") == "message", "message")
        .when(F.col("call_id").isNull(), "malformed")
        .when((F.col("kind") == "call") & (F.col("here") != first), "duplicate")
        .when(F.col("kind") == "call", F.when(F.col("n_results") > 0, "answered").otherwise("unanswered"))
        .otherwise(F.when(first.isNull(), "orphan").otherwise("linked"))
    )
    early = F.coalesce((F.col("kind") == "result") & (F.col("here") < first), F.lit(False))
    order = [F.when(early, first["turn"]).otherwise(F.col("turn")).alias("order_turn"), F.when(early, first["part"]).otherwise(F.col("part")).alias("order_part"), F.when(F.col("kind") == "result", 1).otherwise(0).alias("order_kind")]
    # A field that is JSON already is put in as it is; keys stand in order.
    quoted = lambda x: F.when(x.isNotNull(), F.regexp_replace(F.to_json(F.struct(x.alias("x"))), r'(?s)^\{"x":(.*)\}$', "$1"))
    field = lambda key, value: F.concat(F.lit(f'"{key}":'), value)
    made = lambda *fields: F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*fields)), ","), F.lit("}"))
    raw = F.col("raw")
    json = (
        F.when(F.col("kind") == "message", made(field("content", quoted(raw)), field("role", quoted(F.col("role")))))
        .when(F.col("kind") == "call", made(field("arguments", F.col("arguments")), field("id", quoted(F.col("call_id"))), field("name", quoted(F.col("name"))), field("raw", quoted(raw))))
        .otherwise(made(field("content", F.col("content")), field("id", quoted(F.col("call_id"))), field("raw", quoted(raw))))
    )
    return both.select("conv_id", "turn", "part", "kind", "call_id", "name", status.alias("status"), "error", *order, json.alias("json"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "conversations"))
