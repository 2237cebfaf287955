"""Chat formatting with tool-call linking.

Messages become events: plain messages, calls and results. Results are hash-joined to calls by
(conversation, identifier); calls that wait for later calls get levels by joins, round by round;
arguments are validated against schemas; every event is serialised as canonical JSON and placed.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored

#: A tool's arguments: name -> (JSON type, whether it must be there), or a schema in these words of JSON
#: Schema: type (one or a list), properties, required, additionalProperties, items, enum.
Schemas = dict[str, dict]
#: The one tool of plain conversations: a user's turn asks, the next assistant's turn answers.
EXCHANGE: Schemas = {"answer": {"prompt": ("string", True), "turn": ("integer", True)}}
#: Variant types that stand for each JSON type.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID"}
CALLS = "struct<tool_calls: array<struct<id: string, name: string, arguments: string, after: array<string>>>>"
RESULT = "struct<tool_call_id: string, content: string>"


def events(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, nth, role, kind, call_id, name, arguments, after, content.

    An assistant's text that is a JSON object with ``tool_calls`` gives a call for each of them, a
    tool's with ``tool_call_id`` a result; anything else is a message. In a conversation without
    such texts a user's turn is a call of ``answer`` and an assistant's turn the result of the turn
    before it: see ``exchanges``. Null texts and roles are messages, repeated rows are events of their
    own, an empty table gives no events; other columns are not read.
    """
    d = messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    brace = F.coalesce(F.ltrim(F.col("text")).startswith("{"), F.lit(False))
    calls = F.when(brace & (F.col("role") == "assistant"), F.from_json("text", CALLS)["tool_calls"])
    result = F.when(brace & (F.col("role") == "tool"), F.from_json("text", RESULT))
    d = d.withColumn("_calls", calls).withColumn("_result", result)
    none = F.lit(None).cast("string")
    one = F.array(F.struct(F.lit(None).cast("string").alias("id"), none.alias("name"), none.alias("arguments"), F.lit(None).cast("array<string>").alias("after")))
    d = d.select("*", F.posexplode(F.when(F.coalesce(F.size("_calls"), F.lit(0)) > 0, F.col("_calls")).otherwise(one)).alias("nth", "_c"))
    called, got = F.col("_c.id").isNotNull() | F.col("_c.name").isNotNull(), F.col("_result.tool_call_id").isNotNull()
    kind = F.when(called, "call").when(got, "result").otherwise("message")
    return d.select(
        "conv_id", "turn", "nth", "role", kind.alias("kind"), F.coalesce("_c.id", "_result.tool_call_id").alias("call_id"),
        "_c.name", "_c.arguments", "_c.after", F.when(called, none).when(got, F.col("_result.content")).otherwise(F.col("text")).alias("content"),
    )


def exchanges(found: DataFrame) -> DataFrame:
    """Events with the plain turns of users and assistants as calls and results of ``answer``."""
    plain = F.col("kind") == "message"
    asks, replies = plain & (F.col("role") == "user"), plain & (F.col("role") == "assistant")
    name = lambda turn: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), turn.cast("string"))
    arguments = F.to_json(F.struct(F.col("content").alias("prompt"), F.col("turn")))
    return found.select(
        "conv_id", "turn", "nth", "role", F.when(asks, "call").when(replies, "result").otherwise(F.col("kind")).alias("kind"),
        F.when(asks, name(F.col("turn"))).when(replies, name(F.col("turn") - 1)).otherwise(F.col("call_id")).alias("call_id"),
        F.when(asks, "answer").otherwise(F.col("name")).alias("name"), F.when(asks, arguments).otherwise(F.col("arguments")).alias("arguments"),
        "after", F.when(asks, F.lit(None).cast("string")).otherwise(F.col("content")).alias("content"),
    )


def _rule(fields: dict) -> dict:
    """The schema of a tool's arguments; fields with a pair each take nothing beside them."""
    if not all(isinstance(x, tuple) for x in fields.values()):
        return fields
    needed = [name for name, (_, there) in fields.items() if there]
    return {"properties": {name: {"type": kind} for name, (kind, _) in fields.items()}, "required": needed, "additionalProperties": False}


def _broken(value: Column, rule: dict, path: str) -> Column:
    """The faults of a variant that is there, each with its place: a dot before a field, [] for an array's elements."""
    none, kind = F.array().cast("array<string>"), F.schema_of_variant(value)
    fault = lambda broken, what, at: F.when(broken, F.array(F.lit(f"{what}:{at}"))).otherwise(none)
    found = []
    if "enum" in rule:
        found.append(fault(~F.to_json(value).isin([json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for x in rule["enum"]]), "enum", path))
    fields, is_object = rule.get("properties", {}), kind.startswith("OBJECT")
    for name in sorted({*fields, *rule.get("required", [])}):
        at, quote = f"{path}.{name}" if path else name, '"' if "'" in name else "'"
        part = F.try_variant_get(value, f"$[{quote}{name}{quote}]", "variant")
        own = fields.get(name, {})
        null_fits = "null" in _kinds(own)
        there = F.coalesce(part.isNotNull() & (F.lit(null_fits) | (F.schema_of_variant(part) != "VOID")), F.lit(False))
        found.append(F.when(there, _broken(part, own, at)).otherwise(fault(is_object & F.lit(name in rule.get("required", [])), "missing", at)))
    if rule.get("additionalProperties", True) is False:
        names = F.coalesce(F.json_object_keys(F.to_json(value)), none)
        known = F.array(*[F.lit(name) for name in sorted(fields)]).cast("array<string>")
        found.append(F.transform(F.array_except(names, known), lambda k: F.concat(F.lit(f"unknown:{path}." if path else "unknown:"), k)))
    if "items" in rule:
        parts = F.when(kind.startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))
        found.append(F.coalesce(F.flatten(F.transform(parts, lambda x: _broken(x, rule["items"], f"{path}[]"))), none))
    inner = F.array_distinct(F.concat(none, *found))
    if not _kinds(rule):
        return inner
    return F.when(~kind.rlike(f"^({'|'.join(TYPES[k] for k in _kinds(rule))})$"), F.array(F.lit(f"type:{path}"))).otherwise(inner)


def _kinds(rule: dict) -> list[str]:
    kind = rule.get("type", [])
    return [kind] if isinstance(kind, str) else list(kind)


def faults(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's arguments, sorted; an empty list if nothing is.

    ``json``: they are no JSON object; ``tool``: there is no such tool; else a word and a place each,
    such as ``type:a.b``, ``enum:c``, ``missing:d[].e`` (a null counts as missing unless its type may
    be null) and ``unknown:f``. Equal faults of an array's elements count as one.
    """
    parsed = F.try_parse_json(arguments)
    by_tool = F.when(F.lit(False), F.array().cast("array<string>"))
    for tool, fields in sorted(schemas.items()):
        by_tool = by_tool.when(name == tool, _broken(parsed, _rule(fields), ""))
    told = by_tool.otherwise(F.array(F.lit("tool")))
    return F.sort_array(F.when(~F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False)), F.array(F.lit("json"))).otherwise(told))


def _levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level, late: the place of calls that need more than their own.

    ``calls``: conv_id, call_id, at (turn, nth, _tag), after. Where every call of a conversation waits
    only for calls before it, the order of the calls is topological as it stands, however long a chain
    is, and nothing is returned. In the others ``level`` is 0 for a call that waits for none, else one
    more than the deepest it waits for, and ``late`` the latest turn among itself and all that it waits
    for; both are null for calls in a circle or behind one. A round for each level of those.
    """
    waits = calls.select("conv_id", "call_id", "at", F.explode("after").alias("other"))
    others = calls.select("conv_id", F.col("call_id").alias("other"), F.col("at").alias("_at"))
    waits = cut(waits.join(others, ["conv_id", "other"]).distinct())
    back = cut(waits.where(F.struct("_at.turn", "_at.nth") >= F.struct("at.turn", "at.nth")).select("conv_id").distinct())
    waits = waits.join(back, "conv_id", "left_semi")
    left = cut(waits.select("conv_id", "call_id", "other", F.col("at.turn").alias("turn")))
    known = calls.join(back, "conv_id", "left_semi").join(left, ["conv_id", "call_id"], "left_anti")
    known = cut(known.select("conv_id", "call_id", F.lit(0).alias("level"), F.col("at.turn").alias("late")))
    while left.count():
        seen = left.join(known.withColumnRenamed("call_id", "other"), ["conv_id", "other"], "left")
        ready = seen.groupBy("conv_id", "call_id").agg(
            (F.count("level") == F.count("*")).alias("_all"), (F.max("level") + 1).alias("level"), F.greatest(F.max("turn"), F.max("late")).alias("late")
        )
        ready = cut(ready.where("_all").drop("_all"))
        if not ready.count():
            none = [F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("late")]
            return known.unionByName(left.select("conv_id", "call_id", *none).distinct())
        known = cut(known.unionByName(ready))
        left = cut(left.join(ready, ["conv_id", "call_id"], "left_anti"))
    return known


def link(found: DataFrame, schemas: Schemas) -> DataFrame:
    """Per event: conv_id, turn, nth, kind, call_id, status, faults, position, json.

    ``status``: message; call: answered, unanswered, invalid (its arguments), duplicate (a later one
    of an identifier) or cyclic; result: linked or orphan. ``position`` numbers a conversation's
    events from 0: by turn, but a call comes after the calls that it waits for (at the turn of the
    latest of all those, if that is later than its own), and a result right after its call. ``json`` is canonical: keys in order, no white space, null fields left out.
    Events without conversation, turn or identifier never link; they are placed by what they have,
    null turns last. Repeated rows are events of their own. An empty table gives an empty result.
    """
    d = stored(found.withColumn("_tag", F.monotonically_increasing_id()))
    slim = d.select("conv_id", "turn", "nth", "kind", "call_id", "_tag")
    here = F.struct(F.coalesce("turn", F.lit((1 << 62))).alias("turn"), "nth", "_tag")
    named = d.where((F.col("kind") == "call") & F.col("call_id").isNotNull() & F.col("conv_id").isNotNull())
    first = named.groupBy("conv_id", "call_id").agg(F.min_by(F.struct("after", here.alias("at")), here).alias("c"))
    calls = cut(first.select("conv_id", "call_id", "c.at", "c.after"))
    levels = _levels(calls).withColumn("_hard", F.lit(True))
    placed = calls.select("conv_id", "call_id", "at").join(levels, ["conv_id", "call_id"], "left")
    placed = placed.withColumns({"level": F.when(F.col("_hard"), F.col("level")).otherwise(0), "late": F.coalesce("late", "at.turn")})
    replied = slim.where((F.col("kind") == "result") & F.col("call_id").isNotNull()).select("conv_id", "call_id").distinct().withColumn("_replied", F.lit(True))
    placed = cut(placed.join(replied, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.col("at").alias("_at"), "level", F.col("late").alias("_late"), "_replied", F.lit(True).alias("_named")))
    e = slim.join(placed, ["conv_id", "call_id"], "left")
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    same = F.col("_at._tag") == F.col("_tag")
    status = (
        F.when(call & F.col("_named") & ~same, "duplicate").when(call & F.col("_named") & F.col("level").isNull(), "cyclic")
        .when(call & F.col("_replied"), "answered").when(call, "unanswered")
        .when(result & F.col("_named"), "linked").when(result, "orphan").otherwise("message")
    )
    e = e.withColumn("_status", status)
    linked = F.col("_status") == "linked"
    own = F.coalesce("turn", F.lit(1 << 62))
    turn = F.greatest(F.when(linked, F.col("_at.turn")).otherwise(own), F.when(call | linked, F.col("_late")))
    order = F.struct(turn.alias("turn"), F.when(call | linked, F.coalesce("level", F.lit(0))).otherwise(0).alias("level"), F.when(linked, F.col("_at.nth")).otherwise(F.col("nth")).alias("nth"), F.when(linked, F.col("call_id")).when(call, F.col("call_id")).alias("id"), F.when(linked, 1).otherwise(0).alias("after"), own.alias("own"), F.col("_tag").alias("tag"))
    at = _positions(e.select(F.col("conv_id").alias("_conv"), "_tag", "_status", order.alias("_order")))
    arguments = F.coalesce(F.to_json(F.try_parse_json(F.col("arguments"))), F.to_json(F.col("arguments").cast("variant")))
    field = lambda key, value: F.when(value.isNotNull(), F.concat(F.lit(f'"{key}":'), value))
    quoted = lambda c: F.to_json(F.col(c).cast("variant"))
    body = F.concat_ws(",", field("arguments", F.when(call, arguments)), field("call_id", quoted("call_id")), field("content", quoted("content")), field("name", quoted("name")), field("role", quoted("role")))
    d = d.select(
        "_tag", "conv_id", "turn", "nth", "kind", "call_id", F.coalesce(F.concat_ws(",", F.when(call, faults(F.col("name"), F.col("arguments"), schemas))), F.lit("")).alias("faults"),
        F.concat(F.lit("{"), body, F.lit("}")).alias("json"),
    ).join(at, "_tag")
    invalid = F.col("_status").isin("answered", "unanswered") & (F.col("faults") != "")
    return d.select("conv_id", "turn", "nth", "kind", "call_id", F.when(invalid, "invalid").otherwise(F.col("_status")).alias("status"), "faults", "position", "json")


def _positions(d: DataFrame) -> DataFrame:
    """_tag, _status, position of events by ``_order`` within ``_conv``.

    Events are range-partitioned by conversation and order, which is unique, so that a conversation of
    any size is divided. Only the first conversation of a range goes on from an earlier one.
    """
    d = cut(d.repartitionByRange("_conv", "_order").withColumn("_range", F.spark_partition_id()))
    totals = d.groupBy("_conv", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_conv").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    goes_on = totals.select(F.col("_conv").alias("_c"), F.col("_range").alias("_r"), F.sum("_n").over(before).alias("_before")).where("_before is not null")
    d = d.withColumn("_nth", F.row_number().over(Window.partitionBy("_conv", "_range").orderBy("_order")) - 1)
    d = d.join(F.broadcast(goes_on), F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_range") == F.col("_r")), "left")  # a row per range at most
    return d.select("_tag", "_status", (F.coalesce("_before", F.lit(0)) + F.col("_nth")).cast("long").alias("position"))
