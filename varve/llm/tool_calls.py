"""Tool calls of conversations: linked to their results, checked against schemas, ordered, written as canonical JSON.

Everything is DataFrame expressions and joins. JSON goes through the variant type, which keeps an object's keys sorted, so
its text is canonical: sorted keys, no spaces, numbers in one form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.llm.tables import columns_or_null
from varve.session import stage

_KINDS = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN"}
_CALLS = "tool_calls array<struct<id: string, function: struct<name: string, arguments: string>>>"
_RESULT = "tool_call_id string, content string"
ID = ["conv_id", "call_id"]


def _member(arguments: Column, name: str) -> Column:
    return F.try_variant_get(arguments, f"$['{name}']", "variant")


def _problems(arguments: Column, name: str, rule: dict) -> list[Column]:
    """What is wrong with one argument: one text or null for each condition of its rule."""
    value = _member(arguments, name)
    kind = F.schema_of_variant(value)
    given = value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(True))
    wanted = rule.get("type", "any")
    if wanted == "number":
        fits = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    elif wanted == "array":
        fits = kind.startswith("ARRAY")
    elif wanted == "object":
        fits = kind.startswith("OBJECT")
    elif wanted in ("any", "call"):
        fits = F.lit(True) if wanted == "any" else kind == "STRING"
    else:
        fits = kind == _KINDS[wanted]
    out = [F.when(given & ~fits, F.lit(f"{name}: not of type {wanted}"))]
    if rule.get("required"):
        out.append(F.when(~given, F.lit(f"{name}: missing")))
    number, text = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
    limits = {
        "minimum": lambda x: number < x,
        "maximum": lambda x: number > x,
        "min_length": lambda x: F.length(text) < x,
        "max_length": lambda x: F.length(text) > x,
        "enum": lambda x: ~text.isin(*x),
    }
    return out + [F.when(given & fits & breaks(rule[key]), F.lit(f"{name}: against {key}")) for key, breaks in limits.items() if key in rule]


def validation_errors(name: Column, arguments: Column, raw: Column, schemas: dict[str, dict[str, dict]]) -> Column:
    """Array of texts, empty where `arguments` (a variant) fits the schema of the function `name`.

    `schemas[function][argument]` holds `type` (string, integer, number, boolean, array, object, any, or call: the id of
    another call), `required`, `minimum`, `maximum`, `min_length`, `max_length`, `enum`. Other arguments are errors."""
    is_object = F.coalesce(F.schema_of_variant(arguments).startswith("OBJECT"), F.lit(False))
    out = F.array(F.lit("unknown function"))
    for function, rules in schemas.items():
        known = F.array(*[F.lit(a) for a in sorted(rules)]).cast("array<string>")
        extra = F.transform(F.array_sort(F.array_except(F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")), known)), lambda k: F.concat(k, F.lit(": not an argument")))
        found = F.concat(F.array_compact(F.array(*[p for a, rule in sorted(rules.items()) for p in _problems(arguments, a, rule)])), extra)
        out = F.when(name == function, found).otherwise(out)
    return F.when(~is_object, F.array(F.lit("arguments: not an object"))).otherwise(out)


def link_tool_calls(messages: DataFrame, schemas: dict[str, dict[str, dict]]) -> DataFrame:
    """(conv_id, call_id, turn, name, step, status, errors, result, line), one row per call and per result without a call.

    `messages(conv_id, turn, role, text)`: an assistant text `{"tool_calls": [{"id", "function": {"name", "arguments"}}]}`
    makes calls, a tool text `{"tool_call_id", "content"}` answers one. Other texts, null ones included, make none.

    `status`: answered, unanswered, duplicate_id (another call of the conversation had the id before; the result belongs to
    that one), no_id, orphan_result. Of several results of one call the first in turn counts; each result
    without a call has a row. `step` numbers the calls
    of a conversation from 0 so that each follows all calls it refers to by an argument of type `call`, earlier turns
    first; calls in a circle, and what refers to them, come last and get an error, as do references to no call. Messages
    equal in all four columns count once. Null conversations are one conversation. `line` is the canonical JSON.
    """
    messages = columns_or_null(messages, conv_id="long", turn="long", role="string", text="string").distinct()
    asked = messages.where("role = 'assistant'").select("conv_id", "turn", F.md5("text").alias("mark"), F.posexplode(F.from_json("text", _CALLS)["tool_calls"]).alias("index", "call"))
    raw = F.col("call.function.arguments")
    calls = asked.select("conv_id", F.col("call.id").alias("call_id"), "turn", "mark", "index", F.col("call.function.name").alias("name"), raw.alias("raw"))
    arguments = F.try_parse_json("raw")
    refers = F.lit(None).cast("array<string>")
    for function, rules in schemas.items():
        named = [F.try_variant_get(arguments, f"$['{a}']", "string") for a, rule in sorted(rules.items()) if rule.get("type") == "call"]
        refers = F.when(F.col("name") == function, F.array_distinct(F.array_compact(F.array(*named).cast("array<string>")))).otherwise(refers)
    calls = stage(calls.withColumn("errors", validation_errors(F.col("name"), arguments, F.col("raw"), schemas)).withColumn("refers", refers).withColumn("at", F.struct("turn", "mark", "index")))

    owners = calls.where("call_id is not null").groupBy(*ID).agg(F.min("at").alias("first"))
    answers = messages.where("role = 'tool'").select("conv_id", "turn", F.md5("text").alias("mark"), F.from_json("text", _RESULT).alias("r"))
    answers = answers.select("conv_id", F.col("r.tool_call_id").alias("call_id"), F.struct("turn", F.col("r.content").alias("content"), "mark").alias("message"))
    answers = stage(answers.where("call_id is not null"))
    firsts = answers.groupBy(*ID).agg(F.min("message").alias("answer"))
    linked = owners.join(firsts.withColumnsRenamed({"conv_id": "_conv", "call_id": "_call"}), owners.conv_id.eqNullSafe(F.col("_conv")) & (owners.call_id == F.col("_call")), "full")
    linked = stage(linked.select(F.coalesce("conv_id", "_conv").alias("l_conv"), F.coalesce("call_id", "_call").alias("l_call"), "first", "answer", F.col("answer.content").alias("result"), F.col("_call").isNotNull().alias("has_result")))

    joined = calls.join(linked.where("first is not null"), calls.conv_id.eqNullSafe(F.col("l_conv")) & (calls.call_id == F.col("l_call")), "left")
    owner = F.col("first") == F.col("at")
    status = F.when(F.col("call_id").isNull(), "no_id").when(~owner, "duplicate_id").when(F.col("has_result"), "answered").otherwise("unanswered")
    joined = joined.withColumn("status", status).withColumn("result", F.when(owner, F.col("result"))).drop("l_conv", "l_call", "first", "has_result", "answer")
    placed = _steps(joined, owners)

    line = F.to_json(F.struct(F.coalesce(F.try_parse_json("raw"), F.col("raw").cast("variant")).alias("arguments"), "call_id", "conv_id", "errors", "name", "result", "status", "step", "turn"))
    placed = placed.withColumn("line", line).select("conv_id", "call_id", "turn", "name", "step", "status", "errors", "result", "line")
    others = answers.join(linked.where("first is null").drop("result"), answers.conv_id.eqNullSafe(F.col("l_conv")) & (answers.call_id == F.col("l_call")))
    orphans = others.select("conv_id", "call_id", "message.turn", F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("step"), F.lit("orphan_result").alias("status"), F.array().cast("array<string>").alias("errors"), F.col("message.content").alias("result"))
    return placed.union(orphans.withColumn("line", F.to_json(F.struct("call_id", "conv_id", "errors", "result", "status", "turn"))))


def _steps(calls: DataFrame, owners: DataFrame) -> DataFrame:
    """Adds `step`, and errors for references that lead nowhere or around in a circle.

    In a sound transcript references point back, and the order of turns is a topological one: level 0 for all. A reference
    to a later call lifts the level of the one that refers; levels then spread along references until none changes. A level
    above the conversation's number of such references is only reached from a circle."""
    node = ["conv_id", "at"]
    edges = calls.select(*node, F.explode("refers").alias("to"))
    targets = owners.select(F.col("conv_id").alias("t_conv"), F.col("call_id").alias("to"), F.col("first").alias("target"))
    edges = stage(edges.join(targets, edges.conv_id.eqNullSafe(F.col("t_conv")) & (edges["to"] == targets["to"]), "left").select(*node, edges["to"], "target", (F.col("target") >= F.col("at")).alias("ahead")))
    lost = edges.where("target is null").groupBy(*node).agg(F.transform(F.array_sort(F.collect_set("to")), lambda t: F.concat(t, F.lit(": no such call"))).alias("lost"))
    edges = edges.where("target is not null")
    levels = None
    if not edges.where("ahead").isEmpty():
        limit = edges.where("ahead").groupBy("conv_id").agg(F.count(F.lit(1)).alias("limit"))
        bent = stage(edges.withColumnRenamed("conv_id", "e_conv").join(limit, F.col("e_conv").eqNullSafe(limit.conv_id)).drop("conv_id").withColumnRenamed("e_conv", "conv_id"))
        levels = stage(bent.where("ahead").groupBy(*node).agg(F.lit(1).cast("long").alias("level"), F.max("limit").alias("limit")))
        while True:
            held = levels.select(F.col("conv_id").alias("h_conv"), F.col("at").alias("h_at"), F.col("level").alias("h_level"))
            rise = bent.join(held, bent.conv_id.eqNullSafe(held.h_conv) & (bent["target"] == held["h_at"]))
            rise = rise.select(*node, F.least(F.col("h_level") + F.col("ahead").cast("long"), F.col("limit") + 1).alias("level"), "limit")
            new = stage(levels.select(*node, "level", "limit").union(rise).groupBy(*node).agg(F.max("level").alias("level"), F.max("limit").alias("limit")))
            same = new.select(*node, "level").exceptAll(levels.select(*node, "level")).isEmpty()
            levels = new
            if same:
                break
    out = _attach(calls, lost, "lost", "array<string>")
    if levels is None:
        out = out.withColumn("level", F.lit(0).cast("long")).withColumn("circle", F.lit(False))
    else:
        out = _attach(out, levels.select(*node, F.struct("level", (F.col("level") > F.col("limit")).alias("circle")).alias("height")), "height", "struct<level: long, circle: boolean>")
        out = out.withColumn("level", F.coalesce("height.level", F.lit(0))).withColumn("circle", F.coalesce("height.circle", F.lit(False))).drop("height")
    nothing = F.array().cast("array<string>")
    out = out.withColumn("errors", F.concat("errors", F.coalesce("lost", nothing), F.when(F.col("circle"), F.array(F.lit("refers in a circle"))).otherwise(nothing))).drop("lost")

    # Numbered in pieces: what the pieces before hold, and the place in the own one, so a long conversation is many tasks.
    piece = ["circle", "level", "turn", "_part"]
    out = out.withColumn("_part", F.substring("mark", 1, 2))
    counts = out.groupBy("conv_id", *piece).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("conv_id").orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(c).alias(f"p_{c}") for c in ("conv_id", *piece)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = out.withColumn("_place", F.row_number().over(Window.partitionBy("conv_id", *piece).orderBy("mark", "index", "call_id")))
    same = F.lit(True)
    for c in ("conv_id", *piece):
        same = same & out[c].eqNullSafe(counts[f"p_{c}"])
    return out.join(counts, same).withColumn("step", F.col("_before") + F.col("_place") - 1)


def _attach(calls: DataFrame, found: DataFrame, name: str, kind: str) -> DataFrame:
    found = found.select(F.col("conv_id").alias("f_conv"), F.col("at").alias("f_at"), F.col(name).cast(kind).alias(name))
    return calls.join(found, calls.conv_id.eqNullSafe(F.col("f_conv")) & calls["at"].eqNullSafe(F.col("f_at")), "left").drop("f_conv", "f_at")


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """Conversations as tool traffic: each user turn calls a function with its text, the assistant's next turn is the result.

    The first user turn is a `lookup`, the others a `follow_up` to the call two turns before."""
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"))
    later = F.col("turn") > 1
    arguments = F.to_json(F.struct(F.when(later, F.concat(name, (F.col("turn") - 2).cast("string"))).alias("after"), F.col("text").alias("question"), F.size(F.split("text", " ")).alias("words")))
    function = F.struct(F.when(later, "follow_up").otherwise("lookup").alias("name"), arguments.alias("arguments"))
    call = F.to_json(F.struct(F.array(F.struct(F.concat(name, F.col("turn").cast("string")).alias("id"), function.alias("function"))).alias("tool_calls")))
    answer = F.to_json(F.struct(F.concat(name, (F.col("turn") - 1).cast("string")).alias("tool_call_id"), F.col("text").alias("content")))
    role = F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool").otherwise(F.col("role"))
    text = F.when(F.col("role") == "user", call).when(F.col("role") == "assistant", answer).otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))


#: Schemas of the functions of `as_tool_messages`.
SCHEMAS = {
    "lookup": {"question": {"type": "string", "required": True, "max_length": 400}, "words": {"type": "integer", "required": True, "maximum": 60}},
    "follow_up": {
        "after": {"type": "call", "required": True},
        "question": {"type": "string", "required": True, "max_length": 400},
        "words": {"type": "integer", "required": True, "maximum": 60},
    },
}
