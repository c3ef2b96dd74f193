"""Chat records with their tool calls linked, ordered, validated and serialised, in DataFrame functions only.

An assistant message may be a JSON object {"content", "tool_calls": [{"id", "name", "arguments", "after"}]}, where
"after" names calls whose results it waits for; a message of role tool is {"tool_call_id", "content"}. Each message
gives an event of kind message or result, and each call one of kind call; the events of a conversation are ordered by
(order_turn, level, turn, step), a topological order: a result stands behind its call and a call behind the
results it waits for, whatever their turns say. Calls and results are joined by (conversation, identifier), the
earliest call of an identifier counting; a call without an identifier is an event of its own, linked to nothing
(call_id null, linked false, no id in its json). No conversation is brought together in one place.

json is canonical: keys in alphabetical order, no white space, numbers with the digits they were written with (so none
overflows or is rounded). linked: whether the call has a result, the result a call (null for messages). valid: whether
the arguments are an object that has what the tool's schema requires, of the types it names and nothing else; tools
without a schema are not valid; null for other events.
Null texts are empty; a text that is not one JSON object and nothing else (also: one in which an object has a key twice)
is a plain message, and keeps its whole text; keys of messages and calls beyond those above are left out; a call that is
no object is all arguments. Strings that begin with the private-use character U+E000 stand for numbers inside.
Null conversations are one conversation and null turns come first; calls that wait for each other get the level -1 and
keep their turns. Rows that repeat are events each. Very long texts are parsed as one value. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ancestra.llm.corpus import settled
from ancestra.plans.materialise import bounded

#: Stands in front of the digits of a number while JSON is parsed.
_MARK = "\ue000"
_NUMBER = r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?"
#: From the end of the number before on: what comes before a number (strings whole), and the number.
_NUMBERS = r'\G((?:[^"\d-]|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+)(' + _NUMBER + r")(?![0-9.eE+-])"
_CALL = "array<struct<id:string,name:string,arguments:variant,after:array<string>>>"

#: tool -> argument -> (type, required)
Schemas = dict[str, dict[str, tuple[str, bool]]]


def _parsed(text: Column) -> Column:
    """The variant of a text that is one JSON value and nothing else, its numbers marked; null for others."""
    marked = F.regexp_replace(text, F.lit(_NUMBERS), F.lit(f'$1"{_MARK}$2"'))
    # what follows the value ends the text of one of the two too early
    inside = F.try_parse_json(F.concat(F.lit('{"v":'), marked, F.lit("}")))
    return F.when(inside.isNotNull(), F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), marked, F.lit("]"))), "$[0]", "variant"))


def _digits(json: Column) -> Column:
    return F.regexp_replace(json, f'"{_MARK}({_NUMBER})"', "$1")


def _string(v: Column, path: str) -> Column:
    """A string at a path, or the JSON of what is there; null for null."""
    at = F.try_variant_get(v, path, "variant")
    text = F.coalesce(F.try_variant_get(v, path, "string"), F.to_json(at))
    return F.when(F.schema_of_variant(at) != "VOID", F.regexp_replace(text, f"^{_MARK}", ""))


def is_valid(name: Column, arguments: Column, schemas: Schemas) -> Column:
    kind = lambda v: F.schema_of_variant(v)
    out = F.lit(False)
    for tool, wanted in schemas.items():
        fine = F.coalesce(kind(arguments).startswith("OBJECT"), F.lit(False))
        keys = F.map_keys(F.from_json(F.to_json(arguments), "map<string,string>"))
        fine &= F.size(F.array_except(keys, F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>"))) == 0
        for arg, (type_, required) in wanted.items():
            there = F.array_contains(keys, arg)
            value = F.try_variant_get(arguments, f"$.{arg}", "variant")
            string = F.try_variant_get(arguments, f"$.{arg}", "string")
            is_string, marked = kind(value) == "STRING", string.startswith(_MARK)
            of_type = {
                "string": is_string & ~marked,
                "integer": is_string & string.rlike(f"^{_MARK}-?[0-9]+$"),
                "number": is_string & marked,
                "boolean": kind(value) == "BOOLEAN",
                "array": kind(value).startswith("ARRAY"),
                "object": kind(value).startswith("OBJECT"),
            }[type_]
            fine &= F.when(there, F.coalesce(of_type, F.lit(False))).otherwise(F.lit(not required))
        out = F.when(name == tool, F.coalesce(fine, F.lit(False))).otherwise(out)
    return out


def events(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """A row per event: conv_id, turn, step, kind, role, call_id, waits, valid, json."""
    m = messages.select(messages["conv_id"].cast("long"), messages["turn"].cast("long"), messages["role"], F.coalesce(messages["text"], F.lit("")).alias("text"))
    m = m.withColumn("v", F.when(F.col("role").isin("assistant", "tool") & F.col("text").startswith("{"), _parsed(F.col("text"))))

    def call(c: Column) -> Column:
        whole = F.schema_of_variant(c).startswith("OBJECT")
        after = F.transform(F.try_variant_get(c, "$.after", "array<variant>"), lambda x: _string(x, "$"))
        return F.struct(_string(c, "$.id").alias("id"), _string(c, "$.name").alias("name"), F.when(whole, F.try_variant_get(c, "$.arguments", "variant")).otherwise(c).alias("arguments"), after.alias("after"))

    calls = F.transform(F.filter(F.try_variant_get("v", "$.tool_calls", "array<variant>"), lambda c: F.schema_of_variant(c) != "VOID"), call)
    calls = F.coalesce(F.when(F.col("role") == "assistant", calls), F.array().cast(_CALL))
    m = m.withColumns({"calls": calls, "answers": F.when(F.col("role") == "tool", _string(F.col("v"), "$.tool_call_id")), "content": _string(F.col("v"), "$.content")})
    m = m.withColumn("result", F.col("answers").isNotNull())
    said = F.when(F.col("result") | (F.size("calls") > 0), F.coalesce("content", F.lit(""))).otherwise(F.col("text"))
    none = F.lit(None).cast("string")
    own = m.select(
        "conv_id", "turn", F.lit(0).alias("step"), F.when(F.col("result"), "result").otherwise("message").alias("kind"), "role",
        F.col("answers").alias("call_id"), F.lit(None).cast("array<string>").alias("waits"), F.lit(None).cast("boolean").alias("valid"),
        F.when(F.col("result"), F.to_json(F.struct(said.alias("content"), F.col("role").alias("role"), F.col("answers").alias("tool_call_id")))).otherwise(F.to_json(F.struct(said.alias("content"), F.col("role").alias("role")))).alias("json"),
    )
    c = m.where(F.size("calls") > 0).select("conv_id", "turn", "role", F.posexplode("calls").alias("k", "c"))
    called = c.select(
        "conv_id", "turn", (F.col("k") + 1).alias("step"), F.lit("call").alias("kind"), "role", F.col("c.id").alias("call_id"), F.col("c.after").alias("waits"),
        is_valid(F.col("c.name"), F.col("c.arguments"), schemas).alias("valid"),
        _digits(F.to_json(F.struct(F.col("c.arguments").alias("arguments"), F.col("c.id").alias("id"), F.col("c.name").alias("name"), F.lit("tool_call").alias("type")))).alias("json"),
    )
    return own.unionByName(called.withColumn("call_id", F.coalesce("call_id", none)))


def linked(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """A row per event: conv_id, turn, step, kind, role, call_id, linked, valid, order_turn, level, json."""
    e = events(messages, schemas)
    key = ["conv_id", "call_id"]
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["call_id"] == b["call_id"])
    # texts are parsed once for all that the order needs
    first = F.min(F.when(F.col("kind") == "call", F.struct("turn", "step", "waits"))).alias("c")
    tied = settled(e.where("kind <> 'message' and call_id is not null").groupBy(*key).agg(first, F.min(F.when(F.col("kind") == "result", F.col("turn"))).alias("result_turn"), F.count_if(F.col("kind") == "result").alias("results")))
    calls = tied.where("c is not null").select(*key, F.col("c.turn").alias("turn"), F.col("c.waits").alias("waits"))
    results = tied.where("results > 0").select(*key, "result_turn")
    order = _ordered(calls, results)
    r = order.select(F.col("conv_id").alias("c_conv"), F.col("call_id").alias("c_call"), "call_turn", "call_level", "has_result")
    plain = e.where("call_id is null").select("*", F.when(F.col("kind") == "call", F.lit(False)).alias("linked"), F.col("turn").alias("order_turn"), F.lit(0).alias("level"))
    tied = e.where("call_id is not null").join(r, F.col("conv_id").eqNullSafe(F.col("c_conv")) & (F.col("call_id") == F.col("c_call")), "left")
    is_call = F.col("kind") == "call"
    tied = tied.select(
        *e.columns,
        F.when(is_call, F.col("has_result")).otherwise(F.col("c_call").isNotNull()).alias("linked"),
        F.when(is_call, F.greatest("turn", "call_turn")).otherwise(F.greatest("turn", "call_turn")).alias("order_turn"),
        F.when(F.col("c_call").isNull(), 0).when(F.col("call_level") < 0, -1).when(is_call, F.col("call_level")).otherwise(F.col("call_level") + 1).cast("int").alias("level"),
    )
    return plain.unionByName(tied).select("conv_id", "turn", "step", "kind", "role", "call_id", "linked", "valid", "order_turn", "level", "json")


def _ordered(calls: DataFrame, results: DataFrame) -> DataFrame:
    """conv_id, call_id, call_turn, call_level, has_result: calls are placed when those that they wait for are (Kahn's order)."""
    res = results.select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call"), "result_turn")
    base = calls.join(res, F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("call_id") == F.col("r_call")), "left")
    base = base.select("conv_id", "call_id", "turn", "result_turn", F.coalesce("waits", F.array().cast("array<string>")).alias("waits"))
    # only calls that the conversation has are waited for
    wait = base.where(F.size("waits") > 0).select("conv_id", "call_id", F.explode("waits").alias("on")).distinct()
    there = calls.select(F.col("conv_id").alias("t_conv"), F.col("call_id").alias("t_call"))
    wait = settled(wait.join(there, F.col("conv_id").eqNullSafe(F.col("t_conv")) & (F.col("on") == F.col("t_call"))).select("conv_id", "call_id", "on"))
    waiting = wait.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"))
    held = waiting.select(F.col("conv_id").alias("h_conv"), F.col("call_id").alias("h_call"), "n")
    base = base.join(held, F.col("conv_id").eqNullSafe(F.col("h_conv")) & (F.col("call_id") == F.col("h_call")), "left").drop("h_conv", "h_call", "waits")
    placed = base.where("n is null").select("conv_id", "call_id", "result_turn", F.col("turn").alias("call_turn"), F.lit(0).alias("call_level"))
    rest = settled(base.where("n is not null"))
    left = rest.count()
    if left:
        placed = settled(placed)
    while left:
        p = placed.select(F.col("conv_id").alias("p_conv"), F.col("call_id").alias("p_call"), F.greatest("call_turn", "result_turn").alias("p_turn"), "call_level")
        met = wait.join(p, F.col("conv_id").eqNullSafe(F.col("p_conv")) & (F.col("on") == F.col("p_call")))
        met = met.groupBy("conv_id", "call_id").agg(F.count("*").alias("met"), F.max("p_turn").alias("after_turn"), F.max("call_level").alias("deep")).select(F.col("conv_id").alias("m_conv"), F.col("call_id").alias("m_call"), "met", "after_turn", "deep")
        rest = settled(bounded(rest.join(met, F.col("conv_id").eqNullSafe(F.col("m_conv")) & (F.col("call_id") == F.col("m_call")), "left")))
        now = rest.where("met = n").select("conv_id", "call_id", "result_turn", F.greatest("turn", "after_turn").alias("call_turn"), (F.col("deep") + 2).alias("call_level"))
        placed, rest = settled(bounded(placed.unionByName(now))), rest.where("met is null or met < n").select("conv_id", "call_id", "turn", "result_turn", "n")
        was, left = left, rest.count()
        if left == was:
            placed = placed.unionByName(rest.select("conv_id", "call_id", "result_turn", F.col("turn").alias("call_turn"), F.lit(-1).alias("call_level")))
            break
    return placed.withColumn("has_result", F.col("result_turn").isNotNull())
