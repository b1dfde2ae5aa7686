"""Tool-call linking for chat data, in DataFrame operations alone.

Three kinds of message carry JSON objects as their text:

* a system message declares tools, ``{"tools": [{"name", "parameters": {"properties", "required",
  "additionalProperties"}}]}``;
* an assistant message makes calls, ``{"content", "tool_calls": [{"id", "name", "arguments", "depends_on"}]}``;
  name and arguments may stand in ``function``, and arguments may be a string that holds JSON;
* a tool message gives a result, ``{"tool_call_id", "content"}``.

Calls and results of a conversation are hash-joined by identifier, calls are put in topological order of what
they depend on, arguments are checked against the schema the conversation declares for the tool, and each
message comes out as canonical JSON: keys sorted at every depth, no blanks, null fields left out.

Any other text, JSON or not, is content as it is. Null text gives a message without content, empty text an
empty content. A second call with an identifier that the conversation has is a ``duplicate``; of several results
the first turn counts. A call without a result is ``unanswered``, a result without a call has ``"linked":false``.
Calls on a cycle have no ``order`` and are ``cyclic``; dependencies on unknown calls are ignored. Messages of a
null conversation are formatted, not linked. Repeated rows are linked once and come out as often as they came in.
Messages are rows of their own and carry (conv_id, turn), so no conversation is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wayfare.plans.shared import cut

#: Names of JSON schema types, by the beginning of the type's name in the engine.
_TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",), "null": ("VOID",)}
_KEYS = ("conv_id", "turn", "role", "text")


def _field(name: str, value: Column) -> Column:
    """``"name":value`` with the value as JSON; null if the value is."""
    text = F.to_json(F.struct(value.alias(name)))
    return F.when(value.isNotNull(), F.regexp_extract(text, r"(?s)^\{(.*)\}$", 1))


def _object(*fields: Column) -> Column:
    """A JSON object of the fields that are not null."""
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def _array(items: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", items), F.lit("]"))


def _get(variant: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(variant, path, kind)


def _has_type(value: Column, declared: Column) -> Column:
    """Whether a variant is of the JSON type ``declared``; unknown types pass."""
    own = F.schema_of_variant(value)
    test = F.lit(True)
    for name, kinds in _TYPES.items():
        fits = F.lit(False)
        for kind in kinds:
            fits = fits | own.startswith(kind)
        test = F.when(declared == name, fits).otherwise(test)
    return test


def _payload(messages: DataFrame) -> DataFrame:
    """The messages with ``body``, the JSON object of those that carry tools, calls or results, else null."""
    body = F.when(F.col("text").rlike(r"^\s*\{"), F.try_parse_json("text"))
    kind = (
        F.when((F.col("role") == "assistant") & _get(F.col("body"), "$.tool_calls", "array<variant>").isNotNull(), "calls")
        .when((F.col("role") == "tool") & _get(F.col("body"), "$.tool_call_id", "string").isNotNull(), "result")
        .when((F.col("role") == "system") & _get(F.col("body"), "$.tools", "array<variant>").isNotNull(), "tools")
    )
    return messages.withColumn("body", body).withColumn("kind", kind)


def _calls(marked: DataFrame) -> DataFrame:
    """One row for each call of a message."""
    each = marked.where("kind = 'calls'").select(*_KEYS, F.posexplode(_get(F.col("body"), "$.tool_calls", "array<variant>")).alias("at", "call"))
    arguments = F.coalesce(_get(F.col("call"), "$.arguments", "variant"), _get(F.col("call"), "$.function.arguments", "variant"))
    said = each.select(
        *_KEYS,
        "at",
        _get(F.col("call"), "$.id", "string").alias("call_id"),
        F.coalesce(_get(F.col("call"), "$.name", "string"), _get(F.col("call"), "$.function.name", "string")).alias("name"),
        arguments.alias("given"),
        F.coalesce(_get(F.col("call"), "$.depends_on", "array<string>"), F.array().cast("array<string>")).alias("depends_on"),
    )
    parsed = F.when(F.schema_of_variant("given") == "STRING", F.try_parse_json(_get(F.col("given"), "$", "string"))).otherwise(F.col("given"))
    return said.withColumn("arguments", parsed).drop("given")


def _orders(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 for calls that depend on none, else one more than the highest of those.

    Calls with one dependency point to it, and pointers are doubled until they reach a call with none or several, so a
    chain takes as many rounds as its length has binary digits. Only calls with several dependencies are then taken in
    rounds, as many as the longest chain of these. Calls on a cycle, or that need one, never get a level.
    """
    key = ["conv_id", "call_id"]
    known = calls.where("conv_id is not null and call_id is not null")
    ids = known.select(*key).distinct()
    edges = known.select(*key, F.explode("depends_on").alias("needs")).distinct()
    edges = cut(edges.join(ids.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"]).select(*key, "needs"))
    roots = ids.join(edges, key, "left_anti").withColumn("level", F.lit(0))
    if edges.isEmpty():
        return roots
    needs = edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("needs").alias("to"))
    jumps = cut(needs.where("n = 1").select(*key, "to", F.lit(1).alias("far")))
    for _ in range(jumps.count().bit_length() + 1):
        after = jumps.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"))
        open_ = jumps.join(after, ["conv_id", "to"], "left")
        jumps = cut(open_.select(*key, F.coalesce("next", "to").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far")))
        if jumps.join(jumps.select("conv_id", F.col("call_id").alias("to")), ["conv_id", "to"], "left_semi").isEmpty():
            break
    # A pointer that still leads to a call with one dependency is on a cycle or leads to one.
    chains = jumps.join(jumps.select("conv_id", F.col("call_id").alias("to")), ["conv_id", "to"], "left_anti")
    forks = needs.where("n > 1").select(*key)
    ends = chains.select(*key, "to", "far").union(roots.union(forks.withColumn("level", F.lit(0))).select(*key, F.col("call_id").alias("to"), F.lit(0).alias("far")))
    wanted = edges.join(forks, key, "left_semi").join(ends.select("conv_id", F.col("call_id").alias("needs"), "to", "far"), ["conv_id", "needs"], "left")
    wanted = cut(wanted.select(*key, "to", "far"))
    done = cut(roots)
    while True:
        levels = done.select("conv_id", F.col("call_id").alias("to"), "level")
        open_ = wanted.join(done.select(*key), key, "left_anti").join(levels, ["conv_id", "to"], "left")
        tried = open_.groupBy(*key).agg(F.count_if(F.col("level").isNull()).alias("missing"), F.max(F.col("level") + F.col("far") + 1).alias("level"))
        ready = cut(tried.where("missing = 0").select(*key, "level"))
        if ready.isEmpty():
            break
        done = cut(done.union(ready))
    placed = chains.join(done.select("conv_id", F.col("call_id").alias("to"), "level"), ["conv_id", "to"])
    return done.union(placed.select(*key, (F.col("level") + F.col("far")).alias("level")))


def _errors(declared: Column) -> Column:
    """Sorted texts of what is wrong with ``arguments`` (given, as a map of variants) under the joined schema."""
    given, properties = F.col("given"), F.col("properties")
    missing = F.transform(F.filter("required", lambda k: ~F.array_contains(F.map_keys(given), k)), lambda k: F.concat(F.lit("missing:"), k))
    wrong = F.transform(
        F.map_keys(given),
        lambda k: F.when(~F.array_contains(F.map_keys(properties), k), F.when(~F.col("open"), F.concat(F.lit("unexpected:"), k)))
        .when(~_has_type(F.element_at(given, k), F.element_at(properties, k)), F.concat(F.lit("type:"), k)),
    )
    found = F.array_sort(F.concat(missing, F.filter(wrong, lambda x: x.isNotNull())))
    return F.when(~declared, F.array(F.lit("undeclared"))).when(given.isNull(), F.array(F.lit("not an object"))).otherwise(found)


def link_calls(messages: DataFrame) -> DataFrame:
    """One row for each call: the message's keys, ``at``, call_id, name, ``order``, status, result_turn, errors, json."""
    marked = _payload(messages.select(*_KEYS).distinct())
    calls = _calls(marked)
    tools = marked.where("kind = 'tools' and conv_id is not null").select("conv_id", "turn", F.explode(_get(F.col("body"), "$.tools", "array<variant>")).alias("tool"))
    tools = tools.select("conv_id", "turn", F.coalesce(_get(F.col("tool"), "$.name", "string"), _get(F.col("tool"), "$.function.name", "string")).alias("name"), F.coalesce(_get(F.col("tool"), "$.parameters", "variant"), _get(F.col("tool"), "$.function.parameters", "variant")).cast("string").alias("schema"))
    tools = tools.groupBy("conv_id", "name").agg(F.min_by("schema", F.struct("turn", "schema")).alias("schema"), F.lit(True).alias("declared"))
    results = marked.where("kind = 'result' and conv_id is not null").select("conv_id", _get(F.col("body"), "$.tool_call_id", "string").alias("call_id"), "turn")
    results = results.groupBy("conv_id", "call_id").agg(F.min("turn").alias("result_turn"))
    first = calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "at")).alias("first"))
    schema = F.try_parse_json("schema")
    joined = calls.join(first, ["conv_id", "call_id"], "left").join(results, ["conv_id", "call_id"], "left").join(_orders(calls), ["conv_id", "call_id"], "left").join(tools, ["conv_id", "name"], "left")
    checked = joined.select(
        "*",
        _get(F.col("arguments"), "$", "map<string,variant>").alias("given"),
        F.coalesce(F.transform_values(_get(schema, "$.properties", "map<string,variant>"), lambda _, v: F.coalesce(_get(v, "$.type", "string"), F.lit("any"))), F.create_map().cast("map<string,string>")).alias("properties"),
        F.coalesce(_get(schema, "$.required", "array<string>"), F.array().cast("array<string>")).alias("required"),
        F.coalesce(_get(schema, "$.additionalProperties", "boolean"), F.lit(True)).alias("open"),
    ).withColumn("errors", _errors(F.coalesce("declared", F.lit(False))))
    status = (
        F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), "unlinked")
        .when(F.struct("turn", "at") != F.col("first"), "duplicate")
        .when(F.col("level").isNull(), "cyclic")
        .when(F.col("result_turn").isNull(), "unanswered")
        .otherwise("answered")
    )
    told = checked.withColumn("status", status).withColumn("result_turn", F.when(F.col("status") == "answered", F.col("result_turn")))
    fields = ("arguments", F.col("arguments")), ("errors", F.when(F.size("errors") > 0, F.col("errors"))), ("id", F.col("call_id")), ("name", F.col("name")), ("order", F.col("level")), ("result_turn", F.col("result_turn")), ("status", F.col("status"))
    return told.select(*_KEYS, "at", "call_id", "name", F.col("level").alias("order"), "status", "result_turn", "errors", _object(*(_field(n, c) for n, c in fields)).alias("json"))


def format_chat(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, message, n_calls, n_answered, n_invalid) of each row of ``messages`` (conv_id, turn, role, text).

    Messages without calls or results are formatted where they are read; only the others are joined.
    """
    rows = _payload(messages.select(*_KEYS))
    zero = F.lit(0).cast("long")
    plain = rows.where("kind is null or kind = 'tools'").select(
        "conv_id", "turn", "role", _object(_field("content", F.col("text")), _field("role", F.col("role")), _field("turn", F.col("turn"))).alias("message"), zero.alias("n_calls"), zero.alias("n_answered"), zero.alias("n_invalid")
    )
    special = messages.select(*_KEYS).where(F.col("role").isin("assistant", "tool", "system") & F.col("text").rlike(r"^\s*\{"))
    links = cut(link_calls(special))  # for the calls' own messages and for their results
    sorted_calls = F.array_sort(F.collect_list(F.struct(F.coalesce("order", F.lit(1 << 30)).alias("o"), "at", "json")))
    of_message = links.groupBy(*_KEYS).agg(
        sorted_calls.alias("calls"), F.count("*").alias("n_calls"), F.count_if(F.col("status") == "answered").alias("n_answered"), F.count_if(F.size("errors") > 0).alias("n_invalid")
    )
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in _KEYS]
    marked = _payload(special)
    makers = marked.where("kind = 'calls'").groupBy(*_KEYS).agg(F.count("*").alias("copies"), F.first(F.to_json("body")).alias("body")).alias("m")
    called = makers.join(of_message.alias("c"), same(makers, of_message), "left")
    content = _get(F.try_parse_json("m.body"), "$.content", "variant")
    calls_json = F.concat(F.lit('"tool_calls":'), _array(F.transform(F.coalesce("calls", F.array().cast("array<struct<o:int,at:int,json:string>>")), lambda x: x["json"])))
    made = called.select(
        "m.conv_id", "m.turn", "m.role", _object(_field("content", content), _field("role", F.col("m.role")), calls_json, _field("turn", F.col("m.turn"))).alias("message"), *(F.coalesce(c, zero).alias(c) for c in ("n_calls", "n_answered", "n_invalid")), "copies"
    )
    ids = links.where("status <> 'unlinked'").select("conv_id", "call_id").distinct().withColumn("linked", F.lit(True))
    answers = marked.where("kind = 'result'").withColumn("call_id", _get(F.col("body"), "$.tool_call_id", "string")).withColumn("content", _get(F.col("body"), "$.content", "variant"))
    given = answers.join(ids, ["conv_id", "call_id"], "left").select(
        "conv_id",
        "turn",
        "role",
        _object(_field("content", F.col("content")), _field("linked", F.coalesce("linked", F.lit(False))), _field("role", F.col("role")), _field("tool_call_id", F.col("call_id")), _field("turn", F.col("turn"))).alias("message"),
        zero.alias("n_calls"),
        zero.alias("n_answered"),
        zero.alias("n_invalid"),
    )
    repeated = made.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "copy")
    return plain.unionByName(repeated).unionByName(given)


ORACLE = """SELECT conv_id, turn, role,
'{' || concat_ws(',', '"content":' || to_json(text)::VARCHAR, '"role":' || to_json(role)::VARCHAR, '"turn":' || turn) || '}' AS message,
0::BIGINT AS n_calls, 0::BIGINT AS n_answered, 0::BIGINT AS n_invalid FROM conversations"""
