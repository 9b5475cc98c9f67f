"""Operator 7: linking tool calls to their results, on DataFrame functions alone.

Calls and results meet in a hash join by conversation and identifier.  Calls are ordered topologically: a
call comes after the calls it names in ``after``.  Arguments are parsed as variants and checked against the
tool's schema by expressions built from it; JSON is written canonically (keys sorted at every depth, no
blanks), which is how Spark writes a variant.

A conversation may hold a third of all rows: nothing gathers a conversation in one task.  Duplicates are
settled by pre-aggregated minima, and places come from range-partitioned ranks.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import grouped_rank
from ..sources.scratch import staged

_TYPES = {
    "string": ("STRING",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"),
    "boolean": ("BOOLEAN",),
    "array": ("ARRAY",),
    "object": ("OBJECT",),
    "null": ("VOID",),
}


def canonical(json: Column) -> Column:
    """Canonical text of a JSON text; null if it isn't JSON, or has a key twice."""
    return F.to_json(F.try_parse_json(json))


def _is(value: Column, kinds: str | list[str]) -> Column:
    found = F.schema_of_variant(value)
    names = [n for k in ([kinds] if isinstance(kinds, str) else kinds) for n in _TYPES[k]]
    return reduce(lambda a, b: a | b, [found.startswith(n) for n in names])


def _field_errors(json: Column, parsed: Column, name: str, rule: dict[str, Any], required: bool) -> list[Column]:
    there = F.array_contains(F.json_object_keys(json), name)
    value = F.try_variant_get(parsed, f'$["{name}"]', "variant")
    text = F.try_variant_get(parsed, f'$["{name}"]', "string")
    number = F.try_variant_get(parsed, f'$["{name}"]', "double")
    tests: list[tuple[Column, str]] = []
    if required:
        tests.append((~there, "missing"))
    kinds = rule.get("type")
    if kinds:
        tests.append((there & ~F.coalesce(_is(value, kinds), F.lit(False)), "type"))
    if "enum" in rule:
        tests.append((there & ~F.coalesce(text.isin([str(x) for x in rule["enum"]]), F.lit(False)), "enum"))
    for key, wrong in (("minLength", lambda n: F.char_length(text) < n), ("maxLength", lambda n: F.char_length(text) > n), ("minimum", lambda n: number < n), ("maximum", lambda n: number > n)):
        if key in rule:
            tests.append((there & F.coalesce(wrong(rule[key]), F.lit(False)), key))
    if "pattern" in rule:
        tests.append((there & ~F.coalesce(text.rlike(rule["pattern"]), F.lit(False)), "pattern"))
    return [F.when(wrong, F.lit(f"{name}: {what}")) for wrong, what in tests]


def argument_errors(tool: Column, json: Column, schemas: dict[str, dict[str, Any]]) -> Column:
    """Array of what is wrong with a call's arguments, in the order of the schema; empty if nothing is.

    Schemas are JSON schemas of objects: properties with type, enum, minLength, maxLength, minimum, maximum,
    pattern; required; additionalProperties false.
    """
    parsed = F.try_parse_json(json)
    keys = F.json_object_keys(json)
    out = F.array(F.lit("unknown tool"))
    for name, schema in schemas.items():
        fields = schema.get("properties", {})
        found = [e for f, rule in fields.items() for e in _field_errors(json, parsed, f, rule, f in schema.get("required", ()))]
        errors = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")
        if schema.get("additionalProperties") is False:
            known = F.array(*[F.lit(f) for f in fields]) if fields else F.array().cast("array<string>")
            errors = F.concat(errors, F.transform(F.sort_array(F.array_except(keys, known)), lambda x: F.concat(x, F.lit(": unknown"))))
        out = F.when(tool == name, errors).otherwise(out)
    return F.when(keys.isNull(), F.array(F.lit("not a JSON object"))).otherwise(out)


#: So many rounds' results are written as one table, which keeps the plan of their union small.
_ROUNDS = 64


def _levels(calls: DataFrame, most: int | None = None) -> DataFrame:
    """Kahn's rounds over calls (conv, call_id, after): conv, call_id, level; no row for calls in a cycle.

    Rounds go on until none is free. Past ``most`` levels an error is raised.
    """
    edges = staged(calls.select("conv", "call_id", F.explode("after").alias("on")).join(calls.select("conv", F.col("call_id").alias("on")), ["conv", "on"], "left_semi").distinct(), "after")
    waiting, done, level = staged(calls.select("conv", "call_id").distinct(), "waiting"), None, 0
    while True:
        held = edges.join(waiting.select("conv", F.col("call_id").alias("on")), ["conv", "on"], "left_semi").select("conv", "call_id").distinct()
        free = staged(waiting.join(held, ["conv", "call_id"], "left_anti").withColumn("level", F.lit(level)), "free")
        done = free if done is None else done.unionByName(free)
        if free.isEmpty():
            return done
        if most is not None and level >= most:
            raise RuntimeError(f"calls depend on each other over more than {most} levels")
        waiting = staged(waiting.join(free, ["conv", "call_id"], "left_anti"), "waiting")
        level += 1
        if level % _ROUNDS == 0:
            done = staged(done, "levels")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, Any]], most_levels: int | None = None) -> DataFrame:
    """calls: conv, call_id, position, tool, arguments (JSON), after (array of call_ids); results: conv, call_id, position, content.

    One row per call and one per result that goes with none.  Columns: conv, call_id, tool, position,
    result_position, status, place (topological, from 0 in its conversation; null for what isn't a call that
    counts), errors (array), valid, canonical (JSON with arguments, id, name, result).

    status: linked; unanswered; early (its result stands before it); cyclic (waits for itself, or for a call that does);
    duplicate_call (a call of that id came before, which alone counts); orphan (a result without call);
    duplicate_result (the call has an earlier one).  Calls or results without conv or identifier link to
    nothing: unanswered or orphan, each a row.  Equal positions are settled by content.  Arguments that
    aren't a JSON object are invalid and have no canonical form.  Other columns are not read.

    Chains of any length are followed; with ``most_levels`` a longer one is an error.
    """
    a = calls.select("conv", "call_id", "position", "tool", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    r = results.select("conv", "call_id", "position", "content")
    named = F.col("conv").isNotNull() & F.col("call_id").isNotNull()
    ids = ["conv", "call_id"]
    first = a.where(named).groupBy(*ids).agg(F.min(F.struct("position", "tool", "arguments", "after")).alias("c"), F.count("*").alias("n_calls"))
    answer = r.where(named).groupBy(*ids).agg(F.min(F.struct("position", "content")).alias("r"), F.count("*").alias("n_results"))
    met = staged(first.join(answer, ids, "full"), "met").withColumns({f: F.col(f"c.{f}") for f in ("position", "tool", "arguments", "after")})
    own = met.where("c is not null")
    asked = own.select("conv", "call_id", "position", F.explode("after").alias("on"))
    before = own.select("conv", F.col("call_id").alias("on"), F.col("position").alias("on_position"))
    late = staged(asked.join(before, ["conv", "on"]).where("on_position >= position").select("conv").distinct(), "late")
    level = F.lit(0)
    cyclic = F.lit(False)
    if not late.isEmpty():
        levels = _levels(own.join(late, "conv", "left_semi"), most_levels)
        own = own.join(levels, ids, "left").join(late.withColumn("_late", F.lit(True)), "conv", "left")
        cyclic = F.coalesce("_late", F.lit(False)) & F.col("level").isNull()
        level = F.when(cyclic, F.lit(2**31 - 1)).otherwise(F.coalesce("level", F.lit(0)))
    own = own.withColumns({"_level": level, "_cyclic": cyclic})
    placed = grouped_rank(own, ["conv"], ["_level", "position", "call_id"], "place")
    status = F.when(F.col("_cyclic"), "cyclic").when(F.col("r").isNull(), "unanswered").when(F.col("r.position") < F.col("position"), "early").otherwise("linked")
    kept = placed.select(*ids, "tool", "position", F.col("r.position").alias("result_position"), status.alias("status"), F.when(~F.col("_cyclic"), F.col("place")).alias("place"), "arguments", F.col("r.content").alias("content"))

    def extra(rows: DataFrame, what: str, is_call: bool) -> DataFrame:
        none = F.lit(None)
        if is_call:
            return rows.select(*ids, "tool", "position", none.cast("long").alias("result_position"), F.lit(what).alias("status"), none.cast("long").alias("place"), "arguments", none.cast("string").alias("content"))
        return rows.select(*ids, none.cast("string").alias("tool"), none.cast("long").alias("position"), F.col("position").alias("result_position"), F.lit(what).alias("status"), none.cast("long").alias("place"), none.cast("string").alias("arguments"), "content")

    def repeats(rows: DataFrame, n: str, chosen: Column, fields: list[str]) -> DataFrame:
        """The rows of identifiers that come several times, without the one that counts (equal rows: without one of them)."""
        several = met.where(F.col(n) > 1).select(*ids, chosen.alias("_chosen"))
        counted = rows.join(several, ids).groupBy(*ids, *fields, "_chosen").agg(F.count("*").alias("_n"))
        same = F.struct(*fields).eqNullSafe(F.col("_chosen"))
        times = F.col("_n") - same.cast("long")
        return counted.where(times > 0).withColumn("_", F.explode(F.sequence(F.lit(1), times))).drop("_", "_n", "_chosen")

    tool_fields = ["position", "tool", "arguments", "after"]
    rows = [
        kept,
        extra(a.where(~named), "unanswered", True),
        extra(repeats(a.where(named), "n_calls", F.col("c"), tool_fields), "duplicate_call", True),
        extra(r.where(~named), "orphan", False),
        extra(met.where("c is null").select(*ids, "r.*"), "orphan", False),
        extra(repeats(r.where(named), "n_results", F.col("r"), ["position", "content"]), "duplicate_result", False),
    ]
    out = reduce(DataFrame.unionByName, rows)
    errors = F.when(F.col("tool").isNotNull() | F.col("arguments").isNotNull(), argument_errors(F.col("tool"), F.coalesce("arguments", F.lit("")), schemas))
    whole = F.concat(
        F.lit('{"arguments":'), canonical(F.col("arguments")), F.lit(',"id":'), _quoted(F.col("call_id")), F.lit(',"name":'), _quoted(F.col("tool")),
        F.lit(',"result":'), F.coalesce(_quoted(F.col("content")), F.lit("null")), F.lit("}"),
    )
    return out.withColumn("errors", errors).select(*ids, "tool", "position", "result_position", "status", "place", "errors", (F.col("tool").isNotNull() & (F.size("errors") == 0)).alias("valid"), F.when(F.col("place").isNotNull(), whole).alias("canonical"))


def _quoted(text: Column) -> Column:
    """A string as a JSON string."""
    return F.when(text.isNotNull(), F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1))


def from_messages(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Calls and results of chat messages that carry them as JSON.

    An assistant's ``{"tool_calls": [{"id", "name", "arguments", "after"}]}`` makes calls; a tool's
    ``{"tool_call_id", "content"}`` makes a result.  Other messages make neither.
    """
    base = messages.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("position"), F.col(role).alias("role"), F.try_parse_json(F.col(text)).alias("v"))
    listed = F.try_variant_get("v", "$.tool_calls", "array<variant>")
    call = F.explode(listed).alias("x")
    calls = base.where("role = 'assistant'").select("conv", "position", call).select(
        "conv",
        F.try_variant_get("x", "$.id", "string").alias("call_id"),
        "position",
        F.try_variant_get("x", "$.name", "string").alias("tool"),
        F.to_json(F.try_variant_get("x", "$.arguments", "variant")).alias("arguments"),
        F.try_variant_get("x", "$.after", "array<string>").alias("after"),
    )
    results = base.where("role = 'tool' and v is not null").select("conv", F.try_variant_get("v", "$.tool_call_id", "string").alias("call_id"), "position", F.try_variant_get("v", "$.content", "string").alias("content"))
    return calls, results


def from_turns(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Plain chats as calls: a user's turn asks for a reply, the assistant's next turn is its result.

    The identifier is ``conversation/turn`` of the user's turn.  Plain chats name no dependencies, so they are given by rule: of
    every four requests the first waits for the second and the second for the third, which stand behind them; the fourth
    waits for the first.  Where the conversation is divisible by 10 the third waits for the first as well: a cycle, which
    holds the fourth too.  A request that isn't there holds nobody.
    """
    ident = lambda shift: F.concat_ws("/", F.col(conv).cast("string"), (F.col(turn) - shift).cast("string"))
    arguments = F.to_json(F.struct(F.col(text).alias("text"), F.col(turn).cast("long").alias("turn")))
    nth = F.pmod(F.expr(f"`{turn}` div 2"), F.lit(4))
    cycle = F.pmod(F.col(conv).try_cast("long"), F.lit(10)) == 0
    after = F.when(nth < 2, F.array(ident(-2))).when(nth == 3, F.array(ident(6))).when(cycle, F.array(ident(4)))
    after = F.coalesce(after, F.array().cast("array<string>"))
    calls = messages.where(F.col(role) == "user").select(F.col(conv).alias("conv"), ident(0).alias("call_id"), F.col(turn).cast("long").alias("position"), F.lit("reply").alias("tool"), arguments.alias("arguments"), after.alias("after"))
    results = messages.where(F.col(role) == "assistant").select(F.col(conv).alias("conv"), ident(1).alias("call_id"), F.col(turn).cast("long").alias("position"), F.col(text).alias("content"))
    return calls, results
