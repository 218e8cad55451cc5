"""Chat formatting: linking tool calls to their results.

Calls and results are hash-joined by conversation and identifier. Calls are
ordered so that each follows all it depends on: ``level`` is the length of the longest
chain of dependencies below a call, so (level, turn) orders a conversation.
Levels come by doubling: round k knows which calls lie exactly 2^k dependencies below a call,
and joins these steps with themselves, so the rounds are the logarithm of the
longest chain. Arguments are validated against per-tool schemas compiled to one
expression, and written as canonical JSON by way of Spark's variant type: keys sorted,
no blanks, and numbers as ECMAScript writes them, so 1.0, 1 and 1e0 are all 1.

All of it is DataFrame functions. No conversation is gathered: the rows of a hot one
meet by (conversation, identifier). Steps are as many as the calls of a chain, or the
calls times the width where dependencies fan out and in again.

Defined results: arguments that are null, no JSON or no object are ``invalid_json``
and have null canonical JSON; a tool without a schema is ``unknown_tool``; a call
with no result has null content and ``linked`` false; of several results the one of
the least turn is taken, then of the least content; a result of no call is a row of its own,
``unknown_call`` and not linked, with a null tool and level; repeated calls are one per
distinct row; a dependency on an unknown call is ``missing_dependency`` and counts for no level,
one on itself or in a cycle, or on what is in one, ``cycle`` with null level; rows with
a null conversation or identifier are returned unlinked; very long arguments and contents are
taken whole; empty tables give an empty one. Other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# JSON types and the names that Spark gives them in a variant.
TYPES = {
    "string": ("STRING",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"),
    "boolean": ("BOOLEAN",),
    "object": ("OBJECT",),
    "array": ("ARRAY",),
}


@dataclass(frozen=True)
class Parameter:
    name: str
    type: str
    required: bool = True


Schemas = dict[str, tuple[Parameter, ...]]


#: Strings and numbers of a JSON text.
_SCALARS = r'"(?:[^"\\]|\\.)*+"|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?'


def number(text: Column) -> Column:
    """A JSON number as ECMAScript writes it; an integer stays as it is, of whatever length."""
    size = F.abs(text.cast("double"))
    # Between these bounds without an exponent, with as many places as a double may need.
    plain = F.when(size >= 1, text.cast("decimal(38,16)").cast("string")).otherwise(F.regexp_replace(F.format_number(text.cast("decimal(38,25)"), 25), ",", ""))
    plain = F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    power = F.regexp_replace(F.regexp_replace(text.cast("double").cast("string"), r"\.0E", "E"), r"E(?=[0-9])", "e+")
    return F.when(~text.rlike("[.eE]"), text).when(size == 0, F.lit("0")).when((size >= 1e-6) & (size < 1e21), plain).otherwise(F.replace(power, F.lit("E-"), F.lit("e-")))


def canonical(args: Column) -> Column:
    """Canonical JSON of a JSON text: sorted keys, no blanks, one form for each number; null if it is none."""
    text = F.to_json(F.try_parse_json(args))
    tokens = F.regexp_extract_all(text, F.lit(_SCALARS), F.lit(0))
    written = F.transform(tokens, lambda t: F.when(t.startswith('"'), t).otherwise(number(t)))
    between = F.split(text, _SCALARS, -1)
    whole = F.array_join(F.zip_with(between, written, lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")
    return F.when(text.rlike("[0-9][.eE]"), whole).otherwise(text)


def problems(tool: Column, args: Column, schemas: Schemas) -> Column:
    """Names of what is wrong with a call's arguments, in a fixed order."""
    value = F.try_parse_json(args)
    kind = F.schema_of_variant(value)
    is_object = kind.startswith("OBJECT")

    def of(params: tuple[Parameter, ...]) -> Column:
        found = []
        for p in params:
            part = F.try_variant_get(value, f"$['{p.name}']", "variant")
            own = F.coalesce(F.schema_of_variant(part), F.lit("VOID"))
            fits = F.lit(False)
            for t in TYPES[p.type]:
                fits = fits | own.startswith(t)
            there = part.isNotNull() & (own != "VOID")
            found.append(F.when(~there, F.lit(f"missing:{p.name}") if p.required else F.lit(None).cast("string")).when(~fits, F.lit(f"type:{p.name}")))
        # Keys come from the value's map form, so that names no schema has are seen.
        keys = F.map_keys(F.from_json(F.to_json(value), "map<string,string>"))
        extra = F.array_sort(F.array_except(keys, F.array(*[F.lit(p.name) for p in params]).cast("array<string>")))
        return F.concat(F.array_compact(F.array(*found).cast("array<string>")), F.transform(extra, lambda k: F.concat(F.lit("unknown:"), k)))

    out = F.array(F.lit("unknown_tool"))
    for name, params in sorted(schemas.items()):
        out = F.when(tool == name, of(params)).otherwise(out)
    return F.when(value.isNull() | ~is_object, F.array(F.lit("invalid_json"))).otherwise(out)


def levels(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, call_id, level, missing) of calls (conv_id, call_id, depends_on)."""
    key = ["conv_id", "call_id"]
    nodes = calls.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).select(*key).distinct()
    edges = calls.select(*key, F.explode("depends_on").alias("needs")).where(F.col("needs").isNotNull() & F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).distinct()
    there = nodes.select("conv_id", F.col("call_id").alias("needs"), F.lit(True).alias("there"))
    edge = scratch.put(edges.join(there, ["conv_id", "needs"], "left"), "edges")
    missing = edge.where("there is null").select(*key, F.lit(True).alias("missing")).distinct()
    # Levels below 2^k are known in round k; ``step`` has what lies exactly 2^k dependencies below a call.
    level = scratch.put(nodes.withColumn("level", F.lit(0)), "levels")
    step = scratch.put(edge.where("there").select(*key, "needs"), "steps")
    most = level.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    k = 0
    while not step.isEmpty() and 1 << k < 2 * most:
        below = level.select("conv_id", F.col("call_id").alias("needs"), F.col("level").alias("below"))
        more = step.join(below, ["conv_id", "needs"]).groupBy(*key).agg((F.max("below") + F.lit(1 << k)).alias("more"))
        known, walked = level, step
        level = scratch.put(level.join(more, key, "left").select(*key, F.coalesce("more", "level").alias("level")), "levels")
        onward = step.select("conv_id", F.col("call_id").alias("needs"), F.col("needs").alias("further"))
        step = scratch.put(step.join(onward, ["conv_id", "needs"]).select(*key, F.col("further").alias("needs")).distinct(), "steps")
        scratch.drop(known)
        scratch.drop(walked)
        k += 1
    # A chain of more steps than a conversation has calls goes round in a cycle.
    endless = step.select(*key, F.lit(True).alias("endless")).distinct()
    level = level.join(endless, key, "left").join(missing, key, "left")
    return level.select(*key, F.when(F.col("endless").isNull(), F.col("level")).alias("level"), F.coalesce("missing", F.lit(False)).alias("missing"))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call, and per result of no call: conv_id, call_id, turn, tool, level, linked, valid, errors, json.

    calls: conv_id, call_id, turn, tool, args (JSON text), depends_on (array of call ids).
    results: conv_id, call_id, turn, content. ``json`` is the canonical record of the call and its result.
    """
    key = ["conv_id", "call_id"]
    calls = calls.select("conv_id", F.col("call_id").cast("string").alias("call_id"), "turn", "tool", "args", F.coalesce(F.col("depends_on"), F.array().cast("array<string>")).alias("depends_on")).distinct()
    results = results.select("conv_id", F.col("call_id").cast("string").alias("call_id"), "turn", "content")
    whole = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    result = results.where(whole).groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("result"))
    placed = levels(calls, Scratch(calls.sparkSession, "calls"))
    joined = calls.hint("shuffle_hash").join(result, key, "left").join(placed, key, "left")
    joined = joined.withColumn("canonical", canonical(F.col("args"))).withColumn("wrong", problems(F.col("tool"), F.col("args"), schemas))
    more = F.array_compact(F.array(F.when(F.col("missing"), F.lit("missing_dependency")), F.when(F.col("missing").isNotNull() & F.col("level").isNull(), F.lit("cycle"))))
    errors = F.concat("wrong", more)
    linked = F.col("result").isNotNull()
    # Names in alphabetic order; null fields are left out.
    head = F.to_json(F.struct(F.col("call_id").alias("id"), F.col("result.content").alias("result"), F.col("tool").alias("tool")))
    record = F.concat(F.lit('{"arguments":'), F.coalesce("canonical", F.lit("null")), F.lit(","), F.substring(head, 2, 2**31 - 1))
    asked = joined.select(*key, "turn", "tool", "level", linked.alias("linked"), (F.size(errors) == 0).alias("valid"), errors.alias("errors"), record.alias("json"))
    alone = result.join(calls.where(whole).select(*key).distinct(), key, "left_anti").select(*key, "result.turn", "result.content")
    alone = alone.unionByName(results.where(~whole).distinct())
    record = F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result")))
    none = lambda t: F.lit(None).cast(t)
    return asked.unionByName(
        alone.select(*key, "turn", none("string").alias("tool"), none("int").alias("level"), F.lit(False).alias("linked"), F.lit(False).alias("valid"), F.array(F.lit("unknown_call")).alias("errors"), record.alias("json"))
    )


#: The tool that the turns of a plain conversation are calls of.
TURN_SCHEMAS: Schemas = {"reply": (Parameter("prompt", "string"), Parameter("turn", "integer"))}


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations (conv_id, turn, role, text).

    A user's turn calls ``reply`` with its text as argument; the assistant's turn
    after it carries the result. A call depends on the one two turns before.
    """
    asked = turns.where(F.col("role") == "user")
    name = lambda t: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), t.cast("string"))
    args = F.to_json(F.struct(F.col("turn").alias("turn"), F.col("text").alias("prompt")))
    earlier = F.when(F.col("turn") >= 2, F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
    calls = asked.select("conv_id", name(F.col("turn")).alias("call_id"), "turn", F.lit("reply").alias("tool"), args.alias("args"), earlier.alias("depends_on"))
    results = turns.where(F.col("role") == "assistant").select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
