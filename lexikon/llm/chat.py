"""Tool-call linking for chat data, in DataFrame operations only.

Calls and results are hash-joined by their identifier, calls are put in
topological order (pointer doubling along the call each one depends on, so a
chain of n calls takes log n joins), arguments are validated against schemas,
and every link is serialised as canonical JSON: keys in order, no white space.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexikon.llm.common import written

#: Names of JSON types as ``schema_of_variant`` gives them.
KINDS = {
    "string": r"^STRING$",
    "integer": r"^BIGINT$",
    "number": r"^(BIGINT|DOUBLE|DECIMAL\(.*\))$",
    "boolean": r"^BOOLEAN$",
    "array": r"^ARRAY<",
    "object": r"^OBJECT<",
}


def field_errors(arguments: Column, field: str, rule: dict) -> list[Column]:
    """What is wrong with one field: null where nothing is.  ``rule``: type, required,
    and min and max of a number or of a string's length."""
    value = F.try_variant_get(arguments, f"$['{field}']", "variant")
    kind = F.schema_of_variant(value)
    absent = value.isNull() | (kind == "VOID")
    out = [F.when(absent, F.lit(f"{field}: missing") if rule.get("required") else F.lit(None)).when(
        ~kind.rlike(KINDS[rule["type"]]), F.lit(f"{field}: not of type {rule['type']}"))]
    text = F.try_variant_get(arguments, f"$['{field}']", "string")
    size = F.length(text).cast("double") if rule["type"] == "string" else text.try_cast("double")
    fits = ~absent & kind.rlike(KINDS[rule["type"]])
    if "min" in rule:
        out.append(F.when(fits & (size < rule["min"]), F.lit(f"{field}: below {rule['min']}")))
    if "max" in rule:
        out.append(F.when(fits & (size > rule["max"]), F.lit(f"{field}: above {rule['max']}")))
    return out


def errors(name: Column, arguments: Column, schemas: dict[str, dict[str, dict]]) -> Column:
    """The errors of a call's parsed ``arguments`` under the schema of its tool."""
    found = F.array(F.lit("unknown tool"))
    for tool, fields in schemas.items():
        own = [e for f, rule in fields.items() for e in field_errors(arguments, f, rule)]
        listed = F.array_compact(F.array(*own)) if own else F.array().cast("array<string>")
        found = F.when(name == tool, listed).otherwise(found)
    return F.when(arguments.isNull() | ~F.schema_of_variant(arguments).rlike(KINDS["object"]),
                  F.array(F.lit("arguments: not an object"))).otherwise(found)


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth) from unique (conv_id, call_id, after): 0 for a call that
    depends on no other one, null for one on a cycle or behind one."""
    ids = calls.select("conv_id", F.col("call_id").alias("after"), F.col("call_id").alias("at"))
    state = written(calls.join(ids, ["conv_id", "after"], "left").select(
                        "conv_id", "call_id", F.col("at").alias("up"),
                            F.when(F.col("at").isNull(), 0).otherwise(1).cast("long").alias("depth")), "depths")
    n = state.where("up IS NOT NULL").count()
    for _ in range(math.ceil(math.log2(n + 1)) + 1 if n else 0):
        far = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("far"),
                           F.col("depth").alias("more"))
        state = written(state.join(far, ["conv_id", "up"], "left").select(
            "conv_id", "call_id", F.col("far").alias("up"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "depths")
        if state.where("up IS NOT NULL").isEmpty():
            break
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, dict]]) -> DataFrame:
    """One row for each link of a call (conv_id, call_id, after, name, arguments as JSON
    text) with a result (conv_id, call_id, content), and one for each call or result
    without any: conv_id, call_id, status, depth, name, errors, valid, content, json.

    status is answered, unanswered, orphan (a result of no call) or duplicate (a
    different call under an identifier that a call with a smaller name, then
    smaller arguments, has; it is not linked).  Rows that repeat are one row.  A
    null conv_id or call_id links with nothing.  ``after`` names the call whose
    result a call waits for; if there is no such call it waits for none.  Depth
    orders the calls of a conversation topologically.  Arguments that are null,
    no JSON or no object are one error.  Other columns are left out.
    """
    unique = calls.select("conv_id", "call_id", "after", "name", "arguments").distinct()
    key = F.struct("name", "arguments", "after")
    first = unique.groupBy("conv_id", "call_id").agg(F.min(key).alias("first"))
    same = F.col("u.conv_id").eqNullSafe(F.col("f.conv_id")) & F.col("u.call_id").eqNullSafe(F.col("f.call_id"))
    nameless = F.col("u.conv_id").isNull() | F.col("u.call_id").isNull()
    parted = written(unique.withColumn("own", key).alias("u").join(first.alias("f"), same).select(
        "u.conv_id", "u.call_id", "u.after", "u.name", "u.arguments",
        (F.col("own").eqNullSafe(F.col("first")) | nameless).alias("linked")), "calls")
    named = parted.where("linked AND conv_id IS NOT NULL AND call_id IS NOT NULL")
    levels = depths(named.select("conv_id", "call_id", "after"))
    single = results.select("conv_id", "call_id", F.col("content"), F.lit(True).alias("has")).distinct()
    linked = (parted.where("linked").join(levels, ["conv_id", "call_id"], "left")
              .withColumn("depth", F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), 0)
                          .otherwise(F.col("depth")))
              .withColumn("is_call", F.lit(True))
              .join(single, ["conv_id", "call_id"], "full")
              .withColumn("status", F.when(F.col("is_call").isNull(), "orphan").when(
                  F.col("has").isNull(), "unanswered").otherwise("answered")))
    other = parted.where("NOT linked").withColumn("status", F.lit("duplicate"))
    columns = ["conv_id", "call_id", "status", "depth", "name", "arguments", "content"]
    rows = linked.select(columns).unionByName(other.select(
        "conv_id", "call_id", "status", F.lit(None).cast("long").alias("depth"), "name", "arguments",
        F.lit(None).cast("string").alias("content")))
    parsed = F.try_parse_json("arguments")
    judged = rows.withColumn("parsed", parsed).withColumn(
        "errors", F.when(F.col("status") == "orphan", F.array().cast("array<string>")).otherwise(
            errors(F.col("name"), F.col("parsed"), schemas))).withColumn("valid", F.size("errors") == 0)
    canonical = F.to_json(F.struct(F.col("parsed").alias("arguments"), "content", "depth", "errors",
                                   F.col("call_id").alias("id"), "name", "status"), {"ignoreNullFields": "false"})
    return judged.withColumn("json", canonical).select("conv_id", "call_id", "status", "depth", "name", "errors",
                                                       "valid", "content", "json")


CALLERS = {"user": "ask", "system": "instruct"}


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain (conv_id, turn, role, text) conversations.

    A turn of a user or of the system asks and has an identifier of its own; a
    turn of any other role answers the turn before it.  A call waits for what
    the turn before it stands for.  No window over a conversation is needed:
    neighbours are joined by turn number.
    """
    calls = F.col("role").isin(*CALLERS)
    own = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    before = F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    ids = turns.select("conv_id", "turn", "role", "text", F.when(known, F.when(calls, own).otherwise(before)).alias("call_id"))
    previous = ids.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("call_id").alias("after")) \
        .groupBy("conv_id", "turn").agg(F.min("after").alias("after"))
    asked = ids.where(calls).join(previous, ["conv_id", "turn"], "left")
    name = F.when(F.col("role") == "user", "ask").otherwise("instruct")
    arguments = F.to_json(F.struct("text", "turn"), {"ignoreNullFields": "false"})
    return (asked.select("conv_id", "call_id", "after", name.alias("name"), arguments.alias("arguments")),
            ids.where(~calls | F.col("role").isNull()).select("conv_id", "call_id", F.col("text").alias("content")))
