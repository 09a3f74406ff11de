"""Tool-call linking in DataFrame operations only.

Calls and results are joined by conversation and call identifier, calls are put
in topological order of their dependencies by pointer doubling, arguments are
parsed as variants and checked against the schema of their tool, and every
record is serialised as canonical JSON (keys sorted, no spaces).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auralake.llm.storage import materialise

#: JSON type -> how schema_of_variant names it.
_TYPES = {
    "string": r"^STRING$",
    "integer": r"^BIGINT$",
    "number": r"^(BIGINT|DOUBLE|DECIMAL.*)$",
    "boolean": r"^BOOLEAN$",
    "array": r"^ARRAY<.*$",
    "object": r"^OBJECT<.*$",
}


def _spec(given: tuple | dict) -> dict:
    return dict(zip(("type", "required"), given, strict=True)) if isinstance(given, tuple) else given


def _problems(arguments: Column, properties: dict, path: str, inside: Column) -> list[tuple[Column, Column]]:
    """(holds, text) of each thing that can be wrong with the properties of an object that is there where `inside` holds."""
    found = []
    for key, given in properties.items():
        spec = _spec(given)
        name = f"{path}{key}"
        kind = F.schema_of_variant(F.try_variant_get(arguments, f"$.{name}", "variant"))
        missing = F.coalesce(kind == "VOID", F.lit(True))
        fits = kind.rlike(_TYPES[spec["type"]])
        found.append((inside & ~missing & ~fits, F.lit(f"{name}: not {spec['type']}")))
        if spec.get("required"):
            found.append((inside & missing, F.lit(f"{name}: missing")))
        if "items" in spec:
            item = _TYPES[spec["items"]].strip("^$")
            found.append((inside & ~missing & fits & ~kind.rlike(f"^ARRAY<({item}|VOID)>$"), F.lit(f"{name}: items not {spec['items']}")))
        if "enum" in spec:
            value = F.try_variant_get(arguments, f"$.{name}", "string")
            found.append((inside & ~missing & fits & ~F.coalesce(value.isin(*map(str, spec["enum"])), F.lit(False)), F.lit(f"{name}: not allowed")))
        if "properties" in spec:
            found += _problems(arguments, spec["properties"], f"{name}.", inside & ~missing & fits)
    return found


def validation_errors(arguments: Column, tool: Column, schemas: dict[str, dict[str, tuple[str, bool] | dict]]) -> Column:
    """Sorted array of errors of a variant column against schemas[tool][property].

    A property is (type, required), or a dict of type, required, and optionally
    enum (allowed values), items (type of an array's entries) and properties (of
    an object, to any depth).  Properties that no schema names are allowed.
    """
    known = tool.isin(*schemas)
    errors = [F.when(arguments.isNull(), F.lit("arguments: not JSON")), F.when(~known, F.lit("tool: unknown"))]
    for name, properties in schemas.items():
        here = (tool == name) & arguments.isNotNull()
        errors += [F.when(holds, text) for holds, text in _problems(arguments, properties, "", here)]
    return F.array_sort(F.array_compact(F.array(*errors)))


def topological_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 without a known dependency, else 1 + the level of `parent_id`; null in a cycle or below one.

    Pointer doubling: every call knows an ancestor and the steps up to it, and
    each round replaces it by the ancestor's own, so a chain of n calls takes
    log2(n) rounds.  A call whose ancestor is a root is done and is not joined
    again.  After r rounds an open call has more than 2 ** r calls above it; when
    that is more than there are, it is above itself.
    """
    key = ["conv_id", "call_id"]
    nodes = calls.groupBy(*key).agg(F.min("parent_id").alias("up"))
    roots = materialise(nodes.select(*key, "up"), "nodes")
    known = roots.select("conv_id", F.col("call_id").alias("up"), F.lit(True).alias("there"))
    linked = materialise(roots.join(known.hint("shuffle_hash"), ["conv_id", "up"], "left"), "linked")
    steps = F.when(F.col("there"), 1).otherwise(0).cast("long").alias("steps")
    done = [linked.filter("there IS NULL").select(*key, steps)]
    waiting = linked.filter("there").select(*key, "up", steps)
    most, reach = waiting.count(), 1
    left = most
    while left and reach <= most:
        open_ones = waiting.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
        above = open_ones
        for part in done:
            above = above.unionByName(part.select("conv_id", F.col("call_id").alias("up"), F.lit(None).cast("string").alias("next"), F.col("steps").alias("more")))
        jumped = materialise(
            waiting.join(above.hint("shuffle_hash"), ["conv_id", "up"]).select(*key, F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps")), "jumped"
        )
        done.append(jumped.filter("up IS NULL").select(*key, "steps"))
        waiting = jumped.filter("up IS NOT NULL")
        reach, left = 2 * reach, waiting.count()
    out = waiting.select(*key, F.lit(None).cast("long").alias("level"))
    for part in done:
        out = out.unionByName(part.select(*key, F.col("steps").alias("level")))
    return out


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool] | dict]]) -> DataFrame:
    """One row per call and per result without a call: (conv_id, call_id, status, level, valid, errors, record).

    calls: conv_id, call_id, turn, tool, arguments (JSON text), parent_id.
    results: conv_id, call_id, turn, content.  Where an identifier repeats in a
    conversation the first turn counts.  status is linked, pending (no result),
    orphan (no call) or early (the result's turn precedes the call).  level is
    the topological level; (level, turn) orders a conversation.  Rows with a null
    identifier are left out; null or malformed arguments are invalid; empty
    tables give an empty result.
    """
    calls = _first(calls, ["tool", "arguments", "parent_id"])
    results = _first(results, ["content"])
    levels = topological_levels(calls)
    asked = calls.withColumn("arguments", F.try_parse_json("arguments")).withColumnRenamed("turn", "call_turn")
    errors = validation_errors(F.col("arguments"), F.col("tool"), schemas)
    asked = asked.select("conv_id", "call_id", "call_turn", "tool", F.to_json("arguments").alias("canonical"), errors.alias("errors"))
    joined = asked.join(levels, ["conv_id", "call_id"], "left").join(
        results.withColumnRenamed("turn", "result_turn").hint("shuffle_hash"), ["conv_id", "call_id"], "full_outer"
    )
    status = (
        F.when(F.col("tool").isNull() & F.col("call_turn").isNull(), "orphan")
        .when(F.col("result_turn").isNull(), "pending")
        .when(F.col("result_turn") < F.col("call_turn"), "early")
        .otherwise("linked")
    )
    quoted = lambda c: F.coalesce(F.get(F.split(F.to_json(F.struct(F.col(c).alias("a"))), '^[{]"a":'), F.lit(1)), F.lit("null}"))
    text = lambda c: F.expr(f"left({c}, length({c}) - 1)")
    fields = joined.withColumns({"status": status, "_c": quoted("content"), "_i": quoted("call_id"), "_t": quoted("tool")})
    record = F.concat(
        F.lit('{"arguments":'), F.coalesce("canonical", F.lit("null")),
        F.lit(',"call_id":'), text("_i"), F.lit(',"result":'), text("_c"), F.lit(',"tool":'), text("_t"), F.lit("}"),
    )
    return fields.select(
        "conv_id",
        "call_id",
        "status",
        F.col("level").cast("int").alias("level"),
        F.coalesce(F.size("errors") == 0, F.lit(False)).alias("valid"),
        F.concat_ws("; ", "errors").alias("errors"),
        record.alias("record"),
    )


def _first(rows: DataFrame, payload: list[str]) -> DataFrame:
    """The first row of each (conv_id, call_id), by turn, then content, through partial aggregation."""
    rows = rows.filter("conv_id IS NOT NULL AND call_id IS NOT NULL")
    best = rows.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", *payload)).alias("s"))
    return best.select("conv_id", "call_id", "s.turn", *(f"s.{c}" for c in payload))


#: Tools and argument schemas of the derived calls below.
SCHEMAS = {
    "lookup": {"limit": ("integer", True), "query": ("string", True)},
    "measure": {"exact": ("boolean", False), "length": ("integer", True)},
    "note": {"tags": ("array", True), "text": ("string", True)},
}


def derive_calls(conversations: DataFrame) -> DataFrame:
    """Every assistant turn as a call: the tool from the length of its text, the whole text as argument.

    Some arguments break their schema (a limit as text, no length, no tags).  A
    call depends on the one at half its turn number, if that is a call.
    """
    n = F.length(F.coalesce("text", F.lit("")))
    body = F.coalesce("text", F.lit(""))
    q = lambda c: F.expr(f"substring({c}, 6, length({c}) - 6)")
    rows = conversations.filter("role = 'assistant'").withColumns(
        {"n": n, "_q": F.to_json(F.struct(body.alias("a")))}
    )
    lookup = F.concat(F.lit('{"query": '), q("_q"), F.lit(', "limit": '), F.when(F.col("n") % 7 == 0, '"5"').otherwise("5"), F.lit("}"))
    measure = F.concat(F.lit('{"exact": true'), F.when(F.col("n") % 5 == 0, "").otherwise(F.concat(F.lit(', "length": '), F.col("n"))), F.lit("}"))
    note = F.concat(F.lit('{"text": '), q("_q"), F.when(F.col("n") % 4 == 0, "").otherwise(', "tags": [1, 2]'), F.lit("}"))
    kind = F.col("n") % 3
    return rows.select(
        "conv_id",
        F.concat(F.lit("call_"), F.col("turn").cast("string")).alias("call_id"),
        "turn",
        F.when(kind == 0, "lookup").when(kind == 1, "measure").otherwise("note").alias("tool"),
        F.when(kind == 0, lookup).when(kind == 1, measure).otherwise(note).alias("arguments"),
        F.when(F.col("turn") > 0, F.concat(F.lit("call_"), F.floor(F.col("turn") / 2).cast("string"))).alias("parent_id"),
    )


def derive_results(conversations: DataFrame) -> DataFrame:
    """Every user turn as the result of the call one turn earlier."""
    return conversations.filter("role = 'user'").select(
        "conv_id", F.concat(F.lit("call_"), (F.col("turn") - 1).cast("string")).alias("call_id"), "turn", F.col("text").alias("content")
    )
