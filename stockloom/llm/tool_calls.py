"""Chat formatting: calls of tools linked to their results, in dependency order, as canonical JSON.

Calls and results are joined by (conversation, identifier) after repeats were folded by aggregates. A call
comes at its own turn, or at the latest turn of what it depends on, if that is later; within one such
moment a call follows its dependencies. Both are found by passing values along dependency edges until
nothing changes: no pass is needed where dependencies point back, as they usually do, and as many as the longest
chain of forward edges otherwise. Positions are counts over blocks of turns, so that a long conversation spreads
over tasks. Arguments are parsed as variants and checked against the tool's schema; JSON is written with keys in
order and without spaces.

Defined cases: null identifiers, conversations or turns: a call without identifier or conversation cannot be linked and
is left out, a null turn comes first; of repeated calls or results with one identifier the earliest counts
(then the smallest text); a result without a call is left out; dependencies on unknown calls are ignored;
arguments that are null, no JSON, no object or have a key twice are ``malformed``; calls on a cycle of
dependencies, or after one, come last in their moment, by turn and identifier, with status ``cycle``; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.operators.scans import RunningSum, materialize, running

#: Turns in a block of the running positions.
BLOCK = 64
_FIRST = -(1 << 63)
#: JSON types by the beginning of Spark's name of a variant's type.
_KINDS = {
    "string": ("STRING",),
    "integer": ("BIGINT", "INT", "SMALLINT", "TINYINT"),
    "number": ("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT"),
    "boolean": ("BOOLEAN",),
    "array": ("ARRAY",),
    "object": ("OBJECT",),
}


@dataclass(frozen=True)
class Schema:
    """Types of a tool's parameters (a key of ``_KINDS``) and which of them are required."""

    types: Mapping[str, str]
    required: frozenset[str] = field(default_factory=frozenset)


def _first(df: DataFrame, values: list[str]) -> DataFrame:
    """The earliest row of each identifier."""
    named = df.filter("conv_id IS NOT NULL AND call_id IS NOT NULL").select(
        "conv_id", "call_id", F.coalesce(F.col("turn").cast("bigint"), F.lit(_FIRST)).alias("turn"), *values
    )
    row = F.struct("turn", *values)
    return named.groupBy("conv_id", "call_id").agg(F.min(row).alias("row")).select("conv_id", "call_id", "row.*")


def moments(calls: DataFrame, depends: DataFrame) -> DataFrame:
    """``conv_id``, ``call_id``, ``turn``, ``moment``, ``level`` of distinct calls.

    ``depends`` has ``conv_id``, ``call_id``, ``needs``. ``level`` orders the calls of one moment; it is null on a
    cycle or after one. Both tables should be stored.
    """
    keys = ["conv_id", "call_id"]
    known = calls.select("conv_id", F.col("call_id").alias("needs"))
    edges = materialize(depends.join(calls.select(*keys), keys, "left_semi").join(known, ["conv_id", "needs"], "left_semi").distinct())
    ready = calls.select(*keys, "turn", F.col("turn").alias("moment"))
    while True:
        later = materialize(_needed(edges, ready).filter("needed > moment").groupBy(*keys).agg(F.max("needed").alias("later")))
        if later.isEmpty():
            break
        ready = materialize(
            ready.join(later, keys, "left").withColumn("moment", F.coalesce("later", "moment")).drop("later")
        )
    # Only edges inside one moment are left to be ordered; level 0 has none of them.
    open_edges = materialize(_needed(edges, ready).filter("needed = moment").select("conv_id", "call_id", "needs"))
    levels, step = ready.withColumn("level", F.lit(0)), 0
    if not open_edges.isEmpty():
        waiting = materialize(open_edges.select(*keys).distinct())
        free = ready.join(waiting, keys, "left_anti").withColumn("level", F.lit(0))
        levels = materialize(free)
        while not waiting.isEmpty():
            step += 1
            # A call is free once none of the calls it needs in this moment waits.
            blocked = open_edges.join(waiting.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left_semi")
            still = materialize(blocked.select(*keys).distinct().join(waiting, keys, "left_semi"))
            freed = materialize(waiting.join(still, keys, "left_anti"))
            if freed.isEmpty():
                levels = levels.unionByName(ready.join(still, keys, "left_semi").withColumn("level", F.lit(None).cast("int")))
                break
            levels = materialize(levels.unionByName(ready.join(freed, keys, "left_semi").withColumn("level", F.lit(step))))
            waiting = still
    return levels


def _needed(edges: DataFrame, ready: DataFrame) -> DataFrame:
    """Edges with the moments of both ends."""
    ends = ready.select("conv_id", F.col("call_id").alias("needs"), F.col("moment").alias("needed"))
    return edges.join(ends, ["conv_id", "needs"]).join(ready.select("conv_id", "call_id", "moment"), ["conv_id", "call_id"])


def positions(ordered: DataFrame) -> DataFrame:
    """Add ``position`` in the conversation, from 0, by moment, level, turn and identifier."""
    last = F.coalesce("level", F.lit((1 << 31) - 1))
    return running(
        ordered.withColumn("_last", last),
        ["conv_id"],
        ["moment", "_last", "turn", "call_id"],
        [RunningSum("position", F.lit(1).cast("bigint"), inclusive=False)],
        block=F.expr(f"moment div {BLOCK}"),
        output=["conv_id", "call_id", "level"],
    )


def argument_errors(name: Column, arguments: Column, schemas: Mapping[str, Schema]) -> Column:
    """Sorted array of errors of parsed arguments (variant, null if malformed)."""
    kind = F.schema_of_variant(arguments)
    errors = F.array(F.lit("unknown tool"))
    for tool, schema in schemas.items():
        found = []
        for key, type_ in sorted(schema.types.items()):
            got = F.schema_of_variant(F.variant_get(arguments, f"$['{key}']", "variant"))
            fits = F.lit(False)
            for start in _KINDS[type_]:
                fits = fits | got.startswith(start)
            missing = F.lit(f"missing {key}") if key in schema.required else F.lit(None).cast("string")
            # A JSON null is of the type VOID and counts as absent.
            absent = got.isNull() | (got == "VOID")
            found.append(F.when(absent, missing).when(~fits, F.lit(f"type of {key}")))
        known = F.array(*map(F.lit, sorted(schema.types)))
        keys = F.map_keys(arguments.cast("map<string,variant>"))
        extra = F.transform(F.array_except(keys, known), lambda k: F.concat(F.lit("unexpected "), k))
        these = F.array_sort(F.concat(F.array_compact(F.array(*found)), F.coalesce(extra, F.array().cast("array<string>"))))
        errors = F.when(name == tool, these).otherwise(errors)
    return F.when(arguments.isNull() | ~kind.startswith("OBJECT"), F.array(F.lit("malformed"))).otherwise(errors)


def link(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Schema]) -> DataFrame:
    """One row for each call with an identifier.

    ``calls``: ``conv_id``, ``call_id``, ``turn``, ``name``, ``arguments`` (JSON), ``depends_on`` (array of
    identifiers); ``results``: ``conv_id``, ``call_id``, ``turn``, ``content``. Returns ``conv_id``, ``position``,
    ``call_id``, ``name``, ``status`` (ok, unanswered, invalid or cycle), ``errors`` and ``json``.
    """
    first = materialize(_first(calls, ["name", "arguments", "depends_on"]))
    answers = _first(results, ["content"]).select("conv_id", "call_id", "content")
    depends = first.select("conv_id", "call_id", F.explode("depends_on").alias("needs")).filter("needs IS NOT NULL")
    placed = positions(moments(first, materialize(depends)))
    joined = (
        first.join(answers.withColumn("answered", F.lit(True)), ["conv_id", "call_id"], "left")
        .join(placed, ["conv_id", "call_id"])
        .withColumn("parsed", F.try_parse_json("arguments"))
    )
    checked = joined.withColumn("errors", argument_errors(F.col("name"), F.col("parsed"), schemas))
    status = (
        F.when(F.col("level").isNull(), "cycle")
        .when(F.size("errors") > 0, "invalid")
        .when(F.col("answered").isNull(), "unanswered")
        .otherwise("ok")
    )
    # Members in the order of their names; a variant keeps its own keys in order.
    message = F.struct(
        F.col("parsed").alias("arguments"), F.col("call_id").alias("id"), F.col("name").alias("name"),
        F.col("content").alias("result"),
    )
    return checked.select(
        "conv_id", "position", "call_id", "name", status.alias("status"), "errors",
        F.to_json(message, {"ignoreNullFields": "false"}).alias("json"),
    )
