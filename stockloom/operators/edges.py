"""Typed transformation edges: direct transforms and decomposition through recipes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.functions.arrays import take_while
from stockloom.functions.names import EDGE_ITEM_LABEL, fallback_label, resolve_name
from stockloom.functions.numbers import default_amount
from stockloom.operators.dedupe import dedupe_first
from stockloom.operators.lookups import lookup_left, with_equivalent
from stockloom.operators.nesting import take_while_rows
from stockloom.schemas import DECOMPOSE_EDGE, DIRECT_EDGE

EDGE_KEY = ["input_item_id", "output_item_id", "output_amount", "type"]
EDGE_ORDER = ["input_item_id", "type", "output_item_id", "output_amount"]


def edge_names(names: DataFrame) -> DataFrame:
    """(item_id, item_name) from (id, localized_name, internal_name), one row per id in range."""
    return names.select(
        F.col("id").alias("item_id"),
        resolve_name(
            F.col("localized_name"),
            F.col("internal_name"),
            label=EDGE_ITEM_LABEL,
            id_col=F.col("id"),
        ).alias("item_name"),
    )


def _direct_keys(ids: DataFrame, transform_map: DataFrame) -> DataFrame:
    targets = transform_map.filter((F.col("item_id") >= 1) & (F.col("to_item_id") > 0))
    return targets.join(ids, "item_id", "left_semi").select(
        F.col("item_id").alias("input_item_id"),
        F.col("to_item_id").alias("output_item_id"),
        F.lit(1).alias("output_amount"),
        F.lit(DIRECT_EDGE).alias("type"),
    )


def recipe_outputs(recipes: DataFrame) -> DataFrame:
    """(recipe_index, output_item_id, stack) from nested recipes.

    Custom results are used when present, even if empty, else the required items. The list stops at
    the first id <= 0; null elements are skipped.
    """
    outputs = take_while(
        F.coalesce(F.col("custom_results"), F.col("required_items")), lambda x: x["type"] <= 0
    )
    return recipes.select("recipe_index", F.explode(outputs).alias("o")).select(
        "recipe_index", F.col("o")["type"].alias("output_item_id"), F.col("o")["stack"].alias("stack")
    )


def flat_recipe_outputs(
    required: DataFrame, custom: DataFrame, has_custom: DataFrame, order: Sequence[str]
) -> DataFrame:
    """As :func:`recipe_outputs` from flat rows (recipe_index, order..., type, stack).

    ``has_custom`` lists the recipes whose custom results replace the required items; such a recipe
    without rows in ``custom`` has no outputs.
    """
    slots = required.join(has_custom, "recipe_index", "left_anti").unionByName(custom)
    kept = take_while_rows(slots, ["recipe_index"], order, F.col("type") <= 0)
    return kept.filter(F.col("type").isNotNull()).select(
        "recipe_index", F.col("type").alias("output_item_id"), "stack"
    )


def _decompose_keys(
    ids: DataFrame,
    transform_map: DataFrame,
    equivalence_map: DataFrame,
    decraft_map: DataFrame,
    outputs: DataFrame,
) -> DataFrame:
    inputs = ids.filter(F.col("item_id") >= 1).select("item_id")
    equivalents = with_equivalent(inputs, equivalence_map, "item_id", "equivalent_id")
    blocked = transform_map.filter(F.col("to_item_id") > 0).select(
        F.col("item_id").alias("equivalent_id")
    )
    decraft = decraft_map.filter(F.col("recipe_index") >= 0).select(
        F.col("item_id").alias("equivalent_id"), "recipe_index"
    )
    return (
        equivalents.join(blocked, "equivalent_id", "left_anti")
        .join(decraft, "equivalent_id")
        .join(outputs, "recipe_index")
        .select(
            F.col("item_id").alias("input_item_id"),
            "output_item_id",
            default_amount(F.col("stack")).alias("output_amount"),
            F.lit(DECOMPOSE_EDGE).alias("type"),
        )
    )


def _with_names(edges: DataFrame, item_names: DataFrame) -> DataFrame:
    """Names of both ends, attached after de-duplication so that shuffles carry integers only."""
    named = edges
    for end in ("input", "output"):
        named = lookup_left(
            named, item_names, {f"{end}_item_id": "item_id"}, {"item_name": f"_{end}_name"}
        ).withColumn(
            f"{end}_item_name",
            F.coalesce(
                F.col(f"_{end}_name"), fallback_label(EDGE_ITEM_LABEL, F.col(f"{end}_item_id"))
            ),
        )
    return named.select(
        "input_item_id",
        "input_item_name",
        "output_item_id",
        "output_item_name",
        "output_amount",
        "type",
    )


def direct_edges(item_names: DataFrame, transform_map: DataFrame) -> DataFrame:
    return _with_names(dedupe_first(_direct_keys(item_names, transform_map), EDGE_KEY), item_names)


def decompose_edges(
    item_names: DataFrame,
    transform_map: DataFrame,
    equivalence_map: DataFrame,
    decraft_map: DataFrame,
    outputs: DataFrame,
) -> DataFrame:
    """One edge per output of the recipe of each id's equivalent.

    ``outputs`` comes from :func:`recipe_outputs` or :func:`flat_recipe_outputs`.
    An id is skipped when its *equivalent* has a direct transform; the id itself may have one.
    """
    keys = _decompose_keys(item_names, transform_map, equivalence_map, decraft_map, outputs)
    return _with_names(dedupe_first(keys, EDGE_KEY), item_names)


def transform_edges(
    item_names: DataFrame,
    transform_map: DataFrame,
    equivalence_map: DataFrame,
    decraft_map: DataFrame,
    outputs: DataFrame,
) -> DataFrame:
    """Direct and decomposition edges, each once. Unordered; see :func:`edge_order`."""
    keys = _direct_keys(item_names, transform_map).unionByName(
        _decompose_keys(item_names, transform_map, equivalence_map, decraft_map, outputs)
    )
    return _with_names(dedupe_first(keys, EDGE_KEY), item_names)


def edge_order(edges: DataFrame) -> DataFrame:
    """Total order of edges: a range-partitioned sort."""
    return edges.orderBy(*EDGE_ORDER)
