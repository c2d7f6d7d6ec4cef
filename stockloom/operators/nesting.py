"""Shaping of nested child lists.

A nested list must fit in one row. Children are numbered inside their parent, in the order of their
ids, and every ``part_width`` of them make one part. A parent with no more children than the width is
exactly one row, whatever its ids are; a parent holding a large share of all children is spread over
many rows and tasks, and nothing is dropped. The numbers are counts over blocks of ids, so that no
parent is numbered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.operators.scans import RunningSum, materialize, running

DEFAULT_PART_WIDTH = 65_536
# Ids in a block of the numbering.
_BLOCK = 65_536
_LOWEST = -(1 << 62)


def nest_children(
    parents: DataFrame | None,
    children: DataFrame,
    keys: Sequence[str],
    order: str,
    fields: Sequence[str],
    out: str,
    part_width: int = DEFAULT_PART_WIDTH,
) -> DataFrame:
    """(keys, part, list of child structs sorted by ``order``).

    ``children`` holds each (keys, order) once; ``order`` is an integer. With ``parents`` given, every
    parent has a part 0, with an empty list when it has no children. Writes the numbered children once.
    """
    numbered = running(
        children,
        keys,
        [order],
        [RunningSum("_before", F.lit(1).cast("bigint"), inclusive=False)],
        block=F.coalesce(F.expr(f"`{order}` div {_BLOCK}"), F.lit(_LOWEST)),
        output=list(dict.fromkeys([*keys, order, *fields])),
    )
    child = F.struct(F.col(order).alias("_order"), F.struct(*fields).alias("_child"))
    part = F.expr(f"_before div {part_width}").alias("part")
    stream = numbered.select(*keys, part, child.alias("_entry"))
    if parents is not None:
        headers = parents.select(*keys, F.lit(0).cast("bigint").alias("part"))
        stream = stream.unionByName(headers, allowMissingColumns=True)
    entries = F.array_sort(F.collect_list("_entry"))
    return stream.groupBy(*keys, "part").agg(
        F.transform(entries, lambda e: e["_child"]).alias(out)
    )


def distinct_set(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per key, one row each."""
    return df.select(*keys, value).distinct()


def distinct_over_samples(
    rolls: DataFrame, item: str = "item_id", sample: str = "sample"
) -> DataFrame:
    """Union of the positive ids over all samples, with the number of samples that hold each.

    Values that are no integers are skipped. Repeats inside a sample collapse before the shuffle.
    """
    ids = rolls.select(F.col(item).try_cast("int").alias(item), sample)
    return (
        ids.filter(F.col(item) > 0)
        .distinct()
        .groupBy(item)
        .agg(F.count("*").alias("n_samples"))
    )


def take_while_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], stop: Column
) -> DataFrame:
    """Rows of each group before its first stop row along ``order``.

    The flat form of ``take_while``: the stop position is a partial aggregate and rows are kept by
    comparison, so a group is never gathered. A null stop test does not stop. The stops, one row per
    group that has one, are stored: Spark sees their size, and their join is not tied to the aggregate.
    """
    position = F.struct(*order)
    stops = materialize(
        df.filter(F.coalesce(stop, F.lit(False)))
        .groupBy(*keys)
        .agg(F.min(position).alias("_stop"))
    )
    joined = df.join(stops, list(keys), "left")
    return joined.filter(F.col("_stop").isNull() | (position < F.col("_stop"))).select(*df.columns)


def sum_nested_sizes(df: DataFrame, arr: str, out: str) -> DataFrame:
    return df.agg(F.coalesce(F.sum(F.size(arr)), F.lit(0)).alias(out))
