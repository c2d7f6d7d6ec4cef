"""Equi lookups against a dimension.

No join here is forced to broadcast. Spark broadcasts a side when its measured size is below
``spark.sql.autoBroadcastJoinThreshold`` (at planning time or at run time) and otherwise does a
sort-merge join, where adaptive skew handling splits a hot key on the probe side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.numbers import equivalent_id


def first_wins_map(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """First value per positive key along ``order``; null values become ``''``."""
    picked = F.min_by(F.struct(value), F.struct(*order))[value]
    return (
        df.filter(F.col(key) > 0)
        .groupBy(key)
        .agg(F.coalesce(picked, F.lit("")).alias(value))
    )


def lookup_left(
    df: DataFrame, dim: DataFrame, on: str | dict[str, str], columns: dict[str, str]
) -> DataFrame:
    """Left join; ``on`` maps probe column -> dimension key, ``columns`` dimension -> output name.

    The dimension must hold each key once.
    """
    on = {on: on} if isinstance(on, str) else on
    side = dim.select(
        *[F.col(k).alias(f"_k_{k}") for k in on.values()],
        *[F.col(c).alias(out) for c, out in columns.items()],
    )
    condition: Column | None = None
    for left, right in on.items():
        test = df[left] == side[f"_k_{right}"]
        condition = test if condition is None else condition & test
    return df.join(side, condition, "left").drop(*[f"_k_{k}" for k in on.values()])


def with_equivalent(df: DataFrame, equivalence: DataFrame, id_col: str, out: str) -> DataFrame:
    """Add the id each row counts as: the mapped id when positive, else its own."""
    joined = lookup_left(
        df, equivalence, {id_col: "item_id"}, {"counts_as_id": "_counts_as"}
    )
    return joined.withColumn(out, equivalent_id(F.col(id_col), F.col("_counts_as"))).drop("_counts_as")
