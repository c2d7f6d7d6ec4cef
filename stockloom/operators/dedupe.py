"""First-wins de-duplication and prioritised source choice, as map-side-combinable aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the first along ``order``.

    An aggregate instead of a ranking window: copies of one key collapse before the shuffle, so a
    key holding a large share of all rows costs no more than any other. Without ``order`` the other
    columns must be functions of the keys.
    """
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.distinct()
    row = F.struct(*others)
    picked = F.min_by(row, F.struct(*order)) if order else F.any_value(row)
    return (
        df.groupBy(*keys)
        .agg(picked.alias("_row"))
        .select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])
    )


def first_match(df: DataFrame, condition: Column, order: Sequence[str]) -> DataFrame:
    """At most one row: the first along ``order`` that meets the condition.

    One partial ``min_by`` per task; nothing is sorted.
    """
    row = F.struct(*df.columns)
    return (
        df.filter(condition)
        .agg(F.min_by(row, F.struct(*order)).alias("_row"))
        .filter(F.col("_row").isNotNull())
        .select("_row.*")
    )


def ordered_distinct_list(
    df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], out: str
) -> DataFrame:
    """Distinct values per key in first-seen order.

    Repeats collapse (map side) before anything is gathered, so a list holds distinct values only.
    """
    first_seen = df.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_at"))
    entries = F.array_sort(F.collect_list(F.struct("_at", F.col(value).alias("_value"))))
    return first_seen.groupBy(*keys).agg(F.transform(entries, lambda x: x["_value"]).alias(out))


def choose_source(
    status: DataFrame, keys: Sequence[str], priority: str = "priority", empty_wins_at: int | None = 1
) -> DataFrame:
    """Priority of the source to use per key; keys without a usable source are absent.

    ``status`` has ``ok`` and ``n_rows`` per key and source. The source with priority
    ``empty_wins_at`` is used whenever it succeeded, even with no rows; the others need rows.
    """
    usable = F.col("n_rows") > 0
    if empty_wins_at is not None:
        usable = (F.col(priority) == empty_wins_at) & F.col("ok") | (
            F.col(priority) != empty_wins_at
        ) & usable
    return status.filter(usable).groupBy(*keys).agg(F.min(priority).alias(priority))


def first_nonempty_source(
    rows: DataFrame,
    status: DataFrame,
    keys: Sequence[str],
    priority: str = "priority",
    empty_wins_at: int | None = 1,
) -> tuple[DataFrame, DataFrame]:
    """(chosen source per key, rows of the chosen sources).

    The first result keeps keys whose chosen source is empty.
    """
    chosen = choose_source(status, keys, priority, empty_wins_at)
    return chosen, rows.join(chosen, [*keys, priority], "left_semi")
