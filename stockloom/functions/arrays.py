"""Array shaping with higher-order functions; every function is row-local."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def drop_nulls(arr: Column) -> Column:
    return F.filter(arr, lambda x: x.isNotNull())


def stop_position(arr: Column, stop: Callable[[Column], Column]) -> Column:
    """1-based position of the first element for which ``stop`` holds; 0 when there is none."""
    hits = F.transform(arr, lambda x: F.coalesce(stop(x), F.lit(False)))
    return F.array_position(hits, True)


def take_while(
    arr: Column, stop: Callable[[Column], Column], *, skip_null: bool = True
) -> Column:
    """Elements before the first one for which ``stop`` holds.

    A null stop test does not stop. With ``skip_null`` null elements are left out.
    A null array gives an empty one.
    """
    first_stop = F.nullif(stop_position(arr, stop), F.lit(0))
    length = F.coalesce(first_stop - 1, F.size(arr)).cast("int")
    kept = F.slice(arr, F.lit(1), length)
    return F.coalesce(drop_nulls(kept) if skip_null else kept, F.array())


def flags_to_labels(flags: Sequence[tuple[Column, str]]) -> Column:
    """Labels of the true flags, in the given order."""
    return F.array_compact(F.array(*[F.when(flag, F.lit(label)) for flag, label in flags]))


def contains_all(ids: Column, required: Sequence[int]) -> Column:
    """True when every required id occurs in the array."""
    found = [F.array_contains(ids, F.lit(r)) for r in required]
    test = found[0]
    for f in found[1:]:
        test = test & f
    return F.coalesce(test, F.lit(False))


def nested_size(arr: Column) -> Column:
    """Length of a list; a null list has length 0."""
    return F.coalesce(F.greatest(F.size(arr), F.lit(0)), F.lit(0))
