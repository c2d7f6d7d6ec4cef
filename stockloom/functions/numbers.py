"""Integer rules: prices, amounts, ids, lenient parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sell price divisor and lowest plausible rotating-stock id.
SELL_DIVISOR = 5
PLAUSIBLE_ID_MIN = 1000


def sell_price(value: Column, divisor: int = SELL_DIVISOR) -> Column:
    """Integer division truncating toward zero."""
    return F.call_function("div", value, F.lit(divisor)).cast("int")


def default_amount(amount: Column) -> Column:
    """Amounts below one count as one."""
    return F.when(amount <= 0, 1).otherwise(amount)


def equivalent_id(id_col: Column, mapped: Column) -> Column:
    """The mapped id when positive, else the id itself."""
    return F.coalesce(F.when(mapped > 0, mapped), id_col)


def is_valid_reference(id_col: Column) -> Column:
    return id_col > 0


def is_plausible_id(id_col: Column, id_count: Column, low: int = PLAUSIBLE_ID_MIN) -> Column:
    """``low <= id``, and ``id <= id_count`` when a positive count is known (both inclusive)."""
    return (id_col > 0) & (id_col >= low) & ((id_count <= 0) | (id_col <= id_count))


def lenient_int(raw: Column) -> Column:
    return F.coalesce(raw.try_cast("int"), F.lit(0))


def lenient_long(raw: Column) -> Column:
    return F.coalesce(raw.try_cast("bigint"), F.lit(0).cast("bigint"))


def lenient_bool(raw: Column) -> Column:
    """Only the words true and false count, in any case; everything else is false."""
    return F.coalesce(F.lower(F.trim(raw)) == "true", F.lit(False))
