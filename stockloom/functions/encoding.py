"""Flat text encodings of nested values, as used in CSV cells.

Separators are not escaped inside names: the format is write-only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def encode_ingredient(x: Column) -> Column:
    """``<item_id>:<name>x<count>``."""
    return F.concat(_text(x["item_id"]), F.lit(":"), _text(x["name"]), F.lit("x"), _text(x["count"]))


def encode_offer(x: Column) -> Column:
    """``<item_id>|<name>|<buy_price>|<cond>&<cond>``; no condition leaves the last part empty."""
    conditions = F.coalesce(F.array_join(x["conditions"], "&", ""), F.lit(""))
    bar = F.lit("|")
    return F.concat(_text(x["item_id"]), bar, _text(x["name"]), bar, _text(x["buy_price"]), bar, conditions)


def list_to_cell(arr: Column, sep: str = ";") -> Column:
    """Elements joined by ``;``; a null element keeps its place as an empty text."""
    return F.coalesce(F.array_join(arr, sep, ""), F.lit(""))
