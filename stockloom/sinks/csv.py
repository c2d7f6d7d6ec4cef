"""CSV output with nested lists flattened into cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from stockloom.functions.encoding import encode_ingredient, encode_offer, list_to_cell

# How the elements of nested columns become text.
ELEMENT_ENCODERS: dict[str, Callable[[Column], Column]] = {
    "ingredients": encode_ingredient,
    "items": encode_offer,
}


def flatten_for_csv(
    df: DataFrame, encoders: dict[str, Callable[[Column], Column]] = ELEMENT_ENCODERS
) -> DataFrame:
    """Every column as text; arrays joined by ``;``, nulls as empty text."""

    def cell(name: str) -> Column:
        dtype = df.schema[name].dataType
        column = F.col(name)
        if isinstance(dtype, ArrayType):
            if name in encoders:
                column = F.transform(column, encoders[name])
            return list_to_cell(column.cast("array<string>"))
        if isinstance(dtype, BooleanType):
            column = F.initcap(column.cast("string"))
        return F.coalesce(column.cast("string"), F.lit(""))

    return df.select(*[cell(c).alias(c) for c in df.columns])


def write_csv_flat(
    df: DataFrame, path: str, header: list[str] | None = None, line_end: str = "\n"
) -> None:
    """CSV folder with a header in every file, also for no rows.

    A cell is quoted only when it holds a comma, a quote or a line break; quotes are doubled.
    """
    flat = flatten_for_csv(df)
    if header is not None:
        flat = flat.toDF(*header)
    flat.write.mode("overwrite").options(
        header=True,
        escape='"',
        emptyValue="",
        nullValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        lineSep=line_end,
    ).csv(path)
