"""JSON output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.schemas import JSON_FIELDS, NESTED_JSON_FIELDS


def _public_column(name: str, alias: str) -> Column:
    nested = NESTED_JSON_FIELDS.get(name)
    if nested is None:
        return F.col(name).alias(alias)
    return F.transform(
        name, lambda x: F.struct(*[x[field].alias(out) for field, out in nested])
    ).alias(alias)


def public_names(df: DataFrame, dataset: str) -> DataFrame:
    """Rename to the dataset's public JSON field names; other columns are left out.

    A dataset without ``part`` has one row for each recipe or shop, so its part is 0.
    """
    whole = df if "part" in df.columns else df.withColumn("part", F.lit(0).cast("bigint"))
    return whole.select(*[_public_column(name, alias) for name, alias in JSON_FIELDS[dataset]])


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, one file per partition. Null fields are written as nulls."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
