"""The row after each row in the order of a key, without one task that holds all rows.

Keys are cut into buckets at approximate quantiles; a window inside each bucket finds the next row, and the
first rows of the buckets, as many as buckets, give it to the last row of each. The boundaries are constants of
the plan, so that a recomputed task puts a row into the same bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.llm.arrow import fresh, with_columns
from stockloom.operators.scans import materialize

#: Buckets for each shuffle partition, so that partitions are of similar size.
BUCKETS_PER_PARTITION = 4


def with_next(df: DataFrame, key: str, tie: str, columns: dict[str, str]) -> DataFrame:
    """Add the values of the next row in descending order of ``key``, circularly: ``columns`` maps names to added names.

    Nulls in ``key`` come last. Rows of one key follow each other by ``tie``; rows that are equal in both are
    in any order. In a table of one row, that row is its own next.
    """
    parts = BUCKETS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(key, shares, F.lit(max(10_000, 10 * parts))).alias("q")).collect()[0]["q"]
    bounds = np.unique(np.array(found or [], np.int64))
    bucket, first = fresh(df, "_bucket"), fresh(df, "_first")

    def bucketed(rows: DataFrame) -> DataFrame:
        return with_columns(rows, [key], lambda: lambda keys: [_places(keys, bounds)], [(bucket, T.IntegerType(), pa.int32())])

    order = [F.desc_nulls_last(key), F.asc_nulls_first(tie)]
    inside = Window.partitionBy(bucket).orderBy(*order)
    last = fresh(df, "_last")
    cut = bucketed(df)
    led = cut.select(
        *cut.columns,
        F.lead(F.lit(False), 1, True).over(inside).alias(last),
        *[F.lead(c).over(inside).alias(name) for c, name in columns.items()],
    )
    # First rows of the buckets, found by aggregates: first the keys alone, then their rows.
    tops = materialize(bucketed(df.select(key)).groupBy(bucket).agg(F.max(key).alias(first)))
    values = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)])
    heads = materialize(
        df.join(F.broadcast(tops), F.col(key).eqNullSafe(F.col(first)))
        .groupBy(bucket)
        .agg(F.min_by(values, F.struct(F.col(tie).isNotNull(), F.col(tie))).alias("values"))
    )
    circle = Window.orderBy(F.desc(bucket))
    beyond = heads.select(
        bucket,
        F.coalesce(F.lead("values").over(circle), F.first("values").over(circle)).alias(first),
    )
    joined = led.join(beyond, bucket)
    return joined.select(
        *df.columns,
        *[
            F.when(F.col(last), F.col(first)[f"v{i}"]).otherwise(F.col(name)).alias(name)
            for i, name in enumerate(columns.values())
        ],
    )


def _places(keys: list[int | None], bounds: np.ndarray) -> np.ndarray:
    known = np.array([k is not None for k in keys], bool)
    place = np.searchsorted(bounds, np.array([k or 0 for k in keys], np.int64), "right")
    return np.where(known, place, -1).astype(np.int32)
