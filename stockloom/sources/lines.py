"""Ordered lines of text files, read in splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockloom.operators.scans import materialize


def read_lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(file, line_no from 1, line). CR, LF and CRLF end a line, or ``separator``; a final one adds no empty line.

    Big files are read in splits. Rows keep their order inside a split; one count per split, added
    up over the splits of a file, gives each split the number of its first line. These numbers, one row
    per split, are stored, so that Spark sees their size and need not shuffle the lines to meet them.
    """
    raw = spark.read.text(path, lineSep=separator).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("row_id"),
        F.col("value").alias("line"),
    )
    splits = raw.groupBy("file", "split_start").agg(
        F.count("*").alias("n_lines"), F.min("row_id").alias("first_row")
    )
    before = Window.partitionBy("file").orderBy("split_start").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = materialize(
        splits.select(
            "file",
            "split_start",
            "first_row",
            F.coalesce(F.sum("n_lines").over(before), F.lit(0)).alias("lines_before"),
        )
    )
    return raw.join(offsets, ["file", "split_start"]).select(
        "file",
        (F.col("lines_before") + F.col("row_id") - F.col("first_row") + 1).alias("line_no"),
        "line",
    )
