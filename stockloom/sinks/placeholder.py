"""Placeholders for the outputs of a failed phase."""

from __future__ import annotations

from pyspark.sql import SparkSession

from stockloom.sinks.text import write_text_file
from stockloom.sources.tables import delete_path


def write_placeholder(spark: SparkSession, json_path: str, csv_path: str, *stale: str) -> list[str]:
    """Replace the outputs by an empty JSON array and a CSV of zero bytes, and delete ``stale`` tables.

    What an earlier run left is replaced as well, so that nothing reads it as the result of this one.
    Returns the paths written.
    """
    for path in stale:
        delete_path(spark, path)
    for path, text in ((json_path, "[]"), (csv_path, "")):
        delete_path(spark, path)
        write_text_file(spark, path, text)
    return [json_path, csv_path]
