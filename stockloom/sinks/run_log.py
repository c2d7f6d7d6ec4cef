"""Outcome of each phase as an append-only Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.functions.numbers import lenient_bool, lenient_int, lenient_long
from stockloom.functions.text import is_blank
from stockloom.schemas import RUN_LOG
from stockloom.sources.tables import read_table


def append_run_log(df: DataFrame, path: str) -> None:
    df.select(*RUN_LOG.fieldNames()).write.mode("append").parquet(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """All outcomes; an absent log is empty."""
    return read_table(spark, path, RUN_LOG)[0]


def parse_run_log(raw: DataFrame) -> DataFrame:
    """Typed outcomes from text columns; what does not parse becomes 0, false or ``''``."""

    def text(name: str):
        return F.coalesce(F.col(name), F.lit("")).alias(name)

    return raw.select(
        text("run_id"),
        text("phase_name"),
        text("phase_key"),
        lenient_int(F.col("row_count")).cast("bigint").alias("row_count"),
        lenient_bool(F.col("succeeded")).alias("succeeded"),
        text("json_path"),
        text("csv_path"),
        lenient_long(F.col("elapsed_ms")).alias("elapsed_ms"),
        F.filter("errors", lambda e: ~is_blank(e)).alias("errors"),
    )
