"""Typed reads of tables that may be absent."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence on any file system the session can reach."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder, if it is there."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def empty_table(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_table(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", **options: str
) -> tuple[DataFrame, str | None]:
    """(table, warning). A missing or unreadable path gives an empty table and a warning, never an error.

    Readable means that the files open in the given format: their first rows are read. For JSON, badly
    typed fields become null instead of failing the read.
    """
    if not path_exists(spark, path):
        return empty_table(spark, schema), f"missing table: {path}"
    try:
        table = spark.read.format(fmt).schema(schema).options(**options).load(path)
        table.limit(1).collect()
    except (PySparkException, Py4JJavaError) as error:
        return empty_table(spark, schema), f"unreadable table: {path}: {type(error).__name__}"
    return table, None
