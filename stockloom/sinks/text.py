"""One small text file on any file system."""

from __future__ import annotations

from pyspark.sql import SparkSession


def write_text_file(spark: SparkSession, path: str, text: str) -> None:
    """Write (or replace) one UTF-8 file. For reports and small exports only."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(hadoop_path, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
