"""File listings as DataFrames; file contents are read only when asked for."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.functions.paths import (
    ASSET_CATEGORIES,
    category_rank,
    file_name,
    file_stem,
    manifest_path,
    parse_numeric_id,
)
from stockloom.operators.scans import materialize
from stockloom.sources.tables import path_exists

_FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def _binary_files(spark: SparkSession, folder: str, glob: str, recursive: bool) -> DataFrame:
    if not path_exists(spark, folder):
        return spark.createDataFrame([], _FILE_SCHEMA)
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(folder)
    )


def _qualified(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString().rstrip("/")


def _entries(folders: DataFrame) -> DataFrame:
    """The entries of each ``folder``, read by the task that holds its row; a folder that can't be read gives an error.

    Lengths are null where the store does not list them, and beside an error.
    """

    # Nested, so that it is sent with the tasks and executors need no copy of the package.
    def read(frames):
        import os
        from itertools import islice

        import pandas as pd

        def found(folder):
            scheme, _, rest = folder.partition(":")
            if scheme == "file":
                with os.scandir("/" + rest.lstrip("/")) as entries:
                    for e in entries:
                        if not e.is_dir():
                            yield e.name, False, None
                        elif not e.is_symlink():
                            yield e.name, True, 0
                return
            from pyarrow import fs

            authority, _, inside = rest.removeprefix("//").partition("/")
            store, base = fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{authority}")
            for e in store.get_file_info(fs.FileSelector(f"{base.rstrip('/')}/{inside}")):
                if e.type not in (fs.FileType.Directory, fs.FileType.File) or (e.size is None and e.type == fs.FileType.File):
                    raise OSError(f"no kind or length of {e.path}")
                yield e.base_name, e.type == fs.FileType.Directory, e.size or 0

        def rows(folder):
            try:
                for name, is_folder, length in found(folder):
                    if not name.startswith(("_", ".")):
                        yield folder, name, is_folder, length, None
            except Exception as error:  # the row carries it, whatever the store raised
                yield folder, None, False, None, f"{type(error).__name__}: {error}"

        columns = ["folder", "name", "is_folder", "length", "error"]
        for frame in frames:
            for folder in frame["folder"]:
                entries = rows(folder)
                while batch := list(islice(entries, 10_000)):
                    yield pd.DataFrame(batch, columns=columns)

    return folders.mapInPandas(read, "folder string, name string, is_folder boolean, length bigint, error string")


def _with_length(files: DataFrame) -> DataFrame:
    """(path, length, error): lengths that the listing lacks are asked for one by one, in many tasks."""

    def read(frames):
        import os

        def of(path):
            name = "/" + path.partition(":")[2].lstrip("/")
            try:
                return os.stat(name).st_size, None
            except OSError as error:
                broken = isinstance(error, FileNotFoundError) and os.path.islink(name)
                return None, f"{'BrokenLink' if broken else type(error).__name__}: {error}"

        for frame in frames:
            frame["length"] = frame["length"].astype("Int64")
            asked = frame["length"].isna() & frame["error"].isna()
            found = [of(path) for path in frame.loc[asked, "path"]]
            frame.loc[asked, "length"] = [n for n, _ in found]
            frame.loc[asked, "error"] = [e for _, e in found]
            yield frame

    dealt = files.repartition(files.sparkSession.sparkContext.defaultParallelism, "path")
    return dealt.mapInPandas(read, "path string, length bigint, error string")


def walk_files(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """(path, length, error) of the files in a folder, empty files included, names that start with _ or . not.

    Level by level, tasks list the folders that the level before has found; each level is stored, and no name passes
    the driver. The names of one folder are listed by one task, their lengths looked up by many. ``path`` is the full name; where a folder can't be read, it is that of the folder, ``length`` is null
    and ``error`` says why; so it is for a file without a length, as a link to nothing (``BrokenLink``).
    ``glob`` may hold ``*``, ``?`` and ``[...]``. Links to folders are left out. Local (shared) folders are read
    directly, other stores by Arrow's file systems.
    """
    if not path_exists(spark, folder):
        return spark.createDataFrame([], "path string, length bigint, error string")
    level = spark.createDataFrame([(_qualified(spark, folder),)], "folder string")
    path = F.concat_ws("/", "folder", "name")
    pattern = "".join({"*": ".*", "?": "."}.get(c, c if c in "[-]" else re.escape(c)) for c in glob)
    files = None
    while True:
        found = materialize(_entries(level.repartition(spark.sparkContext.defaultParallelism, "folder")))
        wanted = F.col("error").isNotNull() | F.col("name").rlike(rf"(?s)\A{pattern}\z")
        here = found.filter(~F.col("is_folder") & wanted).select(path.alias("path"), "length", "error")
        here = materialize(_with_length(here))
        files = here if files is None else files.unionByName(here)
        level = found.filter("is_folder").select(path.alias("folder"))
        if not recursive or level.isEmpty():
            return files


def _without_failures(files: DataFrame) -> DataFrame:
    """The (path, length) of a walk, or OSError with some of its failures: a part of the files is no result."""
    failed = [f"{r['path']}: {r['error']}" for r in files.filter("error IS NOT NULL").take(5)]
    if failed:
        raise OSError("can't be read: " + "; ".join(failed))
    return files.drop("error")


def list_files(
    spark: SparkSession, folder: str, glob: str = "*", recursive: bool = False
) -> DataFrame:
    """(path relative to ``folder``, length), files of zero bytes included. Links to nothing are no files.

    OSError where a folder or file can't be read: what it holds is not known.
    """
    found = walk_files(spark, folder, glob, recursive)
    files = _without_failures(found.filter("error IS NULL OR NOT startswith(error, 'BrokenLink')"))
    start = len(_qualified(spark, folder)) + 2
    return files.select(F.substring("path", F.lit(start), F.length("path")).alias("path"), "length")


def existing(spark: SparkSession, folder: str, names: Sequence[str]) -> DataFrame:
    """(file, exists) of expected names in a folder; a file, a folder of part files and an empty file all exist."""
    root = folder.rstrip("/")
    found = [(name, path_exists(spark, f"{root}/{name}")) for name in names]
    return spark.createDataFrame(found, "file string, exists boolean")


def list_assets(
    spark: SparkSession,
    folder: str,
    categories: Sequence[tuple[str, str, str]] = ASSET_CATEGORIES,
    with_content: bool = False,
) -> DataFrame:
    """(id, category, stem, sprite_file, path[, content]) of the top-level asset files.

    The file system's glob is case-sensitive while the name rule is not, so the glob only narrows by
    shape and the name rule decides. OSError where the folder or the length of a file in it can't be read.
    """
    glob = "*_*.[xX][nN][bB]"
    if with_content:
        return assets_of(_binary_files(spark, folder, glob, recursive=False), categories)
    return assets_of(_without_failures(walk_files(spark, folder, glob)), categories)


def assets_of(
    files: DataFrame, categories: Sequence[tuple[str, str, str]] = ASSET_CATEGORIES
) -> DataFrame:
    """Apply the name rule of every category to files with a ``path`` column."""
    name = file_name(F.col("path"))
    options = F.array(
        *[
            F.struct(
                parse_numeric_id(name, prefix).alias("id"),
                F.lit(category).alias("category"),
                F.lit(out_folder).alias("folder"),
            )
            for category, prefix, out_folder in categories
        ]
    )
    matched = files.withColumn("_asset", F.explode(options)).filter(F.col("_asset.id").isNotNull())
    return matched.select(
        "_asset.id",
        "_asset.category",
        category_rank(F.col("_asset.category")).alias("category_rank"),
        file_stem(name).alias("stem"),
        manifest_path(F.col("_asset.folder"), file_stem(name)).alias("sprite_file"),
        *files.columns,
    )


def required_files(expected: DataFrame, present: DataFrame) -> DataFrame:
    """(file, exists): one row per expected file. ``present`` has a ``path`` column."""
    found = present.select(F.col("path").alias("file"), F.lit(True).alias("_found")).distinct()
    return expected.select("file").join(found, "file", "left").select(
        "file", F.coalesce("_found", F.lit(False)).alias("exists")
    )
