"""Columns computed from a text column by batch functions in Python workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows handled at once inside an Arrow batch, and bytes of text beyond which a block ends; they bound the
#: memory of a worker. A single longer text is a block of its own.
BLOCK_DOCS, BLOCK_BYTES = 256, 8 << 20
#: Rows that Spark hands to a worker at once, at most. Its default of 10,000 makes batches of tens of MB out of texts
#: of some KB, which executor and worker both hold, with their copies.
BATCH_ROWS = 1_024
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"

BlockFunction = Callable[..., Sequence[object]]


def with_columns(
    df: DataFrame,
    inputs: Sequence[str],
    make: Callable[[], BlockFunction],
    adds: Sequence[tuple[str, T.DataType, pa.DataType]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Append columns to each row without moving rows between tasks.

    ``make`` is called once per task and returns a function from the Python lists of the input columns
    (a block of at most ``BLOCK_DOCS`` rows) to one sequence per added column. Columns of ``df`` not in
    ``keep`` (default: all are kept) are not returned. Added names replace columns of the same name.
    """
    new = {name for name, _, _ in adds}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    fields = [df.schema[c] for c in kept] + [T.StructField(n, t) for n, t, _ in adds]
    # Inputs may have the name of an added column, so they travel under names of their own.
    names = [fresh(df, f"_input_{i}") for i in range(len(inputs))]
    given = df.select(*[_quoted(df, c) for c in kept], *[_quoted(df, c).alias(n) for c, n in zip(inputs, names)])
    types = [t for _, _, t in adds]
    n_kept = len(kept)
    n_inputs = len(inputs)
    out_names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for part in _blocks(batch, range(n_kept, n_kept + n_inputs)):
                columns = [part.column(n_kept + i).to_pylist() for i in range(n_inputs)]
                results = function(*columns)
                arrays = [
                    r if isinstance(r, (pa.Array, pa.ChunkedArray)) else pa.array(r, type=t)
                    for r, t in zip(results, types)
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[:n_kept], *arrays], names=out_names)
        _give_back()

    _bound_batches(df.sparkSession)
    return given.mapInArrow(run, T.StructType(fields))


def keep_rows(df: DataFrame, inputs: Sequence[str], make: Callable[[], BlockFunction]) -> DataFrame:
    """Rows for which the block function says true; columns stay as they are, whatever their names."""
    names = df.columns
    at_inputs = [names.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for part in _blocks(batch, at_inputs):
                kept = function(*[part.column(i).to_pylist() for i in at_inputs])
                yield part.filter(pa.array(kept, pa.bool_()))
        _give_back()

    _bound_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)


def _bound_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to ``BATCH_ROWS``; a smaller positive number stays."""
    if not 0 < int(spark.conf.get(_BATCH_CONF)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, BATCH_ROWS)


def _give_back() -> None:
    """Return freed buffers to the system: workers are kept for later tasks, and Arrow's pool would keep them too."""
    pa.default_memory_pool().release_unused()


def _blocks(batch: pa.RecordBatch, inputs: Sequence[int]) -> Iterator[pa.RecordBatch]:
    sizes = np.zeros(batch.num_rows, np.int64)
    for i in inputs:
        column = batch.column(i)
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for at, size in enumerate(sizes.tolist()):
        if at > start and (at - start == BLOCK_DOCS or held + size > BLOCK_BYTES):
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def fresh(df: DataFrame, name: str) -> str:
    """A name like ``name`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _quoted(df: DataFrame, name: str):
    return df["`" + name.replace("`", "``") + "`"]


class WordTable(dict):
    """Numbers of byte words, given on first sight; ``describe`` yields a tuple of integers per word.

    ``table[word]`` is the number. The descriptions of all words seen are columns of ``columns()``.
    At most ``limit`` words are held: ``trim`` forgets all of them, and must be called only between
    blocks. Forgetting costs time, never a different result.
    """

    def __init__(self, describe: Callable[[bytes], tuple], width: int, limit: int = 400_000):
        super().__init__()
        self.describe, self.width, self.limit = describe, width, limit
        self.rows: list[tuple] = []
        self.array = np.zeros((0, width), np.int64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.rows)
        self.rows.append(self.describe(word))
        return number

    def columns(self) -> np.ndarray:
        if len(self.rows) > len(self.array):
            more = np.array(self.rows[len(self.array) :], np.int64).reshape(-1, self.width)
            if len(self.rows) - len(self.array) < len(self.array) // 8:
                self.array = np.concatenate([self.array, more])
            else:
                self.array = np.concatenate([self.array, more])
        return self.array

    def trim(self) -> None:
        if len(self.rows) > self.limit:
            self.clear()
            self.rows = []
            self.array = np.zeros((0, self.width), np.int64)


def split_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []
