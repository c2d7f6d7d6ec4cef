"""Running values over an ordered group, cut into blocks so that no group sits in one task.

A plain window over ``keys`` would sort a whole group in a single task. Here a group is cut into
blocks of consecutive positions. Each block is scanned on its own; one summary row per block carries
the value into the next block. Work per task is bounded by the block, whatever the group's size.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

DEFAULT_BLOCK = 100_000


@dataclass(frozen=True)
class RunningSum:
    """Sum of ``value`` from the start of the group up to this row."""

    name: str
    value: Column
    inclusive: bool = True


@dataclass(frozen=True)
class RunningLast:
    """Latest non-null ``value`` from the start of the group up to this row."""

    name: str
    value: Column
    inclusive: bool = True


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: Sequence[RunningSum | RunningLast],
    block: Column | None = None,
    keep: Column | None = None,
    output: Sequence[str] | None = None,
) -> DataFrame:
    """Add one column per spec to the rows that meet ``keep`` (default: all).

    ``order`` must be a total order inside ``keys``; its first column must be an integer position
    unless ``block`` (non-decreasing along ``order``) is given. ``output`` names the columns to return
    besides the new ones (default: all).

    ``df`` is computed, shuffled and sorted once, by block. The block-local values are materialised:
    the carry is read from there (one row per block), and so are the results. Values carried into a block are stored.
    """
    block_no = block if block is not None else F.expr(f"`{order[0]}` div {DEFAULT_BLOCK}")
    block_keys = [*keys, "_block"]
    columns = list(df.columns if output is None else output)
    prepared = df.withColumns(
        {"_block": block_no.cast("bigint"), "_keep": F.lit(True) if keep is None else keep}
        | {f"_in_{s.name}": s.value for s in specs}
    )

    inside = Window.partitionBy(*block_keys).orderBy(*order)
    scanned = prepared.select(
        *prepared.columns,
        *[_local(s, inside).alias(f"_local_{s.name}") for s in specs],
        F.lead(F.lit(True)).over(inside).isNull().alias("_ends_block"),
    )
    # The last row of a block knows the block's totals.
    ends = F.col("_ends_block")
    local = materialize(
        scanned.filter(F.col("_keep") | ends).select(
            *dict.fromkeys([*keys, *columns]),
            "_block",
            "_keep",
            "_ends_block",
            *[f"_local_{s.name}" for s in specs],
            *[F.when(ends, _up_to_here(s)).alias(f"_total_{s.name}") for s in specs],
        )
    )
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = local.filter(ends).select(
        *block_keys,
        *[
            (
                F.sum(f"_total_{s.name}").over(earlier)
                if isinstance(s, RunningSum)
                else F.last(f"_total_{s.name}", ignorenulls=True).over(earlier)
            ).alias(f"_carry_{s.name}")
            for s in specs
        ],
    )
    # The first block of a group is given nothing, and most groups have no other: what is left is stored, so that
    # Spark sees its size, and rows need not be shuffled again to meet it.
    given = materialize(carry.filter(reduce(or_, [F.col(f"_carry_{s.name}").isNotNull() for s in specs])))
    # Null keys form a group as well, so the join compares them as equal.
    named = given.withColumnsRenamed({k: f"_of_{k}" for k in block_keys})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in block_keys]
    return (
        local.filter("_keep")
        .join(named, same, "left")
        .select(*columns, *[_with_carry(s).alias(s.name) for s in specs])
    )


def _local(spec: RunningSum | RunningLast, inside: WindowSpec) -> Column:
    frame = inside.rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1)
    value = F.col(f"_in_{spec.name}")
    if isinstance(spec, RunningSum):
        return F.coalesce(F.sum(value).over(frame), F.lit(0))
    return F.last(value, ignorenulls=True).over(frame)


def _up_to_here(spec: RunningSum | RunningLast) -> Column:
    """The local value including this row."""
    value, local = F.col(f"_in_{spec.name}"), F.col(f"_local_{spec.name}")
    if spec.inclusive:
        return local
    if isinstance(spec, RunningSum):
        return local + F.coalesce(value, F.lit(0))
    return F.coalesce(value, local)


def _with_carry(spec: RunningSum | RunningLast) -> Column:
    local, carry = F.col(f"_local_{spec.name}"), F.col(f"_carry_{spec.name}")
    if isinstance(spec, RunningSum):
        return local + F.coalesce(carry, F.lit(0))
    return F.coalesce(local, carry)


def with_position(ordered: DataFrame, name: str = "position") -> DataFrame:
    """Add the place (from 0) of each row of a sorted frame. Rows are written once and not moved again.

    Rows are numbered inside the partitions of the sort; one count per partition gives the place of its first.
    """
    stored = materialize(ordered.withColumn("_row", F.monotonically_increasing_id()))
    # The identifier holds the partition above its lower 33 bits.
    part, row = F.shiftright("_row", 33), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    starts = materialize(counts.select("_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_start")))
    return (
        stored.withColumn("_part", part)
        .join(starts, "_part")
        .select(*ordered.columns, (F.col("_start") + row).alias(name))
    )


_written: list[str] = []


def release_tables(spark: SparkSession) -> int:
    """Delete the tables that :func:`materialize` has written in this process, and return their number.

    For the end of a job: frames that read them no longer work afterwards.
    """
    n = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def materialize(df: DataFrame) -> DataFrame:
    """Write a table into the shared checkpoint folder and read it back.

    Cuts lineage so that later reads do not recompute, and survives the loss of executors. The folder
    is the one the session names in ``spark.checkpoint.dir``; only a local session without that
    setting gets a folder of its own. :func:`release_tables` deletes what was written.
    """
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, without which a session that is not local is refused."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named is not None:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()
