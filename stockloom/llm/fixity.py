"""Merkle fixity audit of archive replicas.

Records of an archive are ordered by id; a manifest gives each its ordinal and byte range. A leaf is the SHA-256
of the byte range and the record's own SHA-256, a node that of the byte range it covers and its children's
hashes, ``FANOUT`` at most. Trees of all archives and replicas grow level by level, each level one
aggregate of a ``FANOUT``-th of the rows. Replicas are compared at the roots, and only children of
nodes that differ are compared next, down to the records.

Offsets and ordinals are running sums over blocks of records, so that an archive of any size spreads over tasks.

Defined cases: a null payload is an absent record; null archives and null ids form an archive and an id of
their own (``(none)`` and the lowest); repeated ids are numbered in the order of their digests; records that a
replica has beyond the manifest are listed as ``unlisted``, without a byte range; empty tables give empty results;
extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.operators.scans import RunningSum, materialize, running

#: Children of a node, at most, and ids in a block of the running sums.
FANOUT, BLOCK = 16, 4_096
_LOWEST = -(1 << 63)


def warc_record(url: Column, body: Column) -> Column:
    """A response record: header lines, the body, and the blank lines that end it."""
    body, url = F.coalesce(body, F.lit("")), F.coalesce(url, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def digests(records: DataFrame) -> DataFrame:
    """``archive``, ``id``, ``copy``, ``size``, ``digest`` of each record (``archive``, ``id``, ``payload``) that is there."""
    plain = records.filter("payload IS NOT NULL").select(
        F.coalesce(F.col("archive").cast("string"), F.lit("(none)")).alias("archive"),
        F.coalesce(F.col("id").cast("bigint"), F.lit(_LOWEST)).alias("id"),
        F.octet_length("payload").cast("bigint").alias("size"),
        F.sha2(F.col("payload").cast("binary"), 256).alias("digest"),
    )
    # Equal records are counted, then numbered one by one.
    counted = plain.groupBy("archive", "id", "digest", "size").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("archive", "id").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counted.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    copies = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("copy")
    return numbered.select("archive", "id", copies, "size", "digest")


def manifest(digested: DataFrame) -> DataFrame:
    """Add ``ordinal`` and ``offset`` of each record in its archive, in the order of id and copy."""
    return running(
        digested,
        ["archive"],
        ["id", "copy"],
        [
            RunningSum("ordinal", F.lit(1).cast("bigint"), inclusive=False),
            RunningSum("offset", F.col("size"), inclusive=False),
        ],
        block=F.floor(F.expr(f"id div {BLOCK}")),
    )


def leaves(listed: DataFrame, replica: DataFrame, name: str) -> DataFrame:
    """Nodes of level 0 of a replica: one for each record of the manifest, whether the replica has it or not."""
    own = replica.select("archive", "id", "copy", F.col("digest").alias("own_digest"), F.col("size").alias("own_size"))
    placed = listed.drop("digest").join(own, ["archive", "id", "copy"], "left")
    span = F.concat_ws("-", "offset", F.col("offset") + F.col("size"))
    content = F.coalesce(F.concat_ws(":", F.col("own_size").cast("string"), F.col("own_digest")), F.lit("absent"))
    return placed.select(
        F.lit(name).alias("replica"), "archive", F.col("ordinal").alias("node"), "offset",
        (F.col("offset") + F.col("size")).alias("end"), F.sha2(F.concat_ws(":", span, content), 256).alias("hash"),
    )


def parents(nodes: DataFrame) -> DataFrame:
    """The next level: each node covers ``FANOUT`` nodes of this one."""
    child = F.struct("node", "hash")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda c: c["hash"]), "")
    grouped = nodes.groupBy("replica", "archive", F.expr(f"node div {FANOUT}").alias("parent")).agg(
        F.min("offset").alias("offset"), F.max("end").alias("end"), joined.alias("children")
    )
    span = F.concat_ws("-", "offset", "end")
    return grouped.select(
        "replica", "archive", F.col("parent").alias("node"), "offset", "end",
        F.sha2(F.concat_ws(":", span, "children"), 256).alias("hash"),
    )


def trees(level: DataFrame) -> list[DataFrame]:
    """All levels from the leaves to one root for each archive and replica; each level is stored."""
    levels = [materialize(level)]
    last = levels[0].agg(F.max("node")).collect()[0][0] or 0
    while last > 0:
        last //= FANOUT
        levels.append(materialize(parents(levels[-1])))
    return levels


def mismatches(levels: list[DataFrame], first: str, second: str) -> DataFrame:
    """``archive``, ``node`` of the leaves that differ; only below nodes that differ is anything compared."""
    suspects: DataFrame | None = None
    for level in reversed(levels):
        nodes = level.withColumn("above", F.expr(f"node div {FANOUT}"))
        if suspects is not None:
            nodes = nodes.join(suspects, ["archive", "above"], "left_semi")
        sides = nodes.groupBy("archive", "node").agg(
            F.max(F.when(F.col("replica") == first, F.col("hash"))).alias("a"),
            F.max(F.when(F.col("replica") == second, F.col("hash"))).alias("b"),
        )
        differing = materialize(sides.filter(~F.col("a").eqNullSafe(F.col("b"))).select("archive", "node"))
        suspects = differing.withColumnRenamed("node", "above")
    return differing


def audit(master: DataFrame, replica: DataFrame) -> DataFrame:
    """Records in which a replica differs from the master (both ``archive``, ``id``, ``payload``).

    Returns ``archive``, ``id``, ``ordinal``, ``offset``, ``size`` (of the master's record), ``found_size`` and
    ``kind``: missing, resized, altered or unlisted.
    """
    mine, theirs = materialize(digests(master)), materialize(digests(replica))
    listed = materialize(manifest(mine))
    level = leaves(listed, mine, "master").unionByName(leaves(listed, theirs, "replica"))
    bad = mismatches(trees(level), "master", "replica").withColumnRenamed("node", "ordinal")
    key = ["archive", "id", "copy"]
    found = theirs.select(*key, F.col("size").alias("found_size"))
    located = listed.join(bad, ["archive", "ordinal"]).join(found, key, "left")
    kind = F.when(F.col("found_size").isNull(), "missing").when(F.col("found_size") != F.col("size"), "resized")
    beyond = theirs.join(listed, key, "left_anti").withColumnRenamed("size", "found_size")
    columns = ["archive", "id", "ordinal", "offset", "size", "found_size", "kind"]
    rows = [
        located.withColumn("kind", kind.otherwise("altered")).select(*columns),
        beyond.withColumns(
            {c: F.lit(None).cast("bigint") for c in ("ordinal", "offset", "size")} | {"kind": F.lit("unlisted")}
        ).select(*columns),
    ]
    return reduce(DataFrame.unionByName, rows).withColumn(
        "id", F.when(F.col("id") != _LOWEST, F.col("id"))
    )
