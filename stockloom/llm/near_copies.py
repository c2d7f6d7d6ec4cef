"""Near copies by SimHash fingerprints and the exact Jaccard similarity of word-shingle sets.

A document is the set of its hashed shingles (``WIDTH`` words, ASCII lower case; a shorter text is one
shingle). Documents of equal sets are one node, and each node has the 64-bit SimHash of its set. Fingerprints
within ``DISTANCE`` bits are found by the generalised pigeonhole of :mod:`stockloom.llm.simhash`; their nodes are candidates.

Two sets of similarity 0.8 differ in some ten bits, more than any probing finds without comparing most pairs. Those
are found by an exact prefix filter, so that no link is lost. All shingles are put in one order, from rare to common
over the corpus. Two sets of similarity 0.8 or more share one of the first ``n - ceil(0.8 n) + 1`` shingles
of both, and the smaller set holds it even among its first ``n - ceil(8 n / 9) + 1``. Shingles of a single node
come first in the order: they fill the prefixes of most nodes, which then have no candidate at all, and
a passage of many documents drops out of the prefixes. Nothing depends on a probability.

The order needs the number of nodes of each shingle. Shingles travel packed: a block of documents sends one
row of 32-bit keys to each shard of the hash range, a shard counts its keys and answers with those that
were seen twice, and the block cuts its prefixes. Keys may collide; that adds candidates and loses none.

Buckets (prefix shingles) of at most ``CROWD`` nodes are paired. In a larger one, nodes are compared with a
pivot, the node with the smallest share of shingles of its own, then those not near it with the next pivot.
What remains are pairs of different components; sizes, positions and the triangle inequality over the first
pivot (Jaccard distance is a metric) exclude most, the others are verified. Every candidate is verified on whole
sets, in whole numbers; no node is dropped or sampled, and the result does not depend on ``CROWD``.

Defined cases: texts without words, and null, have the empty set and are copies of each other. A very long
text is a block of its own. Rows of equal text, also of one id, are one node; an id with unlike texts stands for
several nodes, which stay or go separately. Of a component, the smallest (id, digest) stays, null ids last; of rows
equal in both, the one whose JSON has the smallest SHA-256. An empty table gives an empty table. Other columns,
whatever their names, stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.llm.arrow import split_words, with_columns
from stockloom.llm.components import connected_components, joined_components
from stockloom.llm.simhash import DISTANCE, keep_first, links, majority, plan_probes
from stockloom.operators.scans import materialize

WIDTH, SEED = 5, 42
#: Similarity from which two documents are near copies, as a fraction.
NEAR = (4, 5)
#: Nodes in a bucket from which they are compared with pivots instead of pairwise.
CROWD = 32
#: Another round of pivots is run while the last one settled at least this share of the rows.
WORTHWHILE = 0.05
#: Bytes of text in a block, about, and shingles in a shard.
BLOCK_BYTES, SHARD_KEYS = 12 << 20, 2_000_000


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    words = [w.lower() for w in split_words(text)]  # of bytes, so A-Z only
    if not words:
        return np.empty(0, np.uint64)
    shingles = {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles)))


def _node(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes(), SEED)


def with_node(documents: DataFrame, keep: list[str] | None = None, name: str = "fp", width: int = WIDTH) -> DataFrame:
    """Add the digest of the shingle set (binary)."""

    def make():
        return lambda texts: [[_node(shingle_set(t, width)) for t in texts]]

    return with_columns(documents, ["text"], make, [(name, T.BinaryType(), pa.binary())], keep)


def _with_size(documents: DataFrame, width: int) -> DataFrame:
    def make():
        def block(texts):
            sets = [shingle_set(t, width) for t in texts]
            return [[_node(s) for s in sets], [len(s) for s in sets], np.array([majority(s) for s in sets], np.uint64).view(np.int64)]

        return block

    adds = [("fp", T.BinaryType(), pa.binary()), ("n", T.LongType(), pa.int64()), ("simhash", T.LongType(), pa.int64())]
    return with_columns(documents, ["text"], make, adds, ["doc_id"])


def _with_set(documents: DataFrame, width: int) -> DataFrame:
    def make():
        def block(texts):
            sets = [shingle_set(t, width) for t in texts]
            return [[_node(s) for s in sets], [s.view(np.int64).tolist() for s in sets]]

        return block

    adds = [("fp", T.BinaryType(), pa.binary()), ("hashes", T.ArrayType(T.LongType()), pa.list_(pa.int64()))]
    return with_columns(documents, ["text"], make, adds, ["doc_id"])


# Rows between blocks and shards. The row that names the nodes of a block has no keys.
_PACKED = pa.schema(
    [("shard", pa.int64()), ("block", pa.int64()), ("nodes", pa.binary()), ("sizes", pa.binary()),
     ("keys", pa.binary()), ("docs", pa.binary()), ("classes", pa.binary())]
)
_PACKED_SQL = "shard bigint, block bigint, nodes binary, sizes binary, keys binary, docs binary, classes binary"


def _packed(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, _PACKED)


def _postings(nodes: DataFrame, shards: int, width: int) -> DataFrame:
    """Keys of the nodes' shingles: a row for each block and shard, and one that names the block's nodes."""

    def block_rows(block: int, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(s) for s in sets], np.int64)
        head = {"shard": block % shards, "block": block, "nodes": b"".join(map(_node, sets)), "sizes": sizes.tobytes()}
        yield from _packed([head]).to_batches()
        hashes = np.concatenate(sets)
        docs = np.repeat(np.arange(len(sets)), sizes)
        low = np.uint64(32)
        shard = ((hashes >> low) * np.uint64(shards)) >> low
        order = np.argsort(shard, kind="stable")
        ends = np.cumsum(np.bincount(shard.astype(np.int64), minlength=shards))
        keys = hashes.astype(np.uint32)
        for s, (start, end) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
            if start < end:
                part = order[start:end]
                per_doc = np.bincount(docs[part], minlength=len(sets)).astype(np.uint32)
                row = {"shard": s, "block": block, "keys": keys[part].tobytes(), "docs": per_doc.tobytes()}
                yield from _packed([row]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        sets, held = [], 0
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                sets.append(shingle_set(text, width))
                held += len(text or "")
                if held >= BLOCK_BYTES:
                    yield from block_rows(block, sets)
                    block, sets, held = block + 1, [], 0
        if sets:
            yield from block_rows(block, sets)

    return nodes.select("text").mapInArrow(run, _PACKED_SQL)


def _seen_twice(table: pa.Table) -> pa.Table:
    """A shard's answer to each block: the keys that several nodes hold, whose they are, and how common."""
    rows = table.to_pylist()
    heads = [r for r in rows if r["keys"] is None]
    rows = [r for r in rows if r["keys"] is not None]
    if not rows:
        return _packed(heads)
    keys = [np.frombuffer(r["keys"], np.uint32) for r in rows]
    _, place, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    classes = np.minimum(np.log2(count) * 4, 255).astype(np.uint8)[place]
    start = 0
    for row, own in zip(rows, keys):
        class_ = classes[start : start + len(own)]
        start += len(own)
        per_doc = np.frombuffer(row["docs"], np.uint32)
        kept = class_ > 0  # two nodes are class 4
        docs = np.repeat(np.arange(len(per_doc), dtype=np.uint32), per_doc)
        row.update(keys=own[kept].tobytes(), docs=docs[kept].tobytes(), classes=class_[kept].tobytes())
    return _packed(heads + rows)


def _prefixes(table: pa.Table, near: tuple[int, int]) -> pa.Table:
    """The prefix shingles of a block's nodes that other nodes hold as well."""
    rows = table.to_pylist()
    head = next(r for r in rows if r["nodes"] is not None)
    rows = [r for r in rows if r["nodes"] is None]
    nodes = [head["nodes"][i : i + 16] for i in range(0, len(head["nodes"]), 16)]
    sizes = np.frombuffer(head["sizes"], np.int64)
    join = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(r[name], kind) for r in rows)])
    docs, classes = join("docs", np.uint32).astype(np.int64), join("classes", np.uint8)
    lengths = [len(r["keys"]) // 4 for r in rows]
    shard = np.repeat(np.array([r["shard"] for r in rows], np.int64), lengths)
    bucket = shard << 32 | join("keys", np.uint32).astype(np.int64)
    order = np.lexsort((bucket, classes, docs))
    docs, bucket = docs[order], bucket[order]
    shared = np.bincount(docs, minlength=len(nodes))
    own = sizes - shared
    place = np.arange(len(docs)) - (np.cumsum(shared) - shared)[docs] + own[docs]
    top, bottom = near
    n = sizes[docs]
    inside = place < n + (-n * top) // bottom + 1
    docs, bucket, place, n = docs[inside], bucket[inside], place[inside], n[inside]
    return pa.table(
        {
            "bucket": pa.array(bucket, pa.int64()),
            "fp": pa.array([nodes[d] for d in docs.tolist()], pa.binary()),
            "n": pa.array(n, pa.int64()),
            "place": pa.array(place, pa.int64()),
            "own": pa.array(own[docs] / np.maximum(n, 1), pa.float64()),
            "short": pa.array(place < n + (-2 * n * top) // (top + bottom) + 1, pa.bool_()),
        }
    )


def prefixes(nodes: DataFrame, shards: int, width: int = WIDTH, near: tuple[int, int] = NEAR) -> DataFrame:
    """``bucket``, ``fp``, ``n``, ``place``, ``own`` (share of shingles of no other node), ``short`` of the prefix shingles.

    ``nodes`` has one ``text`` for each distinct shingle set; ``short`` is true inside the shorter prefix.
    """
    answers = _postings(nodes, shards, width).groupBy("shard").applyInArrow(_seen_twice, _PACKED_SQL)
    schema = "bucket bigint, fp binary, n bigint, place bigint, own double, short boolean"
    return answers.groupBy("block").applyInArrow(lambda table: _prefixes(table, near), schema)


def _sizes_allow(a: str, b: str, near: tuple[int, int]):
    """The smaller set has at least the accepted share of the larger one."""
    top, bottom = near
    return (F.col(a) * bottom >= F.col(b) * top) & (F.col(b) * bottom >= F.col(a) * top)


def _bounds_allow(near: tuple[int, int]):
    """Whether a pair of one bucket, the second named ``b``, ``of_b``, ``place_b``, ``short_b``, can be near."""
    top, bottom = near
    smaller_is_short = F.when(F.col("n") < F.col("of_b"), F.col("short")).when(F.col("n") > F.col("of_b"), F.col("short_b"))
    # Of the first common shingle, only those after it can be common as well.
    after = F.least(F.col("n") - F.col("place"), F.col("of_b") - F.col("place_b"))
    enough = after * (top + bottom) >= (F.col("n") + F.col("of_b")) * top
    return _sizes_allow("n", "of_b", near) & F.coalesce(smaller_is_short, F.col("short") | F.col("short_b")) & enough


def _second(members: DataFrame, *more: str) -> DataFrame:
    names = {"fp": "b", "n": "of_b", "place": "place_b", "short": "short_b"} | {c: f"{c}_b" for c in more}
    return members.select("bucket", *[F.col(c).alias(n) for c, n in names.items()])


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``both`` (common shingles) and ``all`` (those of either) of the pairs ``a``, ``b``."""
    first = sets.select(F.col("fp").alias("a"), F.col("hashes").alias("of_a"))
    second = sets.select(F.col("fp").alias("b"), F.col("hashes").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    found = pairs.join(second, "b").join(first, "a").select("a", "b", both.alias("both"), (F.size("of_a") + F.size("of_b") - both).alias("all"))
    return materialize(found)


def _near(compared: DataFrame, near: tuple[int, int]) -> DataFrame:
    top, bottom = near
    return compared.filter(F.col("both") * bottom >= F.col("all") * top).select("a", "b")


def simhash_pairs(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs ``a``, ``b`` of nodes (``fp``, ``simhash``) whose fingerprints are equal or linked within ``distance`` bits.

    A fingerprint of several nodes is stood for by the smallest of them, which the others are paired with: rows grow
    with the nodes and the links between fingerprints.
    """
    leaders = materialize(nodes.groupBy("simhash").agg(F.min("fp").alias("leader")))
    values = leaders.select(F.col("simhash").alias("fp"))
    linked = links(values, plan_probes(values, distance), distance)
    first = leaders.select(F.col("simhash").alias("a"), F.col("leader").alias("x"))
    second = leaders.select(F.col("simhash").alias("b"), F.col("leader").alias("y"))
    between = linked.join(first, "a").join(second, "b").select("x", "y")
    equal = nodes.join(leaders, "simhash").filter("fp != leader").select(F.col("leader").alias("x"), F.col("fp").alias("y"))
    return materialize(between.unionByName(equal).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def components(marked: DataFrame, documents: DataFrame, width: int = WIDTH, near: tuple[int, int] = NEAR) -> DataFrame:
    """``fp``, ``component`` for each distinct set; ``marked`` is the stored result of :func:`_with_size`."""
    own = [F.min("doc_id").alias("own_id"), F.first("n").alias("n"), F.first("simhash").alias("simhash")]
    nodes = materialize(marked.groupBy("fp").agg(*own))
    total = nodes.agg(F.sum("n")).first()[0] or 0
    ids = nodes.select("fp", F.col("own_id").alias("doc_id"))
    alike = simhash_pairs(nodes)
    copies = materialize(marked.join(ids.withColumnRenamed("doc_id", "own_id"), "fp").filter("doc_id != own_id").select("doc_id").distinct())
    chosen = prefixes(_of_nodes(documents, ids, width, copies), 1 + total // SHARD_KEYS, width, near)
    chosen = materialize(chosen)
    counts = chosen.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.bool_or("short").alias("any_short"))
    members = materialize(chosen.join(materialize(counts.filter("members > 1 AND any_short").drop("any_short")), "bucket"))
    ends = alike.select(F.col("a").alias("fp")).unionByName(alike.select(F.col("b").alias("fp")))
    wanted = materialize(members.select("fp").unionByName(ends).distinct())
    named = materialize(ids.join(wanted, "fp", "left_semi"))
    sets = _with_set(_of_nodes(documents, named, width), width).join(wanted, "fp", "left_semi")
    sets = materialize(sets.groupBy("fp").agg(F.first("hashes").alias("hashes")))

    quiet = members.filter(F.col("members") <= CROWD)
    pairs = quiet.join(_second(quiet), "bucket").filter((F.col("fp") < F.col("b")) & _bounds_allow(near))
    pairs = alike.unionByName(pairs.select(F.col("fp").alias("a"), "b")).distinct()
    edges = _near(_compared(materialize(pairs), sets), near)
    crowded = materialize(members.filter(F.col("members") > CROWD).drop("members"))
    if crowded.isEmpty():
        found = connected_components(materialize(edges.distinct()))
    else:
        found = joined_components(*_among_crowds(crowded, sets, edges, near))
    joined = nodes.select("fp").join(found.withColumnRenamed("node", "fp"), "fp", "left")
    return materialize(joined.select("fp", F.coalesce("component", "fp").alias("component")))


def _of_nodes(documents: DataFrame, ids: DataFrame, width: int, others: DataFrame | None = None) -> DataFrame:
    """One document (``doc_id``, ``text``) of each node ``fp``, found by its id; rows of other texts of the id go.

    Where most documents are wanted, ``others`` names the ids of the rest: the smaller side, so that texts need not move.
    """
    some = documents.select("doc_id", "text")
    # Few ids stand for several rows; only these are looked at again.
    repeated = materialize(some.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1 OR doc_id IS NULL").select("doc_id"))
    known = some.filter("doc_id IS NOT NULL").join(repeated, "doc_id", "left_anti")
    single = known.join(ids, "doc_id", "left_semi") if others is None else known.join(others, "doc_id", "left_anti")
    if repeated.isEmpty():
        return single
    several = some.join(repeated, some["doc_id"].eqNullSafe(repeated["doc_id"]), "left_semi")
    several = with_node(several, name="fp", width=width).join(ids.select("fp"), "fp", "left_semi")
    # The id found by the minimum is one of several rows of equal set; which of them is read is the same.
    folded = several.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text")).alias("r"))
    here = ids.filter("doc_id IS NULL").select("fp").unionByName(ids.join(repeated, "doc_id", "left_semi").select("fp"))
    folded = folded.join(here, "fp", "left_semi")
    return single.unionByName(folded.select("r.doc_id", "r.text"))


def _among_crowds(crowded: DataFrame, sets: DataFrame, edges: DataFrame, near: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Components of ``edges`` and the links to pivots, and the further links between components in crowded buckets."""
    top, bottom = near
    left, together, first = crowded, None, None
    rows = left.count()
    while rows:
        # The same order in all buckets, so that the buckets of one group mostly name the same pivot.
        best = F.min(F.struct("own", F.xxhash64("fp"), "fp", "n"))
        pivots = materialize(left.groupBy("bucket").agg(best.alias("p")).select("bucket", F.col("p.fp").alias("a"), F.col("p.n").alias("of_a")))
        met = left.join(pivots, "bucket").filter("fp != a")
        pairs = met.filter(_sizes_allow("n", "of_a", near)).select("a", F.col("fp").alias("b")).distinct()
        compared = _compared(materialize(pairs), sets)
        near_pivot = _near(compared, near)
        if first is None:
            first = _first_distances(crowded, pivots, compared)
        together = near_pivot if together is None else together.unionByName(near_pivot)
        settled = near_pivot.withColumnRenamed("b", "fp")
        left = met.join(settled, ["a", "fp"], "left_anti").select(crowded.columns)
        # What is left of a bucket needs no other pivot once it could be paired.
        many = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > CROWD).select("bucket")
        left = materialize(left.join(many, "bucket", "left_semi"))
        before, rows = rows, left.count()
        if before - rows < WORTHWHILE * before:
            break
    known = connected_components(materialize(together.unionByName(edges).distinct()))
    placed = first.join(known.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    placed = materialize(placed)
    # Each pair of two components has an end outside the largest component of its bucket.
    counts = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k"))
    largest = counts.groupBy("bucket").agg(F.max(F.struct("k", "component")).alias("m"), F.count(F.lit(1)).alias("parts"))
    split = materialize(largest.filter("parts > 1").select("bucket", F.col("m.component").alias("main")))
    placed = materialize(placed.join(split, "bucket"))
    minor = _second(placed.filter("component != main"), "component", "at_least", "exact")
    # A pair with the largest component is named once, from the outside; of other pairs the smaller end comes first.
    once = (F.col("component") == F.col("main")) | (F.col("fp") < F.col("b"))
    # Two nodes differ at least by the difference of their distances to the pivot.
    limit = F.lit((bottom - top) / bottom + 1e-9)
    apart = F.greatest(
        F.when(F.col("exact"), F.col("at_least_b") - F.col("at_least")), F.when(F.col("exact_b"), F.col("at_least") - F.col("at_least_b"))
    )
    possible = (F.col("component") != F.col("component_b")) & once & _bounds_allow(near) & (F.coalesce(apart, F.lit(0.0)) <= limit)
    pairs = placed.join(minor, "bucket").filter(possible)
    return known, _near(_compared(materialize(pairs.select(F.col("fp").alias("a"), "b").distinct()), sets), near)


def _first_distances(crowded: DataFrame, pivots: DataFrame, compared: DataFrame) -> DataFrame:
    """Add the distance to the bucket's pivot: ``at_least``, and whether it is ``exact`` or a bound from the sizes."""
    known = compared.select("a", F.col("b").alias("fp"), (1 - F.col("both") / F.col("all")).alias("measured"))
    met = crowded.join(pivots, "bucket").join(known, ["a", "fp"], "left")
    by_size = 1 - F.least("n", "of_a") / F.greatest("n", "of_a")
    same = F.col("fp") == F.col("a")
    at_least = F.when(same, F.lit(0.0)).otherwise(F.coalesce("measured", by_size))
    return materialize(met.select(*crowded.columns, at_least.alias("at_least"), (same | F.col("measured").isNotNull()).alias("exact")))


def deduplicate(documents: DataFrame, width: int = WIDTH, near: tuple[int, int] = NEAR) -> DataFrame:
    """Keep one document of each component of near copies, as :func:`simhash.keep_first` says."""
    marked = materialize(_with_size(documents.select("doc_id", "text"), width))
    found = components(marked, documents, width, near)
    return keep_first(documents, marked.select("doc_id", "fp"), found, lambda d, name: with_node(d, name=name, width=width))
