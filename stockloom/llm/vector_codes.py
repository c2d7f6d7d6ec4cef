"""Vector code compression: product codebooks fitted by Lloyd's rounds over two trees.

A vector becomes integers, is cut into parts, and each part is coded by the nearest entry of the codebook of
its position. Blocks of vectors are compiled once: for each part position a balanced tree over the block's
parts, whose nodes hold bounding boxes and cached sums. Each round sends the codebooks (a table of a fixed
size) to the tasks, which put a tree over the entries and descend both trees at once. A pair of nodes is pruned
when its smallest distance is above the largest distance of another pair of the same data node; a node left
with a single entry is assigned as a whole through its cached sum; at leaves that stay uncertain, exact
distances to the entries that are left decide. A round returns one row of sums for each task and entry.

All numbers are integers: doubles while every squared distance stays under 2**53, Python integers otherwise.
Ties go to the lower entry.

Defined cases: a vector that is null, or holds null, NaN or an infinite component, is dropped, and so is one
whose length differs from that of the first kept vector (smallest id, nulls last, then smallest components). Rows
that repeat are coded each; with fewer than ``ENTRIES`` vectors there are fewer entries; an empty table gives an
empty table. Parts differ by one component where the length is not divisible. Null labels form one group.
Errors beyond a long are the largest long. Columns other than the id, the label and the vector are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.operators.scans import materialize

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors in a block, parts in a leaf, entries in a leaf of the entry tree.
BLOCK, LEAF, ENTRY_LEAF = 4096, 64, 8
#: Entries of surviving leaves up to which a data node is compared with single entries.
FEW = 64
_EXACT, _LONGEST = 1 << 53, (1 << 63) - 1


@dataclass(frozen=True)
class Codebooks:
    """``entries[part]`` is an array (entries, width), of doubles that hold integers, or of Python integers."""

    entries: list[np.ndarray]

    def digest(self) -> str:
        flat = ",".join(str(int(x)) for book in self.entries for row in book for x in row)
        return hashlib.sha256(flat.encode()).hexdigest()


def to_integers(vectors: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)`` of each component, as doubles if they are below 2**53 and as Python integers otherwise."""
    vectors = vectors.astype(np.float64, copy=False)
    if not vectors.size or np.abs(vectors).max() < _EXACT / SCALE:
        return np.floor(vectors * SCALE)
    # A double of this size is an integer; SCALE is a power of two.
    whole = lambda x: math.floor(x * SCALE) if abs(x) < 1 << 40 else int(x) * SCALE
    return np.array([[whole(x) for x in row] for row in vectors.tolist()], object)


def _cuts(width: int) -> list[int]:
    return [width * i // PARTS for i in range(PARTS + 1)]


def _bounds(n: int, leaf: int) -> list[np.ndarray]:
    """Starts (and the end) of the nodes of each level of a balanced tree over n places, the root first."""
    levels, parts = [], 1
    while True:
        levels.append(np.arange(parts + 1) * n // parts)
        if n <= leaf * parts:
            return levels
        parts *= 2


@dataclass(frozen=True)
class Tree:
    """Points in tree order, and of each level the boxes and sums of its nodes."""

    points: np.ndarray
    order: np.ndarray  # row of each point
    levels: list[np.ndarray]  # first places of the nodes
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]

    @staticmethod
    def order_of(points: np.ndarray, leaf: int) -> np.ndarray:
        """Split every node at the middle of its widest component, level by level."""
        order = np.arange(len(points))
        if not points.shape[1]:
            return order
        for level in _bounds(len(points), leaf)[1:]:
            for start, middle, end in zip(level[:-2:2], level[1:-1:2], level[2::2]):
                if middle - start and end - middle:
                    inside = points[order[start:end]]
                    axis = int(np.argmax(inside.max(0) - inside.min(0)))
                    order[start:end] = order[start:end][np.argpartition(inside[:, axis], middle - start)]
        return order

    @staticmethod
    def over(points: np.ndarray, order: np.ndarray, leaf: int) -> Tree:
        """The tree of points that already stand in its order."""
        levels = _bounds(len(points), leaf)
        last = levels[-1]
        spans = list(zip(last[:-1], last[1:]))
        low = [np.array([points[a:b].min(0) for a, b in spans])]
        high = [np.array([points[a:b].max(0) for a, b in spans])]
        sums = [np.array([points[a:b].sum(0) for a, b in spans])]
        for _ in levels[1:]:
            low.insert(0, np.minimum(low[0][::2], low[0][1::2]))
            high.insert(0, np.maximum(high[0][::2], high[0][1::2]))
            sums.insert(0, sums[0][::2] + sums[0][1::2])
        return Tree(points, order, levels, low, high, sums)


def _middles(tree: Tree) -> list[np.ndarray]:
    """Of each node of each level, the point nearest to the middle of its box."""
    found = []
    for level, low, high in zip(tree.levels, tree.low, tree.high):
        rows = []
        for start, end, middle in zip(level[:-1], level[1:], low + high):
            apart = 2 * tree.points[start:end] - middle
            rows.append(tree.points[start + int(np.argmin((apart * apart).sum(1)))])
        found.append(np.array(rows))
    return found


def _box_distances(low: np.ndarray, high: np.ndarray, of_low: np.ndarray, of_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest squared distance between points of pairs of boxes."""
    apart = np.maximum(np.maximum(of_low - high, low - of_high), 0)
    across = np.maximum(of_high - low, high - of_low)
    return (apart * apart).sum(1), (across * across).sum(1)


def _group_min(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Smallest value of each group; groups are sorted and none is empty."""
    starts = np.searchsorted(group, np.arange(n))
    return np.minimum.reduceat(values, starts)


def _pruned(nodes: np.ndarray, others: np.ndarray, n: int, lower: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    limit = _group_min(upper, nodes, n)
    keep = np.asarray(lower <= limit[nodes], bool)
    return nodes[keep], others[keep]


def assign(data: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
    """Nearest entry of each point (in tree order), entry counts and sums, and how the points were settled."""
    entry_order = Tree.order_of(book, ENTRY_LEAF)
    entries = Tree.over(book[entry_order], entry_order, ENTRY_LEAF)
    middles = _middles(entries)
    nearest = np.full(len(data.points), -1, np.int64)
    counts, sums = np.zeros(len(book), np.int64), np.zeros_like(book)
    settled = {"whole": 0, "leaves": 0, "distances": 0}

    def whole(level: int, node: int, entry: int) -> None:
        start, end = data.levels[level][node : node + 2]
        nearest[start:end] = entry
        counts[entry] += end - start
        sums[entry] += data.sums[level][node]
        settled["whole"] += int(end - start)

    depth, entry_depth = len(data.levels) - 1, len(entries.levels) - 1
    nodes, others = np.zeros(1, np.int64), np.zeros(1, np.int64)
    level = entry_level = 0
    while True:
        # ``nodes`` are sorted, with every node that is not settled; ``others`` are nodes of the entry tree.
        open_nodes, nodes = np.unique(nodes, return_inverse=True)
        at = open_nodes[nodes]
        low, high = data.low[level][at], data.high[level][at]
        lower, _ = _box_distances(low, high, entries.low[entry_level][others], entries.high[entry_level][others])
        # No point of the data node is farther from its nearest entry than from the one in the middle of the pair's other node.
        middle = middles[entry_level][others]
        _, upper = _box_distances(low, high, middle, middle)
        nodes, others = _pruned(nodes, others, len(open_nodes), lower, upper)
        if entry_level == entry_depth:
            nodes, others = _single_entries(data, entries, book, level, open_nodes, nodes, others, whole)
        if not len(nodes):
            return nearest, counts, sums, settled
        nodes = open_nodes[nodes]
        if level == depth and entry_level == entry_depth:
            break
        if entry_level < entry_depth:
            nodes, others = np.repeat(nodes, 2), np.repeat(others * 2, 2) + np.tile([0, 1], len(others))
            entry_level += 1
        if level < depth:
            nodes, others = np.concatenate([nodes * 2, nodes * 2 + 1]), np.concatenate([others, others])
            order = np.argsort(nodes, kind="stable")
            nodes, others = nodes[order], others[order]
            level += 1
    # Uncertain leaves: distances to the entries of the surviving entry leaves, in the entries' own order.
    squares = (book * book).sum(1)
    firsts = np.concatenate([np.nonzero(np.diff(nodes, prepend=-1))[0], [len(nodes)]])
    spans = entries.levels[-1]
    for a, b in zip(firsts[:-1], firsts[1:]):
        node = nodes[a]
        start, end = data.levels[-1][node : node + 2]
        left = np.sort(np.concatenate([entry_order[spans[o] : spans[o + 1]] for o in others[a:b]]))
        points = data.points[start:end]
        # The square of the point is the same for all entries.
        found = left[np.argmin(squares[left] - 2 * (points @ book[left].T), axis=1)]
        nearest[start:end] = found
        settled["leaves"] += int(end - start)
        settled["distances"] += int(end - start) * len(left)
    inside = np.concatenate([np.arange(*data.levels[-1][node : node + 2]) for node in np.unique(nodes)])
    found, points = nearest[inside], data.points[inside]
    counts += np.bincount(found, minlength=len(book))
    if sums.dtype == object:
        np.add.at(sums, found, points)
    else:
        for i in range(book.shape[1]):
            sums[:, i] += np.bincount(found, weights=points[:, i], minlength=len(book))
    return nearest, counts, sums, settled


def _single_entries(data, entries, book, level, open_nodes, nodes, others, whole):
    """Settle nodes that a single entry is left for; the others keep their entry leaves."""
    width = np.diff(entries.levels[-1])
    held = np.bincount(nodes, weights=width[others], minlength=len(open_nodes))
    few = np.nonzero(held <= FEW)[0]
    if not len(few):
        return nodes, others
    chosen = np.isin(nodes, few)
    at, leaf = nodes[chosen], others[chosen]
    starts = entries.levels[-1][leaf]
    single = np.repeat(at, width[leaf])
    begins = np.cumsum(width[leaf]) - width[leaf]
    entry = entries.order[np.repeat(starts - begins, width[leaf]) + np.arange(len(single))]
    box = open_nodes[single]
    lower, upper = _box_distances(data.low[level][box], data.high[level][box], book[entry], book[entry])
    # Of the entries with the least upper bound the lowest is the one to beat; at equal bounds it wins.
    order = np.lexsort((entry, upper.astype(np.float64), single)) if upper.dtype != object else np.array(
        sorted(range(len(single)), key=lambda i: (single[i], upper[i], entry[i])), np.int64
    )
    first = order[np.concatenate([[True], np.diff(single[order]) > 0])]
    best = np.zeros(len(open_nodes), np.int64)
    best[single[first]] = first
    rival = best[single]
    left = np.asarray((lower < upper[rival]) | ((lower == upper[rival]) & (entry <= entry[rival])), bool)
    alone = np.bincount(single[left], minlength=len(open_nodes)) == 1
    for i in np.nonzero(left)[0]:
        if alone[single[i]]:
            whole(level, int(open_nodes[single[i]]), int(entry[i]))
    keep = ~alone[nodes]
    return nodes[keep], others[keep]


def _kind(books: list[np.ndarray], largest: int) -> type:
    """Doubles if all sums of squares of the differences stay exact, else Python integers."""
    width = max((book.shape[1] for book in books), default=0)
    return np.float64 if max(1, width) * (2 * largest) ** 2 * 2 < _EXACT else object


def _as_kind(values: np.ndarray, kind: type) -> np.ndarray:
    if kind is object and values.dtype != object:
        return np.array([[int(x) for x in row] for row in values.tolist()], object).reshape(values.shape)
    return values if kind is object else values.astype(np.float64)


def _pack(values: np.ndarray) -> bytes:
    """Integers as text of a known shape if they are Python integers, else as bytes."""
    if values.dtype == object:
        return b"," + ",".join(str(x) for row in values for x in row).encode()
    small = not values.size or np.abs(values).max() < 1 << 31
    return (b"i" if small else b"q") + values.astype(np.int32 if small else np.int64).tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    if data[:1] == b",":
        values = np.array([int(x) for x in data[1:].split(b",") if x], object)
    else:
        values = np.frombuffer(data, np.int32 if data[:1] == b"i" else np.int64, offset=1).astype(np.float64)
    return values.reshape(n, -1) if values.size else np.zeros((n, 0))


def kept_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is neither null nor holds a component that is null, NaN or infinite."""
    x = F.col(vector)
    wide = F.transform(x, lambda v: v.cast("double"))
    bad = F.exists(wide, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.filter(x.isNotNull() & ~bad)


def _compiled(vectors: DataFrame, width: int) -> DataFrame:
    """One row for each block: ids, labels, and of each part position its points in tree order."""
    cuts = _cuts(width)
    fields = {f.name: f.dataType for f in vectors.schema}
    schema = T.StructType(
        [T.StructField("ids", T.ArrayType(fields["id"])), T.StructField("labels", T.ArrayType(fields["label"]))]
        + [T.StructField(f"{name}{p}", T.BinaryType()) for p in range(PARTS) for name in ("points", "order")]
    )
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                n = part.num_rows
                flat = part.column(2).flatten().to_numpy(zero_copy_only=False)
                values = to_integers(flat.reshape(n, width))
                out = [_as_list(part.column(0)), _as_list(part.column(1))]
                for p in range(PARTS):
                    points = values[:, cuts[p] : cuts[p + 1]]
                    order = Tree.order_of(points, LEAF)
                    out += [pa.array([_pack(points[order])]), pa.array([order.astype(np.int32).tobytes()])]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return vectors.select("id", "label", "vector").mapInArrow(run, schema)


def _as_list(column: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def _blocks(batch: pa.RecordBatch, kind: type) -> Iterator[tuple[int, list[Tree]]]:
    names = batch.schema.names
    for row in range(batch.num_rows):
        get = lambda name: batch.column(names.index(name))[row].as_py()  # noqa: B023, E731
        trees = []
        for p in range(PARTS):
            order = np.frombuffer(get(f"order{p}"), np.int32).astype(np.int64)
            trees.append(Tree.over(_as_kind(_unpack(get(f"points{p}"), len(order)), kind), order, LEAF))
        yield row, trees


def _round(blocks: DataFrame, books: Codebooks, kind: type) -> Codebooks:
    """Assign all parts and move each entry to the floored mean of its parts."""
    shared = blocks.sparkSession.sparkContext.broadcast(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [_as_kind(book, kind) for book in shared.value]
        counts = [np.zeros(len(book), np.int64) for book in entries]
        sums = [np.zeros_like(book) for book in entries]
        for batch in batches:
            for _, trees in _blocks(batch, kind):
                for p, tree in enumerate(trees):
                    _, n, total, _ = assign(tree, entries[p])
                    counts[p] += n
                    sums[p] += total
        rows = [(p, e, int(counts[p][e]), [int(x) for x in sums[p][e]]) for p in range(PARTS) for e in np.nonzero(counts[p])[0].tolist()]
        if rows:
            part, entry, n, total = zip(*rows)
            text = [[str(x) for x in t] for t in total]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n, pa.int64()), pa.array(text, pa.list_(pa.string()))],
                names=["part", "entry", "n", "total"],
            )

    sent = blocks.mapInArrow(run, "part int, entry int, n bigint, total array<string>")
    moved = [book.copy() for book in books.entries]
    for part, entry, n, total in _summed(sent, kind, max(book.shape[1] for book in books.entries)):
        moved[part][entry] = np.array([x // n for x in total], moved[part].dtype)
    shared.unpersist()
    return Codebooks(moved)


def _summed(sent: DataFrame, kind: type, width: int) -> list[tuple[int, int, int, list[int]]]:
    """Counts and component sums of each part and entry: at most ``PARTS * ENTRIES`` rows."""
    if kind is not object:
        # A sum of longs cannot overflow: components are below 2**26 here.
        total = F.array(*[F.sum(F.get("total", F.lit(i)).cast("bigint")) for i in range(width)]).cast("array<string>")
        found = sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), total.alias("total"))
    else:
        # One row for each task that met the entry.
        def add(table: pa.Table) -> pa.Table:
            totals = [sum(map(int, column)) for column in zip(*table.column("total").to_pylist())]
            row = {"part": table["part"][0].as_py(), "entry": table["entry"][0].as_py(), "n": sum(table["n"].to_pylist()), "total": list(map(str, totals))}
            return pa.Table.from_pylist([row], pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.string()))]))

        found = sent.groupBy("part", "entry").applyInArrow(add, "part int, entry int, n bigint, total array<string>")
    return [(r["part"], r["entry"], r["n"], [int(x) for x in r["total"] if x is not None]) for r in found.collect()]


def _coded(blocks: DataFrame, books: Codebooks, kind: type) -> DataFrame:
    """``id``, ``label``, ``code`` (binary, one byte a part) and ``error`` of each vector."""
    shared = blocks.sparkSession.sparkContext.broadcast(books.entries)
    fields = {f.name: f.dataType for f in blocks.schema}
    schema = T.StructType(
        [T.StructField("id", fields["ids"].elementType), T.StructField("label", fields["labels"].elementType),
         T.StructField("code", T.StringType()), T.StructField("error", T.DecimalType(38, 0))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [_as_kind(book, kind) for book in shared.value]
        for batch in batches:
            for row, trees in _blocks(batch, kind):
                n = len(trees[0].order)
                codes = np.zeros((n, PARTS), np.uint8)
                errors = np.zeros(n, object if kind is object else np.float64)
                for p, tree in enumerate(trees):
                    nearest, _, _, _ = assign(tree, entries[p])
                    codes[tree.order, p] = nearest
                    apart = tree.points - entries[p][nearest]
                    errors[tree.order] += (apart * apart).sum(1)
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[row].values, batch.column(1)[row].values,
                        pa.array([text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]),
                        pa.array([min(int(e), _LONGEST) for e in errors.tolist()], pa.int64()).cast(pa.decimal128(38, 0)),
                    ],
                    names=schema.names,
                )

    return blocks.mapInArrow(run, schema)


def compress(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, Codebooks]:
    """Codes of all kept vectors (``id``, ``label``, ``code``, ``error`` as decimal), stored, and the codebooks.

    Only the first ``ENTRIES`` vectors and, each round, one row for each part and entry reach the driver.
    """
    named = kept_vectors(vectors, vector).select(
        F.col(id).alias("id"), F.col(label).alias("label"), F.transform(vector, lambda v: v.cast("double")).alias("vector")
    )
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    first = named.select("id", "vector").orderBy(*order).limit(1).collect()
    if not first:
        nothing = named.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("decimal(38,0)").alias("error"))
        return nothing.limit(0), Codebooks([np.zeros((0, 0))] * PARTS)
    width = len(first[0]["vector"])
    named = named.filter(F.size("vector") == width)
    start = named.select("id", "vector").orderBy(*order).limit(ENTRIES).collect()
    values = to_integers(np.array([r["vector"] for r in start], np.float64).reshape(len(start), width))
    cuts = _cuts(width)
    books = Codebooks([values[:, cuts[p] : cuts[p + 1]] for p in range(PARTS)])
    blocks = materialize(_compiled(named, width))
    top = named.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0] if width else 0
    kind = _kind(books.entries, math.ceil(top) * SCALE + 1)
    for _ in range(ROUNDS):
        books = _round(blocks, books, kind)
    return materialize(_coded(blocks, books, kind)), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add ``label_error``: the error summed over rows of an equal label, nulls together."""
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of_label")), "left").drop("of_label")
