"""Language-model scoring by prediction by partial matching over bytes, with a model that grows with the corpus.

A text (ASCII lower case, UTF-8) is a sequence of bytes and an end. The next symbol is predicted from the longest
context of up to ``ORDER`` symbols that was seen in training. With total T and D different symbols seen after a
context, a symbol seen n times has the probability (n - d) / T, and the escape to the next shorter context d D / T,
for d = 1/2 (``DISCOUNT``). Symbols of the longer context are excluded from the shorter one's T and D, as they would
have been coded there. After the empty context, the symbols that are left are equally likely. Training texts are
preceded by ``ORDER`` symbols that stand for the start.

The trie of contexts is a set of tables, one for each order, keyed by the packed symbols; a shorter context's counts
are sums of the longer one's. Blocks of text send their different grams (``ORDER`` + 1 symbols) and words once, with
counts over training texts; these are added up, and probabilities go from the shortest order to the longest by joins on
the key without its first symbol, so excluded sums need no lists. The log probability of each gram then returns
to the blocks that asked for it, in one shuffle with their texts, sorted by block, and the texts are scored by look-up
as they stream by. Texts travel as compressed rows of up to ``TEXT_BYTES``, answers as compressed runs of one block.
Nothing is broadcast, and nothing but two numbers reaches the driver.

Defined cases: null text is the empty text, which is an end; rows without id are learned from; repeated rows are learned
from and scored each; ties play no part. A very long text is a block of its own, and read in pieces of ``PIECE`` bytes.
Where nothing was learned, every symbol is equally likely; an empty table gives an empty table. Columns other than the
id and the text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.operators.scans import materialize

#: Symbols of a context; symbols are bytes, the end of a text, and the start before it, of nine bits each.
ORDER = 5
END, START, BITS = 256, 257, 9
#: What is taken from the count of each symbol for the escape.
DISCOUNT = 0.5
#: Symbols that can follow a context: bytes and the end.
ALPHABET = 257
#: Bytes of text in a block, about, and positions whose grams are made at once.
BLOCK_BYTES, PIECE = 32 << 20, 1 << 20
#: Bytes of the texts of one row between the passes, about.
TEXT_BYTES = 2 << 20
#: Longer words are represented by a digest, after a byte that no UTF-8 text has.
LONGEST_WORD = 40
_NO_WORD = b"\xfe"  # the end, as a token


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


def grams_of(text: bytes, order: int) -> Iterator[np.ndarray]:
    """Packed grams of all positions of a text, the end included, in pieces."""
    symbols = np.empty(len(text) + order + 1, np.int64)
    symbols[:order] = START
    symbols[order:-1] = np.frombuffer(text, np.uint8)
    symbols[-1] = END
    for at in range(0, len(text) + 1, PIECE):
        n = min(PIECE, len(text) + 1 - at)
        packed = np.zeros(n, np.int64)
        for i in range(order + 1):
            packed = packed << BITS | symbols[at + i : at + i + n]
        yield packed


def words_of(text: bytes) -> list[bytes]:
    return [w if len(w) <= LONGEST_WORD else b"\xff" + xxhash.xxh3_128_hexdigest(w).encode() for w in text.split()]


def _lower(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _add_counts(into: tuple[np.ndarray, np.ndarray], grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different grams with their counts, after adding more grams."""
    keys, counts = into
    more, n = np.unique(np.concatenate(grams), return_counts=True)
    if not len(keys):
        return more, n
    both, place = np.unique(np.concatenate([keys, more]), return_inverse=True)
    return both, np.bincount(place, weights=np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)


_NOTHING = (np.zeros(0, np.int64), np.zeros(0, np.int64))


class _BlockCounts:
    """Grams and words of a block, with their counts in training texts."""

    def __init__(self, order: int):
        self.order = order
        self.known, self.asked = _NOTHING, _NOTHING
        self.waiting: dict[bool, list[np.ndarray]] = {True: [], False: []}
        self.size = 0
        self.words: Counter[bytes] = Counter()
        self.other: set[bytes] = set()

    def add(self, text: bytes, learn: bool) -> None:
        for piece in grams_of(text, self.order):
            self.waiting[learn].append(piece)
            self.size += len(piece)
            if self.size >= PIECE:
                self.settle()
        words = words_of(text)
        if learn:
            self.words.update(words)
            self.words[_NO_WORD] += 1
        else:
            self.other.update(words)

    def settle(self) -> None:
        if self.waiting[True]:
            self.known = _add_counts(self.known, self.waiting[True])
        if self.waiting[False]:
            self.asked = _add_counts(self.asked, self.waiting[False])
        self.waiting, self.size = {True: [], False: []}, 0

    def columns(self) -> tuple[np.ndarray, np.ndarray, list[bytes], list[int]]:
        self.settle()
        new = np.setdiff1d(self.asked[0], self.known[0], assume_unique=True)
        grams = np.concatenate([self.known[0], new])
        counts = np.concatenate([self.known[1], np.zeros(len(new), np.int64)])
        words, n = list(self.words), list(self.words.values())
        unknown = [w for w in (*self.other, _NO_WORD) if w not in self.words]
        return grams, counts, words + unknown, n + [0] * len(unknown)


# Rows of blocks: grams, words, answers to either, or texts that are to be scored.
_GRAM, _WORD, _TEXT = 0, 1, 2
_COLUMNS = {"block": pa.int64(), "kind": pa.int8(), "gram": pa.int64(), "word": pa.binary(), "n": pa.int64(), "data": pa.binary()}
_BLOCKS = "block bigint, kind tinyint, gram bigint, word binary, n bigint, data binary, ids array<{id}>, held_out array<boolean>"
_ANSWERS = "block bigint, kind tinyint, data binary"


def _pack(*parts: bytes) -> bytes:
    return zstandard.compress(b"".join(len(p).to_bytes(8, "little") + p for p in parts), 3)


def _unpack(data: bytes) -> list[bytes]:
    data, parts, at = zstandard.decompress(data), [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        parts.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return parts


def _row_batch(block: int, kind: int, rows: int, id_type: pa.DataType, **columns: pa.Array) -> pa.RecordBatch:
    types = _COLUMNS | {"ids": pa.list_(id_type), "held_out": pa.list_(pa.bool_())}
    given = {"block": pa.array(np.full(rows, block)), "kind": pa.array(np.full(rows, kind, np.int8))} | columns
    return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(rows, t) for c, t in types.items()], names=list(types))


def _blocks(documents: DataFrame, order: int) -> DataFrame:
    """Texts with the number of their block, and the different grams and words of each block."""
    id_type = documents.schema["doc_id"].dataType
    rows = documents.select("doc_id", held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))

    def text_row(block: int, part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(i)) for i in (0, 1)]
        data = pa.array([_pack(*texts)], pa.binary())
        return _row_batch(block, _TEXT, 1, part.schema.types[0], data=data, ids=lists[0], held_out=lists[1])

    def count_rows(block: int, counts: _BlockCounts, ids: pa.DataType) -> Iterator[pa.RecordBatch]:
        grams, n, words, n_words = counts.columns()
        yield _row_batch(block, _GRAM, len(grams), ids, gram=pa.array(grams), n=pa.array(n, pa.int64()))
        yield _row_batch(block, _WORD, len(words), ids, word=pa.array(words, pa.binary()), n=pa.array(n_words, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, counts, ids = TaskContext.get().partitionId() << 32, 0, None, None
        for batch in batches:
            begin, texts, held, ids = 0, [], 0, batch.schema.types[0]
            for at in range(batch.num_rows):
                counts = counts or _BlockCounts(order)
                text = _lower(batch.column(2)[at].as_py())
                counts.add(text, not batch.column(1)[at].as_py())
                texts.append(text)
                held += len(text)
                size += len(text)
                if held >= TEXT_BYTES or size >= BLOCK_BYTES or at + 1 == batch.num_rows:
                    yield text_row(block, batch.slice(begin, at + 1 - begin), texts)
                    begin, texts, held = at + 1, [], 0
                if size >= BLOCK_BYTES:
                    yield from count_rows(block, counts, ids)
                    block, size, counts = block + 1, 0, None
        if counts is not None:
            yield from count_rows(block, counts, ids)

    return rows.mapInArrow(run, _BLOCKS.format(id=id_type.simpleString()))


def _answers(values: DataFrame, kind: int) -> DataFrame:
    """Runs of keys and values (columns 1 and 2) of one block, as they lie in a task, each in one row."""

    def packed(keys: pa.Array, values: pa.Array) -> bytes:
        values = values.to_numpy().tobytes()
        if kind == _GRAM:
            return _pack(np.diff(keys.to_numpy(), prepend=0).tobytes(), values)
        return _pack(b" ".join(keys.to_pylist()), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy()
            cuts = (np.nonzero(np.diff(block))[0] + 1).tolist()
            spans = [(a, b) for a, b in zip([0, *cuts], [*cuts, len(block)]) if b > a]
            data = [packed(batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)) for a, b in spans]
            blocks = pa.array([int(block[a]) for a, _ in spans], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [blocks, pa.array([kind] * len(data), pa.int8()), pa.array(data, pa.binary())], names=["block", "kind", "data"]
            )

    key = values.columns[1]
    return values.sortWithinPartitions("block", key).mapInArrow(run, _ANSWERS)


def _log_share(part: Column, total: Column) -> Column:
    """Null where the total is 0: such a context is passed by."""
    return F.log10(F.try_divide(part, total))


def log_probabilities(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram``, ``log_p`` (base 10) of all grams of ``counts`` (``gram``, ``n``; n may be 0).

    Each order's table has ``gram``, its count ``n``, total and number of different symbols of its context
    (``total``, ``kinds``), the log probability ``direct`` where this context is the longest that was seen, and
    ``after`` where a longer context, whose last symbols are this one, has escaped to it.
    """
    tables = [counts]
    for k in reversed(range(order)):
        # The count of a shorter gram is the sum over the symbol before it.
        short = F.col("gram").bitwiseAND(F.lit((1 << BITS * (k + 1)) - 1)).alias("gram")
        tables.append(materialize(tables[-1].groupBy(short).agg(F.sum("n").alias("n"))))
    tables.reverse()
    result = None
    for k, table in enumerate(tables):
        context = F.shiftright("gram", BITS)
        inside = Window.partitionBy("context")
        sums = {"total": F.sum("n").over(inside), "kinds": F.count(F.when(F.col("n") > 0, True)).over(inside)}
        if k == 0:
            found = table.withColumn("context", context).withColumns(sums)
            left = F.log10(ALPHABET - F.col("kinds"))
            below = {"below": -left}
        else:
            shorter = result.select(
                F.col("gram").alias("_short"), F.col("n").alias("n_s"), F.col("total").alias("total_s"),
                F.col("kinds").alias("kinds_s"), F.col("direct").alias("direct_s"), F.col("below").alias("below_s"),
            )
            short = F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1))
            joined = table.withColumn("_short", short).join(shorter, "_short").drop("_short").withColumn("context", context)
            sums["covered"] = F.sum(F.when(F.col("n") > 0, F.col("n_s")).otherwise(0)).over(inside)
            found = joined.withColumns(sums)
            # What the shorter context predicts once this one's symbols are excluded.
            total, kinds = F.col("total_s") - F.col("covered"), F.col("kinds_s") - F.col("kinds")
            escape = F.when(kinds > 0, _log_share(DISCOUNT * kinds, total)).otherwise(0.0)
            below = {"below": F.when(F.col("n_s") > 0, _log_share(F.col("n_s") - DISCOUNT, total)).otherwise(escape + F.col("below_s"))}
        unseen = F.col("below") if k == 0 else F.col("direct_s")
        direct = (
            F.when(F.col("n") > 0, _log_share(F.col("n") - DISCOUNT, F.col("total")))
            .when(F.col("kinds") > 0, _log_share(DISCOUNT * F.col("kinds"), F.col("total")) + F.col("below"))
            .otherwise(unseen)
        )
        result = materialize(found.withColumns(below).withColumn("direct", direct).select("gram", "n", "total", "kinds", "below", "direct"))
    return result.select("gram", F.col("direct").alias("log_p"))


def score(documents: DataFrame, order: int = ORDER) -> DataFrame:
    """``doc_id``, ``held_out``, token counts, unigram ``base_score`` and model ``score`` of every row."""
    id_type = documents.schema["doc_id"].dataType
    blocks = materialize(_blocks(documents, order))
    grams = blocks.filter(F.col("kind") == _GRAM).select("block", "gram", "n")
    counts = materialize(grams.groupBy("gram").agg(F.sum("n").alias("n")))
    log_p = log_probabilities(counts, order)
    # A word has one row in each block at most, so a window holds as many rows as there are blocks.
    of_word = Window.partitionBy("word")
    words = blocks.filter(F.col("kind") == _WORD).select("block", "word", "n")
    words = materialize(
        words.withColumns({"count": F.sum("n").over(of_word), "first": F.row_number().over(of_word.orderBy("block")) == 1})
    )
    n_tokens, n_kinds = words.agg(F.sum("n"), F.count_if(F.col("first") & (F.col("count") > 0))).first()
    n_tokens, all_words = n_tokens or 0, (n_tokens or 0) + n_kinds + 1

    nothing = [F.lit(None).cast(T.ArrayType(id_type)).alias("ids"), F.lit(None).cast("array<boolean>").alias("held_out")]
    rows = (
        _answers(grams.join(log_p, "gram").select("block", "gram", "log_p"), _GRAM)
        .unionAll(_answers(words.select("block", "word", "count"), _WORD))
        .select("*", *nothing)
        .unionAll(blocks.filter(F.col("kind") == _TEXT).select("block", "kind", "data", "ids", "held_out"))
    )
    ordered = rows.repartition("block").sortWithinPartitions("block", "kind")
    schema = f"doc_id {id_type.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            for at, (block, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if table is None or block != table.block:
                    table = _BlockTable(block, order, all_words)
                data = batch.column(2)[at].as_py()
                if kind == _TEXT:
                    ids, held = (batch.column(i)[at].values for i in (3, 4))
                    yield pa.RecordBatch.from_arrays([ids, held, *table.scores(_unpack(data))], names=names)
                else:
                    table.add(kind, *_unpack(data))

    scored = ordered.mapInArrow(run, schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


class _BlockTable:
    """Values of one block's grams and words, gathered from its rows, and the scores of its texts."""

    def __init__(self, block: int, order: int, all_words: int):
        self.block, self.order, self.all_words = block, order, all_words
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.words: dict[bytes, int] = {}
        self.counts: list[np.ndarray] = []
        self.ready: tuple | None = None

    def add(self, kind: int, keys: bytes, values: bytes) -> None:
        if kind == _GRAM:
            self.parts.append((np.cumsum(np.frombuffer(keys, np.int64)), np.frombuffer(values)))
        else:
            counts = np.frombuffer(values, np.int64)
            self.words.update(zip(keys.split(b" "), range(len(self.words), len(self.words) + len(counts))))
            self.counts.append(counts)

    def scores(self, texts: list[bytes]) -> list[pa.Array]:
        if self.ready is None:
            keys, values = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
            self.parts = []
            counts = np.concatenate(self.counts)
            self.ready = pd.Index(keys), values, counts, np.log10((counts + 1) / self.all_words)
        keys, values, counts, logs = self.ready
        rows = []
        for text in texts:
            score = sum(float(values[keys.get_indexer(piece)].sum()) for piece in grams_of(text, self.order))
            place = np.array([*map(self.words.__getitem__, words_of(text)), self.words[_NO_WORD]], np.int64)
            rows.append((len(place), int(np.count_nonzero(counts[place])), float(logs[place].sum()), score))
        types = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return [pa.array(column, t) for column, t in zip(zip(*rows), types)]
