"""Quality classifier: similarity-weighted vote of nearest labelled documents in a latent-semantic space.

Terms are hashed lower-cased words and hashed word shapes. A bounded sample of labelled documents gives
weighted term vectors, their truncated singular value decomposition gives the latent space, and the
sample's unit vectors there are broadcast. Every document is projected, multiplied with all labelled
vectors in blocks (exact cosines, no index), and scored by its ``NEIGHBOURS`` nearest ones.

Defined cases: null text is empty; a text without words, or one unlike every labelled document, gets the
share of good documents in the sample; with no usable label every document scores 1, so nothing is
rejected without evidence. Labels that are null count as missing; of several labels of one document the
smallest counts. Rows are never joined or dropped, so repeated rows and extra columns stay as they are.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.llm.arrow import WordTable, keep_rows, split_words, with_columns
from stockloom.operators.scans import materialize

#: Labelled documents that are sampled for the fit, at most, for each label value.
SAMPLE_PER_LABEL = 1_200
#: Hashed terms: shapes come first, then terms of adjacent repeats, then words.
SHAPE_TERMS, TERMS = 256, 4_096
#: Shares of words equal to the word before, each with a term that counts all words of a text above it.
REPEAT_RATES = (0.1, 0.2, 0.4)
#: Dimensions of the latent space, neighbours that vote, and the score from which a document is good.
RANK, NEIGHBOURS, THRESHOLD = 64, 31, 0.7
#: Rounds of the subspace iteration that finds this space.
ITERATIONS = 12
_REPEAT = SHAPE_TERMS - 1 - len(REPEAT_RATES)
_SYMBOLS = frozenset(b"#*$%&|<>")


@dataclass(frozen=True)
class Model:
    """What is broadcast; its size depends on the constants above only."""

    projection: np.ndarray  # (TERMS, rank): weights of terms times right singular vectors
    vectors: np.ndarray  # (labelled, rank), unit length
    good: np.ndarray  # (labelled,), 1.0 for label 1
    weight: np.ndarray  # (labelled,), documents that a sampled one stands for


def _describe(word: bytes) -> tuple[int, int]:
    """Word term and shape term of a word."""
    core = word.strip(b".,;:!?").lower()
    shape = (
        word.isupper(),
        word[-1:] in b".,;:!?",
        word[-2:] == b"!!",
        word.isascii(),
        bool(_SYMBOLS.intersection(word)),
        any(48 <= b < 58 for b in word),
        min(len(word), 12) // 3,
    )
    return (
        SHAPE_TERMS + zlib.crc32(core) % (TERMS - SHAPE_TERMS),
        zlib.crc32(repr(shape).encode()) % _REPEAT,
    )


def term_counts(texts: list[str | None], table: WordTable) -> np.ndarray:
    """Counts of the hashed terms, one row per text."""
    words = [split_words(t) for t in texts]
    lengths = np.array([len(w) for w in words])
    ids = np.fromiter(map(table.__getitem__, chain.from_iterable(words)), np.int64, int(lengths.sum()))
    described = table.columns()
    owner = np.repeat(np.arange(len(texts)), lengths)
    repeats = np.zeros(len(ids), bool)
    repeats[1:] = (ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1])
    cells = np.concatenate(
        [owner * TERMS + described[ids, 0], owner * TERMS + described[ids, 1], owner[repeats] * TERMS + _REPEAT]
    )
    counts = np.bincount(cells, minlength=len(texts) * TERMS).reshape(len(texts), TERMS).astype(np.float32)
    for at, rate in enumerate(REPEAT_RATES, _REPEAT + 1):
        counts[:, at] = np.where(counts[:, _REPEAT] > rate * lengths, lengths, 0)
    table.trim()
    return counts


def _sparse_terms():
    table = WordTable(_describe, 2)

    def block(texts):
        counts = term_counts(texts, table)
        found = [np.nonzero(row)[0].astype(np.int32) for row in counts]
        return [f.tobytes() for f in found], [row[f].tobytes() for row, f in zip(counts, found)]

    return block


def fit(documents: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on a sample of the labelled documents; ``None`` if no document has a label.

    ``documents`` has ``doc_id`` and ``text``, ``labels`` has ``doc_id`` and ``quality``. For each label
    the ``SAMPLE_PER_LABEL`` documents with the smallest hash of their id are taken, so the sample does
    not depend on the order of rows. Only term counts of the sample reach the driver, at most ``TERMS``
    pairs for each document.
    """
    marked = (
        labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("quality"))
    )
    # Ids are chosen before any text is moved; stored, as they are read for each label.
    ids = materialize(documents.select("doc_id").join(marked, "doc_id").distinct())
    n_of = {r["quality"]: r["count"] for r in ids.groupBy("quality").count().collect()}
    order = F.xxhash64(F.col("doc_id").cast("string"))
    sample = None
    for value in sorted(n_of):
        part = ids.filter(F.col("quality") == value).orderBy(order, "doc_id").limit(SAMPLE_PER_LABEL)
        sample = part if sample is None else sample.unionByName(part)
    if sample is None:
        return None
    chosen = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])
    counted = with_columns(
        chosen,
        ["text"],
        _sparse_terms,
        [
            ("terms", T.BinaryType(), pa.binary()),
            ("counts", T.BinaryType(), pa.binary()),
        ],
        keep=["doc_id", "quality"],
    )
    rows = sorted(counted.collect(), key=lambda r: r["doc_id"])
    quality = np.array([r["quality"] for r in rows])
    counts = np.zeros((len(rows), TERMS), np.float32)
    for at in reversed(range(len(rows))):  # a row is let go as soon as it is copied
        row = rows.pop()
        counts[at, np.frombuffer(row["terms"], np.int32)] = np.frombuffer(row["counts"], np.float32)
    return _decompose(counts, quality, n_of)


def _decompose(counts: np.ndarray, quality: np.ndarray, n_of: dict[int, int]) -> Model:
    seen = np.count_nonzero(counts, axis=0)
    weighted = np.log1p(counts, out=counts)  # in place, as the driver may be small
    idf = (np.log((len(counts) + 1) / (seen + 1)) + 0.1).astype(np.float32)
    weighted *= idf
    weighted /= np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-9)
    right = _right_vectors(weighted)
    # Each class votes with its real size, although the sample may hold them in other proportions.
    stands_for = {q: n / max(1, int((quality == q).sum())) for q, n in n_of.items()}
    weight = np.array([stands_for[int(q)] for q in quality], np.float32)
    return Model(idf[:, None] * right, _unit(weighted @ right), quality.astype(np.float32), weight / weight.mean())


def _right_vectors(rows: np.ndarray) -> np.ndarray:
    """The first ``RANK`` right singular vectors, by subspace iteration: no square matrix of rows or terms is held."""
    width = min(2 * RANK, *rows.shape)
    basis = np.random.default_rng(0).standard_normal((rows.shape[1], width)).astype(np.float32)
    for _ in range(ITERATIONS):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0].astype(np.float32)
    _, values, turn = np.linalg.svd(rows @ basis, full_matrices=False)
    rank = min(RANK, int((values > np.sqrt(1e-5) * max(values[0], 1e-6)).sum())) if len(values) else 0
    return basis @ turn[:rank].T.astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.where(norms > 1e-9, rows / np.maximum(norms, 1e-9), 0).astype(np.float32)


def vote(model: Model, counts: np.ndarray) -> np.ndarray:
    """Scores of a block of documents from its term counts."""
    vectors = _unit(np.log1p(counts) @ model.projection)
    cosines = vectors @ model.vectors.T
    k = min(NEIGHBOURS, cosines.shape[1])
    nearest = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    pull = np.maximum(np.take_along_axis(cosines, nearest, 1), 0).astype(np.float64) * model.weight[nearest]
    total = pull.sum(1)
    prior = float((model.good * model.weight).sum() / model.weight.sum())
    return np.where(total > 1e-9, (pull * model.good[nearest]).sum(1) / np.maximum(total, 1e-9), prior)


def classify(documents: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """Add ``score`` (double) and ``predicted`` (int, 1 from ``THRESHOLD`` on) to every document."""
    if model is None:
        kept = documents if keep is None else documents.select(*keep)
        return kept.withColumns({"score": F.lit(1.0), "predicted": F.lit(1)})
    shared = documents.sparkSession.sparkContext.broadcast((model.projection, model.vectors, model.good, model.weight))

    def make():
        table = WordTable(_describe, 2)
        fitted = Model(*shared.value)

        def block(texts):
            scores = vote(fitted, term_counts(texts, table))
            return scores, (scores >= THRESHOLD).astype(np.int32)

        return block

    adds = [("score", T.DoubleType(), pa.float64()), ("predicted", T.IntegerType(), pa.int32())]
    return with_columns(documents, ["text"], make, adds, keep)


def keep_good(documents: DataFrame, model: Model | None) -> DataFrame:
    """The documents with a score of at least ``THRESHOLD``, with their columns as they are."""
    if model is None:
        return documents
    shared = documents.sparkSession.sparkContext.broadcast((model.projection, model.vectors, model.good, model.weight))

    def make():
        table = WordTable(_describe, 2)
        fitted = Model(*shared.value)
        return lambda texts: vote(fitted, term_counts(texts, table)) >= THRESHOLD

    return keep_rows(documents, ["text"], make)


def held_out(doc_id: str = "doc_id"):
    """Documents whose labels are never used for the fit."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train_and_classify(documents: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Fit on labels of documents that are not held out, then classify every document."""
    return classify(documents, fit(documents, labels.filter(~held_out())), keep)
