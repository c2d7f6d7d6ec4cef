"""Quality rules: counting rules, and a line-wise conditional random field that marks boilerplate.

Every line of a text is described by a few numbers; a linear-chain conditional random field with the
states boilerplate and content is decoded by the Viterbi algorithm, and a document is kept if at least
``MIN_CONTENT`` of its words stand in content lines. The field is trained on a bounded sample of chunks
of consecutive lines of labelled documents: all lines of a document have the state of its label, and the
likelihood of the sample is maximised. Without labels fixed prior weights are used.

Defined cases: null text has no words, fails the base rules and is not kept; a line without words is
content (it holds no boilerplate) and has no weight in the share; all rows are judged on their own, so
ties, repeated rows and extra columns change nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.llm.arrow import WordTable, keep_rows, split_words, with_columns
from stockloom.operators.scans import materialize

#: Share of words in content lines from which a document is kept.
MIN_CONTENT = 0.5
#: Base rules: fewest words, and the highest percentage of words in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
#: Bound of the training sample: documents for each label, chunks of lines, and lines in a chunk.
SAMPLE_PER_LABEL, SAMPLE_CHUNKS, CHUNK_LINES = 1_000, 4_000, 48

FEATURES = (
    "bias", "length", "short", "symbols", "upper", "digits", "repeats", "pipes", "shouts", "symbol_ends", "ends", "seen", "variety",
)
#: Weights that favour boilerplate for symbols, shouting, repeats and seen lines; used where nothing is labelled.
PRIOR_EMISSION = np.array([3.0, 0.5, -0.5, -8.0, -6.0, -2.0, -6.0, -8.0, -6.0, -6.0, 0.5, -1.0, 1.0])
PRIOR_TRANSITION = np.array([[0.5, -0.5], [-0.5, 0.5]])


@dataclass(frozen=True)
class Field:
    """Scores of content against boilerplate for each feature, and of moves between the two states."""

    emission: np.ndarray
    transition: np.ndarray


PRIOR = Field(PRIOR_EMISSION, PRIOR_TRANSITION)


def line_features(text: str | None) -> tuple[np.ndarray, list[int], int, list[bytes]]:
    """Features and word counts of the lines, how many lines with a word repeat an earlier one, and all words."""
    rows, sizes, repeated, seen, all_words = [], [], 0, set(), []
    for line in (text or "").split("\n"):
        words = split_words(line)
        n = len(words)
        sizes.append(n)
        all_words += words
        if not n:
            rows.append((1.0, *[0.0] * (len(FEATURES) - 1)))
            continue
        again = line in seen
        seen.add(line)
        repeated += again
        size = len(line)
        pipes, shouts = line.count("|"), line.count("!!")
        symbols = sum(map(line.count, SYMBOLS))
        upper = sum(map(bytes.isupper, words))
        ends = sum(w[-1] in b"#*$%&" for w in words) if symbols else 0
        distinct = len(set(words))
        same = sum(map(bytes.__eq__, words, words[1:])) if distinct < n else 0
        digits = sum(map(line.count, "0123456789"))
        rows.append(
            (
                1.0, min(n, 64) / 32, float(n < 4), min(1.0, 4 * symbols / size), upper / n, digits / size, same / n,
                min(1.0, 2 * pipes / n), min(1.0, shouts / n), ends / n, float(words[-1][-1] in b".!?"), float(again), distinct / n,
            )
        )
    return np.array(rows), sizes, repeated, all_words


def viterbi(scores: np.ndarray, transition: np.ndarray) -> list[int]:
    """Best states (1: content); ``scores`` are those of content, boilerplate scores 0. Ties go to content."""
    (bb, bc), (cb, cc) = transition.tolist()
    b, c, from_b, from_c = 0.0, float(scores[0]), [], []
    for s in scores[1:].tolist():
        to_b, to_c = b + bb > c + cb, b + bc > c + cc  # True: came from boilerplate
        from_b.append(to_b)
        from_c.append(to_c)
        b, c = (b + bb if to_b else c + cb), (b + bc if to_c else c + cc) + s
    state = 1 if c >= b else 0
    states = [state]
    for to_b, to_c in zip(reversed(from_b), reversed(from_c)):
        state = 0 if (to_c if state else to_b) else 1
        states.append(state)
    return states[::-1]


def repeated_words(ids: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Words of each text inside windows of ``WINDOW`` words that occur twice or more in that text."""
    covered = np.zeros(texts, np.int64)
    n = len(ids) - WINDOW + 1
    if n < 2:
        return covered
    # Ranks of pairs, then of four words, then of five; each rank stands for equal words.
    two = np.unique((ids[:-1] << 32) | ids[1:], return_inverse=True)[1].astype(np.int64)
    four = np.unique((two[:-2] << 32) | two[2:], return_inverse=True)[1].astype(np.int64)
    five = np.unique((four[:n] << 32) | ids[WINDOW - 1 :], return_inverse=True)[1].astype(np.int64)
    inside = np.nonzero(owner[:n] == owner[WINDOW - 1 :])[0]
    _, place, times = np.unique(five[inside] * texts + owner[inside], return_inverse=True, return_counts=True)
    starts = inside[times[place] > 1]
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    hit = np.cumsum(edges[:-1]) > 0
    np.add.at(covered, owner[hit], 1)
    return covered


def _rules(field: Field):
    table = WordTable(lambda word: (0,), 1)

    def block(texts):
        lines = [line_features(t) for t in texts]
        n_words = np.array([sum(sizes) for _, sizes, _, _ in lines], np.int64)
        ids = np.fromiter((table[w] for *_, words in lines for w in words), np.int64, int(n_words.sum()))
        table.trim()
        repeats = repeated_words(ids, np.repeat(np.arange(len(texts)), n_words), len(texts))
        chars, symbols, dups, shares, marks = [], [], [], [], []
        for text, (features, sizes, repeated, _) in zip(texts, lines):
            text = text or ""
            chars.append(len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")))
            symbols.append(sum(map(text.count, SYMBOLS)))
            dups.append(repeated)
            states = viterbi(features @ field.emission, field.transition)
            states = [1 if n == 0 else s for s, n in zip(states, sizes)]
            total = sum(sizes)
            shares.append(sum(n for n, s in zip(sizes, states) if s) / total if total else 0.0)
            marks.append([i for i, s in enumerate(states) if not s])
        failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)
        kept = ~failed & (np.array(shares) >= MIN_CONTENT)
        return n_words, chars, symbols, dups, repeats, failed, kept, shares, marks

    return block


def apply_rules(documents: DataFrame, field: Field, keep: list[str] | None = None) -> DataFrame:
    """Add the base counts, ``base_failed``, ``kept``, ``content_share`` and ``boilerplate_lines`` (0-based)."""
    long, flag = (T.LongType(), pa.int64()), (T.BooleanType(), pa.bool_())
    adds = [
        ("n_words", *long),
        ("word_chars", *long),
        ("n_symbols", *long),
        ("n_dup_lines", *long),
        ("n_repeat_words", *long),
        ("base_failed", *flag),
        ("kept", *flag),
        ("content_share", T.DoubleType(), pa.float64()),
        ("boilerplate_lines", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    ]
    return with_columns(documents, ["text"], lambda: _rules(field), adds, keep)


def filter_documents(documents: DataFrame, field: Field) -> DataFrame:
    """The documents that are kept, with their columns as they are."""

    def make():
        rules = _rules(field)
        return lambda texts: rules(texts)[6]

    return keep_rows(documents, ["text"], make)


def train(documents: DataFrame, labels: DataFrame) -> Field:
    """Fit the field on a bounded sample of chunks of labelled documents, see the constants above."""
    marked = (
        labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("quality"))
    )
    # Stored, as they are read for each label.
    ids = materialize(documents.select("doc_id").join(marked, "doc_id").distinct())
    order = F.xxhash64(F.col("doc_id").cast("string"))
    parts = [ids.filter(F.col("quality") == q).orderBy(order, "doc_id").limit(SAMPLE_PER_LABEL) for q in (0, 1)]
    sample = parts[0].unionByName(parts[1])
    chosen = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])

    def make():
        def block(texts):
            out = []
            for text in texts:
                rows, sizes, _, _ = line_features(text)
                rows = rows[np.array(sizes) > 0]
                out.append([rows[i : i + CHUNK_LINES].ravel().tolist() for i in range(0, len(rows), CHUNK_LINES)])
            return [out]

        return block

    kind = T.ArrayType(T.ArrayType(T.DoubleType()))
    adds = [("chunks", kind, pa.list_(pa.list_(pa.float64())))]
    chunks = (
        with_columns(chosen, ["text"], make, adds, keep=["doc_id", "quality"])
        .select("doc_id", "quality", F.posexplode("chunks").alias("at", "chunk"))
        .orderBy(F.xxhash64(F.col("doc_id").cast("string"), "at"), "doc_id", "at")
        .limit(SAMPLE_CHUNKS)
        .collect()
    )
    if len({r["quality"] for r in chunks}) < 2:
        return PRIOR
    return _maximise([np.array(r["chunk"]).reshape(-1, len(FEATURES)) for r in chunks], [r["quality"] for r in chunks])


def _maximise(chunks: list[np.ndarray], states: list[int], rounds: int = 150, decay: float = 1e-3) -> Field:
    """Ascend the mean log-likelihood of the chunks' states, by steps of adaptive size."""
    longest = max(map(len, chunks))
    x = np.zeros((longest, len(chunks), len(FEATURES)))
    present = np.zeros((longest, len(chunks)), bool)
    for i, chunk in enumerate(chunks):
        x[: len(chunk), i], present[: len(chunk), i] = chunk, True
    y = np.array(states)
    # Moves that never change state are all that the sample shows; the prior keeps changes possible.
    weights = np.concatenate([PRIOR_EMISSION, PRIOR_TRANSITION.ravel()])
    start = weights.copy()
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    n_lines = present.sum()
    truth = np.concatenate(
        [
            (x[present] * np.broadcast_to(y, present.shape)[present][:, None]).sum(0),
            [((y == s) * (present.sum(0) - 1)).sum() if s == t else 0.0 for s in (0, 1) for t in (0, 1)],
        ]
    )
    for step in range(1, rounds + 1):
        expected = _expectations(x, present, weights[: len(FEATURES)], weights[len(FEATURES) :].reshape(2, 2))
        slope = (truth - expected) / n_lines - decay * (weights - start)
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        weights = weights + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    transition = np.clip(weights[len(FEATURES) :].reshape(2, 2), -2, 2)
    return Field(weights[: len(FEATURES)], transition)


def _expectations(x: np.ndarray, present: np.ndarray, emission: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Expected feature and move counts under the field: forward and backward passes over all chunks at once."""
    steps, n, _ = x.shape
    scores = np.stack([np.zeros((steps, n)), x @ emission], axis=2)
    forward, backward = np.zeros((steps, n, 2)), np.zeros((steps, n, 2))
    forward[0] = scores[0]
    for t in range(1, steps):
        into = np.logaddexp(forward[t - 1, :, :1] + transition[0], forward[t - 1, :, 1:] + transition[1]) + scores[t]
        forward[t] = np.where(present[t, :, None], into, forward[t - 1])
    for t in range(steps - 2, -1, -1):
        ahead = scores[t + 1] + backward[t + 1]
        back = np.logaddexp(ahead[:, :1] + transition[:, 0], ahead[:, 1:] + transition[:, 1])
        backward[t] = np.where(present[t + 1, :, None], back, 0)
    total = np.logaddexp(forward[-1, :, 0], forward[-1, :, 1])
    content = np.exp(forward[:, :, 1] + backward[:, :, 1] - total) * present
    moves = np.zeros((2, 2))
    both = present[1:]
    for s in (0, 1):
        for t in (0, 1):
            joint = forward[:-1, :, s] + transition[s, t] + scores[1:, :, t] + backward[1:, :, t] - total
            moves[s, t] = np.exp(joint[both]).sum()
    return np.concatenate([(x * content[:, :, None]).sum((0, 1)), moves.ravel()])
