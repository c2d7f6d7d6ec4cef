"""Mixing to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Documents are first summed into cells (source, language, topic). The cell weights are raked until their
sums over each source, each language and each topic meet the targets: in a sweep, each dimension in turn
multiplies its cells by target / sum. A document is then kept with the probability that belongs to its
cell, scaled so that the expected tokens are ``KEEP_SHARE`` of those in cells that the targets allow; probabilities that would exceed 1 are
set to 1 and the rest is scaled again. The decision compares a hash of the document with the probability.

All sums are Spark aggregates over cells; nothing but convergence figures reaches the driver. Each step of a
sweep is stored, so plans stay small: a step uses its cells twice, and three steps in one plan would use them
eight times, of which the driver keeps all figures.

Defined cases: null source, language or topic is a value of its own, written ``(none)``; null or blank text
has no tokens and weighs one token, so that it can be sampled; a target given for an absent value is
ignored, an absent target is zero and drops the documents; targets are scaled to one sum. Raking ends when
the margins meet their targets, or when a further sweep moves no weight: where absent cells make the targets
unreachable, the last dimension is then met, and ``error`` tells how far the others are off. Very long texts
are measured by expressions and stay in their row. Repeated rows have one hash and share one decision; an
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.arrow import fresh
from stockloom.operators.scans import materialize

#: Share of the tokens in allowed cells that the sample is expected to hold.
KEEP_SHARE = 0.5
#: Raking ends at this largest relative error of a margin.
TOLERANCE = 1e-6
#: It also ends when a sweep moves at most this share of the weight: the margins then stay as they are.
STILL = 1e-9
#: Exponent that evens out shares where no targets are given; 1 keeps them, 0 makes them equal.
EVENNESS = 0.7
DIMENSIONS = ("source", "lang", "topic")
_NONE = "(none)"


def tokens(text: Column) -> Column:
    """Words of a text, at least 1: its weight in the mixture."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    # A word starts where white space or the start of the text is followed by something else.
    squeezed = F.regexp_count(flat, F.lit("[^ ]+"))
    return F.greatest(squeezed, F.lit(1)).cast("bigint")


def topic(text: Column) -> Column:
    """Kind of text, from its signs: the tables name no topic."""
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda signs: (F.length(text) - F.length(F.translate(text, signs, ""))) / size
    return (
        F.when(text.isNull() | (F.length(text) == 0), _NONE)
        .when(share("|") > 0.02, "tables")
        .when(share("0123456789") > 0.05, "numbers")
        .when(F.length(text) < 600, "notes")
        .when(F.length(text) < 4000, "articles")
        .otherwise("long reads")
    )


def smoothed_targets(cells: DataFrame, dimension: str) -> DataFrame:
    """``value``, ``target``: token shares raised to ``EVENNESS``."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("base").alias("s"))
    return sums.select("value", F.pow("s", F.lit(EVENNESS)).alias("target"))


def cell_keys() -> dict[str, Column]:
    """The dimensions of a document as expressions of its columns."""
    return {
        "source": F.coalesce(F.col("source").cast("string"), F.lit(_NONE)),
        "lang": F.coalesce(F.col("lang").cast("string"), F.lit(_NONE)),
        "topic": topic(F.col("text")),
    }


def cell_sums(documents: DataFrame) -> DataFrame:
    """Tokens of each cell, as ``base``."""
    weighed = documents.select(*[c.alias(d) for d, c in cell_keys().items()], tokens(F.col("text")).alias("n"))
    return weighed.groupBy(*DIMENSIONS).agg(F.sum("n").cast("double").alias("base"))


def rake(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """Add ``weight``: cell weights that sum to 1 and meet the targets of each dimension, and ``error``.

    ``error`` is the largest relative error that is left in a margin, the same in all rows.

    ``cells`` has the dimensions and ``base`` (positive) and should be stored. ``targets`` maps each
    dimension to ``value``, ``target`` (shares of any sum; values are unique).
    """
    goals = {}
    for d in DIMENSIONS:
        present = cells.select(F.col(d).alias("value")).distinct()
        reached = materialize(targets[d].join(present, "value", "left_semi").filter("target > 0").select("value", "target"))
        # One row; it scales the targets to the sum 1.
        scale = reached.agg(F.sum("target").alias("total")).collect()[0]["total"] or 1.0
        goals[d] = reached.select("value", (F.col("target") / F.lit(scale)).alias("goal"))
    # Cells that a zero target forbids go at once.
    allowed = reduce(
        lambda df, d: df.join(goals[d].select(F.col("value").alias(d)), d, "left_semi"), DIMENSIONS, cells
    )
    raked = materialize(allowed.withColumn("weight", F.col("base")))
    margins = DIMENSIONS[:-1]  # the last one has just been met at the end of a sweep
    goal = materialize(reduce(DataFrame.unionByName, [goals[d].withColumn("dimension", F.lit(d)) for d in margins]))
    while True:
        swept = raked.withColumn("_before", F.col("weight"))
        for d in DIMENSIONS:
            swept = materialize(_meet(swept, d, goals[d]))
        error, moved = _figures(swept, goal, margins)
        raked = swept.drop("_before")
        if error is None or error <= TOLERANCE or moved <= STILL:
            return raked.withColumn("error", F.lit(error or 0.0))


def _figures(swept: DataFrame, goal: DataFrame, margins: Sequence[str]) -> tuple[float | None, float | None]:
    """The largest relative error of the margins (``dimension``, ``value``, ``goal``), and the weight that has moved."""
    part = lambda name, value, x: F.struct(F.lit(name).alias("dimension"), value.alias("value"), x.alias("x"))
    shift = part("", F.lit(None).cast("string"), F.abs(F.col("weight") - F.col("_before")))
    parts = F.array(*[part(d, F.col(d), F.col("weight")) for d in margins], shift)
    sums = swept.select(F.inline(parts)).groupBy("dimension", "value").agg(F.sum("x").alias("s"))
    met = sums.join(goal, ["dimension", "value"], "left")
    moved = F.max(F.when(F.col("dimension") == "", F.col("s")))
    return tuple(met.agg(F.max(F.abs(F.col("s") / F.col("goal") - 1)), moved).collect()[0])


def _meet(cells: DataFrame, dimension: str, goal: DataFrame) -> DataFrame:
    factor = (
        cells.groupBy(dimension)
        .agg(F.sum("weight").alias("s"))
        .join(goal.withColumnRenamed("value", dimension), dimension)
        .select(dimension, (F.col("goal") / F.col("s")).alias("factor"))
    )
    return cells.join(factor, dimension).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")


def calibrate(raked: DataFrame, keep_share: float = KEEP_SHARE) -> DataFrame:
    """Add ``probability``: weight / base scaled so that the expected tokens are ``keep_share`` of the base.

    ``raked`` should be stored. Probabilities are at most 1; what they lose by that goes to the others.
    """
    wanted = keep_share * (raked.agg(F.sum("base")).collect()[0][0] or 0.0)
    ratio = F.col("weight") / F.col("base")
    scale = wanted
    while True:  # each round but the last sets the probability of a further cell to 1
        full = ratio * F.lit(scale) >= 1
        sums = raked.agg(
            F.sum(F.when(full, F.col("base"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("rest")
        ).collect()[0]
        if not sums["full"] or not sums["rest"] or sums["full"] >= wanted:
            break
        better = (wanted - sums["full"]) / sums["rest"]
        if better <= scale * (1 + 1e-9):
            break
        scale = better
    return raked.withColumn("probability", F.least(F.lit(1.0), ratio * F.lit(scale)))


def probabilities(documents: DataFrame, targets: dict[str, DataFrame] | None = None, keep_share: float = KEEP_SHARE) -> DataFrame:
    """``source``, ``lang``, ``topic``, ``base``, ``weight``, ``error``, ``probability`` of each cell, stored."""
    cells = materialize(cell_sums(documents))
    given = targets or {}
    goals = {d: given[d] if d in given else smoothed_targets(cells, d) for d in DIMENSIONS}
    return materialize(calibrate(rake(cells, goals), keep_share))


def draw(seed: int = 0) -> Column:
    """Number from 0 to below 1 that depends on a document's id and text only."""
    mixed = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    return F.shiftrightunsigned(mixed, 11) / F.lit(float(1 << 53))


def sample(documents: DataFrame, cells: DataFrame, seed: int = 0) -> DataFrame:
    """All documents with ``source``, ``lang``, ``topic``, ``tokens``, ``probability`` and ``kept``, without text.

    ``margin_error`` is the error that raking left, null for documents of forbidden cells.
    """
    weighed = documents.select(
        "doc_id", *[c.alias(d) for d, c in cell_keys().items()], tokens(F.col("text")).alias("tokens"), draw(seed).alias("draw")
    )
    joined = weighed.join(cells.select(*DIMENSIONS, "probability", F.col("error").alias("margin_error")), list(DIMENSIONS), "left")
    probability = F.coalesce("probability", F.lit(0.0))
    kept = (F.col("draw") < probability).alias("kept")
    return joined.select("doc_id", *DIMENSIONS, "tokens", probability.alias("probability"), kept, "margin_error")


def mix(documents: DataFrame, targets: dict[str, DataFrame] | None = None, seed: int = 0) -> DataFrame:
    """The sampled documents, with their columns as they are."""
    names = {d: fresh(documents, f"_{d}") for d in (*DIMENSIONS, "probability")}
    cells = probabilities(documents, targets).select(*[F.col(d).alias(n) for d, n in names.items()])
    keyed = documents.withColumns({names[d]: c for d, c in cell_keys().items()})
    joined = keyed.join(cells, [names[d] for d in DIMENSIONS])
    return joined.filter(draw(seed) < F.col(names["probability"])).select(*documents.columns)
