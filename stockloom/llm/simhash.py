"""SimHash near-duplicates by the generalised pigeonhole principle, and their connected components.

Fingerprints have ``BITS`` bits. If the bits are cut into parts with thresholds t_i that add up to
``distance - parts + 1``, two fingerprints within ``distance`` differ in at most t_i bits of some part
i (a part of threshold -1 is never probed). Correlated bits go into the same part. The number of parts
and their thresholds are those with the lowest estimated cost: a dynamic programme over the parts on
estimated candidate counts, which come from statistics over all distinct fingerprints. Any
choice finds every link; the estimate decides cost only.

A fingerprint probes the variants of each part within its threshold; candidates are verified by the
number of differing bits. In a crowded bucket (over ``CROWD`` fingerprints) candidates are not paired:
two fingerprints differ in at most two bits just when they share a centre, that is a bit string that
differs from each in at most one bit. Fingerprints that meet a crowded bucket name all their
centres and link to the smallest fingerprint at each: as many rows as ``BITS`` + 1 for each, no pairs,
and no link is lost. (For ``distance`` above two, centres hold as many changed bits as half of it.)

Defined cases: a text without words, or null, has fingerprint zero and is linked like any other; a text
of fewer than ``SHINGLE`` words is one shingle; null ids never are a component's id unless a component
has no other; repeated rows and extra columns are kept. De-duplication decides by id and fingerprint,
so one id may stand for several unlike texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.llm.arrow import fresh, split_words, with_columns
from stockloom.llm.components import connected_components
from stockloom.operators.scans import materialize

BITS, SHINGLE, SEED, DISTANCE = 64, 3, 42, 2
#: Fingerprints in a bucket from which they are linked through centres instead of pairs.
CROWD = 32
#: Shingles whose bits are counted at once.
_CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """SimHash of the hashed word shingles, repeats included; bit k is 1 if over half of them have it."""
    words = [w.lower() for w in split_words(text)]  # of bytes, so A-Z only
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*[words[i:] for i in range(SHINGLE)])))
    return majority(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles)))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; 0 if there are none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    set_bits = np.nonzero(2 * ones > len(hashes))[0].tolist()
    return sum(1 << b for b in set_bits)


def with_fingerprint(documents: DataFrame, keep: list[str] | None = None, name: str = "fp") -> DataFrame:
    """Add ``fp`` (bigint, the fingerprint as a signed number)."""

    def make():
        return lambda texts: [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]

    return with_columns(documents, ["text"], make, [(name, T.LongType(), pa.int64())], keep)


@dataclass(frozen=True)
class Plan:
    """Bit masks of the parts and the threshold of each; -1: not probed."""

    masks: tuple[int, ...]
    thresholds: tuple[int, ...]


def plan_probes(fingerprints: DataFrame, distance: int = DISTANCE) -> Plan:
    """Choose parts and thresholds from statistics of all distinct fingerprints (column ``fp``).

    Only the number of fingerprints and their 64 x 64 counts of bits set together reach the driver.
    """
    n, together = bit_statistics(fingerprints)
    return min((_allocate(n, together, m, distance) for m in range(1, distance + 2)), key=lambda x: x[0])[1]


def bit_statistics(fingerprints: DataFrame) -> tuple[int, np.ndarray]:
    def count(batches):
        n, sums = 0, np.zeros((BITS, BITS))
        for batch in batches:
            values = np.array(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            for at in range(0, len(values), _CHUNK):
                part = np.ascontiguousarray(values[at : at + _CHUNK])
                bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                bits = bits.astype(np.float32)
                sums += bits.T @ bits
                n += len(part)
        yield pa.RecordBatch.from_pydict({"n": [n], "sums": [sums.ravel().tolist()]})

    parts = fingerprints.select("fp").mapInArrow(count, "n bigint, sums array<double>")
    # One row for each task; added up by position before anything reaches the driver.
    total = parts.select("n", F.posexplode("sums").alias("at", "x")).groupBy("at").agg(
        F.sum("x").alias("x"), F.sum("n").alias("n")
    )
    rows = total.collect()
    sums = np.zeros(BITS * BITS)
    for r in rows:
        sums[r["at"]] = r["x"]
    return (int(rows[0]["n"]) if rows else 0), sums.reshape(BITS, BITS)


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Cut the bits into parts of equal size; each part takes the bits most correlated with those it has."""
    share = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    correlation = np.abs((together / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    left, groups = set(range(BITS)), []
    for part in range(parts):
        size = BITS // parts + (part < BITS % parts)
        # The bit least tied to the others starts the first part, so that ties stay together later.
        group = [max(left, key=lambda b: (correlation[b, list(left)].sum(), -b))]
        left.discard(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (correlation[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def _allocate(n: int, together: np.ndarray, parts: int, distance: int) -> tuple[float, Plan]:
    """Lowest estimated cost with so many parts, and the plan that has it."""
    share = np.diag(together) / max(n, 1)
    agree = share**2 + (1 - share) ** 2
    groups = group_bits(n, together, parts)
    cost = []
    for group in groups:
        # Distribution of the number of differing bits of two fingerprints, bit by bit.
        differ = np.zeros(distance + 1)
        differ[0] = 1.0
        for b in group:
            differ = agree[b] * differ + (1 - agree[b]) * np.concatenate([[0.0], differ[:-1]])
        variants = [sum(len(list(combinations(group, k))) for k in range(t + 1)) for t in range(distance + 1)]
        # Rows that are dealt out for the index and the probes, then candidates.
        cost.append([0.0] + [n * (1 + variants[t]) + n * n * float(differ[: t + 1].sum()) for t in range(distance + 1)])
    wanted = distance - parts + 1
    # best[sum of thresholds so far] = (cost, thresholds)
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for part in range(parts):
        following: dict[int, tuple[float, tuple[int, ...]]] = {}
        for total, (so_far, chosen) in best.items():
            for t in range(-1, distance + 1):
                option = (so_far + cost[part][t + 1], (*chosen, t))
                if total + t not in following or option < following[total + t]:
                    following[total + t] = option
        best = following
    value, thresholds = best[wanted]
    masks = tuple(sum(1 << b for b in group) for group in groups)
    return value, Plan(masks, thresholds)


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _flips(bits: list[int], most: int) -> list[int]:
    """All ways to change at most ``most`` of the bits, as signed masks; no change comes first."""
    return [_signed(sum(1 << b for b in c)) for k in range(most + 1) for c in combinations(bits, k)]


def _exploded(fp: Column, masks: list[int]) -> Column:
    return F.explode(F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]), lambda m: fp.bitwiseXOR(m)))


def links(fingerprints: DataFrame, plan: Plan, distance: int = DISTANCE) -> DataFrame:
    """Edges ``a``, ``b`` (bigint) whose connected components are those of all pairs within ``distance``.

    ``fingerprints`` has distinct values of ``fp``. Each edge joins fingerprints that are linked.
    """
    index, probes = [], []
    for part, (mask, threshold) in enumerate(zip(plan.masks, plan.thresholds)):
        if threshold < 0:
            continue
        bits = [b for b in range(BITS) if mask >> b & 1]
        key = F.col("fp").bitwiseAND(F.lit(_signed(mask)).cast("bigint"))
        index.append(fingerprints.select(F.lit(part).alias("part"), key.alias("key"), "fp"))
        probes.append(
            fingerprints.select(
                F.lit(part).alias("part"), "fp", _exploded(key, _flips(bits, threshold)).alias("key")
            )
        )
    if not index:
        return fingerprints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    indexed = reduce(DataFrame.unionByName, index)
    probing = reduce(DataFrame.unionByName, probes).select("part", "key", F.col("fp").alias("probe"))
    crowded = materialize(
        indexed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("part", "key")
    )
    quiet = indexed.join(crowded, ["part", "key"], "left_anti")
    pairs = (
        quiet.join(probing, ["part", "key"])
        .filter((F.col("fp") < F.col("probe")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("probe"))) <= distance))
        .select(F.col("fp").alias("a"), F.col("probe").alias("b"))
    )
    # Stored, as it is read twice: the plan would hold all probes three times.
    meeting = materialize(
        probing.join(crowded, ["part", "key"], "left_semi").select(F.col("probe").alias("fp")).distinct()
    )
    # Within half the distance of a common centre is within the distance; for an odd distance the
    # remaining bit is changed on one side, so the centre of a pair is a centre of one with that bit.
    every = list(range(BITS))
    centred = meeting.select("fp", _exploded(F.col("fp"), _flips(every, distance // 2)).alias("centre"))
    if distance % 2:
        raise ValueError("links through centres need an even distance")
    smallest = centred.groupBy("centre").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    through = centred.join(smallest, "centre").filter("fp != a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(through).distinct()


def near_duplicates(fingerprinted: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``fp``, ``component_id`` (smallest ``doc_id`` reachable) for each distinct fingerprint.

    ``fingerprinted`` has ``doc_id`` and ``fp`` and should be stored, as it is read more than once.
    """
    joined = _components(fingerprinted, distance)
    ids = joined.groupBy("component").agg(F.min("own_id").alias("component_id"))
    return joined.join(ids, "component").select("fp", "component_id")


def _components(fingerprinted: DataFrame, distance: int) -> DataFrame:
    """``fp``, ``own_id``, ``component`` for each distinct fingerprint."""
    own = materialize(fingerprinted.groupBy("fp").agg(F.min("doc_id").alias("own_id")))
    values = own.select("fp")
    found = connected_components(materialize(links(values, plan_probes(values, distance), distance)))
    joined = own.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    return materialize(joined)


def deduplicate(documents: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Keep one document of each component, as :func:`keep_first` says."""
    fingerprinted = materialize(with_fingerprint(documents, keep=["doc_id"]))
    components = _components(fingerprinted, distance).select("fp", "component")
    return keep_first(documents, fingerprinted, components, lambda d, name: with_fingerprint(d, name=name))


def keep_first(
    documents: DataFrame, marked: DataFrame, components: DataFrame, mark: Callable[[DataFrame, str], DataFrame]
) -> DataFrame:
    """Keep one document of each component: the smallest (``doc_id``, ``fp``), null ids last.

    ``marked`` has ``doc_id`` and ``fp`` of all documents, ``components`` the ``component`` of each ``fp``; both
    are stored. ``mark`` adds ``fp`` to documents under a given name. An id may stand for unlike texts: each
    of them stays or goes by its own component. Of rows equal in id and ``fp``, the one whose JSON has the
    smallest SHA-256 stays.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fp"))
    kept = marked.join(components, "fp").groupBy("component").agg(first.alias("k"))
    kept = materialize(kept.select("k.doc_id", "k.fp").withColumn("stays", F.lit(True)))
    # Few documents go, so their ids are the smaller side to compare all documents with.
    named = marked.filter("doc_id IS NOT NULL")
    judged = named.join(kept.filter("doc_id IS NOT NULL"), ["doc_id", "fp"], "left")
    ids = judged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count("stays").alias("n_stay"))
    ids = materialize(ids.filter("n > 1 OR n_stay = 0").select("doc_id", F.col("n_stay").alias("_n_stay")))
    single = documents.filter("doc_id IS NOT NULL").join(ids.select("doc_id"), "doc_id", "left_anti").select(*documents.columns)
    # Ids of several rows, and rows without id, are decided row by row.
    several = documents.join(ids.filter("_n_stay > 0").select("doc_id"), "doc_id", "left_semi").select(*documents.columns)
    if not kept.filter("doc_id IS NULL").isEmpty():
        several = several.unionByName(documents.filter("doc_id IS NULL"))
    name = fresh(documents, "fp")
    stays = kept.select(F.col("doc_id").alias("_kept_id"), F.col("fp").alias("_kept_fp"))
    remarked = mark(several, name)
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    found = (
        remarked.withColumns({"_row": row, "_tie": F.sha2(F.to_json(row), 256)})
        .select("_row", "_tie", F.col("doc_id").alias("_of_id"), F.col(name).alias("_of_fp"))
        .join(stays, F.col("_of_id").eqNullSafe(F.col("_kept_id")) & (F.col("_of_fp") == F.col("_kept_fp")))
        .groupBy("_of_id", "_of_fp")
        .agg(F.min_by("_row", "_tie").alias("_row"))
    )
    return single.unionByName(found.select("_row.*"))
