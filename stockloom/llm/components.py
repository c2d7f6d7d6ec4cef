"""Connected components by randomised contraction, with joins and aggregates only.

In each round every node takes a pseudo-random rank and moves to the neighbour (or itself) of the lowest
rank. Edges are renamed by these moves, loops and repeats go, and the graph that is left has the same
components with, in expectation, at most a constant fraction of the nodes; so the number of rounds grows
with the logarithm of the largest component. Ranks are drawn anew in every other round: in the second round
with the same ranks, a star whose centre has moved to its lowest leaf moves there as a whole. The moves of
all rounds are composed at the end. A hot node is a key of minimum aggregates, which combine before the shuffle, and of
inner joins, which adaptive execution splits; no neighbourhood is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.operators.scans import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` for each node of an edge with two different ends.

    ``edges`` has ``a`` and ``b`` of one type; null ends and loops are ignored. The component is named by
    one of its nodes, the same for all of them. It should be a stored table, as it is read more than once.
    """
    left = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a != b").select("a", "b")
    moves: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(moves) // 2)), F.col(c))
        lowest = both.groupBy("a").agg(F.min(rank("b")).alias("r"))
        move = materialize(
            lowest.select(
                F.col("a").alias("node"),
                F.when(F.col("r") < rank("a"), F.col("r.b")).otherwise(F.col("a")).alias("target"),
            )
        )
        moves.append(move)
        renamed = (
            left.join(move.select(F.col("node").alias("a"), F.col("target").alias("ta")), "a")
            .join(move.select(F.col("node").alias("b"), F.col("target").alias("tb")), "b")
            .filter("ta != tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        )
        left = materialize(renamed.distinct())
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # From the last round back: where a node ends is where the target of its first move ends.
    ends = moves[-1].select("node", F.col("target").alias("component"))
    for move in reversed(moves[:-1]):
        later = ends.withColumnsRenamed({"node": "target", "component": "later"})
        ends = materialize(
            move.join(later, "target", "left").select("node", F.coalesce("later", "target").alias("component"))
        )
    return ends


def joined_components(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known`` (a result of :func:`connected_components`) after further links ``a``, ``b``, at the cost of these alone.

    Both should be stored tables. Nodes that only the links name are in the result as well.
    """
    ends = known.select(F.col("node"), F.col("component").alias("whole"))
    lifted = links.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
    for end in ("a", "b"):
        lifted = lifted.join(ends.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("whole", end)).drop("whole")
    later = connected_components(materialize(lifted.filter("a != b").distinct()))
    moves = later.select(F.col("node").alias("component"), F.col("component").alias("later"))
    moved = known.join(moves, "component", "left")
    new = later.join(known.select("node"), "node", "left_anti")
    return moved.select("node", F.coalesce("later", "component").alias("component")).unionByName(new.select("node", "component"))
