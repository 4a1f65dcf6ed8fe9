"""Connected components of an edge table, by contraction.

In every round each node is tied to the neighbour, or itself, that comes first by a hash that is new in each round.
Edges are renamed by these ties; what becomes a self-loop goes, and so does what has become equal. A star is done in
one round, and a path loses a good part of its nodes in each, so that rounds grow with the logarithm of the longest
path. The ties, composed in their order, name a node of each node's component; a grouped minimum makes it the least.

Every step is a grouped minimum or an equality join; the state between steps is a table in the shared folder, so a
lost executor costs one step at most. Minima are combined before the shuffle. The joins that rename edges have a plain
exchange on either side, so a node with very many edges is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellprobe.llm.io import cut

#: Ties of so many rounds are composed in one plan.
_COMPOSED = 4


def _ties(edges: DataFrame, turn: int) -> DataFrame:
    """(node, tie): each node's first of itself and its neighbours, in this round's order."""
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).unionAll(edges.select("v", "u"))
    order = lambda c: F.xxhash64(F.lit(turn), c)
    first = both.groupBy("node").agg(F.min_by("other", order("other")).alias("other"))
    return first.select("node", F.when(order("other") < order("node"), F.col("other")).otherwise(F.col("node")).alias("tie"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node that can be reached.

    Self-loops, repeated edges and edges with a null end change nothing; an empty table gives no rows. No round
    makes more edges than it read.
    """
    left = cut(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct())
    label, rounds = None, []

    def composed(label: DataFrame | None, rounds: list[DataFrame]) -> DataFrame:
        for tie in rounds:
            if label is None:
                label = tie.select("node", F.col("tie").alias("label"))
            else:
                label = label.join(tie.select(F.col("node").alias("label"), "tie"), "label", "left").select("node", F.coalesce("tie", "label").alias("label"))
        return label

    turn = 0
    while turn == 0 or not left.isEmpty():
        tie = cut(_ties(left, turn))
        rounds.append(tie)
        if len(rounds) == _COMPOSED:
            label, rounds = cut(composed(label, rounds)), []
        of = lambda side, name: tie.select(F.col("node").alias(side), F.col("tie").alias(name))
        moved = left.join(of("u", "x"), "u").join(of("v", "y"), "v")
        left = cut(moved.where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
        turn += 1
    label = cut(composed(label, rounds))
    least = label.groupBy("label").agg(F.min("node").alias("component"))
    return label.join(least, "label").select("node", "component")
