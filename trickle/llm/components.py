"""Connected components by contraction.

Every round each node takes the neighbour (or itself) that comes first in a
fixed random order, and edges are rewritten to the taken nodes; nodes shrink
by a constant factor a round. The rounds' mappings are then composed from the
last to the first. All steps are joins and aggregations of plain columns over
tables written in the shared folder, so no component is gathered anywhere and
a hot node is pre-aggregated or split by the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trickle.llm.common import stage


def _order(node: Column) -> Column:
    return F.struct(F.xxhash64(node).alias("h"), node.alias("n"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u long, v long) -> (node, root), one row per node that has
    an edge to another; root is the same for all nodes of a component."""
    e = stage(edges.where("u <> v").select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while e.take(1):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        taken = F.least(F.min(_order(F.col("v"))), _order(F.col("u"))).n
        reps = stage(both.groupBy("u").agg(taken.alias("rep")), "contraction")
        rounds.append(reps)
        left = reps.select(F.col("u"), F.col("rep").alias("a"))
        right = reps.select(F.col("u").alias("v"), F.col("rep").alias("b"))
        e = stage(
            e.join(left, "u").join(right, "v").where("a <> b")
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(),
            "edges",
        )
    if not rounds:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
    labels = rounds[-1].select(F.col("u").alias("node"), F.col("rep").alias("root"))
    for reps in reversed(rounds[:-1]):
        nxt = labels.select(F.col("node").alias("rep"), F.col("root"))
        labels = stage(
            reps.join(nxt, "rep", "left").select(
                F.col("u").alias("node"), F.coalesce("root", "rep").alias("root")
            ),
            "labels",
        )
    return labels
