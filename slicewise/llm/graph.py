"""Connected components of a table of links.

Defined cases: a link to itself makes a node of its own; repeated links count once; a link with a null end joins nothing, null is then a node
without label; no links give no nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def flat(hooks: DataFrame) -> DataFrame:
    """hooks(node, to), where to is less than node, with each node's to followed to its end; chains halve with each jump."""
    while True:
        far = hooks.select(F.col("node").alias("via"), F.col("to").alias("far"))
        jumped = stored(hooks.join(far, F.col("to") == F.col("via"), "left").select("node", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")))
        if not jumped.where("moved").limit(1).count():
            return hooks
        hooks = jumped.drop("moved")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links(a, b): label is the smallest node that can be reached.

    Each round hooks every label to the least one that it is linked to, follows the hooks to their ends and contracts the links
    to pairs of these, until no link joins two labels. A label that is still there after two rounds has taken in one that was
    hooked in the first, so two rounds at least halve the labels of a component, whatever its diameter. All of it is joins and
    grouped minima; a node with very many links is summed up on the way. Only whether rows are left is read.
    """
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    edges = stored(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels = None
    while edges.limit(1).count():
        least = edges.groupBy("a").agg(F.min("b").alias("to"))
        hooks = flat(stored(least.withColumnRenamed("a", "node")))
        # a link to the least neighbour joins nothing more
        rest = edges.join(least.withColumnRenamed("a", "node"), F.col("a") == F.col("node")).where(F.col("b") != F.col("to")).select("a", "b")
        one, two = (hooks.select(F.col("node").alias(f"{x}_node"), F.col("to").alias(f"{x}_to")) for x in ("a", "b"))
        rest = rest.join(one, F.col("a") == F.col("a_node")).join(two, F.col("b") == F.col("b_node"), "left").select(F.col("a_to").alias("a"), F.coalesce("b_to", "b").alias("b"))
        edges = stored(rest.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        hooks = hooks.select("node", F.col("to").alias("label"))
        if labels is None:
            labels = hooks
        else:
            to = hooks.select(F.col("node").alias("via"), F.col("label").alias("far"))
            labels = stored(labels.join(to, F.col("label") == F.col("via"), "left").select("node", F.coalesce("far", "label").alias("label")).union(hooks))
    if labels is None:
        return nodes.select("node", F.col("node").alias("label"))
    return stored(nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label")))
