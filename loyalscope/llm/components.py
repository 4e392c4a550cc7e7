"""Connected components of a link table, in Spark: labels and links stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loyalscope.llm.common import stored


def connected_components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``node``, ``label`` for every node of ``links`` (``a``, ``b``) and of ``labels``: the smallest node reachable.

    ``labels`` (``node``, ``label``) continues from earlier components: its nodes keep together. Each round
    hooks every label to the smallest label next to it and replaces labels by the roots of their hooks;
    links inside a component drop out, so a round's work shrinks. A hub with many links is one row per link, and the
    minimum is combined before the shuffle. Rounds grow with the
    logarithm of a chain's length.
    """
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().select("node", F.col("node").alias("label"))
    if labels is not None:
        nodes = labels.unionByName(nodes.join(labels, "node", "left_anti"))
    nodes = stored(nodes, "labels")
    rest = links.select("a", "b")
    while True:
        of_a = nodes.select(F.col("node").alias("a"), F.col("label").alias("la"))
        of_b = nodes.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        across = stored(rest.join(of_a, "a").join(of_b, "b").where("la <> lb")
                        .select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "across")
        if across.isEmpty():
            return nodes
        # every label hooks to its smallest neighbour if that is smaller; hooks of hooks lead to a root
        hooks = stored(across.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("y")), "hooks")
        while True:
            further = hooks.select(F.col("x").alias("y"), F.col("y").alias("z"))
            if hooks.join(further, "y", "left_semi").isEmpty():
                break
            hooks = stored(hooks.join(further, "y", "left").select("x", F.coalesce("z", "y").alias("y")), "hooks")
        nodes = stored(nodes.join(hooks, nodes["label"] == hooks["x"], "left")
                       .select("node", F.coalesce("y", "label").alias("label")), "labels")
        rest = across      # links between labels now; a label is also a node, with its own new label
