"""Connected components of a graph of links, by contraction, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(scratch: Scratch, links: DataFrame, name: str = "cc") -> DataFrame:
    """node, label for every node of links (a, b); label is one node of its component.

    Each round every node takes its least neighbour or itself, four times in a row, and the links are rewritten with
    what their ends took; links within one node go. Components of any shape shrink to one node in
    a number of rounds that grows with the logarithm of their size in all but contrived cases.
    """
    edges = scratch.write(f"{name}/e", links.select("a", "b").filter("a <> b").distinct())
    labels, i = None, 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("p"))
        for _ in range(2):  # to the fourth step up
            up = up.join(up.select(F.col("u").alias("p"), F.col("p").alias("pp")), "p").select("u", F.col("pp").alias("p"))
        up = scratch.write(f"{name}/p{i}", up)
        if labels is None:
            labels = up.select(F.col("u").alias("node"), F.col("p").alias("label"))
        else:
            labels = labels.join(up, labels["label"] == up["u"], "left").select("node", F.coalesce("p", "label").alias("label"))
        labels = scratch.write(f"{name}/l{i}", labels)
        to_a, to_b = up.select(F.col("u").alias("a"), F.col("p").alias("pa")), up.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        edges = edges.join(to_a, "a").join(to_b, "b").filter("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
        edges = scratch.write(f"{name}/e{i}", edges)
        i += 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
