"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node in ``links`` (columns ``a`` and ``b``); the label is the smallest node of its component.

    Contraction: every node takes the smallest of itself and its neighbours, follows that
    node's own choice twice, and the links are rewritten in the new names; links within one
    name vanish. The rounds grow with the logarithm of the longest path, each works on fewer
    links, and each writes its tables to the shared folder. Nothing but a count reaches the driver.
    """
    links = staged(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("c"))
        for _ in range(2):
            low = low.join(low.select(F.col("a").alias("c"), F.col("c").alias("d")), "c").select("a", F.col("d").alias("c"))
        low = staged(low, "labels")
        if labels is None:
            labels = low.select(F.col("a").alias("node"), F.col("c").alias("label"))
        else:
            labels = labels.join(low, labels["label"] == low["a"], "left").select("node", F.coalesce("c", "label").alias("label"))
        one = links.join(low, "a").select(F.col("c").alias("a"), "b")
        two = one.join(low.withColumnRenamed("a", "b"), "b").select("a", F.col("c").alias("b"))
        links = staged(two.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        if links.isEmpty():
            return labels
        labels = staged(labels, "labels")
