"""Connected components of a graph in a DataFrame of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.scratch import settle


def components(links: DataFrame) -> DataFrame:
    """(k, label) of every node of ``links`` (a, b); the label is the smallest node of its component.

    In a round every node points to its smallest neighbour if that is smaller; pointers are followed to their ends, and
    links between different ends are the next round's.  A node that keeps no pointer has a neighbour that does, so at
    least half of the linked nodes go in a round.  A node's many links are only ever reduced to a minimum.  Every table
    is written to the shared folder, so a lost executor costs no more than its tasks.
    """
    live = settle(links.select("a", "b").filter("a <> b"), "links")
    nodes = live.select(F.col("a").alias("k")).union(live.select(F.col("b").alias("k"))).distinct()
    labels = settle(nodes.withColumn("label", F.col("k")), "labels")
    while not live.isEmpty():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = settle(both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("p")).withColumn("p", F.least("k", "p")), "pointers")
        while True:  # each step doubles the length of what is followed
            nearer = to.join(to.select(F.col("k").alias("p"), F.col("p").alias("q")), "p").select("k", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("_moved"))
            nearer = settle(nearer, "pointers")
            to = nearer.select("k", "p")
            if nearer.filter("_moved").isEmpty():
                break
        labels = settle(labels.join(to.select(F.col("k").alias("label"), "p"), "label", "left").select("k", F.coalesce("p", "label").alias("label")), "labels")
        live = live.join(to.select(F.col("k").alias("a"), F.col("p").alias("pa")), "a").join(to.select(F.col("k").alias("b"), F.col("p").alias("pb")), "b")
        live = settle(live.filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
    return labels
