"""Connected components of a link table by contraction, without collecting any part of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import stored


def connect(links: DataFrame) -> DataFrame:
    """(id, label) for every id that occurs in links (a, b); label is the smallest id that links lead to.

    Each round points every vertex at the smallest of itself and its neighbours, follows the pointers to their ends
    and replaces both ends of the remaining links by what they point at. Tables are written between rounds, so joins
    on vertices with very many links see plain inputs, whose skewed partitions Spark can split.
    """
    left = stored(links.select("a", "b").filter("a <> b").distinct(), "links")
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to"))
        points = stored(points.select("id", F.least("id", "to").alias("to")), "points")
        points = follow(points)
        if labels is None:
            labels = points.select("id", F.col("to").alias("label"))
        else:
            moved = points.select(F.col("id").alias("label"), "to")
            labels = labels.join(moved, "label", "left").select("id", F.coalesce("to", "label").alias("label"))
        labels = stored(labels, "labels")
        for end in ("a", "b"):
            at = points.select(F.col("id").alias(end), F.col("to").alias("__to"))
            left = left.join(at, end).drop(end).withColumnRenamed("__to", end)
        left = stored(left.filter("a <> b").select("a", "b").distinct(), "links")
    if labels is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("label")).limit(0)
    return labels


def follow(points: DataFrame) -> DataFrame:
    """Each id with the end of its chain of pointers; a chain's length halves each time."""
    while True:
        step = points.select(F.col("id").alias("to"), F.col("to").alias("__next"))
        nxt = points.join(step, "to").select("id", F.col("__next").alias("to"), (F.col("__next") != F.col("to")).alias("moved"))
        nxt = stored(nxt, "points")
        points = nxt.select("id", "to")
        if nxt.filter("moved").isEmpty():
            return points
