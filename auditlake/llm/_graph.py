"""Connected components of a graph that no machine holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm._tables import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """v, component (its smallest vertex) of every vertex of `links` (u, v).

    Each round a vertex takes the smallest label among its neighbours, then its label's label, so that paths
    halve and the rounds grow as the logarithm of the longest path. Labels are minima, summed up before the
    shuffle: a vertex with any number of neighbours costs one row a task. Tables of a round are files, and
    those of the round before are deleted.
    """
    edges = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v")
    edges = scratch.keep(edges)
    labels = scratch.keep(edges.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("component")))
    while True:
        seen = edges.join(labels.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("component").alias("near"))
        near = scratch.keep(labels.join(seen, "v").select("v", "component", F.least("near", "component").alias("near")))
        of = near.select(F.col("v").alias("_v"), F.col("near").alias("_far"))
        after = scratch.keep(near.join(of, near["near"] == of["_v"], "left").select("v", F.least(F.coalesce("_far", "near"), "near").alias("component"), F.col("component").alias("was")))
        scratch.drop(near, labels)
        labels = after
        if after.filter("component <> was").isEmpty():
            return after.select("v", "component")
