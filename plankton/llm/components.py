"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links: a, b (long).  Returns node, component (the smallest node reachable); only nodes that have a link.

    Union by least label: each round every node takes the least label among
    itself and its neighbours, and then its label's label, until nothing
    changes.  Labels only fall and stay inside the component, so the fixed point
    is exact; following labels halves the way that is left in each round.  Both
    joins are on a node; a node with very many links is split by Spark's skew
    join, and the minimum is taken before the shuffle as well.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).where("u <> v").distinct()
    both = scratch.keep(both, "links")
    labels = scratch.keep(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        low = labels.join(near, "u").select("u", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("u").alias("low"), F.col("label").alias("far"))
        new = scratch.keep(low.join(up, "low").select("u", F.least("low", "far").alias("new"), "label"), "labels")
        changed = new.where("new <> label").limit(1).count()
        scratch.drop(labels)
        labels = new.select("u", F.col("new").alias("label"))
        labels.scratch_path = new.scratch_path
        if not changed:
            scratch.drop(both)
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
