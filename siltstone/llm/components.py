"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.scratch import Scratch


def connected_components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b): the smallest node it reaches.

    Each round gives every node's larger neighbours to its smallest one (large star), then its
    smaller neighbours to it (small star), and writes the links, so no lineage grows; rounds grow
    with the logarithm of the nodes. A hub's links are grouped by a minimum only, never gathered.
    """
    edges = scratch.table(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        f"{label}-0",
    )
    step = 0
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        step += 1
        made = scratch.table(small, f"{label}-{step}")
        same = made.count() == edges.count() and made.join(edges, ["u", "v"], "left_anti").isEmpty()
        scratch.drop(f"{label}-{step - 1}")
        edges = made
        if same:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
