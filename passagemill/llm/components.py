"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.session import cut_lineage


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Links to the smallest neighbour: for all larger neighbours of each node, or from the node and its smaller ones."""
    if both_ways:
        edges = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        near = edges.select(F.col("hi").alias("node"), F.col("lo").alias("next"))
    else:
        near = edges.select(F.col("hi").alias("node"), F.col("lo").alias("next"))
    least = near.groupBy("node").agg(F.least(F.min("next"), F.first("node")).alias("least"))
    met = near.join(least, "node")
    if both_ways:
        out = met.filter("next > node").select(F.col("next").alias("hi"), F.col("least").alias("lo"))
    else:
        out = met.select(F.col("next").alias("hi"), F.col("least").alias("lo")).unionByName(
            least.select(F.col("node").alias("hi"), F.col("least").alias("lo"))
        )
    return out.filter("hi <> lo").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node of ``links`` with columns ``a, b``.

    Alternating large and small stars: each round replaces links by links to smaller nodes, using one
    minimum per node, until every node points at its component. The number of rounds grows with the
    logarithm of the links; each round's links are written to the shared folder, none come to the driver.
    """
    edges = cut_lineage(
        links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    before = None
    while True:
        edges = cut_lineage(_star(_star(edges, True), False))
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(row) == before:
            break
        before = tuple(row)
    nodes = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return nodes.unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
